import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeworks.llm import packing, token_records
from gaugeworks.llm.tokens import TextEncoder, encoder, word_bpe

HARD = [
    None, "", " ", "Don't STOP'S 'tis", "a b c d", "naïve ÀÉÎ ß ÿ × ÷ µ", "x<|endoftext|>y <|startoftext|>", "漢字 é İI ΟΔΟΣ.",
    "tab\tline\r\nnext\x0bv\x0cf\x1cz", "1234 ½ ٣ 5.5%", "word" * 5000, "!!! ### $$$ |", "\x00\x07 bell", "😀👍🏽",
]


def whole(text):
    return encoder(word_bpe()).whole.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_ids_are_those_of_the_whole_text(text):
    enc = TextEncoder(word_bpe())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="latin-1"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    enc = encoder(word_bpe())
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(text)


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length long")


def rows_of(extra=()):
    return [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(3, HARD[3], "x", 1), (None, "no id", "x", 1), *extra]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records_come_back(spark):
    rows = rows_of()
    folder = token_records.fresh_folder(spark)
    docs = frame_of(spark, rows).repartition(5)
    manifest = token_records.write_records(docs, folder, word_bpe(), files=4)
    got = sorted(map(tuple, token_records.read_records(spark, folder, manifest, with_ids=False).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole(text), 2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    ids = token_records.read_records(spark, folder, manifest).filter("doc_id = 3").first()["ids"]
    assert ids == [*whole(HARD[3]), 2]


def test_damage_is_seen():
    import io

    record = bytearray(token_records.frame(b"some body"))
    assert token_records.unframe(io.BytesIO(bytes(record))) == b"some body"
    for at in (1, 9, 14, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 4
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            token_records.unframe(io.BytesIO(bytes(bad)))


def test_empty_tables(spark):
    docs = frame_of(spark, [])
    folder = token_records.fresh_folder(spark)
    manifest = token_records.write_records(docs, folder, word_bpe())
    assert token_records.read_records(spark, folder, manifest).collect() == []
    assert packing.pack_documents(docs, word_bpe()).collect() == []


def test_packing_holds_every_piece_once(spark):
    rows = rows_of([(100 + i, "lorem ipsum dolor " * (37 * i % 1500), "x", 1) for i in range(200)])
    out = packing.pack_documents(frame_of(spark, rows).repartition(3), word_bpe()).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = [*whole(text), 1]
        want += [(doc_id, k, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    total = sum(filled.values())
    assert max(filled.values()) <= 4096
    assert len(filled) <= -(-total // 4096) + 2


def test_two_replace_the_smallest():
    # greedy fills 60 + 30 and leaves 10; the 30 gives way to 25 + 15
    filled = packing.fill_sequences(np.array([60, 30, 25, 15]), 100)
    assert sorted(filled[0]) == [15, 25, 60]
    assert sorted(sum(filled, [])) == [15, 25, 30, 60]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_fill_uses_each_length_once(lengths):
    filled = packing.fill_sequences(np.array(lengths, int), 50)
    assert sorted(sum(filled, [])) == sorted(lengths)
    assert all(sum(x) <= 50 for x in filled)
