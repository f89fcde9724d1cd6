import math
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from gaugeworks.llm import lattice_sampling as G
from gaugeworks.llm.queries import QUERIES


@pytest.fixture(scope="module")
def lat():
    return G.Lattices(G.piece_bpe())


def all_paths(lat, text):
    """Every segmentation of a text with its probability, by plain recursion."""
    out = []

    def go(state, ids, logp, later):
        if state < 0:
            if not later:
                out.append((tuple(ids), logp))
                return
            go(later[0], ids, logp, later[1:])
            return
        for e in range(lat.first[state], lat.first[state + 1]):
            go(int(lat.next[e]), [*ids, int(lat.piece[e])], logp + lat.logp[e], later)

    go(-1, [], 0.0, lat.build(lat.split(text)).tolist())
    return dict(out)


def test_path_probabilities(lat):
    paths = all_paths(lat, "able to")
    assert abs(sum(map(math.exp, paths.values())) - 1) < 1e-9
    weight = {i: w for i, w in lat.weight.values()}
    scores = {ids: sum(weight[i] for i in ids) for ids in paths}
    total = math.log(sum(map(math.exp, scores.values())))
    assert all(abs(paths[ids] - (s - total)) < 1e-9 for ids, s in scores.items())
    assert {lat.model.decode(list(ids)) for ids in paths} == {"able to"}


def test_samples_follow_the_distribution_without_replacement(lat):
    text, n = "abc", 20_000
    paths = all_paths(lat, text)
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    found = G.sample_texts(lat, [lat.split(text)] * n, seeds, 3)
    first, second = Counter(), Counter()
    for rows in found:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) == min(3, len(paths))
        assert all(a[2] >= b[2] for a, b in pairwise(rows))
        assert all(abs(paths[i] - r[1]) < 1e-9 for i, r in zip(ids, rows))
        first[ids[0]] += 1
        second[ids[0], ids[1]] += 1
    for ids, logp in paths.items():
        p = math.exp(logp)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for other, q in paths.items():
            if other != ids:
                want = p * math.exp(q) / (1 - p)  # drawn next from what is left
                assert abs(second[ids, other] / n - want) < 5 * math.sqrt(want / n) + 1e-3


def test_inclusion_scores_are_unbiased(lat):
    """Sums weighted by probability over inclusion estimate sums over all segmentations."""
    text, n = "able", 4000
    paths = all_paths(lat, text)
    want = sum(math.exp(p) * len(ids) for ids, p in paths.items())
    seeds = np.arange(n, dtype=np.uint64) * np.uint64(104729)
    got = [sum(math.exp(lp) / inc * len(ids) for ids, lp, _, inc in rows) for rows in G.sample_texts(lat, [lat.split(text)] * n, seeds, 3)]
    assert abs(np.mean(got) - want) < 5 * np.std(got) / math.sqrt(n)


TEXTS = [None, "", " ", "a", "a  b\nc", "ü漢字😀", "word " * 400, "x" * 3000, "tab\there\r\n", " lead and trail ", "a▁b"]


def test_rows(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, "a", 2, "y"), (None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample int, ids string")
    once = G.sample_segmentations(docs, G.piece_bpe(), samples=4)
    got = sorted(map(str, once.collect()))
    again = G.sample_segmentations(docs.repartition(5), G.piece_bpe(), samples=4)
    assert sorted(map(str, again.collect())) == got
    frame = once.toPandas()
    assert frame["decoded"].all()
    assert (frame[frame.doc_id.isin([0, 1])].n_pieces == 0).all()
    assert ((frame.inclusion > 0) & (frame.inclusion <= 1)).all()
    back = G.decode(once.drop("text"), G.piece_bpe()).filter("doc_id = 5").select("text").distinct().collect()
    assert [r["text"] for r in back] == [TEXTS[5]]
    assert G.sample_segmentations(docs.limit(0), G.piece_bpe()).collect() == []


def test_every_segmentation_is_found_once(lat):
    """The search opens sets of all kinds until nothing is left."""
    for text in ("abc", "able", "to be"):
        paths = all_paths(lat, text)
        seeds = np.arange(40, dtype=np.uint64) * np.uint64(15485863)
        for rows in G.sample_texts(lat, [lat.split(text)] * 40, seeds, len(paths) + 5):
            ids = [tuple(r[0].tolist()) for r in rows]
            assert len(ids) == len(paths) and set(ids) == set(paths)
            assert all(abs(paths[i] - r[1]) < 1e-9 and r[3] == 1 for i, r in zip(ids, rows))


def test_the_query_searches_over_several_rounds(spark, tmp_path):
    """Four samples a text, so that sets are opened, kept and opened again."""
    docs = [(i, f"several words to segment number {i}", "en", "x", 1) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op9_lattice_sampling"](spark, str(tmp_path)).toPandas()
    assert sorted(got["sample"].value_counts().items()) == [(k, 20) for k in (1, 2, 3, 4)]
    assert got["decoded"].all() and (got.groupby("doc_id")["ids_crc32"].nunique() == 4).all()


def test_words_are_built_once_over_several_lots(monkeypatch):
    """Lattices at hand serve later texts; forgetting them changes no sample."""
    lots = [["able to segment", "more words to segment"], ["able to segment words", "ü漢字 to"], ["able to segment", "ü漢字 to more"]]
    seeds = np.arange(2, dtype=np.uint64) + np.uint64(77)

    def run(lat):
        found = [G.sample_texts(lat, [lat.split(t) for t in texts], seeds, 4) for texts in lots]
        return [[(ids.tolist(), *rest) for ids, *rest in own] for lot in found for own in lot]

    lat, made = G.Lattices(G.piece_bpe()), []
    edges = lat._edges
    monkeypatch.setattr(lat, "_edges", lambda ends, text: made.append(text) or edges(ends, text))
    kept = run(lat)
    words = {w for texts in lots for t in texts for w in lat.split(t)}
    assert sum(map(len, made)) == sum(map(len, words))
    monkeypatch.setattr(G, "BUILT_AT_ONCE", 2)
    assert run(G.Lattices(G.piece_bpe())) == kept
    monkeypatch.setattr(G, "KEPT_EDGES", 1)
    assert run(G.Lattices(G.piece_bpe())) == kept


def test_texts_are_read_and_decoded_as_one_by_one(lat):
    for texts in ([*TEXTS, "\n\nx\n", "▁", "  "], ["a\0b c", *TEXTS]):
        sizes, root = lat.read(texts)
        assert sizes.tolist() == [len(lat.split(t)) for t in texts]
        assert root.tolist() == lat.build([w for t in texts for w in lat.split(t)]).tolist()
        found = G.sample_words(lat, sizes, root, np.arange(len(texts), dtype=np.uint64), 3)
        samples = [s[0] for own in found for s in own]
        for change in ("", "!"):
            wanted = [(t or "").replace("▁", " ") + change for t, own in zip(texts, found) for _ in own]
            assert lat.decodes(samples, wanted) == [lat.model.decode(s.tolist()) == w for s, w in zip(samples, wanted)] == [not change] * len(wanted)
    assert lat.decodes([], []) == []
