"""Best-two-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gaugeworks.llm.common import exact_id, plain_id, saved, ship
from gaugeworks.llm.tokens import encoder

SIZE = 4096
END = 1
#: Pieces that one task packs: enough that a task's one part-filled sequence is no loss, and few in memory.
PIECES_PER_TASK = 100_000
PIECE = "doc_id decimal(20,0), piece int, start long, length long, ids_crc32 long"


def piece_lengths(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Each text's ids and the end id, cut after every ``size`` ids only where there are more.

    ``with_ids`` adds the ids themselves (array of int). A null text counts as empty: its piece is the end id.
    """
    ship(docs.sparkSession)
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        tail = np.array([end], enc.dtype).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.frombuffer(enc.encode(text) + tail, enc.dtype)
                for piece, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size].astype("<u4")
                    row = (doc_id, piece, start, len(own), zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype("i4")) if with_ids else row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return plain_id(docs.select(exact_id(), "text").mapInPandas(cut, schema))


class _Lengths:
    """How many pieces of each length are left, and the largest length left up to any limit."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.left = np.bincount(lengths, minlength=size + 1)
        self.below = np.zeros(size + 1, np.int64)
        self.refresh(1)

    def refresh(self, start: int) -> None:
        tail = np.where(self.left[start:] > 0, np.arange(start, len(self.left)), 0)
        if len(tail):
            tail[0] = max(tail[0], self.below[start - 1])
        self.below[start:] = np.maximum.accumulate(tail)

    def take(self, length: int) -> None:
        self.left[length] -= 1
        if not self.left[length]:
            self.refresh(length)

    def put_back(self, length: int) -> None:
        self.left[length] += 1
        if self.left[length] == 1:
            self.refresh(length)

    def best_two(self, room: int) -> tuple[int, int]:
        """The two left lengths with the largest sum up to ``room`` (zeros if there are none)."""
        first = np.flatnonzero(self.left[: room // 2 + 1])
        if not len(first):
            return 0, 0
        second = self.below[room - first]
        alone = (second == first) & (self.left[first] < 2)
        second = np.where(alone, self.below[first - 1], second)
        total = np.where(second > 0, first + second, 0)
        at = int(np.argmax(total))
        return (int(first[at]), int(second[at])) if total[at] else (0, 0)


def fill_sequences(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Lengths of the pieces in each sequence.

    A sequence is filled greedily with the longest piece that still fits. If a gap is left, its smallest
    piece gives way to two others where those fill the widened gap further; this is repeated until it
    gains nothing. The largest pieces left open the sequences.
    """
    store = _Lengths(lengths, size)
    out = []
    while largest := int(store.below[size]):
        held, room = [], size
        while (fit := int(store.below[room])) > 0:
            store.take(fit)
            held.append(fit)
            room -= fit
            if not room:
                break
        while room and len(held) > 1:
            smallest = min(held)
            a, b = store.best_two(room + smallest)
            if a + b <= smallest:
                break
            held.remove(smallest)
            store.put_back(smallest)
            store.take(a)
            store.take(b)
            held += [a, b]
            room += smallest - a - b
        assert held and held[0] <= largest
        out.append(held)
    return out


def pack(pieces: DataFrame, size: int = SIZE, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``.

    Pieces are dealt evenly over tasks whatever their ids or copies, and each task packs its own; the
    pieces are kept in the shared folder first, so a repeated task deals them alike. Full pieces are a
    sequence each. An empty table gives an empty one.
    """
    pieces = saved(pieces, "pieces")
    n = max(1, -(-pieces.count() // per_task))
    pieces = pieces.withColumn("doc_id", exact_id())
    schema = StructType(list(pieces.schema)).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        frame = pd.concat(held, ignore_index=True)
        lengths = frame["length"].to_numpy()
        waiting: dict[int, list[int]] = {}
        for row, length in enumerate(lengths.tolist()):
            waiting.setdefault(length, []).append(row)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        base = TaskContext.get().partitionId() << 32
        for number, members in enumerate(fill_sequences(lengths, size)):
            at = 0
            for length in members:
                row = waiting[length].pop()
                sequence[row], offset[row] = base + number, at
                at += length
        yield frame.assign(sequence_id=sequence, offset=offset)

    return plain_id(pieces.repartition(n).mapInPandas(place, schema))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Whole documents (doc_id, text) as few sequences of at most ``size`` tokens; a row for each piece.

    Null ids stay null, null texts are empty, repeated rows are packed as often as they occur, and other
    columns are left aside.
    """
    return pack(piece_lengths(docs, tokenizer, size, with_ids=with_ids), size)
