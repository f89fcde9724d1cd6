"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. Three letters in a row are
bound into one vector: the letters' vectors, rotated by their place, multiplied element by element. A text's
profile bundles (adds) those of all its trigrams, a language's prototype those of all texts it is learned from;
the prototype with the largest cosine names the language. Anything that is not a letter counts as one blank.

Profiles are sums of whole numbers, so neither the order of rows nor their partition changes a result. The
model is one vector of ``SIZE`` numbers for each language learned, which is what goes through the driver.

A null text, or one without any letter, is ``und`` with score 0; so is every text if nothing was learned. A null
lang teaches nothing, an id of null neither teaches nor is held out. Repeated rows are kept, and teach as often as
they stand. Ties go to the language that sorts first. Extra columns are not read. Texts of any length are read
whole, in pieces that overlap by two letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import ship

#: Elements of a vector.
SIZE = 1024
SEED = 20_240_101
UNKNOWN = "und"
#: One document of ``FOLDS`` is held out of learning.
FOLDS = 5
#: Code points handled at once; a longer text is read in pieces.
PIECE = 1 << 18
#: Texts whose trigrams are bound together; bounds memory, not results.
TOGETHER = 64
#: Bound trigrams that a worker keeps; beyond it the table starts afresh.
KEPT = 40_000
_BLANK = 32


class Profiles:
    """Trigram vectors and the profiles made of them."""

    def __init__(self, size: int = SIZE, seed: int = SEED):
        self.size, self.seed = size, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.empty(0, np.int64)
        self.bound = np.empty((0, size), np.int8)
        self.is_letter = np.zeros(0x110000, bool)
        self.seen = np.zeros(0x110000, bool)

    def _letter(self, point: int) -> np.ndarray:
        found = self.letters.get(point)
        if found is None:
            bits = np.random.default_rng([self.seed, point]).integers(0, 2, self.size, np.int8)
            found = self.letters[point] = 2 * bits - 1
        return found

    def _is_letter(self, points: np.ndarray) -> np.ndarray:
        new = np.unique(points[~self.seen[points]])
        self.is_letter[new] = [chr(p).isalpha() for p in new.tolist()]
        self.seen[new] = True
        return self.is_letter[points]

    def trigrams(self, text: str) -> Iterator[np.ndarray]:
        """Codes of the trigrams of a text, one array for each piece; none if it has no letter."""
        left = np.array([_BLANK], np.int64)
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass")
            points = np.frombuffer(piece, "<u4").astype(np.int64)
            letter = self._is_letter(points)
            points[~letter] = _BLANK
            points = np.concatenate([left, points])
            if at + PIECE >= len(text):
                points = np.append(points, _BLANK)
            blank = points == _BLANK
            points = points[~(blank & np.concatenate([[False], blank[:-1]]))]
            if len(points) > 2:
                yield (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
            left = points[-2:]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of sorted, distinct trigram codes."""
        known = np.isin(codes, self.codes, assume_unique=True)
        if not known.all():
            if len(self.codes) > KEPT:
                self.codes, self.bound = np.empty(0, np.int64), np.empty((0, self.size), np.int8)
                known[:] = False
            new = codes[~known]
            fresh = np.empty((len(new), self.size), np.int8)
            for i, code in enumerate(new.tolist()):
                a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
                fresh[i] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            both = np.concatenate([self.codes, new])
            order = np.argsort(both)
            self.codes, self.bound = both[order], np.concatenate([self.bound, fresh])[order]
        return self.bound[np.searchsorted(self.codes, codes)]

    def bundle(self, codes: np.ndarray, counts: np.ndarray, texts: int = 1, of: np.ndarray | None = None) -> np.ndarray:
        """Profiles of texts: of each, the sum of its trigrams' vectors times their counts.

        ``of`` is the text of each code. Whole numbers below 2**53 are exact in a double, and below 2**24 in a float.
        """
        distinct, place = np.unique(codes, return_inverse=True)
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        out = np.zeros((texts, self.size), np.float64)
        for at in range(0, len(distinct), 4096):
            here = (place >= at) & (place < at + 4096)
            table = np.zeros((texts, min(4096, len(distinct) - at)), kind)
            np.add.at(table, (0 if of is None else of[here], place[here] - at), counts[here])
            out += table @ self.vectors(distinct[at : at + 4096]).astype(kind)
        return out

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text; zeros where it has no letter."""
        codes, counts, of = [], [], []
        for i, text in enumerate(texts):
            for piece in self.trigrams(text or ""):
                code, count = np.unique(piece, return_counts=True)
                codes.append(code)
                counts.append(count)
                of.append(np.full(len(code), i))
        if not codes:
            return np.zeros((len(texts), self.size))
        return self.bundle(np.concatenate(codes), np.concatenate(counts), len(texts), np.concatenate(of))


def _teach(size: int):
    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(size)
        total: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def settle():
            for lang, codes in held.items():
                code, count = np.unique(np.concatenate(codes), return_counts=True)
                total[lang] = total.get(lang, 0) + made.bundle(code, count)[0]
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for codes in made.trigrams(text.as_py()):
                    held.setdefault(lang, []).append(codes)
                    waiting += len(codes)
                if waiting > 1 << 22:
                    settle()
                    waiting = 0
        settle()
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size), pa.array(np.arange(size, dtype=np.int32)), pa.array(vector.astype(np.int64))], ["lang", "at", "value"]
            )

    return bundles


def learn(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Prototype of each ``lang`` (not null) of documents; languages without any letter are left out."""
    ship(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = known.mapInArrow(_teach(size), "lang string, at int, value long")
    summed = parts.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    whole = summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda e: e["value"]).alias("v"))
    rows = whole.orderBy("lang").collect()
    return {r["lang"]: np.array(r["v"], np.float64) for r in rows if any(r["v"])}


def _name(model: dict[str, np.ndarray], size: int):
    languages = sorted(model)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Profiles(size)
        unit = np.array([model[lang] / np.linalg.norm(model[lang]) for lang in languages]).reshape(len(languages), size)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            best, score = [], []
            for at in range(0, len(texts), TOGETHER):
                profile = made.profiles(texts.slice(at, TOGETHER).to_pylist())
                norm = np.linalg.norm(profile, axis=1)
                found = (norm > 0) & bool(languages)
                cosine = (profile @ unit.T) / np.where(norm > 0, norm, 1)[:, None] if languages else np.zeros((len(profile), 1))
                top = cosine.argmax(axis=1)
                best += [languages[t] if f else UNKNOWN for t, f in zip(top, found)]
                score += [min(max(float(c[t]), 0.0), 1.0) if f else 0.0 for c, t, f in zip(cosine, top, found)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return name


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str | Column] = ("doc_id",), size: int = SIZE) -> DataFrame:
    """``lang_pred`` and ``score`` (cosine with that language, 0 to 1) of each row's text, beside the columns ``keep``."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, "text")
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_name(model, size), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's id falls into the fold that is not learned from; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def languages(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document, learned from those not held out."""
    model = learn(docs.filter(~held_out()), size)
    return identify(docs, model, ["doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out")], size)
