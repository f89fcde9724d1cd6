"""What several operators share: intermediate tables, words, hashes and grouped streams of rows."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gaugeworks
from gaugeworks.session import fresh_path

#: Separators between words, as a character class of regular expressions: space and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"

_made: list[list[str]] = [[]]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(gaugeworks.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "gaugeworks.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again, so a lost executor repeats nothing before it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    remember(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def own_tables() -> Iterator[list[str]]:
    """Gather the paths of the intermediate tables made inside; nobody else's are among them."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove these tables; only for callers that have stored all that is made of them."""
    while paths:
        remove_folder(spark, paths.pop())


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remember(path: str) -> None:
    """Count a folder among the intermediate tables."""
    _made[-1].append(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(col: str | Column) -> list[Column]:
    """128 bits that stand for a text (a null text has bits of its own)."""
    return [F.xxhash64(col).alias("t1"), F.xxhash64(F.lit("second"), col).alias("t2")]


def exact_id(name: str = "doc_id") -> Column:
    """An id as a decimal, which pandas holds exactly beside nulls; ``plain_id`` turns it back."""
    return F.col(name).cast("decimal(20,0)").alias(name)


def plain_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def let(value: Column, body) -> Column:
    """Compute ``value`` once in a row and use it in ``body`` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split separates at exactly the bytes of SPACE."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, alike on every machine."""
    if not words:
        return np.empty(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(distinct.astype(object), categorize=False)[codes]


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalizer of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values: a polynomial modulo 2**64 by prefix sums."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = int(_BASE)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(len(hashes), base), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * _powers(n, pow(base, -1, 1 << 64)))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups of a stream sorted by ``keys``, with a column ``group`` numbering them."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(frame) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield _numbered(frame.iloc[:cut].reset_index(drop=True), keys)
        held, count = [frame.iloc[cut:]], len(frame) - cut
    if held:
        frame = pd.concat(held, ignore_index=True)
        if len(frame):
            yield _numbered(frame, keys)


def _numbered(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    change = np.zeros(len(frame), bool)
    for key in keys:
        values = frame[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return frame.assign(group=np.cumsum(change))


def joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number that each of ``n`` rows reaches over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def in_cells(df: DataFrame, size: str, by: Column, block: int) -> DataFrame:
    """Split groups of more than ``block`` rows into blocks and send each row to the pairs of blocks it is in.

    Adds ``cell_a`` <= ``cell_b`` (the pair of blocks) and ``block`` (the row's own). Any two rows of a
    group meet in the cell of their blocks, and no cell holds more than about two blocks.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(by, blocks).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(other, own).alias("a"), F.greatest(other, own).alias("b")),
    )
    out = df.withColumn("block", own).withColumn("_cell", F.explode(cells))
    return out.withColumns({"cell_a": F.col("_cell.a"), "cell_b": F.col("_cell.b")}).drop("_cell")


def met_here(cell_a: int, cell_b: int, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows (a, b) belong to this cell: each pair of a group belongs to exactly one."""
    if cell_a == cell_b:
        return np.ones(len(a), bool)
    return block[a] != block[b]
