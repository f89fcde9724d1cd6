"""Token ids as length-delimited binary records with checksums, and an offset index for shuffled reads.

A data file is a series of records: the body's length (8 bytes), the masked checksum of those 8 bytes
(4 bytes), the body, and its masked checksum (4 bytes); all numbers are little-endian. The checksum is
CRC-32, masked by a rotation and a constant so that checksums of data that hold checksums stay sound. A
body is the document's id (8 bytes; with a flag byte that says whether it is null), one byte with the
bytes of an id (2 or 4), and the ids. Beside each data file lies an index of 8-byte record offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import exact_id, plain_id, remember, saved, ship, shuffle_parts
from gaugeworks.llm.tokens import encoder
from gaugeworks.session import fresh_path

END = 2
#: Fixed value: the constant that record formats of this kind add to a rotated checksum.
MASK = 0xA282EAD8
HEAD = "<QI"
BODY = "<?qB"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def unframe(source) -> bytes:
    """The body of the record at a file's place; raises ValueError where it does not match its checksums."""
    length, check = struct.unpack(HEAD, source.read(struct.calcsize(HEAD)))
    if check != masked(struct.pack("<Q", length)):
        raise ValueError("a record's length does not match its checksum")
    body = source.read(length)
    if len(body) != length or struct.unpack("<I", source.read(4))[0] != masked(body):
        raise ValueError("a record does not match its checksum")
    return body


def place_of(uri: str):
    """File system and path of a folder, by the kind of storage its name states."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int = END, files: int | None = None) -> DataFrame:
    """Write every document (doc_id, text) in ascending doc_id order (null ids first); returns the manifest.

    One row per file: shard, file, n_records, n_tokens. Texts are sorted over the cluster by range, encoded
    in their sorted tasks and written under a name of the attempt, so a repeated task leaves no half file
    behind a manifest row. Null texts are empty; repeated rows are written as often as they occur.
    """
    spark = docs.sparkSession
    ship(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        tail = np.array([end], enc.dtype).tobytes()
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, path = place_of(folder)
        files.create_dir(path)
        offsets, at, tokens, out = [], 0, 0, None
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                out = out or files.open_output_stream(f"{path}/{name}.rec")
                ids = enc.encode(text) + tail
                none = pd.isna(doc_id)
                record = frame(struct.pack(BODY, none, 0 if none else int(doc_id), enc.dtype.itemsize) + ids)
                out.write(record)
                offsets.append(at)
                at += len(record)
                tokens += len(ids) // enc.dtype.itemsize
        if out is None:
            return
        out.close()
        with files.open_output_stream(f"{path}/{name}.idx") as index:
            index.write(np.array(offsets, "<u8").tobytes())
        rows = {"shard": [task.partitionId()], "file": [name], "n_records": [len(offsets)], "n_tokens": [tokens]}
        yield pd.DataFrame(rows)

    parts = files or shuffle_parts(spark)
    # rows of one id, or without one, are spread by their text, and equal ones by the place they are read from
    keys = ["doc_id", "hash", "place"]
    rows = docs.select(exact_id(), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return saved(dealt.mapInPandas(write, "shard long, file string, n_records long, n_tokens long"), "manifest")


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Rows of the files named in the manifest, found by their offset index and checked: doc_id, start, n_tokens,
    ids_crc32, and the ids themselves where asked for. ``start`` counts the ids of all records before."""
    ship(spark)
    schema = "doc_id decimal(20,0), start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file: its count is that of the output files, not of the records
    starts = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = shuffle_parts(spark)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = place_of(folder)
        for batch in batches:
            for name, start in zip(batch["file"], batch["before"]):
                with files.open_input_stream(f"{path}/{name}.idx") as index:
                    offsets = np.frombuffer(index.read(), "<u8")
                with files.open_input_file(f"{path}/{name}.rec") as source:
                    for block in range(0, len(offsets), 256):
                        rows = []
                        for offset in offsets[block : block + 256].tolist():
                            source.seek(offset)
                            body = unframe(source)
                            none, doc_id, width = struct.unpack_from(BODY, body)
                            ids = np.frombuffer(body, f"<u{width}", offset=struct.calcsize(BODY)).astype("<u4")
                            row = (None if none else Decimal(doc_id), start, len(ids), zlib.crc32(ids.tobytes()))
                            rows.append((*row, ids.astype("i4")) if with_ids else row)
                            start += len(ids)
                        yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return plain_id(starts.repartition(parts, "shard").mapInPandas(read, schema))


def fresh_folder(spark: SparkSession) -> str:
    folder = fresh_path(spark, "records")
    remember(folder)
    return folder
