"""Files and folders of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a stored file at most.
TARGET_BYTES = 512 * 1024 * 1024
#: Bytes of rows in memory, by Spark's default sizes of their types, that one task sorts.
SORT_BYTES = 512 * 1024 * 1024


def _row_bytes(table: DataFrame) -> int:
    return int(table._jdf.schema().defaultSize())


def sort_tasks(table: DataFrame, stored: int, target_bytes: int = TARGET_BYTES) -> int:
    """Tasks for sorting a stored table into files: of ``target_bytes`` at most, of fewer where rows are many.

    Stored rows are far smaller than the rows that a task sorts, so files' bytes alone do not bound its memory. Rows are
    counted without reading a column.
    """
    return int(max(1, -(-stored // target_bytes), -(-table.count() * _row_bytes(table) // SORT_BYTES)))


def stored_totals(table: DataFrame) -> DataFrame:
    """Bytes, rows and files that the frame is read from; no column is read."""
    per_file = (
        table.select("_metadata.file_path", "_metadata.file_size")
        .groupBy("file_path")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"))
    )
    return per_file.agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files")
    )


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a table: ``path``, ``length`` and the partition columns. Nothing but the listing is read."""
    return spark.read.format("binaryFile").load(path).drop("content", "modificationTime")


def stored_bytes(files: DataFrame) -> int:
    return files.agg(F.sum("length")).first()[0] or 0


def scattered_partitions(spark: SparkSession, path: str, part: str, target_bytes: int = TARGET_BYTES) -> tuple[str, ...]:
    """Partitions with more than twice the files that their bytes and rows call for, and one for a shared boundary.

    Rows are counted, without reading a column, of those only that have too many files for their bytes.
    """
    each = stored_files(spark, path).groupBy(F.col(part).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
    needy = each.filter(F.col("files") > 2 * F.ceil(F.col("bytes") / target_bytes) + 1)
    files = {r["part"]: r["files"] for r in needy.collect()}
    if not files:
        return ()
    table = spark.read.parquet(path)
    value = F.col(part).cast("string")
    counted = table.filter(value.isin(*files)).groupBy(value.alias("part")).agg(F.count(F.lit(1)).alias("rows")).collect()
    most = {r["part"]: 2 * -(-r["rows"] * _row_bytes(table) // SORT_BYTES) + 1 for r in counted}
    return tuple(sorted(v for v, n in files.items() if n > most.get(v, 1)))


def _partition_folders(spark: SparkSession, path: str, part: str) -> tuple:
    """File system of a table, and the folder of each value of its partition column; nothing is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith(f"{part}="):
            found[name.split("=", 1)[1]] = entry.getPath()
    return files, found


def partition_values(spark: SparkSession, path: str, part: str) -> list[str]:
    return sorted(_partition_folders(spark, path, part)[1])


def drop_partitions(spark: SparkSession, path: str, part: str, values: list[str]) -> None:
    """Remove the folders of these partitions."""
    files, found = _partition_folders(spark, path, part)
    for value in values:
        files.delete(found[value], True)


def drop_partitions_before(spark: SparkSession, path: str, part: str, first_kept: str) -> None:
    """Remove the partition folders whose value sorts before ``first_kept``."""
    drop_partitions(spark, path, part, [v for v in partition_values(spark, path, part) if v < first_kept])
