"""Tables that several writers append to, each key once.

A batch is written to a folder of its own and counts only when a small file that names it is renamed to the next number. Two writers cannot take one number:
the later one looks at what was committed meanwhile and tries again with what is left of its rows. A writer that dies before the
rename leaves a folder that no reader opens; a run repeated after it adds nothing. Rows lie by ``BUCKETS`` hashes of their key, so
a batch is compared with the buckets it touches. The store's rename must refuse an existing target (HDFS and local folders do, plain object stores do not).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import cut_lineage, folder_exists, name_once
from duskwatch.sources.sinks import unstored

BUCKETS = 64  # part of the tables' layout
_BUCKET = "__bucket"


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of what was committed, in order: a short text for each batch."""
    if not folder_exists(spark, f"{path}/commits"):
        return []
    lines = spark.read.option("pathGlobFilter", "*.commit").schema("value string").text(f"{path}/commits")
    return sorted((int(r["number"]), r["value"]) for r in lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).alias("number"), "value").collect())


def _rows_of(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame | None:
    return spark.read.option("basePath", path).parquet(*[f"{path}/{f}" for f in folders]).drop("batch") if folders else None


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches, None if there are none."""
    rows = _rows_of(spark, path, [folder for _, folder in _commits(spark, path)])
    return None if rows is None else rows.drop(_BUCKET)


def append_committed(rows: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = (), before_commit: Callable[[], None] | None = None) -> DataFrame:
    """Append rows whose key the table does not hold (of several with one key the first by ``order``) and return them; null keys are new each time.

    ``before_commit`` is called before each attempt to commit, for tests and for checks of the caller's own.
    """
    spark = rows.sparkSession
    left = rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"))
    seen: set[str] = set()
    while True:
        commits = _commits(spark, path)
        since = [folder for _, folder in commits if folder not in seen]
        stored = _rows_of(spark, path, since)
        if stored is not None:
            touched = [r[0] for r in left.select(_BUCKET).distinct().collect()]  # BUCKETS at most
            stored = stored.filter(F.col(_BUCKET).isin(touched))
        left = cut_lineage(unstored(left, stored, [_BUCKET, *key], order))
        seen.update(since)
        if left.isEmpty():
            return left.drop(_BUCKET)
        number = commits[-1][0] + 1 if commits else 0
        folder = f"batch={left.select(F.expr('uuid()')).first()[0]}"
        left.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{folder}")
        if before_commit:
            before_commit()
        if name_once(spark, f"{path}/commits/{number:020d}.commit", folder):
            return left.drop(_BUCKET)
