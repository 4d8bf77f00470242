"""Table writes: appends, idempotent appends, one-row JSON and files of one row each."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.normalise import with_alert_defaults, with_analysis_defaults, with_incident_defaults, with_report_defaults
from duskwatch.session import cut_lineage
from duskwatch.sources.tail import open_store


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def unstored(rows: DataFrame, stored: DataFrame | None, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose business key is not stored yet; of several with one key the first by ``order`` (all columns in turn, if not given)."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*(order or rows.columns)))
    fresh = rows.groupBy(*key).agg(first.alias("first")).select("first.*")
    return fresh if stored is None else fresh.join(stored.select(*key).distinct(), list(key), "left_anti")


def append_once(rows: DataFrame, path: str, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Append rows with new keys and return what was added; a rerun adds nothing."""
    added = cut_lineage(unstored(rows, read_or_none(rows.sparkSession, path), key, order))
    added.write.mode("append").parquet(path)
    return added


def append_incidents(rows: DataFrame, path: str) -> None:
    with_incident_defaults(rows).write.mode("append").parquet(path)


def append_alerts(rows: DataFrame, path: str) -> None:
    with_alert_defaults(rows).write.mode("append").parquet(path)


def append_analyses(rows: DataFrame, path: str) -> None:
    with_analysis_defaults(rows).write.mode("append").parquet(path)


def append_reports(rows: DataFrame, path: str) -> None:
    with_report_defaults(rows).write.mode("append").parquet(path)


def write_features(features: DataFrame, path: str, as_csv: bool = False) -> None:
    writer = features.dropDuplicates().write.mode("overwrite")
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row metrics frame as a JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_sections(sections: DataFrame, path: str, order: str = "doc_key") -> None:
    """Knowledge sections as a table sorted by id."""
    sections.orderBy(order).write.mode("overwrite").parquet(path)


def write_section_text(sections: DataFrame, path: str, order: str = "doc_key") -> None:
    """Section texts as text files whose order is the id order."""
    sections.orderBy(order).select(F.concat(F.col("text"), F.lit("\n"))).write.mode("overwrite").text(path)


def write_files(files: DataFrame, folder: str) -> None:
    """One file for each row (``path, content``) below ``folder``, a local, mounted or other path that pyarrow opens. A task that runs again writes the same files again."""

    def write(rows):
        store, root = open_store(folder)
        made = set()
        for row in rows:
            target = f"{root}/{row['path']}"
            parent = target.rsplit("/", 1)[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            # Readers see a file whole: it is written beside and moved, so two runs of a task do no harm either.
            draft = f"{parent}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write((row["content"] or "").encode())
            store.move(draft, target)

    # A file takes longer to make than its text to move.
    files.select("path", "content").repartition(4 * files.sparkSession.sparkContext.defaultParallelism).foreachPartition(write)
