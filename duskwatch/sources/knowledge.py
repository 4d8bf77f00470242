"""Scans of reference catalogues and the markdown tree."""

from __future__ import annotations

import fnmatch
import json

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.columns import strip
from duskwatch.schemas import CVE_RECORD, TECHNIQUE_BUNDLE, WEAKNESS_ROW
from duskwatch.session import cut_lineage
from duskwatch.sources.sensors import parse_lines
from duskwatch.sources.tail import open_store

BATCH_FILES, BATCH_BYTES = 1_000, 8 << 20  # of files handed on at once


def _entries(store: pafs.FileSystem, folder: str, recursive: bool):
    """(path, is a folder) of what is in a folder; names that begin with a dot or an underscore are hidden, as for Spark's readers."""
    found = store.get_file_info(pafs.FileSelector(folder, recursive=recursive))
    cut = len(folder.rstrip("/")) + 1
    return [(f.path, f.type == pafs.FileType.Directory) for f in found if not any(name[0] in "._" for name in f.path[cut:].split("/"))]


def read_small_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """``path`` below the folder and ``content`` (bytes) of all files whose name matches; None if the folder is one that only Spark's readers open.

    Tasks list and read the files. Spark's readers have the driver hold every file's state, and start a task for each few dozen of them.
    """
    try:
        root = open_store(folder)[1].rstrip("/")
    except (pa.ArrowInvalid, OSError):
        return None

    def listed(recursive: bool):
        def run(batches):
            store, _ = open_store(folder)
            for batch in batches:
                for path, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = _entries(store, path, recursive) if is_folder else [(path, False)]
                    found = [e for e in found if e[1] and not recursive or not e[1] and fnmatch.fnmatchcase(e[0].rsplit("/", 1)[-1], pattern)]
                    for start in range(0, len(found), 10_000):
                        paths, kinds = zip(*found[start : start + 10_000], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], names=["path", "folder"])

        return run

    def read(batches):
        store, _ = open_store(folder)
        paths, contents, held = [], [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path) as file:
                    contents.append(file.read())
                paths.append(path[len(root) + 1 :])
                held += len(contents[-1])
                if len(paths) >= BATCH_FILES or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    schema, tasks = "path string, folder boolean", 4 * spark.sparkContext.defaultParallelism
    entries = spark.createDataFrame([(root, True)], schema)
    while True:
        entries = cut_lineage(entries.repartition(tasks).mapInArrow(listed(False), schema))
        files, folders = entries.agg(F.count_if(~F.col("folder")), F.count_if("folder")).first()
        if not folders or files + folders >= tasks:
            break
    files = entries.repartition(tasks).mapInArrow(listed(True), schema).select("path").repartition(tasks)
    return files.mapInArrow(read, "path string, content binary")


def _json_text(batches):
    """Bytes to text by the encoding that JSON's first bytes tell; null where they are not of that encoding."""
    for batch in batches:
        texts = []
        for raw in batch.column(0).to_pylist():
            try:
                texts.append(raw.decode(json.detect_encoding(raw)))
            except UnicodeDecodeError:
                texts.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["raw"])


def read_cve_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per ``CVE-*.json`` file; unreadable files are left out."""
    files = read_small_files(spark, folder, "CVE-*.json")
    if files is not None:
        records = parse_lines(files.select("content").mapInArrow(_json_text, "raw string"), "raw", CVE_RECORD)
        return records.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "raw")
    reader = spark.read.schema(CVE_RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record")
    records = reader.option("pathGlobFilter", "CVE-*.json").option("recursiveFileLookup", True).json(folder)
    return records.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``Weakness`` element of the XML catalogue."""
    return spark.read.format("xml").option("rowTag", "Weakness").schema(WEAKNESS_ROW).load(path)


def read_technique_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row per object of a STIX bundle."""
    bundle = spark.read.schema(TECHNIQUE_BUNDLE).option("multiLine", True).json(path)
    return bundle.select(F.explode("objects").alias("o")).select("o.*")


def read_markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every non-blank ``*.md`` file: path relative to ``root`` and whole content."""
    found = read_small_files(spark, root, "*.md")
    if found is not None:
        return found.select("path", F.col("content").cast("string").alias("content")).filter(strip(F.col("content")) != "")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("_metadata.file_path"), base, -1)
    return files.select(path.alias("path"), F.col("value").alias("content")).filter(strip(F.col("content")) != "")


def page_texts(pages: DataFrame) -> DataFrame:
    """Pages (``page, text``) that hold text."""
    return pages.filter(strip(F.coalesce("text", F.lit(""))) != "")
