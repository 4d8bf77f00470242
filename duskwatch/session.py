"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def build_session(app: str = "duskwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; ``conf`` wins over defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Work per row is heavy (JSON, patterns, vectors): read in splits smaller than the default.
        "spark.sql.files.maxPartitionBytes": "32m",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """All timestamps are naive UTC, so casts must run in UTC; Python workers need the package."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="duskwatch-modules-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "duskwatch_modules.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for base, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.join("duskwatch", os.path.relpath(path, PACKAGE)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    A session that leaves it unset gets a folder below its warehouse, which is shared as well.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Stage tables written inside go to one folder, which is removed at the end. Results must be written before that."""
    folder = run_folder(spark, "job")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        delete_folder(spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Reading a table keeps no lineage, survives lost executors, and keeps file
    statistics for the next plan.
    """
    base = _scratch.get()
    path = f"{base}/stage-{uuid.uuid4().hex}" if base else run_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt to a few tasks for each core, for work on a row that takes many times as long as moving it.

    A scan has no more tasks than its files have row groups. Rows are dealt by the hash of their values, so nothing is sorted for it.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))


def name_once(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that is renamed into place whole; False if there is one of that name already."""
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = draft.getFileSystem(conf)
    out = files.create(draft)
    out.write(bytearray(text, "utf-8"))
    out.close()
    # FileContext refuses an existing target, which FileSystem may replace.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(draft).toUri(), conf)
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), no_options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        files.delete(draft, False)
        return False
    return True
