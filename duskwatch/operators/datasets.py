"""Flow datasets: labels, alignment, cleaning, sampling and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.functions.columns import strip
from duskwatch.session import cut_lineage

BUCKET_ROWS = 100_000  # distinct rows that one bucket of a class is meant to hold
RANGE_BITS = 12  # of the hash, by which the rows of a class are counted before it is capped
SEED = 42


# --- labels ----------------------------------------------------------------
def normalise_labels(df: DataFrame, dataset: str) -> DataFrame:
    """Trimmed ``Label``; repeated header rows and other label column names are dealt with."""
    if dataset == "cse-cic-ids2018":
        if "Label" not in df.columns:
            raise ValueError("the dataset has no Label column")
        return df.withColumn("Label", strip(F.col("Label").cast("string"))).filter(F.lower("Label") != "label")
    if dataset == "unsw-nb15":
        # Spark resolves names without case, so compare exactly here.
        for name in ("label", "Label", "attack_cat"):
            if name in df.columns:
                return df.withColumn(name, strip(F.col(name).cast("string"))).withColumnRenamed(name, "Label")
        raise ValueError("the dataset has no supported label column")
    raise ValueError(f"unsupported dataset: {dataset}")


def class_number(label: Column) -> Column:
    """Position of a traffic class, null for an unknown one."""
    out = F.when(label == rules.TRAFFIC_CLASSES[0], 0)
    for n, name in enumerate(rules.TRAFFIC_CLASSES[1:], start=1):
        out = out.when(label == name, n)
    return out


def class_name(number: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(c) for c in rules.TRAFFIC_CLASSES]), number.cast("int") + 1)


def mapped_labels(df: DataFrame) -> DataFrame:
    """``Label`` as class number; an unknown label fails the job that reads it."""
    known = class_number(F.col("Label"))
    message = F.concat(F.lit("unknown label: "), F.coalesce("Label", F.lit("null")))
    return df.withColumn("Label", F.when(known.isNull(), F.raise_error(message)).otherwise(known).cast("int"))


def binary_label(label: Column) -> Column:
    return (F.lower(strip(label)) != "benign").cast("int")


def class_counts(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(label)


# --- alignment and cleaning ------------------------------------------------
def align_to_reference(df: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Columns of the 2018 dataset under the reference names, in reference order."""
    out = df.withColumnsRenamed({k: v for k, v in rules.RENAMED_2018.items() if k in df.columns})
    out = out.drop("Timestamp", "Protocol")
    if "Fwd Header Length" in out.columns and "Fwd Header Length.1" not in out.columns:
        out = out.withColumn("Fwd Header Length.1", F.col("Fwd Header Length"))
    missing = [c for c in reference if c not in out.columns]
    if missing:
        raise ValueError(f"features missing after alignment: {missing}")
    return out.select(*[_quoted(c) for c in reference], *[_quoted(c) for c in out.columns if c == "Label" and c not in reference])


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def finite_double(c: Column) -> Column:
    """The value as a finite double, null for anything that is not one."""
    number = c.try_cast("double")
    return F.when(F.isnan(number) | F.abs(number).isin(float("inf")), None).otherwise(number)


def _number_of(df: DataFrame, name: str) -> Column:
    """The value as a double, null for anything that is not a number. A text without a digit is not even read as one, since each that fails costs an exception."""
    c = _quoted(name)
    return (F.when(c.rlike("[0-9]"), c) if df.select(c).schema[0].dataType.typeName() == "string" else c).try_cast("double")


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` as doubles, rows with a missing, infinite or non-numeric value removed."""
    # Texts are read once: a generator is neither repeated for the filter behind it nor merged with it.
    held = df.withColumn("__numbers", F.explode_outer(F.array(F.array(*[_number_of(df, c) for c in columns]))))
    numbers = held.withColumns({c: finite_double(F.get("__numbers", F.lit(i))) for i, c in enumerate(columns)}).drop("__numbers")
    return numbers.na.drop("any", subset=[f"`{c}`" if "." in c else c for c in columns])


def finite_row_counts(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Rows kept and removed by :func:`finite_rows`, in one pass."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | finite_double(_number_of(df, c)).isNull()
    return df.groupBy(*by).agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("removed"))


def without_missing(df: DataFrame) -> DataFrame:
    """Missing-value texts to null, then rows with any null removed."""
    texts = [c for c, t in df.dtypes if t == "string"]
    cleared = df.withColumns({c: F.when(~_quoted(c).isin(*rules.MISSING_TOKENS), _quoted(c)) for c in texts})
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    return cleared.withColumns({c: finite_double(_quoted(c)) for c in numbers}).na.drop("any")


def distinct_rows(df: DataFrame, ignoring: Sequence[str] = ()) -> DataFrame:
    """Whole-row duplicates removed, or duplicates in all but the ignored columns."""
    return df.dropDuplicates([c for c in df.columns if c not in ignoring])


def duplicate_counts(df: DataFrame, ignoring: Sequence[str] = ()) -> DataFrame:
    """Rows before, after and removed by duplicate removal."""
    key = F.struct(*[_quoted(c) for c in df.columns if c not in ignoring])
    per_row = df.groupBy(key.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    totals = per_row.agg(F.sum("n").alias("before"), F.count(F.lit(1)).alias("after"))
    return totals.withColumn("removed", F.col("before") - F.col("after"))


def missing_features(df: DataFrame, features: str, required: Sequence[str]) -> DataFrame:
    """Adds ``missing``: required names that the feature map lacks."""
    wanted = F.array(*[F.lit(r) for r in required])
    return df.withColumn("missing", F.array_except(wanted, F.map_keys(features)))


def _row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """A digest of a row's values. Each is preceded by its length, so that no two rows spell the same; a missing number (null, not-a-number) has a mark no value has."""

    def spelt(name: str) -> Column:
        value = _quoted(name)
        if df.select(value).schema[0].dataType.typeName() in ("double", "float"):
            value = F.when(~F.isnan(value), value + 0.0)  # -0.0 is 0.0
        text = value.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[spelt(c) for c in columns]), 256)


def leakage(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Test rows also in the training rows, and duplicated feature rows overall. Nulls are alike, and differ from any text."""
    trained = train.select(_row_digest(train, features).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n_train"))
    tested = test.select(_row_digest(test, features).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n_test"))
    # Both sides are counted per row first, so a much repeated row is one row in the join.
    both = trained.join(tested, "row", "full").na.fill(0, ["n_train", "n_test"])
    return both.agg(
        F.sum(F.when(F.col("n_train") > 0, F.col("n_test")).otherwise(0)).alias("overlap"),
        F.sum(F.col("n_train") + F.col("n_test") - 1).alias("duplicates"),
    )


# --- sampling and splits ---------------------------------------------------
def hash_positions(df: DataFrame, by: str, columns: Sequence[str], seed: int = SEED, bucket_rows: int = BUCKET_ROWS, most: int | None = None) -> DataFrame:
    """Adds ``position`` (1, 2, ... per class in hash order, to ``most`` if given) and ``class_rows``.

    Equal rows are counted first and take consecutive positions, so a row that is repeated millions of times is one row
    here. A class may hold most of the rows, so it is not ordered in one task: distinct rows are bucketed by the top bits of
    their hash, as many buckets as their number asks for, and a row's position is the rows in lower buckets plus its place in its own.
    """
    names = list(df.columns)
    h = F.xxhash64(F.lit(seed), *[_quoted(c) for c in columns])
    counted = df.groupBy(*[_quoted(c) for c in names]).agg(F.count(F.lit(1)).alias("row_copies"))
    distinct = cut_lineage(counted.withColumn("row_hash", h))
    bits = max(1, math.ceil(math.log2(max(distinct.count(), 1) / bucket_rows + 1)))
    hashed = distinct.withColumn("bucket", F.shiftrightunsigned("row_hash", 64 - bits))
    counts = hashed.groupBy(by, "bucket").agg(F.sum("row_copies").alias("n"))
    lower = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        by,
        "bucket",
        F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy(by)).alias("class_rows"),
    )
    inside = Window.partitionBy(by, "bucket").orderBy("row_hash", *[_quoted(c) for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(offsets, [by, "bucket"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("row_copies").over(inside), F.lit(0)))
    last = F.col("row_copies")
    if most is not None:  # copies beyond it are not even made
        placed, last = placed.filter(F.col("first") < most), F.least(last, most - F.col("first"))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), last))
    return placed.withColumn("nth", copies).select(*[_quoted(c) for c in names], "class_rows", (F.col("first") + F.col("nth")).alias("position"))


def cap_per_class(df: DataFrame, by: str, columns: Sequence[str], most: int = rules.MAX_PER_CLASS, seed: int = SEED) -> DataFrame:
    """At most ``most`` rows of each class, chosen by hash order.

    Rows are counted by class and range of the hash first. Only those up to the range in which their class is full are put in order, so what is
    moved hardly grows with the rows.
    """
    span = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[_quoted(c) for c in columns]), 64 - RANGE_BITS)
    counts = df.groupBy(_quoted(by).alias("class"), span.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    lower = Window.partitionBy("class").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0))).filter(F.col("before") < most)
    # One row for each class, written so that the join knows its size.
    last = cut_lineage(needed.groupBy("class").agg(F.max("span").alias("last_span")))
    near = df.join(last, (_quoted(by) == F.col("class")) & (span <= F.col("last_span")), "left_semi")
    return hash_positions(near, by, columns, seed, most=most).drop("position", "class_rows")


def stratified_split(df: DataFrame, by: str, columns: Sequence[str], test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: exactly the rounded share of every class."""
    test_rows = F.floor(F.col("class_rows") * test_share + 0.5)
    placed = hash_positions(df, by, columns, seed)
    return placed.withColumn("is_test", F.col("position") <= test_rows).drop("position", "class_rows")


def stratified_folds(df: DataFrame, by: str, columns: Sequence[str], folds: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` (0 to folds-1), spread evenly inside every class."""
    placed = hash_positions(df, by, columns, seed)
    return placed.withColumn("fold", F.pmod(F.col("position") - 1, F.lit(folds)).cast("int")).drop("position", "class_rows")


def balanced_weights(df: DataFrame, by: str) -> DataFrame:
    """Adds ``weight``: n / (classes * rows of the class)."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("class_n"))
    # One row per class: the totals come from a window over the classes, not the rows.
    everything = Window.partitionBy()
    weights = counts.select(
        by, (F.sum("class_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("class_n"))).alias("weight")
    )
    return df.join(weights, by)


def prepare_traffic(parts: Sequence[tuple[DataFrame, Sequence[str]]], features: Sequence[str], most: int = rules.MAX_PER_CLASS) -> DataFrame:
    """Training table from several files, each with the labels it may contribute.

    Filter and cap per file, union, drop non-finite rows, drop duplicates, number the
    labels, order by hash.
    """
    united: DataFrame | None = None
    for rows, allowed in parts:
        kept = rows.withColumn("Label", strip(F.col("Label"))).filter(F.col("Label").isin(*allowed)).select(*[_quoted(f) for f in features], "Label")
        capped = cap_per_class(kept, "Label", features, most)
        united = capped if united is None else united.unionByName(capped)
    if united is None:
        raise ValueError("no dataset given")
    return mapped_labels(distinct_rows(finite_rows(united, features)))
