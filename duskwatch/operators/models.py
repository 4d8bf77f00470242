"""Supervised traffic models, their evaluation, and the combination of engines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.operators import boosting, datasets, evaluation, forest, spread_forest
from duskwatch.session import cut_lineage, run_folder

# --- fixed values: model settings ------------------------------------------
FOREST_TREES = 100
UNSW_TREES = 200
BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP, BOOST_SHARE = 200, 6, 0.1, 0.8
SEED = 42
# The published forests grow without a depth limit; this is the greatest that MLlib allows.
FOREST_DEPTH = 30


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def stored(model: PipelineModel) -> PipelineModel:
    """The model as it is read back from the shared folder: scoring then needs nothing of the session that fitted it."""
    path = run_folder(SparkSession.active(), "model")
    save_model(model, path)
    return PipelineModel.load(path)


def probability_name(class_name: str) -> str:
    return f"{class_name.lower().replace('-', '_')}_probability"


def random_forest(trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, features: str = "features", label: str = "Label") -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=features, labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=SEED, maxMemoryInMB=1024
    )


def fit_forest(train: DataFrame, features: Sequence[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> PipelineModel:
    """Random forest with balanced class weights; ``Label`` is the class number."""
    weighted = datasets.balanced_weights(train, "Label")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return stored(Pipeline(stages=[assembler, random_forest(trees, depth)]).fit(weighted))


def fit_boosted(train: DataFrame, features: Sequence[str], rounds: int = BOOST_ROUNDS) -> DataFrame:
    """Boosted trees as one softmax model: its nodes."""
    settings = boosting.Settings(rounds, BOOST_DEPTH, BOOST_STEP, BOOST_SHARE, BOOST_SHARE, seed=SEED)
    return boosting.fit(train, features, "Label", len(rules.TRAFFIC_CLASSES), settings)


def predict(model: PipelineModel, rows: DataFrame, *keep: str) -> DataFrame:
    """``keep..., prediction_number, prediction`` and one probability column per class."""
    scored = model.transform(rows).withColumn("p", vector_to_array("probability"))
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("prediction_number"),
        datasets.class_name(F.col("prediction")).alias("prediction"),
        *[F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)).alias(probability_name(c)) for i, c in enumerate(rules.TRAFFIC_CLASSES)],
    )


def evaluate_classes(predicted: DataFrame) -> DataFrame:
    """Accuracy, weighted precision, recall, F1 and one-versus-rest ROC area."""
    scores = [probability_name(c) for c in rules.TRAFFIC_CLASSES]
    # Read several times below: score the rows once.
    predicted = cut_lineage(predicted)
    metrics = evaluation.weighted_metrics(predicted, "Label", "prediction_number")
    # Two one-row results.
    return metrics.withColumn("one", F.lit(1)).join(
        evaluation.roc_auc_weighted(predicted, "Label", scores).withColumn("one", F.lit(1)), "one"
    ).drop("one")


def evaluate_external(predicted: DataFrame, truth: str) -> DataFrame:
    """Any class but the first counts as attack, its probability as one minus the first's."""
    binary = cut_lineage(predicted).select(
        F.col(truth).alias("truth"),
        (F.col("prediction_number") != 0).cast("int").alias("attack"),
        (1.0 - F.col(probability_name(rules.TRAFFIC_CLASSES[0]))).alias("attack_probability"),
    )
    metrics = evaluation.binary_metrics(binary, "truth", "attack").withColumn("one", F.lit(1))
    area = evaluation.roc_auc(binary, "truth", "attack_probability").select("roc_auc", F.lit(1).alias("one"))
    return metrics.join(area, "one").drop("one")


def _named(scored: DataFrame, *keep: str) -> DataFrame:
    """``keep..., prediction_number, prediction`` and one probability column per class, from ``shares``; the lowest class of equal shares."""
    number = F.array_position("shares", F.array_max("shares")).cast("int") - 1
    return scored.select(
        *keep,
        number.alias("prediction_number"),
        datasets.class_name(number.cast("double")).alias("prediction"),
        *[F.coalesce(F.get("shares", F.lit(i)), F.lit(0.0)).alias(probability_name(c)) for i, c in enumerate(rules.TRAFFIC_CLASSES)],
    )


def predict_deep(nodes: DataFrame, rows: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """As ``predict``, by the nodes of a forest without a depth limit (``forest.fit``)."""
    return _named(forest.score(nodes, rows, features, *keep), *keep)


def predict_boosted(nodes: DataFrame, rows: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """As ``predict``, by the nodes of a softmax model (``fit_boosted``)."""
    return _named(boosting.score(nodes, rows, features, len(rules.TRAFFIC_CLASSES), *keep), *keep)


def cross_validate(rows: DataFrame, features: Sequence[str], folds: int = 5, trees: int = FOREST_TREES) -> DataFrame:
    """The five metrics of each of the stratified folds: ``fold, accuracy, ..., roc_auc``. Trees of all folds grow at once, without a depth limit.

    ``rows`` is a training table, which is capped by class (``prepare_traffic``).
    """
    placed = cut_lineage(datasets.stratified_folds(rows, "Label", list(features)))
    predicted = cut_lineage(_named(forest.out_of_fold(placed, features, "Label", "fold", folds, trees).withColumnRenamed("label", "Label"), "fold", "Label"))
    results: DataFrame | None = None
    for fold in range(folds):
        metrics = evaluate_classes(predicted.filter(F.col("fold") == fold).drop("fold"))
        row = metrics.select(F.lit(fold).alias("fold"), "accuracy", "precision", "recall", "f1", "roc_auc")
        results = row if results is None else results.unionByName(row)
    if results is None:
        raise ValueError("at least one fold is needed")
    return results


# --- UNSW preprocessing ----------------------------------------------------
def value_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value, rows``: the most frequent value per column, the smaller one on a tie."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    counts = df.select(F.inline(entries)).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("best"))
    return best.select("feature", F.col("best.value").alias("value"), (-F.col("best.n")).alias("rows"))


def unsw_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = rules.UNSW_CATEGORICAL) -> tuple[PipelineModel, dict[str, str]]:
    """Median imputation of numbers, one-hot categories (unknown ones ignored)."""
    fill = {r["feature"]: r["value"] for r in value_modes(train, categorical).collect()}
    filled = [f"{c}_filled" for c in numeric]
    stages = [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled, relativeError=0.0001),
        StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"),
        # The extra index of unknown values is the dropped last category: all zeros.
        OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=True),
        VectorAssembler(inputCols=[*filled, *[f"{c}_hot" for c in categorical]], outputCol="features"),
    ]
    return stored(Pipeline(stages=stages).fit(train.na.fill(fill))), fill


def evaluate_binary(scored: DataFrame) -> DataFrame:
    """Binary metrics and ROC area of ``truth, predicted, p``."""
    out = cut_lineage(scored)
    metrics = evaluation.binary_metrics(out, "truth", "predicted").withColumn("one", F.lit(1))
    return metrics.join(evaluation.roc_auc(out, "truth", "p").select("roc_auc", F.lit(1).alias("one")), "one").drop("one")


def evaluate_unsw(rows: DataFrame, trees: int = UNSW_TREES, depth: int = FOREST_DEPTH) -> DataFrame:
    """Clean, split, preprocess, train and evaluate the UNSW rows."""
    clean = datasets.distinct_rows(datasets.without_missing(rows), ignoring=["id"])
    features = [c for c in clean.columns if c not in rules.UNSW_NON_FEATURES]
    numeric = [c for c in features if c not in rules.UNSW_CATEGORICAL]
    split = cut_lineage(datasets.stratified_split(clean, "label", [*features, "id"]))
    preprocessor, fill = unsw_preprocessor(split.filter(~F.col("is_test")), numeric)
    ready = cut_lineage(preprocessor.transform(split.na.fill(fill)).select("label", "is_test", vector_to_array("features").alias("inputs")))
    first = ready.select(F.size("inputs").alias("n")).first()
    names = [f"input_{i}" for i in range(first["n"] if first else 0)]
    ready = ready.select("label", "is_test", *[F.get("inputs", F.lit(i)).alias(n) for i, n in enumerate(names)])
    model = spread_forest.fit(ready.filter(~F.col("is_test")), names, "label", trees, depth)
    return evaluate_binary(spread_forest.score(model, ready.filter("is_test"), names, "label"))


def evaluate_native_2018(rows: DataFrame, features: Sequence[str], trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> DataFrame:
    """Align, clean, split, train and evaluate the 2018 rows as benign against attack."""
    labelled = datasets.normalise_labels(rows, "cse-cic-ids2018").withColumn("Label", datasets.binary_label(F.col("Label")))
    clean = datasets.distinct_rows(datasets.finite_rows(datasets.align_to_reference(labelled, features), features))
    plain = [f"feature_{i}" for i in range(len(features))]
    split = cut_lineage(datasets.stratified_split(clean.toDF(*plain, "Label"), "Label", plain))
    model = spread_forest.fit(split.filter(~F.col("is_test")), plain, "Label", trees, depth)
    return evaluate_binary(spread_forest.score(model, split.filter("is_test"), plain, "Label"))


# --- combining engines -----------------------------------------------------
def combine_engines(results: DataFrame) -> DataFrame:
    """One verdict from up to three engines.

    Reads ``random_forest_prediction, xgboost_prediction, isolation_forest_prediction,
    is_anomaly, anomaly_score`` and ``failed`` (an engine was run and failed).
    """
    present = [F.when(F.col(f"{e}_prediction").isNotNull(), F.lit(e)) for e in ("random_forest", "xgboost", "isolation_forest")]
    engines = F.array_compact(F.array(*present))
    ran_isolation = F.col("isolation_forest_prediction").isNotNull()
    df = results.withColumn("engines", engines)
    some = F.size("engines") > 0
    return (
        df.withColumn("ml_status", F.when(some, "success").when(F.col("failed"), "failed").otherwise("not_available"))
        .withColumn("ml_engine", F.when(F.size("engines") == 1, F.get("engines", F.lit(0))).when(some, "hybrid"))
        .withColumn("ml_prediction", F.coalesce("xgboost_prediction", "random_forest_prediction", "isolation_forest_prediction"))
        .withColumn("ml_is_anomaly", F.when(ran_isolation, F.col("is_anomaly")))
        .withColumn("ml_anomaly_score", F.when(ran_isolation, F.col("anomaly_score")))
    )


def alerts_as_flows(events: DataFrame) -> DataFrame:
    """Network alerts offered to the flow model as they are.

    An alert lacks most flow fields, so most of its features are zero; kept because the
    published behaviour is the same.
    """
    return events.withColumn("event_type", F.lit("flow"))
