import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.operators import datasets, evaluation, isolation, models
from duskwatch.plans import model_queries, registry
from duskwatch.plans.views import view


def rows_2018(spark):
    columns = ["Dst Port", "Flow Duration", "Tot Fwd Pkts", "Fwd Header Len", "Flow Byts/s", "Flow Pkts/s", "Protocol", "Timestamp", "Label"]
    rows = [
        ("80", "10", "1", "20", "1.5", "2.5", "6", "t", " Benign "),
        ("443", "11", "2", "40", "Infinity", "2.5", "6", "t", "Bot"),
        ("22", "12", "3", "60", "3.5", "4.5", "6", "t", "Bot"),
        ("Dst Port", "x", "x", "x", "x", "x", "x", "x", "Label"),
    ]
    return spark.createDataFrame(rows, columns)


def test_alignment_and_cleaning(spark):
    rows = datasets.normalise_labels(rows_2018(spark), "cse-cic-ids2018")
    assert rows.count() == 3
    clean = datasets.finite_rows(datasets.align_to_reference(rows, model_queries.REFERENCE_2018), model_queries.REFERENCE_2018)
    got = clean.collect()
    assert len(got) == 2 and clean.columns[:7] == list(model_queries.REFERENCE_2018)
    assert all(r["Fwd Header Length"] == r["Fwd Header Length.1"] for r in got)
    with pytest.raises(ValueError):
        datasets.align_to_reference(rows, ["No Such Feature"])


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("BENIGN",), ("Worm",)], "Label STRING")
    with pytest.raises(Exception, match="unknown label"):
        datasets.mapped_labels(df).collect()


def test_unsw_cleaning_ignores_id(spark):
    rows = [(1, 0.5, "tcp", "http", "FIN", "Normal", 0), (2, 0.5, "tcp", "http", "FIN", "Normal", 0), (3, 0.7, "udp", "NA", "FIN", "DoS", 1), (4, 0.9, "udp", "-", "INT", "DoS", 1)]
    df = spark.createDataFrame(rows, "id INT, dur DOUBLE, proto STRING, service STRING, state STRING, attack_cat STRING, label INT")
    assert datasets.distinct_rows(datasets.without_missing(df), ignoring=["id"]).count() == 2


def test_split_and_folds_are_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 970, "big").otherwise("small").alias("y"))
    split = datasets.stratified_split(df, "y", ["id"])
    sizes = {r["y"]: (r["train"], r["test"]) for r in split.groupBy("y").agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).collect()}
    assert sizes == {"big": (776, 194), "small": (24, 6)}
    again = datasets.stratified_split(df.repartition(7), "y", ["id"])
    assert {r["id"] for r in split.filter("is_test").collect()} == {r["id"] for r in again.filter("is_test").collect()}
    folds = datasets.stratified_folds(df, "y", ["id"]).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds} == {194, 6}
    assert datasets.cap_per_class(df, "y", ["id"], most=50).groupBy("y").count().filter("count > 50").isEmpty()


def test_leakage(spark):
    train = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x INT, y STRING")
    test = spark.createDataFrame([(1, "a"), (3, None), (3, None)], "x INT, y STRING")
    r = datasets.leakage(train, test, ["x", "y"]).first()
    assert (r["overlap"], r["duplicates"]) == (1, 3)


def test_leakage_of_rows_that_look_alike(spark):
    kinds = "x STRING, y STRING, z DOUBLE"
    train = spark.createDataFrame([("a|b", "c", 0.0), ("nan", None, float("nan")), ("1:a", "", 1.0), ("-", "-", 2.0)], kinds)
    test = spark.createDataFrame([("a", "b|c", 0.0), (None, "nan", None), ("1", ":a", 1.0), ("-", None, 2.0)], kinds)
    assert tuple(datasets.leakage(train, test, ["x", "y", "z"]).first()) == (0, 0)
    same = spark.createDataFrame([("a|b", "c", -0.0), ("nan", None, None)], kinds)
    assert tuple(datasets.leakage(train, same, ["X", "y", "z"]).first()) == (2, 2)


def test_roc_area_against_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y INT, s DOUBLE")
    pos, neg = s[y == 1], s[y == 0]
    expected = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert evaluation.roc_auc(df, "y", "s", buckets=8).first()["roc_auc"] == pytest.approx(expected)


def test_binary_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y INT, p INT")
    r = evaluation.binary_metrics(df, "y", "p").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.normal(0, 1, 2))) for i in range(2000)] + [(9000 + i, 9.0 + i, -9.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE")
    features = ["a", "b"]
    nodes = isolation.grow_forest(df, features, trees=60, size=128)
    assert nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * 128
    assert nodes.select("tree").distinct().count() == 60
    scored = isolation.score(df, isolation.load_forest(nodes, 128), features, "id")
    judged = isolation.judge(scored, isolation.offset_of(scored, 0.01))
    flagged = {r["id"] for r in judged.filter("is_anomaly").collect()}
    assert len(flagged & set(range(9000, 9010))) >= 9 and len(flagged) <= 25


def test_small_table_reaches_every_tree(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(20)], "a DOUBLE, b DOUBLE")
    sizes = isolation.tree_samples(df, ["a", "b"], trees=5, size=16).groupBy("tree").count().collect()
    assert [r["count"] for r in sizes] == [16] * 5


def test_supervised_models(spark, sf_dir):
    rows = model_queries._prepared(spark, sf_dir)
    split = datasets.stratified_split(rows, "Label", model_queries.FEATURES).cache()
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    forest = models.fit_forest(train, model_queries.FEATURES, trees=10, depth=8)
    predicted = models.predict(forest, test, "Label")
    names = [models.probability_name(c) for c in rules.TRAFFIC_CLASSES]
    total = predicted.select(sum((F.col(n) for n in names), F.lit(0.0)).alias("t")).agg(F.min("t"), F.max("t")).first()
    assert total[0] == pytest.approx(1.0) and total[1] == pytest.approx(1.0)
    quality = models.evaluate_classes(predicted).first()
    assert quality["accuracy"] > 0.8 and quality["roc_auc"] > 0.9
    boosted = models.fit_boosted(train, model_queries.FEATURES, rounds=10)
    assert models.evaluate_classes(models.predict_boosted(boosted, test, model_queries.FEATURES, "Label")).first()["accuracy"] > 0.7
    folds = models.cross_validate(rows, model_queries.FEATURES, folds=2, trees=5)
    assert {r["metric"] for r in evaluation.fold_summary(folds, ["accuracy", "f1"]).collect()} == {"accuracy", "f1"}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(float(i % 50), float(i % 7)) for i in range(3000)], "a DOUBLE, b DOUBLE")
    one, other = (sorted(map(tuple, isolation.tree_samples(df.repartition(n), ["a", "b"], trees=10, size=64).collect())) for n in (1, 5))
    assert one == other and len(one) == 640


def test_positions_of_repeated_rows(spark):
    df = spark.createDataFrame([("x", 1)] * 500 + [("x", i) for i in range(100)] + [("y", 7)] * 3, "label STRING, v INT")
    placed = datasets.hash_positions(df, "label", ["v"], bucket_rows=10).collect()
    for label, n in (("x", 600), ("y", 3)):
        own = [r for r in placed if r["label"] == label]
        assert sorted(r["position"] for r in own) == list(range(1, n + 1)) and {r["class_rows"] for r in own} == {n}
    ones = sorted(r["position"] for r in placed if r["label"] == "x" and r["v"] == 1)
    assert ones == list(range(ones[0], ones[0] + 501))


def test_only_the_start_of_a_class_is_put_in_order(spark, monkeypatch):
    """All rows of a class were ordered to keep a fixed number of them."""
    df = spark.range(40_000).selectExpr("if(id % 4 = 0, 'a', if(id < 30, null, 'b')) AS label", "if(id % 5 = 0, 7, id) AS v").unionByName(spark.sql("SELECT 'c' AS label, 1L AS v"))
    plain = datasets.hash_positions(df, "label", ["v"]).filter("position <= 300").select("label", "v")
    ordered = []
    positions = datasets.hash_positions

    def counted(rows, *args, **kwargs):
        ordered.append(rows.count())
        return positions(rows, *args, **kwargs)

    monkeypatch.setattr(datasets, "hash_positions", counted)
    got = datasets.cap_per_class(df, "label", ["v"], most=300)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.groupBy("label").count().filter("label <> 'c' AND count <> 300").isEmpty()
    assert 601 <= ordered[0] < 1_200


def test_copies_beyond_the_cap_are_not_made(spark):
    """A row that a class has often was multiplied before the class was capped."""
    df = spark.range(500).selectExpr("'a' AS label", "1L AS v")
    plan = datasets.cap_per_class(df, "label", ["v"], most=20)
    assert plan.count() == 20
    assert [r.position for r in datasets.hash_positions(df, "label", ["v"], most=20).orderBy("position").collect()] == list(range(1, 21))


def test_unsw_and_native_models(spark, sf_dir):
    registry.QUERIES["correlation_ids"](spark, sf_dir).count()  # one session must bear both
    unsw = models.evaluate_unsw(view(spark, sf_dir, "unsw_v"), trees=5, depth=5).first()
    assert unsw["accuracy"] > 0.8
    native = models.evaluate_native_2018(view(spark, sf_dir, "flow_2018_v"), model_queries.REFERENCE_2018, trees=5, depth=5).first()
    assert native["rows"] > 0


def test_combined_engines(spark):
    rows = [(1, "DDoS", None, None, None, False), (2, "DDoS", "BENIGN", "NORMAL", False, True), (3, None, None, None, None, True), (4, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "id INT, random_forest_prediction STRING, xgboost_prediction STRING, isolation_forest_prediction STRING, is_anomaly BOOLEAN, failed BOOLEAN")
    got = {r["id"]: (r["ml_status"], r["ml_engine"], r["ml_prediction"]) for r in models.combine_engines(df.withColumn("anomaly_score", F.lit(0.0))).collect()}
    assert got == {1: ("success", "random_forest", "DDoS"), 2: ("success", "hybrid", "BENIGN"), 3: ("failed", None, None), 4: ("not_available", None, None)}


def test_texts_are_read_once(spark):
    """Each text was read up to six times, and one that is no number cost an exception each time."""
    given = [("1", "2"), (" 7e1 ", "3"), ("abc", "1"), ("", "1"), ("NaN", "1"), ("-Infinity", "1"), ("12x", "1"), (None, "1"), ("1", None), ("0x1p3", "4"), ("1e999", "1"), ("5d", "6")]
    rows = datasets.finite_rows(spark.createDataFrame(given, "`a.1` STRING, b STRING").withColumn("kept", F.lit(1)), ["a.1", "b"])
    assert rows.dtypes == [("a.1", "double"), ("b", "double"), ("kept", "int")]
    assert sorted(tuple(r) for r in rows.collect()) == [(1.0, 2.0, 1), (5.0, 6.0, 1), (8.0, 4.0, 1), (70.0, 3.0, 1)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("try_cast") == 2
    counts = datasets.finite_row_counts(spark.createDataFrame(given, "`a.1` STRING, b STRING"), ["a.1", "b"]).first()
    assert (counts["kept"], counts["removed"]) == (4, 8)
