"""Dataset, model and anomaly queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duskwatch.functions import rules
from duskwatch.operators import datasets, evaluation, forest, isolation, models
from duskwatch.operators import metrics as operational
from duskwatch.plans.catalog import query
from duskwatch.plans.views import oracle, oracle_ctes, table, view
from duskwatch.schemas import EVE_EVENT
from duskwatch.session import cut_lineage, run_folder
from duskwatch.sources import datasets as dataset_files
from duskwatch.sources import sensors, sinks

FEATURES = list(rules.FLOW_FEATURES)
# Of the two evaluations whose tables are not capped; with MLlib, which fitted them at first, depth 30 took 695 s for one of them.
QUERY_DEPTH = 14
REFERENCE_2018 = (
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Fwd Header Length", "Flow Bytes/s", "Flow Packets/s", "Fwd Header Length.1",
)


def _traffic(spark, sf_dir):
    """Labelled flows with all model inputs; ``Label`` is text."""
    base = view(spark, sf_dir, "traffic_v")
    return sensors.with_flow_rates(base, "flow_id", "label").withColumnRenamed("label", "Label").drop("alerted")


def _prepared(spark, sf_dir):
    """Three 'files' with the labels each may contribute, as one training table."""
    rows = _traffic(spark, sf_dir).drop("flow_id")
    parts = [(rows, ("BENIGN", "DDoS")), (rows, ("BENIGN", "PortScan")), (rows, ("BENIGN", "FTP-Patator", "SSH-Patator"))]
    return cut_lineage(datasets.prepare_traffic(parts, FEATURES))


# --- datasets --------------------------------------------------------------
@query(
    "aligned_2018_rows",
    oracle_ctes("flow_2018_v", """good AS (SELECT *, TRY_CAST(CASE WHEN "Flow Byts/s" IN ('Infinity', 'NaN', 'abc') THEN NULL ELSE "Flow Byts/s" END AS DOUBLE) AS rate,
      TRY_CAST("Flow Pkts/s" AS DOUBLE) AS pkts, trim(Label) AS l FROM flow_2018_v WHERE lower(trim(Label)) <> 'label')""",
    """SELECT l AS "Label", CAST("Dst Port" AS DOUBLE) AS "Destination Port", CAST("Flow Duration" AS DOUBLE) AS "Flow Duration", CAST("Tot Fwd Pkts" AS DOUBLE) AS "Total Fwd Packets",
      CAST("Fwd Header Len" AS DOUBLE) AS "Fwd Header Length", rate AS "Flow Bytes/s", pkts AS "Flow Packets/s", CAST("Fwd Header Len" AS DOUBLE) AS "Fwd Header Length.1"
      FROM good WHERE rate IS NOT NULL AND pkts IS NOT NULL"""),
)
def aligned_2018_rows(spark, sf_dir):
    rows = datasets.normalise_labels(view(spark, sf_dir, "flow_2018_v"), "cse-cic-ids2018")
    return datasets.finite_rows(datasets.align_to_reference(rows, REFERENCE_2018), REFERENCE_2018)


@query(
    "finite_row_counts",
    oracle("flow_2018_v", """SELECT trim(Label) AS "Label", count(*) FILTER (WHERE "Flow Byts/s" NOT IN ('Infinity', 'NaN', 'abc') AND "Flow Pkts/s" <> '') AS kept,
      count(*) FILTER (WHERE "Flow Byts/s" IN ('Infinity', 'NaN', 'abc') OR "Flow Pkts/s" = '') AS removed FROM flow_2018_v WHERE lower(trim(Label)) <> 'label' GROUP BY 1"""),
)
def finite_row_counts(spark, sf_dir):
    rows = datasets.normalise_labels(view(spark, sf_dir, "flow_2018_v"), "cse-cic-ids2018")
    return datasets.finite_row_counts(datasets.align_to_reference(rows, REFERENCE_2018), REFERENCE_2018, "Label")


@query(
    "label_classes",
    oracle("traffic_v", f"""SELECT {" + ".join(f"CASE WHEN label = '{c}' THEN {i} ELSE 0 END" for i, c in enumerate(rules.TRAFFIC_CLASSES))} AS "Label", count(*) AS rows
      FROM traffic_v GROUP BY 1"""),
)
def label_classes(spark, sf_dir):
    return datasets.class_counts(datasets.mapped_labels(_traffic(spark, sf_dir)))


@query(
    "binary_labels",
    oracle("flow_2018_v", """SELECT CASE WHEN lower(trim(Label)) <> 'benign' THEN 1 ELSE 0 END AS attack, count(*) AS rows FROM flow_2018_v WHERE lower(trim(Label)) <> 'label' GROUP BY 1"""),
)
def binary_labels(spark, sf_dir):
    rows = datasets.normalise_labels(view(spark, sf_dir, "flow_2018_v"), "cse-cic-ids2018")
    return datasets.class_counts(rows.select(datasets.binary_label(F.col("Label")).alias("attack")), "attack")


@query(
    "unsw_labels",
    oracle("unsw_v", """SELECT trim(CAST(label AS VARCHAR)) AS "Label", count(*) AS rows FROM unsw_v GROUP BY 1"""),
)
def unsw_labels(spark, sf_dir):
    return datasets.class_counts(datasets.normalise_labels(view(spark, sf_dir, "unsw_v"), "unsw-nb15"))


@query("distinct_flows", oracle("flow_v", "SELECT DISTINCT destination_port, pkts_to_server, pkts_to_client, duration_seconds, alerted FROM flow_v"))
def distinct_flows(spark, sf_dir):
    flows = view(spark, sf_dir, "flow_v").select("destination_port", "pkts_to_server", "pkts_to_client", "duration_seconds", "alerted")
    return datasets.distinct_rows(flows)


@query(
    "duplicate_counts",
    oracle("unsw_v", """SELECT count(*) AS before, count(DISTINCT (sbytes, rate, proto, service, state)) AS after, count(*) - count(DISTINCT (sbytes, rate, proto, service, state)) AS removed
      FROM unsw_v"""),
)
def duplicate_counts(spark, sf_dir):
    rows = view(spark, sf_dir, "unsw_v").select("id", "sbytes", "rate", "proto", "service", "state")
    return datasets.duplicate_counts(rows, ignoring=["id"])


@query(
    "distinct_ignoring_id",
    oracle("unsw_v", """SELECT DISTINCT sbytes, rate, proto, service, state, attack_cat, label FROM unsw_v WHERE proto IS NOT NULL AND service <> 'NA'"""),
)
def distinct_ignoring_id(spark, sf_dir):
    rows = datasets.without_missing(view(spark, sf_dir, "unsw_v").drop("dur"))
    return datasets.distinct_rows(rows, ignoring=["id"]).drop("id")


@query(
    "united_datasets",
    oracle("traffic_v", """SELECT label, count(*) AS rows FROM (SELECT label FROM traffic_v WHERE label IN ('BENIGN', 'DDoS') UNION ALL SELECT label FROM traffic_v WHERE label IN ('BENIGN', 'PortScan')) u GROUP BY 1"""),
)
def united_datasets(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic_v").select("label")
    first, second = (rows.filter(F.col("label").isin(*names)) for names in (("BENIGN", "DDoS"), ("BENIGN", "PortScan")))
    return datasets.class_counts(first.unionByName(second), "label")


@query(
    "missing_features",
    oracle("flow_v", f"""SELECT flow_id, line_no, CASE WHEN alerted = 1 THEN 'duration_seconds,' ELSE '' END || '{",".join(f for f in FEATURES[6:])}' AS missing, count(*) AS flows
      FROM flow_v GROUP BY ALL"""),
)
def missing_features(spark, sf_dir):
    named = [c for c in FEATURES[:6]]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in named])
    given = F.map_from_entries(F.filter(pairs, lambda p: (p["key"] != "duration_seconds") | (F.col("alerted") == 0)))
    flows = datasets.missing_features(view(spark, sf_dir, "flow_v").withColumn("given", given), "given", FEATURES)
    out = flows.select("flow_id", "line_no", F.array_join("missing", ",").alias("missing"))
    return out.groupBy("flow_id", "line_no", "missing").agg(F.count(F.lit(1)).alias("flows"))


@query(
    "leakage",
    """WITH a AS (SELECT l_quantity, l_discount, l_returnflag, l_shipdate < TIMESTAMP '1997-01-01' AS trained FROM lineitem),
    r AS (SELECT l_quantity, l_discount, l_returnflag, count(*) FILTER (WHERE trained) AS n1, count(*) FILTER (WHERE NOT trained) AS n2 FROM a GROUP BY ALL)
    SELECT CAST(sum(CASE WHEN n1 > 0 THEN n2 ELSE 0 END) AS BIGINT) AS overlap, CAST(sum(n1 + n2 - 1) AS BIGINT) AS duplicates FROM r""",
)
def leakage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    early = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return datasets.leakage(rows.filter(early), rows.filter(~early), ["l_quantity", "l_discount", "l_returnflag"])


@query(
    "cap_per_class",
    oracle("traffic_v", f"SELECT label, least(count(*), {rules.MAX_PER_CLASS}) AS rows FROM traffic_v GROUP BY 1"),
)
def cap_per_class(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic_v")
    return datasets.class_counts(datasets.cap_per_class(rows, "label", [c for c in rows.columns if c != "label"]), "label")


@query(
    "stratified_split",
    oracle("traffic_v", """SELECT label, CAST(count(*) - floor(count(*) * 0.2 + 0.5) AS BIGINT) AS train_rows, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test_rows FROM traffic_v GROUP BY 1"""),
)
def stratified_split(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic_v")
    split = datasets.stratified_split(rows, "label", [c for c in rows.columns if c != "label"])
    return split.groupBy("label").agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))


@query(
    "stratified_folds",
    oracle("traffic_v", """SELECT label, CAST(f.f AS INT) AS fold, CAST(floor((count(*) + 4 - f.f) / 5) AS BIGINT) AS rows FROM traffic_v, range(5) f(f) GROUP BY label, f.f"""),
)
def stratified_folds(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic_v")
    placed = datasets.stratified_folds(rows, "label", [c for c in rows.columns if c != "label"])
    return placed.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "balanced_weights",
    oracle("traffic_v", """SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM traffic_v GROUP BY label"""),
)
def balanced_weights(spark, sf_dir):
    weighted = datasets.balanced_weights(view(spark, sf_dir, "traffic_v").select("label"), "label")
    return weighted.groupBy("label").agg(F.round(F.first("weight"), 9).alias("weight"))


# --- evaluation ------------------------------------------------------------
_PRED = """p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p, l_discount + l_quantity / 1000 AS s,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS pc FROM lineitem)"""


def _predictions(spark, sf_dir):
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.when(flag == "R", 1).otherwise(0).alias("y"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("p"),
        (F.col("l_discount") + F.col("l_quantity") / 1000).alias("s"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("c"),
        F.when(F.col("l_quantity") <= 10, 0).when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("pc"),
    )


def _rounded_to_sql(df, *columns):
    """The columns that the query's SQL rounds."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    "binary_metrics",
    f"""WITH {_PRED}, n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
      count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp FROM p)
    SELECT rows, round((tn + tp) / rows, 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, tn, fp, fn, tp FROM n""",
)
def binary_metrics(spark, sf_dir):
    return _rounded_to_sql(evaluation.binary_metrics(_predictions(spark, sf_dir), "y", "p"), "accuracy", "precision", "recall", "f1")


_REPORT = f"""WITH {_PRED}, k AS (SELECT k.k AS class, count(*) FILTER (WHERE c = k.k) AS support, count(*) FILTER (WHERE pc = k.k) AS claimed, count(*) FILTER (WHERE c = k.k AND pc = k.k) AS hits
  FROM p, (VALUES (0), (1), (2)) k(k) GROUP BY k.k),
  r AS (SELECT class, coalesce(hits / nullif(claimed, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2.0 * hits / nullif(claimed + support, 0), 0) AS f1, support, hits FROM k)
"""


@query("class_report", _REPORT + "SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r")
def class_report(spark, sf_dir):
    report = evaluation.class_report(_predictions(spark, sf_dir), "c", "pc").drop("hits")
    return _rounded_to_sql(report, "precision", "recall", "f1")


@query(
    "weighted_metrics",
    _REPORT + """SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(hits) / sum(support), 9) AS accuracy, round(sum(precision * support) / sum(support), 9) AS precision,
      round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1 FROM r""",
)
def weighted_metrics(spark, sf_dir):
    return _rounded_to_sql(evaluation.weighted_metrics(_predictions(spark, sf_dir), "c", "pc"), "accuracy", "precision", "recall", "f1")


@query(
    "roc_auc",
    f"""WITH {_PRED}, s AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM p GROUP BY s),
    o AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT round(sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 9) AS roc_auc, CAST(sum(pos) AS BIGINT) AS positives FROM o""",
)
def roc_auc(spark, sf_dir):
    return _rounded_to_sql(evaluation.roc_auc(_predictions(spark, sf_dir), "y", "s"), "roc_auc")


@query(
    "fold_summary",
    """WITH f AS (SELECT l_linenumber AS fold, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1)
    SELECT 'q' AS metric, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std, count(*) AS folds FROM f UNION ALL SELECT 'd', round(avg(d), 6), round(stddev_pop(d), 6), count(*) FROM f""",
)
def fold_summary(spark, sf_dir):
    folds = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("fold")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return evaluation.fold_summary(folds, ["q", "d"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(
    "combine_engines",
    oracle("report_v", """SELECT id, CASE WHEN random_forest_prediction IS NOT NULL OR xgboost_prediction IS NOT NULL OR isolation_forest_prediction IS NOT NULL THEN 'success'
        WHEN ml_status = 'failed' THEN 'failed' ELSE 'not_available' END AS ml_status,
      CASE WHEN (random_forest_prediction IS NOT NULL)::INT + (xgboost_prediction IS NOT NULL)::INT + (isolation_forest_prediction IS NOT NULL)::INT > 1 THEN 'hybrid'
        WHEN random_forest_prediction IS NOT NULL THEN 'random_forest' WHEN xgboost_prediction IS NOT NULL THEN 'xgboost' WHEN isolation_forest_prediction IS NOT NULL THEN 'isolation_forest' END AS ml_engine,
      coalesce(xgboost_prediction, random_forest_prediction, isolation_forest_prediction) AS ml_prediction,
      CASE WHEN isolation_forest_prediction IS NOT NULL THEN ml_is_anomaly END AS ml_is_anomaly FROM report_v"""),
)
def combine_engines(spark, sf_dir):
    rows = view(spark, sf_dir, "report_v").select(
        "id", "random_forest_prediction", "xgboost_prediction", "isolation_forest_prediction", F.col("ml_is_anomaly").alias("is_anomaly"),
        F.lit(None).cast("double").alias("anomaly_score"), (F.col("ml_status") == "failed").alias("failed"),
    )
    return models.combine_engines(rows).select("id", "ml_status", "ml_engine", "ml_prediction", "ml_is_anomaly")


# --- models ----------------------------------------------------------------
@query(
    "prepared_traffic",
    oracle("traffic_v", f"""SELECT CAST({" + ".join(f"CASE WHEN label = '{c}' THEN {i} ELSE 0 END" for i, c in enumerate(rules.TRAFFIC_CLASSES))} AS INT) AS "Label", least(count(*), {rules.MAX_PER_CLASS}) AS rows
      FROM (SELECT DISTINCT destination_port, duration_seconds, pkts_to_server, pkts_to_client, bytes_to_server, bytes_to_client, syn_flag, fin_flag, psh_flag, ack_flag, label FROM traffic_v) d GROUP BY 1"""),
)
def prepared_traffic(spark, sf_dir):
    return datasets.class_counts(_prepared(spark, sf_dir))


def _train_test(spark, sf_dir):
    split = cut_lineage(datasets.stratified_split(_prepared(spark, sf_dir), "Label", FEATURES))
    return split.filter(~F.col("is_test")), split.filter("is_test")


def _rounded(df, digits=9):
    """Shares and areas add up in the order in which tasks end."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


@query("random_forest_metrics")
def random_forest_metrics(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    nodes = forest.fit(train, FEATURES, "Label", models.FOREST_TREES)
    return _rounded(models.evaluate_classes(models.predict_deep(nodes, test, FEATURES, "Label")))


@query("score_traffic")
def score_traffic(spark, sf_dir):
    """All flows scored by the forest, as a batch job does it."""
    train, _ = _train_test(spark, sf_dir)
    nodes = forest.fit(train, FEATURES, "Label", models.FOREST_TREES)
    return _rounded(models.predict_deep(nodes, _traffic(spark, sf_dir), FEATURES, "flow_id"))


@query("score_with_saved_models")
def score_with_saved_models(spark, sf_dir):
    """Forest, scaler, anomaly trees and offset are stored, read back and only then used."""
    path = run_folder(spark, "models")
    train, _ = _train_test(spark, sf_dir)
    forest.fit(train, FEATURES, "Label", models.FOREST_TREES).write.parquet(f"{path}/forest")
    flows = sensors.with_flow_rates(view(spark, sf_dir, "traffic_v"), "flow_id")
    stats = isolation.scaler_stats(flows, FEATURES)
    scaled = isolation.scale(flows, stats, FEATURES)
    nodes = cut_lineage(isolation.grow_forest(scaled, FEATURES))
    offset = isolation.offset_of(isolation.score(scaled, isolation.load_forest(nodes), FEATURES))
    isolation.save_scorer(nodes, stats, offset, f"{path}/anomaly")
    judged = isolation.score_with_saved(flows, f"{path}/anomaly", FEATURES, "flow_id", *FEATURES).withColumnRenamed("prediction", "anomaly")
    scored = models.predict_deep(spark.read.parquet(f"{path}/forest"), judged, FEATURES, "flow_id", "normality", "anomaly_score", "is_anomaly", "anomaly")
    return _rounded(scored)


@query("boosted_trees_metrics")
def boosted_trees_metrics(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return _rounded(models.evaluate_classes(models.predict_boosted(models.fit_boosted(train, FEATURES), test, FEATURES, "Label")))


@query("cross_validation")
def cross_validation(spark, sf_dir):
    """Mean and deviation of each metric over five folds, each scored by a full forest of the other four."""
    results = models.cross_validate(_prepared(spark, sf_dir), FEATURES)
    return _rounded(evaluation.fold_summary(results, ["accuracy", "precision", "recall", "f1", "roc_auc"]))


@query(
    "most_frequent_values",
    oracle("unsw_v", "\nUNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS feature, {c} AS value, count(*) AS rows FROM unsw_v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 3 DESC, 2 LIMIT 1) x" for c in rules.UNSW_CATEGORICAL)),
)
def most_frequent_values(spark, sf_dir):
    return models.value_modes(view(spark, sf_dir, "unsw_v"), rules.UNSW_CATEGORICAL)


@query(
    "unsw_features",
    oracle("unsw_v", """SELECT id, CAST((SELECT 3 + count(DISTINCT proto) + count(DISTINCT service) + count(DISTINCT state) FROM unsw_v) AS INT) AS inputs, 3 AS set_categories FROM unsw_v"""),
)
def unsw_features(spark, sf_dir):
    """Imputed and one-hot encoded rows: number of inputs and of set categories per row."""
    rows = view(spark, sf_dir, "unsw_v")
    preprocessor, fill = models.unsw_preprocessor(rows, ["dur", "sbytes", "rate"])
    values = vector_to_array("features")
    hot = F.aggregate(F.slice(values, F.lit(4), F.greatest(F.size(values) - 3, F.lit(0))), F.lit(0.0), lambda a, x: a + x)
    return preprocessor.transform(rows.na.fill(fill)).select("id", F.size(values).alias("inputs"), hot.cast("int").alias("set_categories"))


@query("external_evaluation")
def external_evaluation(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir)
    others = _traffic(spark, sf_dir).withColumn("truth", (F.col("Label") != "BENIGN").cast("int"))
    nodes = forest.fit(train, FEATURES, "Label", models.FOREST_TREES)
    return _rounded(models.evaluate_external(models.predict_deep(nodes, others, FEATURES, "truth"), "truth"))


@query("unsw_evaluation")
def unsw_evaluation(spark, sf_dir):
    return _rounded(models.evaluate_unsw(view(spark, sf_dir, "unsw_v"), depth=QUERY_DEPTH))


@query("native_2018_evaluation")
def native_2018_evaluation(spark, sf_dir):
    return _rounded(models.evaluate_native_2018(view(spark, sf_dir, "flow_2018_v"), REFERENCE_2018, depth=QUERY_DEPTH))


@query(
    "scaler_stats",
    oracle("flow_v", "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std FROM flow_v" for f in FEATURES[:4])),
)
def scaler_stats(spark, sf_dir):
    stats = isolation.scaler_stats(view(spark, sf_dir, "flow_v"), FEATURES[:4])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


def _anomalies(spark, sf_dir):
    flows = sensors.with_flow_rates(view(spark, sf_dir, "traffic_v"), "flow_id")
    scaled = isolation.scale(flows, isolation.scaler_stats(flows, FEATURES), FEATURES)
    forest = isolation.load_forest(isolation.grow_forest(scaled, FEATURES))
    scored = cut_lineage(isolation.score(scaled, forest, FEATURES, "flow_id", "alerted"))
    return isolation.judge(scored, isolation.offset_of(scored))


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    """All flows scored by the trees fitted on them."""
    return _rounded(_anomalies(spark, sf_dir).select("flow_id", "normality", "anomaly_score", "is_anomaly", "prediction"))


@query("anomaly_rate")
def anomaly_rate(spark, sf_dir):
    return _rounded(evaluation.anomaly_rate(_anomalies(spark, sf_dir)))


@query("anomaly_metrics")
def anomaly_metrics(spark, sf_dir):
    judged = _anomalies(spark, sf_dir).select(F.col("alerted").cast("int").alias("y"), F.col("is_anomaly").cast("int").alias("p"))
    return _rounded(evaluation.binary_metrics(judged, "y", "p"))


# --- files: what a scan of written files gives back -------------------------
@query("scan_network_files", oracle("eve_line_v", "SELECT count(*) FILTER (WHERE kind = 1) AS extracted, count(*) FILTER (WHERE kind = 4) AS skipped FROM eve_line_v"))
def scan_network_files(spark, sf_dir):
    path = run_folder(spark, "eve")
    view(spark, sf_dir, "eve_line_v").select("raw").write.text(path)
    return sensors.scan_counts(sensors.read_network_events(spark, path))


@query("flow_feature_sink", oracle("eve_line_v", "SELECT count(*) AS rows FROM (SELECT DISTINCT user_id, gap_s, event_id % 10 = 1 FROM eve_line_v WHERE kind = 1) d"))
def flow_feature_sink(spark, sf_dir):
    lines = view(spark, sf_dir, "eve_line_v").select("event_id", "raw")
    path = run_folder(spark, "features")
    sinks.write_features(sensors.flow_features(sensors.flow_events(sensors.parse_lines(lines, "raw", EVE_EVENT))), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


@query("scan_flow_csv", oracle("flow_2018_v", """SELECT trim(Label) AS "Label", count(*) AS rows FROM flow_2018_v WHERE lower(trim(Label)) <> 'label' GROUP BY 1"""))
def scan_flow_csv(spark, sf_dir):
    path = run_folder(spark, "flows")
    view(spark, sf_dir, "flow_2018_v").write.option("header", True).csv(path)
    rows = dataset_files.read_flow_csv(spark, path)
    return datasets.class_counts(datasets.normalise_labels(rows, "cse-cic-ids2018"))


@query("scan_unsw_csv", oracle("unsw_v", "SELECT count(*) AS rows, count(proto) AS with_proto FROM unsw_v"))
def scan_unsw_csv(spark, sf_dir):
    path = run_folder(spark, "unsw")
    view(spark, sf_dir, "unsw_v").write.option("header", True).csv(path)
    return dataset_files.read_unsw_csv(spark, path).agg(F.count(F.lit(1)).alias("rows"), F.count("proto").alias("with_proto"))


@query("metrics_sink", oracle("incidents_v", "SELECT count(*) AS total_incidents FROM incidents_v"))
def metrics_sink(spark, sf_dir):
    path = run_folder(spark, "metrics")
    sinks.write_metrics(operational.dashboard(view(spark, sf_dir, "incidents_v")), path)
    return spark.read.schema("total_incidents BIGINT").json(path)


@query("stored_forest_nodes")
def stored_forest_nodes(spark, sf_dir):
    """The fitted anomaly model written as a table of nodes and read back."""
    flows = sensors.with_flow_rates(view(spark, sf_dir, "traffic_v"), "flow_id")
    scaled = isolation.scale(flows, isolation.scaler_stats(flows, FEATURES), FEATURES)
    path = run_folder(spark, "forest")
    isolation.save_forest(isolation.grow_forest(scaled, FEATURES), path)
    return isolation.read_forest(spark, path)
