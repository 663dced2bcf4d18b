"""Queries for sources, sinks, streams and trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear, ml
from ..operators import retrain as retraining
from ..operators import sampling as sp
from ..sources import files
from ..streaming import jobs
from ..tables import folder, saved, spread
from .binding import RX, demographics, rx, table
from .registry import query

WITH = f"WITH {RX}"


@query("table_profile", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(l_shipdate)::DATE AS VARCHAR) AS first_day, CAST(max(l_shipdate)::DATE AS VARCHAR) AS last_day, count(DISTINCT l_partkey) AS n_keys FROM lineitem")
def _(spark, sf):
    return files.table_profile(table(spark, sf, "lineitem"), "l_shipdate", "l_partkey")


@query("coverage", "SELECT strftime(l_shipdate, '%Y%m') AS month, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT l_shipdate::DATE) AS n_days FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.date_format("l_shipdate", "yyyyMM").alias("month")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.to_date("l_shipdate")).alias("n_days"))


@query("missing_days", "SELECT CAST(d AS VARCHAR) AS day FROM (SELECT CAST(DATE '1995-01-01' + CAST(i AS INT) AS DATE) AS d FROM range(2600) r(i)) WHERE d NOT IN (SELECT l_shipdate::DATE FROM lineitem)")
def _(spark, sf):
    return files.missing_days(table(spark, sf, "lineitem"), "l_shipdate", "1995-01-01", "2002-02-12").select(F.col("day").cast("string").alias("day"))


@query("dated_scan", "SELECT event_id, user_id, event_type, CAST(ts::DATE AS VARCHAR) AS dt FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'")
def _(spark, sf):
    path = folder(spark, "dated")
    files.write_dated(table(spark, sf, "events"), path, "ts")
    pruned = spark.read.parquet(path).where("dt between date '2024-01-10' and date '2024-01-16'")
    return pruned.select("event_id", "user_id", "event_type", F.col("dt").cast("string").alias("dt"))


@query("subset_extract", f"{WITH} SELECT patient_id, drug_id, CAST(count(*) AS BIGINT) AS n FROM rx WHERE start_date <= DATE '1999-06-30' AND end_date >= DATE '1999-06-01' AND patient_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1, 2")
def _(spark, sf):
    ids = demographics(spark, sf).where("region < 5")
    return files.subset(rx(spark, sf), "1999-06-01", "1999-06-30", ids).groupBy("patient_id", "drug_id").agg(F.count(F.lit(1)).alias("n"))


# ---- streams over the event log; their static twins are monitoring queries


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return files.stream_table(spark, sf, "events", schema).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("disagree", F.col("event_id") * 7 % 10 < 3)


@query("stream_recent", "SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def _(spark, sf):
    return jobs.run(jobs.recent(event_stream(spark, sf), "click").select("event_id", "user_id"), "recent").select("event_id", "user_id")


@query("stream_daily", "SELECT CAST(ts::DATE AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, avg(CAST((event_id * 7) % 10 < 3 AS DOUBLE)) AS disagree_rate FROM events GROUP BY 1")
def _(spark, sf):
    return jobs.run(jobs.windows(event_stream(spark, sf), "1 day"), "daily", "complete").select(F.col("start").cast("date").cast("string").alias("day"), "n", "disagree_rate")


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def _(spark, sf):
    return jobs.run(jobs.without_repeats(event_stream(spark, sf), ["event_id"]).select("event_id"), "dedup").agg(F.count(F.lit(1)).alias("n"))


@query("stream_features", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(max(ts)::DATE AS VARCHAR) AS day FROM events GROUP BY 1")
def _(spark, sf):
    return jobs.upsert_features(event_stream(spark, sf)).select("user_id", "n", F.col("last_ts").cast("date").cast("string").alias("day"))


@query("stream_active", "WITH l AS (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) SELECT user_id, CAST(count(*) AS BIGINT) AS n_seen, CAST(count(*) FILTER (floor(epoch(ts)) + 86400 * (1 + event_id % 5) > epoch(m)) AS BIGINT) AS n_active FROM events JOIN l USING (user_id) GROUP BY 1")
def _(spark, sf):
    log = event_stream(spark, sf).select("user_id", "ts", (F.unix_timestamp("ts") + 86400 * (1 + F.col("event_id") % 5)).alias("ends_at"))
    return jobs.run(jobs.active_state(log), "active", "update", ("user_id",)).select("user_id", "n_seen", "n_active")


@query("stream_prefer", "SELECT user_id, CAST(ts::DATE AS VARCHAR) AS day, min(event_type) AS source FROM events GROUP BY 1, 2")
def _(spark, sf):
    log = event_stream(spark, sf).select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("source"), "ts")
    return jobs.run(jobs.preferred(log, ["user_id", "day"], "source"), "prefer", "update", ("user_id", "day"))


@query("stream_decline", "WITH d AS (SELECT event_type, CAST(ts::DATE AS VARCHAR) AS day, avg(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, lag(v, 1) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, day, v FROM l WHERE v < v1 AND v1 < v2")
def _(spark, sf):
    from ..operators.monitoring import declines

    days = jobs.run(jobs.means(event_stream(spark, sf), ["event_type"], "value"), "means", "complete")
    return declines(days.select("event_type", F.col("start").cast("date").cast("string").alias("day"), "v"), "v", "day", ["event_type"])


# ---- models


def _patients(spark, sf):
    """(label, numbers and split of each patient; codes of each patient), from lines shuffled once by patient."""
    r = spread(rx(spark, sf).select("patient_id", "institution_id", "drug_id", "total_days"), "patient_id")
    # Written once, as each step of the split reads it; a row a patient is small beside its lines.
    counts = saved(_shapes(r), "patients")
    middle = counts.agg(F.avg("places").alias("middle"))
    label = counts.crossJoin(F.broadcast(middle)).select("patient_id", (F.col("places") > F.col("middle")).cast("int").alias("label"), "drugs", "days", "lines")
    return saved(sp.split(label, "label", "patient_id"), "labels"), ml.code_lists(r.select("patient_id", "drug_id"), "drug_id")


@query("train_linear")
def _(spark, sf):
    label, codes = _patients(spark, sf)
    data = saved(label.join(codes, "patient_id"), "training")
    scored = linear.fit(data.where("split = 'train'")).score(data.where("split <> 'train'"))
    from ..operators.metrics import pr_auc, roc_auc

    s = saved(scored.select("patient_id", F.col("label").alias("y"), "score"), "scored")
    return roc_auc(s).crossJoin(pr_auc(s)).select("roc_auc", "pr_auc", "best_f1", "best_threshold")


@query("train_trees")
def _(spark, sf):
    label, _ = _patients(spark, sf)
    columns = ["drugs", "days", "lines"]
    model = ml.tree_model(columns).fit(label.where("split = 'train'"))
    return ml.importances(model, label, columns)


@query("batch_score")
def _(spark, sf):
    """Rows outside the training split, scored and calibrated on the validation split."""
    label, codes = _patients(spark, sf)
    data = saved(label.join(codes, "patient_id"), "training")
    model = linear.fit(data.where("split = 'train'"))
    return ml.calibrated(saved(model.score(data.where("split = 'val'")), "scored"), model.score(data.where("split = 'test'")))


@query("model_comparison")
def _(spark, sf):
    """Linear and tree model side by side on the same held-out patients: AUC, PR AUC, best F1 of each."""
    from ..operators.metrics import pr_auc, roc_auc

    label, codes = _patients(spark, sf)
    data = saved(label.join(codes, "patient_id"), "training")
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    rows = None
    trees = ml.tree_model(["drugs", "days", "lines"]).fit(train)
    for name, scored in (("linear", linear.fit(train).score(test)), ("trees", ml.score(trees, test))):
        s = saved(scored.select("patient_id", F.col("label").alias("y"), "score"), "scored")
        part = roc_auc(s).crossJoin(pr_auc(s)).select(F.lit(name).alias("model"), "roc_auc", "pr_auc", "best_f1")
        rows = part if rows is None else rows.unionByName(part)
    return rows


_SHAPE = ["places", "drugs", "days", "lines"]
_LATER = "DATE '1998-01-01'"


def _shapes(lines):
    """One row of numbers per patient from the lines given."""
    return lines.groupBy("patient_id").agg(F.countDistinct("institution_id").alias("places"), F.countDistinct("drug_id").alias("drugs"), F.avg("total_days").alias("days"), F.count(F.lit(1)).alias("lines"))


def _shape_periods(spark, sf):
    r = rx(spark, sf).select("patient_id", "institution_id", "drug_id", "total_days", "start_date")
    return _shapes(r.where("start_date < date '1998-01-01'")), _shapes(r.where("start_date >= date '1998-01-01'"))


def _saved_reference(spark, sf):
    """Reference distribution of the earlier period, saved and read back."""
    train, later = _shape_periods(spark, sf)
    path = folder(spark, "reference")
    retraining.reference(train, _SHAPE).write.parquet(path)
    return spark.read.parquet(path), later


_SHAPES_SQL = f"""{WITH}, shapes AS (SELECT patient_id, start_date >= {_LATER} AS later, count(DISTINCT institution_id)::DOUBLE AS places, count(DISTINCT drug_id)::DOUBLE AS drugs, avg(total_days) AS days, count(*)::DOUBLE AS lines FROM rx GROUP BY 1, 2),
  cells AS (SELECT later, unnest(['places', 'drugs', 'days', 'lines']) AS feature, unnest([places, drugs, days, lines]) AS v FROM shapes),
  edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM cells WHERE NOT later GROUP BY 1),
  binned AS (SELECT later, feature, len(list_filter(edges, lambda e: e <= v)) AS bin FROM cells JOIN edges USING (feature)),
  shares AS (SELECT feature, bin, later, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY feature, later) AS share FROM binned GROUP BY 1, 2, 3),
  grid AS (SELECT feature, unnest(range(0, len(edges) + 1)) AS bin, edges FROM edges)"""


@query("drift_reference", _SHAPES_SQL + " SELECT feature, CAST(bin AS INT) AS bin, edges[bin + 1] AS upper, coalesce(share, 0) AS share FROM grid LEFT JOIN (SELECT * FROM shares WHERE NOT later) USING (feature, bin)")
def _(spark, sf):
    saved_reference, _ = _saved_reference(spark, sf)
    return saved_reference.select("feature", "edges", F.posexplode("shares").alias("bin", "share")).select("feature", "bin", F.get("edges", "bin").alias("upper"), "share")


@query("drift_saved", _SHAPES_SQL + """, p AS (SELECT feature, greatest(coalesce(a.share, 0), 1e-6) AS r, greatest(coalesce(b.share, 0), 1e-6) AS c FROM grid LEFT JOIN (SELECT * FROM shares WHERE NOT later) a USING (feature, bin) LEFT JOIN (SELECT * FROM shares WHERE later) b USING (feature, bin)),
  s AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM p GROUP BY 1) SELECT feature, psi, CASE WHEN psi >= 0.2 THEN 'drift' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END AS status FROM s""")
def _(spark, sf):
    return retraining.drift(*_saved_reference(spark, sf))


@query("retrain_report")
def _(spark, sf):
    """Raw days to features to a saved model, then the later period scored by what was saved."""
    early, late = _shape_periods(spark, sf)
    middle = F.broadcast(saved(early.agg(F.avg("places").alias("middle")), "middle"))
    train, later = (saved(part.crossJoin(middle).withColumn("label", (F.col("places") > F.col("middle")).cast("int")), "shapes") for part in (early, late))
    product = retraining.retrain(train, _SHAPE[1:], folder(spark, "product"))
    return retraining.report(retraining.load(spark, product.path), later)


@query("pair_dataset")
def _(spark, sf):
    """Positives (severe pairs) and five negatives each, by hash order, with an 80/10/10 split."""
    from ..operators.knowledge import pair_dedup
    from .knowledge import pairs

    def save(df):
        return saved(df, "pairs")

    rated = save(pair_dedup(pairs(spark, sf)).where("id_lo <> id_hi").select("id_lo", "id_hi", "rank"))
    pos = rated.where("rank >= 3").select("id_lo", "id_hi")
    neg = sp.negative_pairs(pos, rated, 5, save)
    share = F.pmod(F.xxhash64("id_lo", "id_hi"), F.lit(10))
    both = pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
    return both.withColumn("split", F.when(share < 8, "train").when(share == 8, "val").otherwise("test"))
