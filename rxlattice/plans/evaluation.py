"""Queries for metrics, thresholds and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as me
from ..operators import monitoring as mo
from .binding import SCORED, scored, table
from .registry import query

WITH = f"WITH {SCORED}"
_CONF = "CAST(count(*) FILTER (y = 1 AND score >= {t}) AS BIGINT) AS tp, CAST(count(*) FILTER (y = 0 AND score >= {t}) AS BIGINT) AS fp, CAST(count(*) FILTER (y = 0 AND score < {t}) AS BIGINT) AS tn, CAST(count(*) FILTER (y = 1 AND score < {t}) AS BIGINT) AS fn"
_RATES = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fp + tn + fn = 0 THEN 0 ELSE (tp + tn)::DOUBLE / (tp + fp + tn + fn) END AS accuracy, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1"
_CURVE = f"{WITH}, b AS (SELECT score, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM scored GROUP BY 1), curve AS (SELECT *, (sum(n_pos) OVER (ORDER BY score DESC))::BIGINT AS tp, (sum(n_neg) OVER (ORDER BY score DESC))::BIGINT AS fp, (sum(n_pos) OVER ())::BIGINT AS pos, (sum(n_neg) OVER ())::BIGINT AS neg FROM b)"


@query("confusion", f"{WITH}, c AS (SELECT {_CONF.format(t=0.5)} FROM scored) SELECT *, {_RATES} FROM c")
def _(spark, sf):
    return me.confusion(scored(spark, sf))


@query("eval_splits", f"{WITH}, c AS (SELECT grp, {_CONF.format(t=0.3)} FROM scored GROUP BY 1) SELECT *, {_RATES} FROM c")
def _(spark, sf):
    return me.confusion(scored(spark, sf), 0.3, ("grp",))


@query("roc_auc", _CURVE + " SELECT sum(n_pos * (neg - fp + n_neg / 2.0))::DOUBLE / (max(pos) * max(neg)) AS roc_auc FROM curve")
def _(spark, sf):
    return me.roc_auc(scored(spark, sf))


@query("pr_curve", _CURVE + " SELECT score, tp, fp, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / pos AS recall FROM curve")
def _(spark, sf):
    return me.pr_curve(scored(spark, sf))


@query("pr_auc", _CURVE + ", l AS (SELECT *, lag(tp::DOUBLE / (tp + fp), 1, 1.0) OVER (ORDER BY score DESC) AS before, 2.0::DOUBLE * tp / (tp + fp + pos) AS f1 FROM curve) SELECT sum(n_pos::DOUBLE / pos * (before + tp::DOUBLE / (tp + fp)) / 2) AS pr_auc, max(f1) AS best_f1, arg_max(score, (f1, score)) AS best_threshold FROM l")
def _(spark, sf):
    return me.pr_auc(scored(spark, sf))


@query("threshold_recall", _CURVE + ", r AS (SELECT score, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / pos AS recall FROM curve) SELECT score, precision, recall FROM r WHERE recall >= 0.9 ORDER BY precision DESC, score DESC LIMIT 1")
def _(spark, sf):
    return me.threshold_for_recall(scored(spark, sf))


@query("threshold_cost", f"{WITH}, t AS (SELECT i / 100.0::DOUBLE AS tau, i FROM range(10, 91) r(i)), b AS (SELECT y, CAST(floor(score * 100 + 1e-9) AS INT) AS k FROM scored) SELECT tau, CAST(count(*) FILTER (y = 1 AND k < i) AS BIGINT) AS fn, CAST(count(*) FILTER (y = 0 AND k >= i) AS BIGINT) AS fp, (count(*) FILTER (y = 1 AND k < i) * 5.0 + count(*) FILTER (y = 0 AND k >= i))::DOUBLE AS cost FROM t, b GROUP BY 1")
def _(spark, sf):
    return me.threshold_costs(scored(spark, sf))


@query("tau_sweep", _CURVE + ", f(floor) AS (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE)), r AS (SELECT floor, score, tp, fp, pos, tp::DOUBLE / pos AS recall, row_number() OVER (PARTITION BY floor ORDER BY score DESC) AS n FROM curve, f WHERE tp::DOUBLE / pos >= floor) SELECT floor, score AS tau, recall, tp + fp AS traffic, pos - tp AS leaked FROM r WHERE n = 1")
def _(spark, sf):
    return me.tau_sweep(scored(spark, sf), [0.8, 0.9, 0.95])


_FLOORS = [0.5, 0.8, 0.9, 0.95, 0.99, 1.5]
_PAIRS = _CURVE + f""", f(floor) AS (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in _FLOORS)}])), e AS (SELECT floor, CASE WHEN floor > 1 THEN 'recall floor ' || floor || ' lies outside (0, 1]' WHEN floor >= 0.98 THEN 'target 0.98 isn''t above the floor ' || floor END AS error FROM f),
  r AS (SELECT floor, score, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / pos AS recall FROM curve, e WHERE error IS NULL),
  red AS (SELECT floor, score AS tau_red FROM r WHERE recall >= floor QUALIFY row_number() OVER (PARTITION BY floor ORDER BY precision DESC, score) = 1),
  rev AS (SELECT floor, max(score) AS review FROM r WHERE recall >= 0.98 GROUP BY 1),
  t AS (SELECT floor, tau_red, CASE WHEN review >= tau_red THEN greatest(0, tau_red - 1e-6) ELSE review END AS tau_review, review >= tau_red AS collapsed FROM red JOIN rev USING (floor)),
  k AS (SELECT t.*, count(*) FILTER (score >= tau_red AND y = 1) AS tp, count(*) FILTER (score >= tau_red) AS n_red, count(*) FILTER (score >= tau_review AND score < tau_red) AS n_review, count(*) FILTER (score < tau_review) AS n_clean, count(*) FILTER (score < tau_review AND y = 1) AS red_lost, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM scored, t GROUP BY ALL)"""


@query("threshold_pairs", _PAIRS + " SELECT floor, error, tau_red, tau_review, collapsed, tp::DOUBLE / pos AS recall, tp::DOUBLE / n_red AS precision, n_red, n_review, n_clean, 100.0::DOUBLE * (n_review + n_clean) / n AS second_stage_pct, pos - tp AS red_missed, red_lost, 100.0::DOUBLE * red_lost / pos AS leakage_pct FROM e LEFT JOIN k USING (floor)")
def _(spark, sf):
    return me.threshold_pairs(scored(spark, sf), _FLOORS)


@query("best_pair", _CURVE + " SELECT round(a.fp + 0.2 * (b.tp + b.fp - a.tp - a.fp) + 20.0 * (b.pos - b.tp), 6)::DOUBLE AS cost, a.score AS tau_red, b.score AS tau_review, a.tp AS red_tp, a.fp AS red_fp FROM curve a JOIN curve b ON b.score < a.score WHERE b.tp::DOUBLE / b.pos >= 0.5 ORDER BY 1, 2, 3 LIMIT 1")
def _(spark, sf):
    return me.best_pair(scored(spark, sf), target=0.5)


@query("topk_metrics", f"{WITH}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n, count(*) OVER () AS a, sum(y) OVER () AS p FROM scored), s(share) AS (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) SELECT share, CAST(ceil(a * share) AS BIGINT) AS k, CAST(sum(y) AS BIGINT) AS hits, sum(y)::DOUBLE / ceil(a * share) AS precision, sum(y)::DOUBLE / p AS recall FROM r, s WHERE n <= ceil(a * share) GROUP BY share, a, p")
def _(spark, sf):
    return me.top_share(scored(spark, sf), [0.01, 0.05])


_CLASS = "CASE WHEN score >= 0.7 THEN 'Red' WHEN score >= 0.4 THEN 'Yellow' WHEN score >= 0.2 THEN 'Green' ELSE 'Normal' END"
_TRUTH = "CASE WHEN y2 = 1 THEN 'Red' WHEN y = 0 THEN 'Yellow' WHEN id % 3 = 0 THEN 'Green' ELSE 'Normal' END"


def _classes(spark, sf):
    from ..operators.rules import probability_level

    truth = F.when(F.col("y2") == 1, "Red").when(F.col("y") == 0, "Yellow").when(F.col("id") % 3 == 0, "Green").otherwise("Normal")
    return scored(spark, sf).select("id", truth.alias("truth"), probability_level(F.col("score")).alias("predicted"))


@query("stage_metrics", f"{WITH}, m AS (SELECT {_TRUTH} AS t, {_CLASS} AS p FROM scored), c(cls) AS (VALUES ('Red'), ('Yellow'), ('Green'), ('Normal')), n AS (SELECT cls, CAST(count(*) FILTER (t = cls AND p = cls) AS BIGINT) AS tp, CAST(count(*) FILTER (t = cls) AS BIGINT) AS actual, CAST(count(*) FILTER (p = cls) AS BIGINT) AS called FROM m, c GROUP BY 1) SELECT cls, tp, actual, called, CASE WHEN called = 0 THEN 0 ELSE tp::DOUBLE / called END AS precision, CASE WHEN actual = 0 THEN 0 ELSE tp::DOUBLE / actual END AS recall, 2.0::DOUBLE * tp / (actual + called) AS f1 FROM n")
def _(spark, sf):
    return me.class_metrics(_classes(spark, sf), "truth", "predicted")


#: Seven classes of the second stage, and of what was predicted, from the score and the id.
_SEVEN = ["Y_DDI_MAJOR", "Y_TRIPLE", "Y_DOUBLE", "Y_DDI_MOD", "Y_DUP", "Y_FRAG", "Green"]
_SEVEN_SQL = "[" + ", ".join(f"'{c}'" for c in _SEVEN) + "]"


@query("confusion_matrix", f"""{WITH}, m AS (SELECT {_SEVEN_SQL}[CAST(1 + id % 7 AS INT)] AS t, {_SEVEN_SQL}[CAST(1 + CASE WHEN score < 0.6 THEN id % 7 ELSE (id + y) % 5 END AS INT)] AS p FROM scored), c AS (SELECT unnest({_SEVEN_SQL}) AS cls), n AS (SELECT a.cls AS truth, b.cls AS predicted, (SELECT count(*) FROM m WHERE t = a.cls AND p = b.cls) AS n FROM c a, c b),
  f AS (SELECT avg(coalesce(2.0::DOUBLE * tp / nullif(called + actual, 0), 0)) AS macro_f1 FROM (SELECT cls, (SELECT count(*) FROM m WHERE t = cls AND p = cls) AS tp, (SELECT count(*) FROM m WHERE p = cls) AS called, (SELECT count(*) FROM m WHERE t = cls) AS actual FROM c)) SELECT truth, predicted, n, macro_f1 FROM n, f""")
def _(spark, sf):
    classes = F.array(*(F.lit(c) for c in _SEVEN))
    called = F.when(F.col("score") < 0.6, F.col("id") % 7).otherwise((F.col("id") + F.col("y")) % 5)
    s = scored(spark, sf).select(F.element_at(classes, (F.col("id") % 7 + 1).cast("int")).alias("t"), F.element_at(classes, (called + 1).cast("int")).alias("p"))
    return me.confusion_matrix(s, "t", "p", _SEVEN)


@query("misclassified", f"{WITH}, m AS (SELECT {_TRUTH} AS truth, {_CLASS} AS predicted FROM scored), k AS (SELECT *, CASE predicted WHEN 'Red' THEN 3 WHEN 'Yellow' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END - CASE truth WHEN 'Red' THEN 3 WHEN 'Yellow' THEN 2 WHEN 'Green' THEN 1 ELSE 0 END AS d FROM m WHERE truth <> predicted) SELECT truth, predicted, CASE WHEN d > 0 THEN 'over' ELSE 'under' END AS kind, abs(d) AS distance, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    from ..operators.rules import level_code

    m = _classes(spark, sf).where("truth <> predicted")
    d = level_code(F.col("predicted")) - level_code(F.col("truth"))
    return m.groupBy("truth", "predicted", F.when(d > 0, "over").otherwise("under").alias("kind"), F.abs(d).alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@query("kappa", "WITH m AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS o, count(*) FILTER (quality = 1) AS a, count(*) FILTER (toxic = 1) AS b FROM labels), p AS (SELECT n, o::DOUBLE / n AS po, (a * b + (n - a) * (n - b))::DOUBLE / (n * n) AS pe FROM m) SELECT n, po AS agreement, CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM p")
def _(spark, sf):
    return me.kappa(table(spark, sf, "labels"), "quality", "toxic")


@query("brier", f"{WITH} SELECT grp, avg((score - y) * (score - y)) AS brier, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1")
def _(spark, sf):
    return me.brier(scored(spark, sf), ("grp",))


@query("fold_pool", f"{WITH}, f AS (SELECT id % 5 AS fold, {_CONF.format(t=0.5)}, avg(score) AS m FROM scored GROUP BY 1), p AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn, avg(m) AS m_mean, stddev_pop(m) AS m_std FROM f) SELECT *, {_RATES} FROM p")
def _(spark, sf):
    s = scored(spark, sf).withColumn("fold", F.col("id") % 5)
    folds = me.confusion(s, 0.5, ("fold",)).join(s.groupBy("fold").agg(F.avg("score").alias("m")), "fold")
    return me.pooled(folds.select("tp", "fp", "tn", "fn", "m"), ["m"])


@query("blend", f"{WITH} SELECT id, CASE WHEN id % 4 = 0 THEN score ELSE (score * 0.6 + (1 - score) * 0.4) END AS p FROM scored")
def _(spark, sf):
    s = scored(spark, sf).withColumn("b", F.when(F.col("id") % 4 != 0, 1 - F.col("score")))
    return s.select("id", me.blend({"score": 0.6, "b": 0.4}).alias("p"))


_GROUPS = "(VALUES ('all'), ('en'), ('odd'), ('long')) v(subgroup)"
_IN = "(subgroup = 'all' OR (subgroup = 'en' AND grp = 'en') OR (subgroup = 'odd' AND id % 2 = 1) OR (subgroup = 'long' AND score >= 0.5))"


def _performance(spark, sf):
    groups = {"all": F.lit(True), "en": F.col("grp") == "en", "odd": F.col("id") % 2 == 1, "long": F.col("score") >= 0.5}
    return mo.subgroup_performance(scored(spark, sf), groups)


_PERF = f"{WITH}, c AS (SELECT subgroup, {_CONF.format(t=0.5)} FROM scored, {_GROUPS} WHERE {_IN} GROUP BY 1), perf AS (SELECT *, {_RATES}, tp + fp + tn + fn AS n FROM c WHERE tp + fp + tn + fn >= 30)"


@query("subgroup_perf", _PERF + " SELECT * FROM perf")
def _(spark, sf):
    return _performance(spark, sf)


@query("fairness_gap", _PERF + " SELECT p.subgroup, a.recall - p.recall AS gap, abs(a.recall - p.recall) <= 0.05 AS fair FROM perf p, (SELECT recall FROM perf WHERE subgroup = 'all') a")
def _(spark, sf):
    p = _performance(spark, sf)
    overall = p.where("subgroup = 'all'").select(F.col("recall").alias("r"))
    return p.crossJoin(F.broadcast(overall)).select("subgroup", (F.col("r") - F.col("recall")).alias("gap"), (F.abs(F.col("r") - F.col("recall")) <= 0.05).alias("fair"))


@query("degradation", _PERF + ", b AS (SELECT subgroup, recall + 0.07 AS recall, precision AS precision FROM perf), u AS (SELECT p.subgroup, 'recall' AS metric, p.recall AS now, b.recall AS base FROM perf p JOIN b USING (subgroup) UNION ALL SELECT p.subgroup, 'precision', p.precision, b.precision FROM perf p JOIN b USING (subgroup)) SELECT subgroup, metric, now, base, base - now AS fall, CASE WHEN base - now >= 0.1 THEN 'critical' WHEN base - now >= 0.05 THEN 'warning' ELSE 'none' END AS alert FROM u")
def _(spark, sf):
    p = _performance(spark, sf)
    return mo.degradation(p, p.withColumn("recall", F.col("recall") + 0.07), ["recall", "precision"])
