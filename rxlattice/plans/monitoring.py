"""Queries for data quality, drift, alerts and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as mo
from ..operators import quality as qu
from ..sources.extract import read_recent
from .binding import table
from .registry import query

_HEAD = "head AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey END AS k, o_custkey AS p, CASE WHEN o_orderkey % 13 = 0 THEN '2021-1-1' ELSE strftime(o_orderdate, '%Y%m%d') END AS d, o_orderstatus AS s FROM orders)"


def _head(spark, sf):
    return table(spark, sf, "orders").selectExpr("case when o_orderkey % 17 = 0 then null else o_orderkey end as k", "o_custkey as p", "case when o_orderkey % 13 = 0 then '2021-1-1' else date_format(o_orderdate, 'yyyyMMdd') end as d", "o_orderstatus as s")


_HEADER_RULES = ("k", "p", "d", "s", ["F", "O"])


@query("validate_header", f"WITH {_HEAD} SELECT 'key_missing' AS rule, CAST(count(*) FILTER (k IS NULL) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows FROM head UNION ALL SELECT 'patient_missing', count(*) FILTER (p IS NULL), count(*) FROM head UNION ALL SELECT 'bad_date', count(*) FILTER (NOT regexp_full_match(d, '[0-9]{{8}}')), count(*) FROM head UNION ALL SELECT 'bad_status', count(*) FILTER (s NOT IN ('F', 'O')), count(*) FROM head")
def _(spark, sf):
    return qu.long_counts(_head(spark, sf), qu.header_rules(*_HEADER_RULES))


@query("header_validity", f"WITH {_HEAD}, b AS (SELECT CAST(k IS NULL AS INT) + CAST(p IS NULL AS INT) + CAST(NOT regexp_full_match(d, '[0-9]{{8}}') AS INT) + CAST(s NOT IN ('F', 'O') AS INT) AS b FROM head), n AS (SELECT count(*) AS n_rows, CAST(sum(b) AS BIGINT) AS n_violations, CAST(count(*) FILTER (b > 0) AS BIGINT) AS n_bad_rows FROM b) SELECT *, 1 - n_violations::DOUBLE / n_rows AS valid_rate, 1 - n_violations::DOUBLE / n_rows >= 0.95 AS passed FROM n")
def _(spark, sf):
    return qu.validity(_head(spark, sf), qu.header_rules(*_HEADER_RULES))


@query("validate_line", "WITH l AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey END AS a, CASE WHEN l_orderkey % 14 = 0 THEN NULL ELSE l_suppkey END AS b, l_quantity - 2 AS d, l_discount - 0.05 AS m FROM lineitem) SELECT 'no_code' AS rule, CAST(count(*) FILTER (a IS NULL AND b IS NULL) AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_rows FROM l UNION ALL SELECT 'days_not_positive', count(*) FILTER (d <= 0), count(*) FROM l UNION ALL SELECT 'amount_negative', count(*) FILTER (m < 0), count(*) FROM l UNION ALL SELECT 'days_too_long', count(*) FILTER (d > 365), count(*) FROM l")
def _(spark, sf):
    l = table(spark, sf, "lineitem").selectExpr("case when l_orderkey % 7 = 0 then null else l_partkey end as a", "case when l_orderkey % 14 = 0 then null else l_suppkey end as b", "l_quantity - 2 as d", "l_discount - 0.05D as m")
    return qu.long_counts(l, qu.line_rules("a", "b", "d", "m"))


@query("quality_header", f"WITH {_HEAD} SELECT 'k' AS column, avg(CAST(k IS NULL AS DOUBLE)) AS null_rate FROM head UNION ALL SELECT 'd', avg(CAST(d IS NULL AS DOUBLE)) FROM head UNION ALL SELECT 's', avg(CAST(s IS NULL AS DOUBLE)) FROM head")
def _(spark, sf):
    return qu.null_rates(_head(spark, sf), ["k", "d", "s"])


@query("quality_line", "WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(n) - count(*) AS BIGINT) AS n_surplus, (sum(n) - count(*))::DOUBLE / sum(n) AS duplicate_rate FROM k")
def _(spark, sf):
    return qu.key_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("file_stats", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS n_f, CAST(min(l_shipdate)::DATE AS VARCHAR) AS first_day, CAST(max(l_shipdate)::DATE AS VARCHAR) AS last_day, count(DISTINCT l_orderkey) AS n_orders FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_linestatus") == "F").alias("n_f"), F.min("l_shipdate").cast("date").cast("string").alias("first_day"), F.max("l_shipdate").cast("date").cast("string").alias("last_day"), F.countDistinct("l_orderkey").alias("n_orders"))


# ---- drift

_EDGES = "e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM lineitem WHERE l_linestatus = 'F')"
_PSI = "sum((greatest(c, 1e-6) - greatest(r, 1e-6)) * ln(greatest(c, 1e-6) / greatest(r, 1e-6)))"


def _two(spark, sf):
    l = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    return l.where("l_linestatus = 'F'"), l.where("l_linestatus = 'O'")


@query("psi_continuous", f"WITH {_EDGES}, b AS (SELECT (SELECT count(*) FROM unnest(edges) u(x) WHERE x <= l_extendedprice) AS bin, l_linestatus FROM lineitem, e), n AS (SELECT bin, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM b GROUP BY 1), s AS (SELECT a / sum(a) OVER ()::DOUBLE AS r, b / sum(b) OVER ()::DOUBLE AS c FROM n) SELECT {_PSI} AS psi FROM s")
def _(spark, sf):
    return mo.psi_continuous(*_two(spark, sf), "l_extendedprice")


@query("psi_categorical", f"WITH n AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1), s AS (SELECT a / sum(a) OVER ()::DOUBLE AS r, b / sum(b) OVER ()::DOUBLE AS c FROM n) SELECT {_PSI} AS psi FROM s")
def _(spark, sf):
    return mo.psi_categorical(*_two(spark, sf), "l_returnflag")


@query("drift_report", f"WITH n AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1), s AS (SELECT a / sum(a) OVER ()::DOUBLE AS r, b / sum(b) OVER ()::DOUBLE AS c FROM n), m AS (SELECT l_quantity, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1), t AS (SELECT a / sum(a) OVER ()::DOUBLE AS r, b / sum(b) OVER ()::DOUBLE AS c FROM m), f AS (SELECT 'l_returnflag' AS feature, {_PSI} AS psi FROM s UNION ALL SELECT 'l_quantity', {_PSI} FROM t) SELECT feature, psi, CASE WHEN psi >= 0.2 THEN 'drift' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END AS status, (sum(CAST(psi >= 0.2 AS INT)) OVER ()) >= 2 AS retrain FROM f")
def _(spark, sf):
    return mo.drift_report(*_two(spark, sf), [], ["l_returnflag", "l_quantity"])


# ---- event log: event_type as level, value as score

_LOG = "log AS (SELECT event_id, ts, user_id, event_type, value, (event_id * 7) % 10 < 3 AS disagree, (event_id * 13) % 997 AS latency FROM events)"


def _log(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "ts", "user_id", "event_type", "value", "(event_id * 7) % 10 < 3 as disagree", "(event_id * 13) % 997 as latency")


@query("disagree_rate", f"WITH {_LOG} SELECT event_type, CAST(count(*) AS BIGINT) AS n, avg(CAST(disagree AS DOUBLE)) AS disagree_rate FROM log GROUP BY 1")
def _(spark, sf):
    return mo.disagreement(_log(spark, sf), [F.col("event_type")])


@query("daily_disagree", f"WITH {_LOG} SELECT CAST(ts::DATE AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS n, avg(CAST(disagree AS DOUBLE)) AS disagree_rate FROM log GROUP BY 1")
def _(spark, sf):
    return mo.disagreement(_log(spark, sf), [F.window("ts", "1 day").start.cast("date").cast("string").alias("day")])


@query("sliding_24h", f"WITH {_LOG}, w AS (SELECT date_trunc('hour', ts) - to_hours(CAST(h AS BIGINT)) AS s, event_id FROM log, range(24) r(h)) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1")
def _(spark, sf):
    return _log(spark, sf).groupBy(F.window("ts", "24 hours", "1 hour").start.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("s", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("latency_histogram", f"WITH {_LOG}, b(le) AS (VALUES (50.0::DOUBLE), (100.0::DOUBLE), (250.0::DOUBLE), (500.0::DOUBLE), (1000.0::DOUBLE)) SELECT event_type, le, CAST(count(*) FILTER (latency <= le) AS BIGINT) AS n FROM log, b GROUP BY 1, 2")
def _(spark, sf):
    return mo.latency_histogram(_log(spark, sf), "latency", [50, 100, 250, 500, 1000], ["event_type"])


_DAILY = f"WITH {_LOG}, d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM log GROUP BY 1, 2), l AS (SELECT *, lag(v, 1) OVER w AS v1, lag(v, 2) OVER w AS v2 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day))"


def _daily(spark, sf):
    return _log(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))


@query("recall_decline", _DAILY + " SELECT event_type, day, v FROM l WHERE v < v1 AND v1 < v2", dates=("day",))
def _(spark, sf):
    return mo.declines(_daily(spark, sf), "v", "day", ["event_type"])


@query("alerts", _DAILY + f" SELECT 'decline' AS kind, event_type AS subject, CAST(count(*) AS BIGINT) AS n FROM l WHERE v < v1 AND v1 < v2 GROUP BY 2 UNION ALL SELECT 'disagreement', event_type, count(*) FILTER (disagree) FROM log GROUP BY 2 HAVING avg(CAST(disagree AS DOUBLE)) > 0.25")
def _(spark, sf):
    fall = mo.declines(_daily(spark, sf), "v", "day", ["event_type"]).groupBy(F.col("event_type").alias("subject")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("decline").alias("kind"), "subject", "n")
    dis = _log(spark, sf).groupBy(F.col("event_type").alias("subject")).agg(F.count_if("disagree").alias("n"), F.avg(F.col("disagree").cast("double")).alias("r")).where("r > 0.25").select(F.lit("disagreement").alias("kind"), "subject", "n")
    return fall.unionByName(dis)


_PSI_OF = f"(SELECT {_PSI} FROM (SELECT a / sum(a) OVER ()::DOUBLE AS r, b / sum(b) OVER ()::DOUBLE AS c FROM (SELECT {{bin}} AS bin, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)))"


def _bins(column: str) -> str:
    edges = f"(SELECT list_distinct(quantile_cont({column}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM lineitem WHERE l_linestatus = 'F')"
    return f"len(list_filter({edges}, lambda x: x <= {column}))"


_DRIFT = "dr AS (SELECT *, CASE WHEN psi >= 0.2 THEN 'drift' WHEN psi >= 0.1 THEN 'watch' ELSE 'stable' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_PSI_OF.format(bin=_bins(c) if c in ('l_extendedprice', 'l_quantity') else c)} AS psi" for c in ("l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
) + "))"
_COLUMNS = ["l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus"]


@query("drift_auto", f"WITH {_DRIFT} SELECT *, (SELECT count(*) FILTER (status = 'drift') >= 2 FROM dr) AS retrain FROM dr")
def _(spark, sf):
    return mo.auto_drift(*_two(spark, sf), _COLUMNS)


_RULES = _DAILY + f""", {_DRIFT}, n AS (SELECT count(*) FILTER (status = 'drift') AS bad, count(*) FILTER (status = 'watch') AS watched FROM dr), ru AS (
  SELECT 'drift' AS kind, CASE WHEN bad >= 2 THEN 'critical' WHEN watched > 0 THEN 'warning' END AS severity, 'features' AS subject, CAST(CASE WHEN bad >= 2 THEN bad ELSE watched END AS BIGINT) AS n FROM n
  UNION ALL SELECT 'decline', 'critical', event_type, count(*) FROM l WHERE v < v1 AND v1 < v2 GROUP BY event_type
  UNION ALL SELECT 'disagreement', CASE WHEN avg(CAST(disagree AS DOUBLE)) >= 0.30 THEN 'critical' WHEN avg(CAST(disagree AS DOUBLE)) >= 0.15 THEN 'warning' END, event_type, count(*) FILTER (disagree) FROM log GROUP BY event_type
  UNION ALL SELECT 'knowledge', 'info', 'rules', count(*) FROM part WHERE p_size = 50 HAVING count(*) > 0)"""


def _rule_alerts(spark, sf):
    log = _log(spark, sf)
    fall = mo.declines(_daily(spark, sf), "v", "day", ["event_type"]).groupBy(F.col("event_type").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    apart = log.groupBy(F.col("event_type").alias("subject")).agg(F.count_if("disagree").alias("n"), F.avg(F.col("disagree").cast("double")).alias("rate"))
    new = table(spark, sf, "part").where("p_size = 50").agg(F.count(F.lit(1)).alias("n"))
    return mo.rule_alerts(mo.auto_drift(*_two(spark, sf), _COLUMNS), fall, apart, new)


@query("alert_rules", _RULES + " SELECT kind, severity, subject, n FROM ru WHERE severity IS NOT NULL")
def _(spark, sf):
    return _rule_alerts(spark, sf)


@query("alert_log", f"WITH {_LOG}, a AS (SELECT CAST(ts::DATE AS VARCHAR) AS day, CASE WHEN avg(CAST(disagree AS DOUBLE)) >= 0.30 THEN 'critical' ELSE 'warning' END AS severity, event_type AS subject, count(*) FILTER (disagree) AS n FROM log GROUP BY 1, event_type HAVING avg(CAST(disagree AS DOUBLE)) >= 0.15), r AS (SELECT DISTINCT day FROM a ORDER BY day DESC LIMIT 7) SELECT severity, CAST(count(*) AS BIGINT) AS n_alerts, CAST(sum(n) AS BIGINT) AS n FROM a WHERE day IN (SELECT day FROM r) GROUP BY 1")
def _(spark, sf):
    """Alerts of every day are kept as files; the last seven days are read back and counted by severity."""
    from ..sources import files
    from ..tables import folder

    by = _log(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("subject")).agg(F.count_if("disagree").alias("n"), F.avg(F.col("disagree").cast("double")).alias("rate"))
    alerts = by.where("rate >= 0.15").select("day", F.when(F.col("rate") >= 0.30, "critical").otherwise("warning").alias("severity"), F.lit("disagreement").alias("kind"), "subject", "n")
    path = folder(spark, "alerts")
    files.append_alerts(alerts, path)
    return read_recent(spark, path, "day", "severity string, kind string, subject string, n long", 7).groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"), F.sum("n").alias("n"))


@query("latest_result", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts)::DATE::VARCHAR AS day FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").cast("date").cast("string").alias("day"))


@query("y_other_drift", "WITH p AS (SELECT ts < TIMESTAMP '2024-01-16' AS old, avg(CAST(event_type = 'click' AS DOUBLE)) AS r, count(*) AS n FROM events GROUP BY 1) SELECT a.r AS base_rate, b.r AS rate, b.r - a.r > 0.05 OR b.r > 0.2 AS alert FROM p a, p b WHERE a.old AND NOT b.old")
def _(spark, sf):
    old, hit = F.col("ts") < F.lit("2024-01-16").cast("timestamp"), (F.col("event_type") == "click").cast("double")
    r = table(spark, sf, "events").agg(F.avg(F.when(old, hit)).alias("base_rate"), F.avg(F.when(~old, hit)).alias("rate"))
    return r.withColumn("alert", (F.col("rate") - F.col("base_rate") > 0.05) | (F.col("rate") > 0.2))


@query("feedback_rate", "WITH f AS (SELECT event_type, l.quality FROM events e JOIN labels l ON l.doc_id = e.event_id) SELECT event_type, CAST(count(*) AS BIGINT) AS n, avg(quality) AS accepted FROM f GROUP BY 1")
def _(spark, sf):
    e, l = table(spark, sf, "events").select("event_id", "event_type"), table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), "quality")
    return e.join(l, "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("accepted"))


@query("high_risk_rate", f"WITH {_LOG} SELECT CAST(ts::DATE AS VARCHAR) AS day, avg(CAST(value > 80 AS DOUBLE)) AS rate FROM log GROUP BY 1")
def _(spark, sf):
    return _log(spark, sf).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.avg((F.col("value") > 80).cast("double")).alias("rate"))
