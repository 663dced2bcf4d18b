"""Evaluation metrics. Scores are grouped first, so curves run over distinct scores, not rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved


def confusion(df: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates at a threshold (columns y 0/1, score)."""
    y, p = F.col("y") == 1, F.col("score") >= threshold
    got = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    return got.withColumns(rates())


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def rates() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {"recall": _ratio(tp, tp + fn), "precision": _ratio(tp, tp + fp), "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def _range(score: Column) -> Column:
    """A number that rises with the score: its binary exponent and the eight bits after it, for any scale of scores."""
    size = F.abs(score)
    exponent = F.floor(F.log2(size))
    place = F.when(size == 0, -600_000).otherwise(exponent * 512 + F.floor(size / F.pow(F.lit(2.0), exponent) * 256)) + 600_001
    return F.when(score < 0, -place).otherwise(place).cast("int")


def curve(df: DataFrame) -> DataFrame:
    """Cumulated tp and fp for each distinct score, descending: score, n_pos, n_neg, tp, fp, pos, neg.

    Distinct scores are cut into ranges, some hundreds for each power of two; running sums inside a range run
    beside each other, and the ranges' totals are summed before them.
    """
    by = df.groupBy("score").agg(F.sum("y").cast("long").alias("n_pos"), F.sum(1 - F.col("y")).cast("long").alias("n_neg"))
    by = by.withColumn("part", _range(F.col("score")))
    totals = by.groupBy("part").agg(F.sum("n_pos").alias("pp"), F.sum("n_neg").alias("nn"))
    above = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("fp0"), F.sum("pp").over(whole).alias("pos"), F.sum("nn").over(whole).alias("neg"))
    w = Window.partitionBy("part").orderBy(F.col("score").desc())
    got = by.withColumn("tp", F.sum("n_pos").over(w)).withColumn("fp", F.sum("n_neg").over(w)).join(F.broadcast(totals), "part")
    return got.select("score", "n_pos", "n_neg", (F.col("tp") + F.col("tp0")).alias("tp"), (F.col("fp") + F.col("fp0")).alias("fp"), "pos", "neg")


def roc_auc(df: DataFrame) -> DataFrame:
    """Mann-Whitney with ties: positives times negatives below, ties count half."""
    c = curve(df)
    below = F.col("neg") - F.col("fp")
    return c.agg(F.try_divide(F.sum(F.col("n_pos") * (below + F.col("n_neg") / 2)), F.max("pos") * F.max("neg")).alias("roc_auc"))


def pr_curve(df: DataFrame) -> DataFrame:
    c = curve(df)
    return c.select("score", "tp", "fp", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("pos")).alias("recall"))


def pr_auc(df: DataFrame) -> DataFrame:
    """Area by trapezoids from (recall 0, precision 1), best F1 and its threshold.

    The area of a step needs the point above only, which is had from the cumulated counts themselves.
    """
    c = curve(df)
    tp0, fp0 = F.col("tp") - F.col("n_pos"), F.col("fp") - F.col("n_neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = _ratio(F.col("n_pos"), F.col("pos")) * (before + now) / 2
    f1 = _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    return c.select(area.alias("area"), f1.alias("f1"), "score").agg(F.sum("area").alias("pr_auc"), F.max("f1").alias("best_f1"), F.max_by("score", F.struct("f1", "score")).alias("best_threshold"))


def threshold_for_recall(df: DataFrame, floor: float = 0.9) -> DataFrame:
    """The threshold of greatest precision among those that keep recall at `floor` or more."""
    ok = pr_curve(df).where(F.col("recall") >= floor)
    return ok.agg(F.max_by(F.struct("score", "precision", "recall"), F.struct("precision", "score")).alias("b")).select("b.score", "b.precision", "b.recall")


def threshold_costs(df: DataFrame, cost_fn: float = 5.0, cost_fp: float = 1.0) -> DataFrame:
    """Cost at each threshold 0.10 .. 0.90 (81 rows), from binned counts."""
    spark = df.sparkSession
    taus = spark.range(10, 91).select((F.col("id") / 100).alias("tau"))
    by = df.groupBy(F.floor(F.col("score") * 100 + 1e-9).alias("bin")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    j = taus.join(F.broadcast(by))
    at = F.round(F.col("tau") * 100).cast("long")
    got = j.groupBy("tau").agg(F.sum(F.when(F.col("bin") < at, F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("bin") >= at, F.col("n")).otherwise(0)).alias("fp"))
    return got.select("tau", "fn", "fp", (F.col("fn") * cost_fn + F.col("fp") * cost_fp).alias("cost"))


def tau_sweep(df: DataFrame, floors: list[float]) -> DataFrame:
    """For each recall floor the highest threshold that keeps it, with traffic above and leaks below."""
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(f,) for f in floors], "floor double"))
    c = curve(df).withColumn("recall", _ratio(F.col("tp"), F.col("pos")))
    best = c.crossJoin(wanted).where("recall >= floor").groupBy("floor").agg(F.max_by(F.struct("score", "tp", "fp", "pos", "neg", "recall"), "score").alias("b"))
    return best.select("floor", F.col("b.score").alias("tau"), F.col("b.recall").alias("recall"), (F.col("b.tp") + F.col("b.fp")).alias("traffic"), (F.col("b.pos") - F.col("b.tp")).alias("leaked"))


def threshold_pairs(df: DataFrame, floors: list[float], target: float = 0.98) -> DataFrame:
    """Cut-offs of confirmed and of suspected positives for each recall floor, and what they let through.

    tau_red has the greatest precision among the thresholds that keep recall at the floor (the least of equals);
    tau_review is the highest one that keeps recall at `target`. Where it isn't below tau_red it is put 1e-6 under
    it and the band counts as collapsed. `red_missed` positives lie below tau_red, `red_lost` even below tau_review:
    they leak. A floor outside (0, 1] or not below the target, and rows of one class, give a row with an error.
    """
    spark = df.sparkSession
    bad = {f: f"recall floor {f} lies outside (0, 1]" if not 0 < f <= 1 else f"target {target} isn't above the floor {f}" if target <= f else None for f in floors}
    wanted = F.broadcast(spark.createDataFrame(sorted(bad.items()), "floor double, error string"))
    c = saved(curve(df), "curve")
    recall, precision = _ratio(F.col("tp"), F.col("pos")), F.col("tp") / (F.col("tp") + F.col("fp"))
    at = c.select("score", "n_pos", "n_neg", "pos", "neg", recall.alias("recall"), precision.alias("precision")).crossJoin(wanted)
    valid = (F.col("error").isNull()) & (F.col("pos") > 0) & (F.col("neg") > 0)
    chosen = at.where(valid).groupBy("floor").agg(
        F.max_by("score", F.when(F.col("recall") >= F.col("floor"), F.struct("precision", (-F.col("score")).alias("low")))).alias("tau_red"),
        F.max(F.when(F.col("recall") >= target, F.col("score"))).alias("review"),
    )
    collapsed = F.col("review") >= F.col("tau_red")
    chosen = chosen.select("floor", "tau_red", F.when(collapsed, F.greatest(F.lit(0.0), F.col("tau_red") - 1e-6)).otherwise(F.col("review")).alias("tau_review"), collapsed.alias("collapsed"))
    # The floors are few, so the counts of all of them come from one pass over the curve.
    red, kept = F.col("score") >= F.col("tau_red"), F.col("score") >= F.col("tau_review")
    n = F.col("n_pos") + F.col("n_neg")

    def total(value: Column, where: Column) -> Column:
        return F.sum(F.when(where, value).otherwise(0))

    counts = c.crossJoin(F.broadcast(chosen)).groupBy("floor", "tau_red", "tau_review", "collapsed").agg(
        total(F.col("n_pos"), red).alias("tp"), total(n, red).alias("n_red"), total(n, kept & ~red).alias("n_review"), total(n, ~kept).alias("n_clean"), total(F.col("n_pos"), ~kept).alias("red_lost"), F.sum("n_pos").alias("pos"), F.sum(n).alias("n"),
    )
    report = counts.select(
        "floor", "tau_red", "tau_review", "collapsed", _ratio(F.col("tp"), F.col("pos")).alias("recall"), _ratio(F.col("tp"), F.col("n_red")).alias("precision"), "n_red", "n_review", "n_clean",
        (100 * (F.col("n_review") + F.col("n_clean")) / F.col("n")).alias("second_stage_pct"), (F.col("pos") - F.col("tp")).alias("red_missed"), "red_lost", (100 * F.col("red_lost") / F.col("pos")).alias("leakage_pct"),
    )
    return wanted.join(report, "floor", "left").withColumn("error", F.coalesce("error", F.when(F.col("tau_red").isNull(), "both classes are needed")))


def best_pair(df: DataFrame, alarm: float = 1.0, review: float = 0.2, leak: float = 20.0, target: float = 0.0) -> DataFrame:
    """The pair of cut-offs tau_review < tau_red of least cost, over all pairs of distinct scores.

    A pair costs `alarm` for each negative at tau_red or above, `review` for each row between the two and `leak` for
    each positive below tau_review, whose recall must be `target` or more. With counts cumulated on the curve the
    cost is a sum of one term for each cut-off, so the best partner of a tau_red is a running minimum over lower
    scores: inside score ranges beside each other, with the ranges' minima before them. No pair is formed. Of equal
    costs the lowest tau_red, then the lowest tau_review is taken; one distinct score gives no row.
    """
    c = curve(df)
    n = F.col("tp") + F.col("fp")
    lower = F.when(_ratio(F.col("tp"), F.col("pos")) >= target, F.struct((review * n + leak * (F.col("pos") - F.col("tp"))).alias("cost"), F.col("score").alias("tau")))
    c = c.select("score", "tp", "fp", "pos", (alarm * F.col("fp") - review * n).alias("upper"), lower.alias("lower"), _range(F.col("score")).alias("part"))
    least = c.groupBy("part").agg(F.min("lower").alias("least"))
    least = least.select("part", F.min("least").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.min("lower").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    met = c.withColumn("inside", inside).join(F.broadcast(least), "part").withColumn("partner", F.least("inside", "before")).where("partner is not null")
    cost = F.round(F.col("upper") + F.col("partner.cost"), 6)
    best = met.agg(F.min(F.struct(cost.alias("cost"), F.col("score").alias("tau_red"), F.col("partner.tau").alias("tau_review"), "tp", "fp", "pos")).alias("b")).where("b is not null")
    return best.select("b.cost", "b.tau_red", "b.tau_review", F.col("b.tp").alias("red_tp"), F.col("b.fp").alias("red_fp"))


def top_share(df: DataFrame, shares: list[float], id_: str = "id") -> DataFrame:
    """Precision and recall in the top ceil(n * share) rows by score; ties by id.

    Rows above the cut score are counted by the curve. Only ties at the cut score are ranked, in ranges of ids
    that lie beside each other.
    """
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(s,) for s in shares], "share double"))
    c = curve(df).crossJoin(wanted).withColumn("k", F.ceil((F.col("pos") + F.col("neg")) * F.col("share")))
    at_cut = c.where("tp + fp >= k").groupBy("share", "k", "pos").agg(F.max_by(F.struct("score", "tp", "fp", "n_pos", "n_neg"), "score").alias("c"))
    # Of the rows that tie at the cut score, `room` are still to be taken.
    cut = saved(at_cut.select("share", "k", "pos", F.col("c.score").alias("cut"), (F.col("c.tp") - F.col("c.n_pos")).alias("above"), F.expr("k - (c.tp - c.n_pos + c.fp - c.n_neg)").alias("room")), "cuts")
    ties = df.select("score", F.col(id_).alias("_id"), "y").join(F.broadcast(cut), F.col("score") == F.col("cut")).select("share", "room", "_id", "y")
    ties = saved(ties.repartitionByRange("share", "_id").withColumn("_part", F.spark_partition_id()), "ties")
    sizes = ties.groupBy("share", "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("share").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ties.withColumn("_in", F.row_number().over(Window.partitionBy("share", "_part").orderBy("_id"))).join(F.broadcast(sizes.select("share", "_part", before.alias("_before"))), ["share", "_part"])
    taken = placed.where(F.col("_in") + F.col("_before") <= F.col("room")).groupBy("share").agg(F.sum("y").cast("long").alias("tied"))
    hits = F.col("above") + F.coalesce("tied", F.lit(0))
    return cut.join(F.broadcast(taken), "share", "left").select("share", "k", hits.alias("hits"), (hits / F.col("k")).alias("precision"), _ratio(hits, F.col("pos")).alias("recall"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, from the confusion matrix."""
    m = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = m.select(F.explode(F.array(F.struct(F.col("t").alias("cls"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called")))).alias("r")).select("r.*")
    got = rows.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("called").alias("called"))
    return got.select("cls", "tp", "actual", "called", _ratio(F.col("tp"), F.col("called")).alias("precision"), _ratio(F.col("tp"), F.col("actual")).alias("recall"), _ratio(2 * F.col("tp"), F.col("actual") + F.col("called")).alias("f1"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and agreement of two raters, from the joint counts."""
    m = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = m.groupBy("a").agg(F.sum("n").alias("ra")), m.groupBy("b").agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, rows.a == cols.b, "left").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("e"))
    seen = m.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("o"))
    po, pe = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return seen.crossJoin(chance).select("n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """All pairs of classes with their counts, zeros included, and the macro F1 over the classes.

    The grid of classes is a fixed small table.
    """
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], "truth string, predicted string")
    n = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    each = class_metrics(df, truth, predicted).where(F.col("cls").isin(*classes))
    macro = each.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / len(classes)).alias("macro_f1"))
    return grid.join(F.broadcast(n), ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(macro)


def brier(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col("score") - F.col("y"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def pooled(folds: DataFrame, values: list[str]) -> DataFrame:
    """Folds pooled: counts added before rates, mean and population deviation of the scalars."""
    return folds.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")), *(f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).withColumns(rates())


def blend(parts: dict[str, float]) -> Column:
    """Weighted mean of probabilities; a missing one's weight goes to the others."""
    have = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    return F.when(have > 0, total / have)
