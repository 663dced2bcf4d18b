"""The feature row of a group of drug lines: counts, duplicates, flags, enzyme loads and pairs, without arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import spread
from .features import in_group, starts_any, whammy_classes
from .knowledge import ENZYME_WEIGHTS, ENZYMES

# Code prefixes of the classes of the triple whammy, where only codes are known.
WHAMMY_CODES = (["C09AA", "C09CA"], ["C03DA", "C03DB"], ["M01A", "M01B", "N02BA01"])

#: What a line's medicine is, as bits of one number: risk groups, whammy classes by name and by code, enzyme roles.
ROLES = ("sub", "strong", "inh")
BITS = {n: 1 << i for i, n in enumerate(["high_risk", "renal_risk", "hepatic_risk", "acei_arb", "k_sparing", "nsaid", "code_acei_arb", "code_k_sparing", "code_nsaid", "qt", *(f"{e}_{r}" for e in ENZYMES for r in ROLES)])}
_ENZYME = sum(BITS[f"{e}_{r}"] for e in ENZYMES for r in ROLES)


def has(name: str) -> str:
    """Whether the column flags has a bit, as SQL."""
    return f"(flags & {BITS[name]}) <> 0"


def packed(named: dict[str, Column]) -> Column:
    """Conditions by their names in BITS as one number; a null condition counts as false."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, BITS[n]).otherwise(0) for n, c in named.items()), F.lit(0))


def whammy_by_code(atc: Column) -> dict[str, Column]:
    code = F.coalesce(atc, F.lit(""))
    return {n: starts_any(code, prefixes) for n, prefixes in zip(("code_acei_arb", "code_k_sparing", "code_nsaid"), WHAMMY_CODES)}


def enzyme_roles(parts: Column, roles: list[tuple[str, str, str, bool]]) -> dict[str, Column]:
    """Roles of a medicine's components from rows (component, enzyme, action, strong); inducers have no part in the score."""
    found: dict[str, list[str]] = {}
    for component, enzyme, action, strong in roles:
        if action == "substrate":
            found.setdefault(f"{enzyme}_sub", []).append(component)
        elif action == "inhibitor":
            found.setdefault(f"{enzyme}_inh", []).append(component)
            if strong:
                found.setdefault(f"{enzyme}_strong", []).append(component)
    return {n: F.arrays_overlap(parts, F.array(*(F.lit(c) for c in cs))) for n, cs in found.items()}


def enzyme_scores() -> dict[str, Column]:
    """Score, greatest enzyme's risk and high-risk pairs from counts named enzyme_sub, enzyme_strong, enzyme_inh."""
    risk = [f"({e}_strong * 3.0D + {e}_inh + {e}_strong * {e}_sub * 2.0D) * {ENZYME_WEIGHTS[e]}D" for e in ENZYMES]
    pairs = [f"{e}_strong * {e}_sub" for e in ENZYMES]
    return {"cyp_risk_score": F.expr(" + ".join(risk)), "cyp_max_enzyme_risk": F.expr(f"greatest({', '.join(risk)})"), "cyp_high_risk_pairs": F.expr(" + ".join(pairs))}


def group_features(lines: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group of lines: counts, duplicates, flags, enzyme scores and the observation window.

    lines: keys, start_date, end_date, institution_id, drug_id, class_no, atc, parts (components), flags (see BITS).
    The lines are shuffled once, by `keys`, a row for each component; the first of a line's rows carries the rest of
    it. Inside a partition they are sorted by one attribute after another: a row that differs from the one before is
    a new value, the second of equal ones a duplicate, so one aggregate counts marks. No array holds a group, so large
    groups spill and cost no more per line. Null institutions, classes and codes aren't counted; a line without a
    component counts by its drug id.
    """
    first = F.col("pos") == 0
    own = F.expr("if(size(parts) > 0, parts, array(cast(drug_id as string)))")
    rows = spread(lines, *keys).select("*", F.posexplode(own).alias("pos", "part")).select(
        *keys, "start_date", "end_date", "flags", "pos", "part", *(F.when(first, F.col(c)).alias(n) for c, n in (("institution_id", "place"), ("class_no", "class"), ("atc", "atc"))),
        F.when(first & F.expr(has("qt")), F.col("drug_id")).alias("qt"), F.when(first, F.col("flags").bitwiseAND(_ENZYME)).otherwise(0).alias("enzyme"),
        F.when(first & F.col("atc").isNull(), F.col("drug_id")).alias("uncoded"),
    )
    whole = Window.partitionBy(*keys)

    def again(value: Column, k: int, order: list[str]) -> Column:
        """Whether the row `k` before, in the group's order, has the same value."""
        return F.coalesce(F.lag(value, k).over(whole.orderBy(*order)) == value, F.lit(False))

    def new(value: Column, *order: str) -> Column:
        return value.isNotNull() & ~again(value, 1, order)

    def second(value: Column, *order: str) -> Column:
        return again(value, 1, order) & ~again(value, 2, order)

    # Codes of one prefix stand together where codes are sorted.
    levels = {f"dup_atc{k}": F.expr(f"if(length(atc) >= {n}, substring(atc, 1, {n}), null)") for k, n in ((5, 7), (4, 5), (3, 4))}
    medicine = Window.partitionBy(*keys, "atc", "uncoded").orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"institution_count": new(F.col("place"), "place")}).drop("place").withColumns({"dup_class": second(F.col("class"), "class")}).drop("class").withColumns({"qt_drugs": new(F.col("qt"), "qt")}).drop("qt")
    rows = rows.withColumns({n: second(v, "atc", "uncoded") for n, v in levels.items()}).withColumn("enzyme", F.expr("enzyme").bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or("enzyme").over(medicine), F.lit(0)))))
    rows = rows.drop("atc", "uncoded").withColumns({"drug_count": new(F.col("part"), "part"), "dup_same_ingredient": second(F.col("part"), "part")}).drop("part")
    rows = rows.withColumns({"window_start": F.min("start_date").over(whole), "last_end": F.max("end_date").over(whole)}).withColumn("window_end", F.expr("least(last_end, date_add(window_start, 89))"))
    marks = ["drug_count", "institution_count", "qt_drugs", "dup_same_ingredient", "dup_class", *levels]
    got = rows.groupBy(*keys).agg(
        *(F.count_if(m).alias(m) for m in marks), F.count_if(first).alias("n_lines"), F.max("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
        F.count_if(first & F.expr("start_date <= window_end and window_end <= end_date")).alias("drug_count_7d"), F.bit_or("flags").alias("flags"),
        # Distinct medicines in an enzyme role: by the first of their rows that has it.
        *(F.count_if(F.col("enzyme").bitwiseAND(BITS[f"{e}_{r}"]) != 0).alias(f"{e}_{r}") for e in ENZYMES for r in ROLES),
    )
    flags = {n: has(n) for n in ("high_risk", "renal_risk", "hepatic_risk")}
    flags |= {"triple_whammy": " and ".join(map(has, ("acei_arb", "k_sparing", "nsaid"))), "triple_whammy_codes": " and ".join(map(has, ("code_acei_arb", "code_k_sparing", "code_nsaid")))}
    return got.withColumns({n: F.expr(v) for n, v in flags.items()} | enzyme_scores()).drop("flags", *(f"{e}_{r}" for e in ENZYMES for r in ROLES))


def group_pairs(lines: DataFrame, least_days: int, epoch: str, width: int) -> DataFrame:
    """patient_id, bucket, drug_a, drug_b: distinct pairs of drugs that overlap long enough, by the later start's bucket.

    lines: patient_id, drug_id, start_date, end_date. A line is copied to each bucket it touches and the sides meet by
    an equi join, which spills and which AQE can split.
    """

    def bucket(day: Column) -> Column:
        return F.floor(F.datediff(day, F.lit(epoch).cast("date")) / width).cast("int")

    base = lines.select("patient_id", F.explode(F.sequence(bucket(F.col("start_date")), bucket(F.col("end_date")))).alias("bucket"), "drug_id", "start_date", "end_date")
    base = spread(base, "patient_id", "bucket")
    a = base.select("patient_id", "bucket", F.col("drug_id").alias("drug_a"), F.col("start_date").alias("s1"), F.col("end_date").alias("e1"))
    b = base.select("patient_id", "bucket", F.col("drug_id").alias("drug_b"), F.col("start_date").alias("s2"), F.col("end_date").alias("e2"))
    later = F.greatest("s1", "s2")
    met = a.join(b, ["patient_id", "bucket"]).where((F.col("drug_a") < F.col("drug_b")) & (F.datediff(F.least("e1", "e2"), later) + 1 >= least_days) & (bucket(later) == F.col("bucket")))
    return met.select("patient_id", "bucket", "drug_a", "drug_b").distinct()


def medicine_flags(name: Column, atc: Column, parts: Column, groups: dict, roles: list[tuple[str, str, str, bool]]) -> Column:
    """BITS of a medicine by its name, code, components and the enzyme roles of these."""

    def some(k: int) -> Column:
        return F.exists(parts, lambda part: whammy_classes(part)[k])

    named = {n: in_group(name, atc, g) for n, g in groups.items()} | {n: some(k) for k, n in enumerate(("acei_arb", "k_sparing", "nsaid"))}
    return packed(named | whammy_by_code(atc) | enzyme_roles(parts, roles))
