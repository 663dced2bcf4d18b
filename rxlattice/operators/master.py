"""The drug master: products resolved in stages to components, normalised names, synonyms and interaction ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..tables import saved
from .knowledge import SYNONYMS, small


def name_ids(matrix: DataFrame, place: str = "place") -> DataFrame:
    """name, id: normalised names of an interaction matrix with the id that was registered first.

    All `drug_a` names register before any `drug_b` name, each side in the order of `place`. Rows with a blank id or
    a name that normalises to nothing don't register. Each distinct raw name is normalised once.
    """
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"drug_{s}_name").alias("raw"), F.trim(f"drug_{s}_id").alias("id")) for k, s in enumerate("ab")))
    rows = matrix.select(F.col(place).alias("place"), F.inline(sides)).where("raw is not null and id <> ''")
    first = rows.groupBy("raw").agg(F.min(F.struct("side", "place", "id")).alias("first"))
    return first.select(nz.ingredient(F.col("raw")).alias("name"), "first").where("name <> ''").groupBy("name").agg(F.min("first").alias("first")).select("name", F.col("first.id").alias("id"))


def resolve(names: DataFrame, index: DataFrame) -> DataFrame:
    """name, id of the distinct `names` that have one: by the index, else by their synonym's place in it."""
    other = names.sparkSession.createDataFrame(sorted(SYNONYMS.items()), "name string, other string")  # a fixed list
    asked = names.select("name").distinct().join(F.broadcast(other), "name", "left")
    # Both lookups at once: the index is read one time, and a name's own entry (0) goes before its synonym's (1).
    keys = asked.select("name", F.posexplode(F.array("name", "other")).alias("at", "key")).where("key is not null")
    found = keys.join(index.withColumnRenamed("name", "key"), "key")
    return found.groupBy("name").agg(F.min_by("id", "at").alias("id"))


def _with_ids(rows: DataFrame, key: str, arrays: dict[str, str], index: DataFrame) -> DataFrame:
    """`rows` with, for each array of names, an array of structs (name, id) in its order; a name without id has null.

    The arrays are exploded together, each distinct name is resolved once, and one aggregate gathers them again.
    """
    cells = F.array(*(F.struct(F.lit(a).alias("kind"), F.col(a).alias("names")) for a in arrays))
    each = rows.select(key, F.inline(cells)).select(key, "kind", F.posexplode("names").alias("at", "name"))
    met = each.join(small(saved(resolve(each, index), "names")), "name", "left")
    gathered = met.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == a, F.struct("at", "name", "id")))).alias(out) for a, out in arrays.items()))
    return rows.join(gathered, key, "left")


def build(products: DataFrame, matrix: DataFrame, place: str = "place") -> DataFrame:
    """code, raw_name, is_combo, components, ids: one row per ingredient code (columns code, name, place).

    Of rows that repeat a code the first by `place` counts; blank codes drop; a component without an id is left out of
    `ids`, which keeps the components' order. A missing name gives no component.
    """
    rows = products.select(F.trim(F.coalesce("code", F.lit(""))).alias("code"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.col(place).alias("place"))
    first = rows.where("code <> ''").groupBy("code").agg(F.min_by("name", F.struct("place", "name")).alias("raw_name"))
    first = first.select("code", "raw_name", nz.is_combination(F.col("code")).alias("is_combo"), nz.components(F.col("raw_name")).alias("components"))
    met = _with_ids(first, "code", {"components": "_met"}, name_ids(matrix, place))
    ids = F.transform(F.filter(F.coalesce("_met", F.array()), lambda x: x["id"].isNotNull()), lambda x: x["id"])
    return met.select("code", "raw_name", "is_combo", "components", ids.alias("ids"))


def repair(master: DataFrame, matrix: DataFrame, place: str = "place") -> DataFrame:
    """A stored master (code, raw_name, is_combo, components) with components parsed anew where that maps to more.

    The new parse is taken only if each stored component is still represented in it (by its name, its normalised name
    or its id) and the stored ids are a strict subset of the new ones. `repaired` says where.
    """
    rows = master.select("code", "raw_name", "is_combo", "components", nz.components(F.col("raw_name")).alias("_parsed"))
    met = _with_ids(rows, "code", {"components": "_old", "_parsed": "_new"}, name_ids(matrix, place))
    met = met.withColumns({c: F.coalesce(c, F.array()) for c in ("_old", "_new")})
    ids = {c: F.filter(F.transform(c, lambda x: x["id"]), lambda i: i.isNotNull()) for c in ("_old", "_new")}
    met = met.withColumns({"_old_ids": F.array_distinct(ids["_old"]), "_new_ids": F.array_distinct(ids["_new"]), "_names": F.transform("_new", lambda x: x["name"])})
    represented = F.forall("_old", lambda x: F.array_contains("_names", x["name"]) | F.array_contains("_names", nz.ingredient(x["name"])) | F.coalesce(F.array_contains("_new_ids", x["id"]), F.lit(False)))
    more = (F.size(F.array_except("_old_ids", "_new_ids")) == 0) & (F.size("_new_ids") > F.size("_old_ids"))
    met = met.withColumn("repaired", (F.size("_names") > 0) & represented & more)
    taken = F.when(F.col("repaired"), ids["_new"]).otherwise(ids["_old"])
    return met.select("code", "raw_name", "is_combo", F.when(F.col("repaired"), F.col("_parsed")).otherwise(F.col("components")).alias("components"), taken.alias("ids"), "repaired")


def report(master: DataFrame) -> DataFrame:
    """Codes, mapped codes, combinations, mapped combinations and both rates in per cent."""
    mapped = F.size("ids") > 0
    n = master.agg(F.count(F.lit(1)).alias("n_codes"), F.count_if(mapped).alias("n_mapped"), F.count_if("is_combo").alias("n_combos"), F.count_if(F.col("is_combo") & mapped).alias("n_combos_mapped"))
    return n.select("*", nz.percent(F.col("n_mapped"), F.col("n_codes")).alias("mapped_pct"), nz.percent(F.col("n_combos_mapped"), F.col("n_combos")).alias("combos_pct"))
