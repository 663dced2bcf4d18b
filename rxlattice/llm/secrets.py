"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Base spans are the matches of three fixed patterns. Every value found there, and every further long mixed
run of letters and digits, is a candidate, known by its hash. Over the whole corpus a candidate's
distinct owners (the document's source) and repositories (source and language, or any columns given) are
counted. A candidate that several owners hold in many repositories is a copied example; one that a single
owner holds in few repositories, with the spread of characters of a generated key, looks live. A further run
is added as a span of kind `owned`, unless it is a copied example or has few different characters.

Only hashes, lengths and offsets are written to the shared folder, never the values themselves.

Defined cases: a null text is empty; a null source or lang counts as an owner or repository of its own,
named ''; repeated rows give repeated results, the frequencies count distinct owners; an empty table gives
an empty result; other columns are ignored; a missing owner or repository column counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

# The base patterns, their least lengths and the order of their kinds.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "owned")

#: Further candidates: a run of 20 or more key characters with a capital, a small letter and a digit.
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
#: A candidate with so many owners and repositories is an example. A live one has one owner, at most so many
#: repositories and so many different characters.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_REPOSITORIES, LIVE_CHARACTERS = 3, 5, 2, 8


_HITS = "array<struct<rank:int,at:int,gap:int,length:int,secret:bigint,size:int,spread:int>>"


def _hits(kind: str, text: Column, pattern: str) -> Column:
    """array<struct<rank, at, gap, length, secret, size, spread>> of the leftmost matches, without their texts.

    What stands between matches comes from split(); `gap` is its length in code points, `size` the length of
    the secret itself.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def hit(pair: Column, at: Column) -> Column:
        secret = F.regexp_extract(pair["match"], ASSIGN_VALUE, 1) if kind == "assign" else pair["match"]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("rank"), at.alias("at"), F.length(pair["gap"]).alias("gap"), F.length(pair["match"]).alias("length"),
            F.xxhash64(secret).alias("secret"), F.length(secret).alias("size"), F.size(F.array_distinct(F.split(secret, ""))).alias("spread"),
        )

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.when(text.rlike(pattern), F.transform(pairs, hit)).otherwise(F.array().cast(_HITS))


def _name(docs: DataFrame, columns: tuple[str, ...]) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string") if c in docs.columns else F.lit(None), F.lit("")) for c in columns))


def candidates(docs: DataFrame, owner: tuple[str, ...] = ("source",), repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document: uid, doc_id, owner, repository, hits (matches of all kinds, see `_hits`)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), _name(docs, owner).alias("owner"), _name(docs, repository).alias("repository"), text.alias("text"))
    patterns = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("owned", OWNED))
    return rows.select("uid", "doc_id", "owner", "repository", F.concat(*(_hits(k, F.col("text"), p) for k, p in patterns)).alias("hits"))


def spans(found: DataFrame) -> DataFrame:
    """One row per span that is long enough: uid, owner, repository, rank, start, end, secret, spread.

    A start is the running sum of the gaps and matches before it, by document and kind.
    """
    each = found.where(F.size("hits") > 0).select("uid", "owner", "repository", F.inline("hits"))
    end = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("uid", "rank").orderBy("at"))
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    short = F.when(F.col("rank") == 0, LEAST_ASSIGN).when(F.col("rank") == 1, LEAST_ACCESS).otherwise(0)
    return placed.where(F.col("size") >= short).select("uid", "owner", "repository", "rank", "start", "end", "secret", "spread")


def ownership(each: DataFrame) -> DataFrame:
    """secret (hash), n_owners, n_repositories of every candidate: partial counts first, then distinct ones."""
    held = each.groupBy("secret", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("secret").agg(F.countDistinct("owner").alias("n_owners"), F.countDistinct("repository").alias("n_repositories"), F.sum("n").alias("n_found"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, owner: tuple[str, ...] = ("source",), repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, frequencies, n_owned, n_live, n_example, n_shared.

    frequencies: owners/repositories of each of `spans`, in their order. n_live: spans with a live-looking
    secret; n_example: spans with a copied example; n_shared: all others. A span that overlaps a base span
    isn't added again.
    """
    found = materialize(candidates(docs, owner, repository), "spans")
    each = materialize(spans(found), "secrets")
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) & (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= LIVE_REPOSITORIES) & (F.col("spread") >= LIVE_CHARACTERS)
    judged = join_hot(each, materialize(ownership(each), "owners"), "secret", "n_found").withColumns({"example": example, "live": live})
    owned = F.col("rank") == KINDS.index("owned")
    # The kept ones of a document in order of their starts; a further run is left out where a base span reaches into it.
    order = Window.partitionBy("uid").orderBy("start", "rank", "end")
    before = F.max(F.when(~owned, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(~owned, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = ~(F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False)))
    wanted = judged.where(~owned | (~F.col("example") & (F.col("spread") >= LIVE_CHARACTERS))).withColumn("free", free).where(~owned | F.col("free"))
    kept = wanted.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live", "example", "n_owners", "n_repositories"))).alias("all"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,live:boolean,example:boolean,n_owners:bigint,n_repositories:bigint>>")
    rows = found.select("uid", "doc_id").join(kept, "uid", "left").select("doc_id", F.coalesce("all", none).alias("all"))

    def count(test) -> Column:
        return F.size(F.filter("all", test)).cast("long")

    def of_rank(k: int):
        return lambda s: s["rank"] == k

    return rows.select(
        "doc_id",
        *(count(of_rank(k)).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_listed(F.filter("all", lambda s: s["rank"] < 3)).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        F.concat_ws(",", F.transform("all", lambda s: F.concat_ws("/", s["n_owners"].cast("string"), s["n_repositories"].cast("string")))).alias("frequencies"),
        count(of_rank(3)).alias("n_owned"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: s["example"]).alias("n_example"),
        count(lambda s: ~s["live"] & ~s["example"]).alias("n_shared"),
    )
