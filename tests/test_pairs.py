import os

import pytest

from rxlattice.operators import sampling as sp
from rxlattice.plans import registry
from rxlattice.plans.knowledge import pairs

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_five_negatives_for_each_positive(spark):
    rows = registry.queries()["pair_dataset"](spark, SF).collect()
    known = {tuple(sorted((r.a_id, r.b_id))) for r in pairs(spark, SF).collect()}
    pos, neg = ([(r.id_lo, r.id_hi) for r in rows if r.label == k] for k in (1, 0))
    assert pos and len(neg) == 5 * len(pos) and len(set(neg)) == len(neg)
    assert not set(neg) & known and all(a < b for a, b in neg) and {i for p in neg for i in p} <= {i for p in known for i in p}
    assert {r.split for r in rows} == {"train", "val", "test"}


def test_fewer_negatives_where_fewer_exist(spark):
    known = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "id_lo long, id_hi long")
    got = [tuple(r) for r in sp.negative_pairs(known.where("id_lo = 1"), known, 5, lambda df: spark.createDataFrame(df.collect(), df.schema)).collect()]
    assert sorted(got) == [(1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5)]


def test_few_more_pairs_are_formed_than_kept(spark):
    """Pairs that are drawn are shuffled; drawing three times what is wanted took three times the bytes."""
    from rxlattice.tables import saved

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    known = saved(spark.range(60_000).selectExpr("id % 1000 as id_lo", "1000 + pmod(xxhash64(id), 5000) as id_hi").distinct(), "known")
    before = shuffled()
    got = sp.negative_pairs(known, known, 5, lambda df: saved(df, "pairs"))
    used = shuffled() - before
    rows = got.distinct().count()
    assert rows == got.count() == 5 * known.count() and got.join(known, ["id_lo", "id_hi"]).isEmpty()
    assert 5 < used / rows < 60
    ends = got.selectExpr("inline(array(struct(id_lo as id), struct(id_hi as id)))").groupBy("id").count()
    assert ends.count() == 6000


def test_no_pairs_at_all(spark):
    none = spark.createDataFrame([], "id_lo long, id_hi long")
    assert sp.negative_pairs(none, none, 5, lambda df: spark.createDataFrame(df.collect(), df.schema)).isEmpty()
