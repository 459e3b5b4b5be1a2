"""Risk policies, confidence and ensembles: boundaries and properties."""

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnrisk.functions import policies as pol

LEVEL_PS = [0.29, 0.3, 0.59, 0.6, 0.79, 0.8, 0.89, 0.9, 1.0]


def test_levels_at_boundaries(spark):
    df = spark.createDataFrame([(p,) for p in LEVEL_PS], "p double")
    r = df.select(pol.risk_level("p", "strict").alias("s"),
                  pol.risk_level("p", "sensitive").alias("v"),
                  pol.decision("p", "strict").alias("ds"),
                  pol.decision("p", "sensitive").alias("dv")).collect()
    assert [x.s for x in r] == ["low", "low", "low", "medium", "medium", "high", "high",
                                "critical", "critical"]
    assert [x.v for x in r] == ["low", "medium", "medium", "high", "high", "critical",
                                "critical", "critical", "critical"]
    assert [x.ds for x in r] == [p >= 0.6 for p in LEVEL_PS]
    assert [x.dv for x in r] == [p >= 0.3 for p in LEVEL_PS]


def test_confidence_one_model(spark):
    df = spark.createDataFrame([(0.7,)], "a double")
    r = df.select(pol.confidence(["a"], "strict").alias("s"),
                  pol.confidence(["a"], "dashboard").alias("d"),
                  pol.confidence([], "strict").alias("z")).first()
    assert (r.s, r.d, r.z) == (1.0, 0.5, 0.0)


def test_weighted_vote_equals_first_member_with_shipped_weights(spark):
    df = spark.createDataFrame([(a, b) for a in (0.1, 0.7) for b in (0.2, 0.9)], "a double, b double")
    r = df.select("a", pol.weighted_vote(["a", "b"], pol.ENSEMBLE_WEIGHTS).alias("v")).collect()
    assert all(x.v == int(x.a >= 0.5) for x in r)


def test_minmax_and_maxscale_use_fitted_state(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (-5.0,)], "s double")
    r = df.select(pol.minmax_inverted("s", F.lit(0.0), F.lit(10.0)).alias("m"),
                  pol.max_scaled("s", F.lit(10.0)).alias("x")).collect()
    assert [x.m for x in r] == [0.5, 0.0, 1.0]
    assert [x.x for x in r] == [0.5, 1.0, 0.0]
    flat = df.select(pol.minmax_inverted("s", F.lit(3.0), F.lit(3.0)).alias("m")).collect()
    assert {x.m for x in flat} == {0.0}


@settings(max_examples=15, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.floats(0, 1), min_size=3, max_size=3))
def test_confidence_in_unit_interval_and_levels_monotone(spark, ps):
    df = spark.createDataFrame([tuple(ps)], "a double, b double, c double")
    r = df.select(pol.confidence(["a", "b", "c"]).alias("c"),
                  pol.mean_of(["a", "b", "c"]).alias("m")).first()
    assert 0.0 < r.c <= 1.0
    order = ["low", "medium", "high", "critical"]
    lv = spark.createDataFrame([(p,) for p in sorted(ps)], "p double") \
        .select(pol.risk_level("p").alias("l")).collect()
    ranks = [order.index(x.l) for x in lv]
    assert ranks == sorted(ranks)


def test_map_confidence_and_member_score(spark):
    df = spark.createDataFrame([({"a": 0.2, "b": 0.6}, None, 1), ({"a": 0.9}, 0.3, 0)],
                               "m map<string,double>, proba double, pred int")
    r = df.select(pol.map_mean("m").alias("mean"), pol.map_confidence("m").alias("s"),
                  pol.map_confidence("m", "dashboard").alias("d"),
                  pol.member_score("proba", "pred").alias("ms")).collect()
    assert abs(r[0].mean - 0.4) < 1e-12 and abs(r[0].s - 1 / (1 + 0.04)) < 1e-12
    assert r[1].s == 1.0 and r[1].d == 0.5
    assert [x.ms for x in r] == [1.0, 0.3]
