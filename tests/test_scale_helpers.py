"""Hot keys take another path in the plan; the answers must not change."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from hearthpanel.functions.columns import order_bucket, seeded_uniform
from hearthpanel.functions.ordered import exact_quantiles, gini, rank_by_draw, subset_quantiles
from hearthpanel.functions.skew import attach_group, join_hot


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group and a third of these with one value."""
    rng = random.Random(1)
    data = []
    for i in range(3000):
        group = 0 if i % 3 == 0 else rng.randint(1, 40)
        value = 0.0 if i % 9 == 0 else rng.choice([round(rng.lognormvariate(8, 2), 2), -rng.random(), rng.randint(1, 5) * 1.0])
        data.append((i, group, value))
    data += [(9001, None, 3.0), (9002, 5, None), (9003, 77, 4.25), (9004, 78, None)]
    return spark.createDataFrame(data, "id long, g int, x double").repartition(4).cache()


@pytest.mark.parametrize("hot", [1, 500, None])
def test_quantiles_equal_the_builtin(skewed, hot):
    probs = {"low": 0.0, "p10": 0.1, "half": 0.5, "p95": 0.95, "top": 1.0}
    builtin = skewed.filter("g is not null and x is not null").groupBy("g").agg(
        *[F.percentile("x", p).alias(n) for n, p in probs.items()])
    got, want = rows(exact_quantiles(skewed, ["g"], "x", probs, hot)), rows(builtin)
    assert [r[0] for r in got] == [r[0] for r in want]
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-9)


def test_quantiles_without_groups(skewed):
    got = exact_quantiles(skewed, [], "x", {"p": 0.37}).first().p
    assert got == pytest.approx(skewed.agg(F.percentile("x", 0.37)).first()[0], abs=1e-9)


def _parts():
    odd = F.col("id") % 2 == 1
    return {"all": F.lit(True), "odd": odd, "odd_high": odd & (F.col("x") > 2.0), "known": F.when(F.col("id") > 30, True),
            "none": F.col("id") < 0}


@pytest.mark.parametrize("hot", [1, 150, None])
def test_quantiles_of_overlapping_subsets(skewed, hot):
    probs = {"low": 0.0, "p10": 0.1, "half": 0.5, "top": 1.0}
    key = lambda r: tuple(r[:2])
    got = sorted(subset_quantiles(skewed, ["g"], _parts(), "x", probs, hot).select("g", "subset", *probs).collect(), key=key)
    want = []
    for name, condition in _parts().items():
        members = skewed.filter(condition & F.col("g").isNotNull() & F.col("x").isNotNull())
        want += [(r[0], name, *r[1:]) for r in members.groupBy("g").agg(*[F.percentile("x", p).alias(n) for n, p in probs.items()]).collect()]
    assert [key(r) for r in got] == sorted(key(r) for r in want)
    for a, b in zip(got, sorted(want, key=key)):
        assert tuple(a[2:]) == pytest.approx(tuple(b[2:]), abs=1e-9)


def test_subsets_of_nothing(skewed):
    assert subset_quantiles(skewed.filter("id < 0"), ["g"], _parts(), "x", {"half": 0.5}).count() == 0


def test_rows_are_copied_behind_the_join_with_their_cells(skewed):
    """Counting is done by then: one read of the rows, and nothing multiplies them below the join."""
    plan = subset_quantiles(skewed, ["g"], _parts(), "x", {"half": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and plan.count("Generate") == 1
    assert plan.index("Generate") < plan.index("Join Inner") < plan.index("InMemoryRelation")


def test_value_cells_keep_the_order(spark):
    values = [-1e300, -5.5, -5.4, -1e-9, 0.0, 1e-12, 0.3, 1.0, 1.0000001, 7e5, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_bucket(F.col("x"), 256 * 4096).alias("b"))
    cells = [r.b for r in df.orderBy("x").collect()]
    assert cells == sorted(cells)


def test_infinite_values_have_end_cells(spark):
    values = [float("-inf"), -1.7e308, 0.0, 1.7e308, float("inf")]
    df = spark.createDataFrame([(1, v) for v in values], "g int, x double")
    cells = [r.b for r in df.select("x", order_bucket(F.col("x"), 256 * 4096).alias("b")).orderBy("x").collect()]
    assert cells == sorted(set(cells))
    got = exact_quantiles(df, ["g"], "x", {"low": 0.0, "half": 0.5, "top": 1.0}, 1).first()
    assert (got.half, got.top) == (0.0, float("inf")) or got.half == 0.0


def _pairs(values):
    n = len(values)
    return sum(abs(a - b) for i, a in enumerate(values) for b in values[i + 1:]) / (n * n * (sum(values) / n))


def test_gini(spark, skewed):
    cases = {1: [1, 1, 1], 2: [0, 0, 3], 3: [1, 1, 2, 2], 4: [0.5, 10, 200, 3000, 3000, 7]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in cases.items() for v in vs], "g int, x double")
    got = {r.g: r.gini for r in gini(df, ["g"], "x").collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(2 / 3) and got[3] == pytest.approx(1 / 6)
    assert got[4] == pytest.approx(_pairs(cases[4]))
    overall = [r.x for r in skewed.filter("x > 0").select("x").collect()]
    assert gini(skewed.filter("x > 0"), [], "x").first().gini == pytest.approx(_pairs(overall))


@pytest.mark.parametrize("hot", [1, 500, None])
def test_group_values_reach_every_member(skewed, hot):
    got = attach_group(skewed, ["g"], [F.sum("x").alias("s"), F.count("x").alias("k")], hot)
    want = {r.g: (r.s, r.k) for r in skewed.groupBy("g").agg(F.sum("x").alias("s"), F.count("x").alias("k")).collect()}
    out = got.collect()
    assert len(out) == skewed.count()
    for r in out:
        if r.g is None:
            assert r.s is None
        else:
            assert r.k == want[r.g][1] and r.s == (None if want[r.g][0] is None else pytest.approx(want[r.g][0]))


@pytest.mark.parametrize("hot", [1, None])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_join_equals_a_plain_join(spark, skewed, hot, how):
    table = spark.createDataFrame([(g, f"g{g}") for g in range(0, 30)], "g int, name string")
    assert rows(join_hot(skewed, table, ["g"], how, hot), "id", "name") == rows(skewed.join(table, "g", how), "id", "name")


def test_slice_is_part_of_the_shuffle(skewed):
    out = attach_group(skewed, ["g"], [F.sum("x").alias("s")], 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_slice" in line and "_in_slice" in line]
    assert joins, plan


def test_rank_by_draw(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("pid"), F.lit(2000).alias("year"))
    df = df.withColumn("u", F.floor(seeded_uniform(["pid", "year"], "r", 1) * 50) / 50)
    out = rank_by_draw(df, ["g"], "u", "pid", "rank").collect()
    for g in range(3):
        mine = sorted((r for r in out if r.g == g), key=lambda r: (r.u, r.pid))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
