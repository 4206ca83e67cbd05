"""Partners against brute force, and the one-to-one rule."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearthpanel.functions.ordered import rank_by_draw
from hearthpanel.operators.matching import FEATURES, _cells, _comparable, knn_candidates, match_pairs, nearest_cells

SCHEMA = "pid long, year int, age int, education int, migback int, east int, n_children int"
FINE = "pid long, year int, age double, education double, migback double, east double, n_children double"


def people(seed, n, start, ages=(18, 90)):
    rng = random.Random(seed)
    return [(start + i, rng.choice([2000, 2001]), rng.randint(*ages), rng.randint(0, 4), rng.randint(0, 1), rng.randint(0, 1), 0)
            for i in range(n)]


def fine_people(seed, n, start):
    rng = random.Random(seed)
    return [(start + i, rng.choice([2000, 2001]), rng.gauss(40, 15), rng.random() * 4, rng.random(), float(rng.randint(0, 1)), rng.expovariate(1))
            for i in range(n)]


def distance2(m, w):
    return sum((a - b) ** 2 for a, b in zip(m[2:], w[2:]))


def nearest(men, girls, k):
    want = set()
    for m in men:
        near = sorted((distance2(m, w), w[0]) for w in girls if w[1] == m[1])[:k]
        want |= {(m[0], i + 1, w) for i, (_, w) in enumerate(near)}
    return want


@pytest.mark.parametrize("women, hot", [(40, None), (400, 1), (3, None)])
def test_candidates_equal_brute_force(spark, women, hot):
    men, girls = people(1, 60, 0), people(2, women, 10_000)
    got = knn_candidates(spark, spark.createDataFrame(men, SCHEMA), spark.createDataFrame(girls, SCHEMA), 5, hot_rows=hot).collect()
    assert {(r.pid, r["rank"], r.candidate) for r in got if r.candidate} == nearest(men, girls, 5)


def test_fractional_characteristics_and_missing_ones(spark):
    men, girls = fine_people(3, 80, 0), fine_people(4, 300, 10_000)
    odd = [(900, 2000, None, 1.0, 0.0, 0.0, 0.0), (901, 2000, float("nan"), 1.0, 0.0, 0.0, 0.0), (902, 2000, float("inf"), 1.0, 0.0, 0.0, 0.0),
           (903, 1990, 30.0, 1.0, 0.0, 0.0, 0.0), (904, None, 30.0, 1.0, 0.0, 0.0, 0.0)]
    girls += [(20_000, 2000, 1e6, 0.0, 0.0, 0.0, 0.0)]  # far from everybody
    got = knn_candidates(spark, spark.createDataFrame(men + odd, FINE),
                         spark.createDataFrame(girls + [(30_000, 2000, None, 1.0, 0.0, 0.0, 0.0)], FINE), 7).collect()
    assert {(r.pid, r["rank"], r.candidate) for r in got if r.candidate} == nearest(men, girls, 7)
    assert sorted(r.pid for r in got if r.candidate is None) == [900, 901, 902, 903, 904]


def test_each_ring_joins_on_more_than_the_year(spark):
    men, girls = (spark.createDataFrame(fine_people(s, 200, s * 1000), FINE) for s in (5, 6))
    cells = [_cells(_comparable(df, side, FEATURES), side, FEATURES) for df, side in ((men, "l"), (girls, "r"))]
    found = nearest_cells(spark, *cells, F.lit(5))
    per = found.groupBy("year", *[f"l_{f}" for f in FEATURES]).agg(F.sum("r_n").alias("n"))
    assert per.filter("n < 5").isEmpty() and per.count() == 200
    # a cell of its own size is covered as far as it asks
    wide = nearest_cells(spark, *cells, F.col("l_n") + 20)
    assert wide.groupBy("year", *[f"l_{f}" for f in FEATURES]).agg(F.sum("r_n").alias("n")).filter("n < 21").isEmpty()


@pytest.mark.parametrize("men, women, share", [(80, 50, 1.0), (5, 1, 1.0), (60, 90, 0.5), (7, 7, 1.0)])
def test_pairs_are_one_to_one_and_whole(spark, men, women, share):
    # everybody alike, so that all men compete for the same women
    same = [(i, 2000, 30, 1, 0, 0, 0) for i in range(men)]
    girls = [(1000 + i, 2000, 30 + i % 2, 1, 0, 0, 0) for i in range(women)]
    pairs = match_pairs(spark, spark.createDataFrame(same, SCHEMA), spark.createDataFrame(girls, SCHEMA), share).collect()
    assert len(pairs) == round(share * min(men, women))
    assert max(Counter(p.man for p in pairs).values()) == 1 == max(Counter(p.woman for p in pairs).values())


def test_no_free_woman_is_nearer_than_all_of_a_mans_choices(spark):
    alike = lambda side: [(*p[:3], p[3] // 3, 0, *p[5:]) for p in side]
    men, girls = alike(people(1, 60, 0, (30, 33))), alike(people(11, 110, 10_000, (30, 60)))
    pairs = match_pairs(spark, spark.createDataFrame(men, SCHEMA), spark.createDataFrame(girls, SCHEMA), 1.0, k=5).collect()
    per_year = [min(sum(p[1] == y for p in side) for side in (men, girls)) for y in (2000, 2001)]
    assert len(pairs) == sum(per_year) == len({p.man for p in pairs}) == len({p.woman for p in pairs})
    taken, by_id = {p.woman for p in pairs}, {p[0]: p for p in men + girls}
    for p in pairs:
        m, w = by_id[p.man], by_id[p.woman]
        assert m[1] == w[1]
        assert sum(distance2(m, g) < distance2(m, w) for g in girls if g[1] == m[1] and g[0] not in taken) < 5


def test_the_old_find_the_old(spark):
    men = [(i, 2000, 60, 1, 0, 0, 0) for i in range(20)]
    girls = [(100 + i, 2000, 60 - i, 1, 0, 0, 0) for i in range(20)] + [(1000 + i, 2000, 18, 1, 0, 0, 0) for i in range(100)]
    pairs = match_pairs(spark, spark.createDataFrame(men, SCHEMA), spark.createDataFrame(girls, SCHEMA), 1.0).collect()
    assert len(pairs) == 20 and all(p.woman < 1000 for p in pairs)


def test_a_large_cell_needs_few_rounds(spark, monkeypatch):
    from hearthpanel.operators import matching
    rounds = []
    once = matching._round
    monkeypatch.setattr(matching, "_round", lambda *a: rounds.append(1) or once(*a))
    same = F.lit(1).alias("education"), *[F.lit(0).alias(c) for c in FEATURES[2:]]
    men = spark.range(100_000).select(F.col("id").alias("pid"), F.lit(2000).alias("year"), F.lit(40).alias("age"), *same)
    women = spark.range(200_000).select((F.col("id") + 1_000_000).alias("pid"), F.lit(2000).alias("year"),
                                        (F.lit(20) + F.col("id") % 60).cast("int").alias("age"), *same)
    pairs = match_pairs(spark, men, women, 1.0)
    assert pairs.select("man").distinct().count() == 100_000 == pairs.select("woman").distinct().count() and len(rounds) <= 3


def test_missing_characteristics_are_not_chosen(spark):
    men = [(1, 2000, None, 1, 0, 0, 0), (2, 2000, 30, 1, 0, 0, 0)]
    pairs = match_pairs(spark, spark.createDataFrame(men, SCHEMA), spark.createDataFrame([(9, 2000, 50, 1, 0, 0, 0)], SCHEMA), 1.0).collect()
    assert [tuple(p) for p in pairs] == [(2000, 2, 9)]
    nobody = spark.createDataFrame([], SCHEMA)
    assert match_pairs(spark, nobody, nobody).collect() == []
    assert knn_candidates(spark, nobody, nobody).collect() == []


def test_a_single_man_prefers_the_nearest(spark):
    men = [(1, 2000, 30, 1, 0, 0, 0)]
    girls = [(10, 2000, 60, 1, 0, 0, 0)] + [(20 + i, 2000, 31, 1, 0, 0, 0) for i in range(5)]
    pair = match_pairs(spark, spark.createDataFrame(men, SCHEMA), spark.createDataFrame(girls, SCHEMA), 1.0).collect()
    assert len(pair) == 1 and pair[0].woman >= 20


def test_ranks_by_draw_in_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.random(), i) for i in range(300)]
    got = rank_by_draw(spark.createDataFrame(rows, "g string, u double, id long"), ["g"], "u", "id", "r", slice_rows=7).collect()
    for g in "ab":
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.r)] == [i for _, i in sorted((u, i) for x, u, i in rows if x == g)]
        assert sorted(r.r for r in got if r.g == g) == list(range(1, 1 + sum(x == g for x, _, _ in rows)))
