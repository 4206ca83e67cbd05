"""Nearest partners and one-to-one pairing.

Persons with the same characteristics in the same year share one *cell*. Distances are taken between cells, found
through grids of growing width, and never between persons. Persons are touched by group-bys and equi joins alone.
Characteristics can be any numbers; a person who lacks one, or has one that is not finite, is compared with nobody.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthpanel.functions.columns import seeded_uniform
from hearthpanel.functions.ordered import rank_by_draw
from hearthpanel.functions.skew import join_by_weight
from hearthpanel.session import cut_lineage

FEATURES = ["age", "education", "migback", "east", "n_children"]


def eligible_singles(df: DataFrame) -> DataFrame:
    """Adults without a partner who are the only adult of their household."""
    return df.filter((F.col("in_couple") == 0) & (F.col("child") == 0)
                     & (F.col("n_people") - F.col("n_children") == 1))


def _names(side: str, features: list[str]) -> list[str]:
    return [f"{side}_{f}" for f in features]


def _comparable(df: DataFrame, side: str, features: list[str], *more: Column) -> DataFrame:
    """year, `more` and the characteristics of one side; what is not finite becomes null."""
    kinds = dict(df.dtypes)
    finite = lambda f: F.when(~F.isnan(f) & (F.abs(F.col(f)) < float("inf")), F.col(f)) if kinds[f] in ("double", "float") else F.col(f)
    return df.select("year", *more, *[finite(f).alias(f"{side}_{f}") for f in features])


def _cells(people: DataFrame, side: str, features: list[str]) -> DataFrame:
    keys = ["year", *_names(side, features)]
    return people.select(*keys).na.drop("any").groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_n"))


def _extent(left: DataFrame, right: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """Lowest and highest value of each characteristic over both sides: two numbers each."""
    both = left.select(*[F.col(f"l_{f}").alias(f) for f in features]).union(right.select(*_names("r", features)))
    row = both.agg(*[F.struct(F.min(f).cast("double"), F.max(f).cast("double")) for f in features]).first()
    return [tuple(pair) for pair in row]


def _in_ring(waiting: DataFrame, right: DataFrame, features: list[str], extent: list[tuple[float, float]],
             radius: float) -> DataFrame:
    """All pairs of cells at most `radius` apart: grids twice as wide meet each cell in two buckets a side at most."""
    width, reach = 2 * radius, radius * (1 + 1e-9)
    buckets = [f"_b{i}" for i in range(len(features))]
    seeking, offered = waiting, right
    for name, f, (low, high) in zip(buckets, features, extent):
        last = math.floor((high - low) / width)
        bucket = lambda x: F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(last))
        x = F.col(f"l_{f}").cast("double")
        seeking = seeking.withColumn(name, F.explode(F.sequence(bucket(x - reach), bucket(x + reach))) if last else F.lit(0).cast("bigint"))
        offered = offered.withColumn(name, bucket(F.col(f"r_{f}").cast("double")))
    gap = lambda f: F.col(f"l_{f}").cast("double") - F.col(f"r_{f}").cast("double")
    square = reduce(lambda a, b: a + b, [gap(f) * gap(f) for f in features])
    return seeking.join(offered, ["year", *buckets]).drop(*buckets).withColumn("d2", square).filter(F.col("d2") <= reach * reach)


def nearest_cells(spark: SparkSession, left: DataFrame, right: DataFrame, cover: Column, features: list[str] = FEATURES) -> DataFrame:
    """For each left cell the right cells around it, nearest first, until `cover` persons are reached (ties included).

    Rings of doubling radius are searched. A ring holds every right cell within its radius, so a left cell that has
    its persons there is settled, exactly; only the others go on to the next ring, up to the radius that spans
    all. Both tables of cells are written once, and a ring joins on the year and a bucket of each characteristic.
    """
    lkeys = ["year", *_names("l", features)]
    left, right = cut_lineage(spark, left.withColumn("_cover", cover)), cut_lineage(spark, right)
    if left.isEmpty() or right.isEmpty():
        return left.join(right, "year").withColumn("d2", F.lit(0.0)).drop("_cover").limit(0)
    extent = _extent(left, right, features)
    widest = max(math.sqrt(sum((high - low) ** 2 for low, high in extent)), 1e-9)
    per_year = right.groupBy("year").count().agg(F.max("count")).first()[0]
    radius = widest * min(max((8 / per_year) ** (1 / len(features)), 1 / 1024), 1 / 4)
    waiting, settled = left, []
    while True:
        ring = cut_lineage(spark, _in_ring(waiting, right, features, extent, min(radius, widest)))
        if radius >= widest:
            settled.append(ring)
            break
        full = ring.groupBy(*lkeys).agg(F.sum("r_n").alias("_got"), F.max("_cover").alias("_need")).filter("_got >= _need").select(*lkeys)
        settled.append(ring.join(full, lkeys, "left_semi"))
        waiting = cut_lineage(spark, waiting.join(full, lkeys, "left_anti"))
        if waiting.isEmpty():
            break
        radius *= 2
    # Persons up to this distance less those at it; equal distances are one step of the order.
    before = F.sum("r_n").over(Window.partitionBy(*lkeys).orderBy("d2")) - F.sum("r_n").over(Window.partitionBy(*lkeys, "d2"))
    found = reduce(DataFrame.unionByName, settled)
    return found.withColumn("_before", before).filter(F.col("_before") < F.col("_cover")).drop("_before", "_cover")


def knn_candidates(spark: SparkSession, left: DataFrame, right: DataFrame, k: int = 5, features: list[str] = FEATURES,
                   hot_rows: int | None = None) -> DataFrame:
    """The k nearest right persons of the same year for each left person, ties by lower id.

    A right cell passes on at most its k lowest ids, which Spark cuts on the map side. A left person who is
    compared with nobody (a characteristic is missing, or the year has no right person) has one row with nulls.
    """
    lnames, rnames = _names("l", features), _names("r", features)
    seekers = _comparable(left, "l", features, F.col("pid"))
    people = _comparable(right, "r", features, F.col("pid").alias("candidate"))
    lowest = Window.partitionBy("year", *rnames).orderBy("candidate")
    first = people.na.drop("any").withColumn("_row", F.row_number().over(lowest)).filter(F.col("_row") <= k).drop("_row")
    ordered = Window.partitionBy("year", *lnames).orderBy("d2", "candidate")
    listed = (nearest_cells(spark, _cells(seekers, "l", features), _cells(people, "r", features), F.lit(k), features)
              .join(first, ["year", *rnames])
              .withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)
              .groupBy("year", *lnames, "l_n")
              .agg(F.collect_list(F.struct("rank", "candidate", F.sqrt("d2").alias("distance"))).alias("found")))
    answered = join_by_weight(seekers, listed, ["year", *lnames], "l_n", "left", hot_rows)
    return answered.select("pid", "year", F.inline_outer("found"))


def _round(spark: SparkSession, men: DataFrame, women: DataFrame, k: int, features: list[str], seed: int, event: str) -> DataFrame:
    """One round: every man asks for a place among the women around his cell; a cell of women takes the lowest draws.

    The n men of a cell, in the order of their draws, are dealt to the places of the women by distance: the first k
    men to the first k places, the next k men to the next, in random order, so that each has one of the k that those
    before him leave. A place falls into a cell of women; its i-th accepted man gets its i-th woman by her draw.
    """
    lnames, rnames = _names("l", features), _names("r", features)
    mkeys, wkeys = ["year", *lnames], ["year", *rnames]
    mcells, wcells = _cells(men, "l", features), _cells(women, "r", features)
    upto = F.sum("r_n").over(Window.partitionBy(*mkeys).orderBy("d2", *rnames).rowsBetween(Window.unboundedPreceding, 0))
    asked_for = F.least(F.col("_upto"), F.col("l_n") + k)
    lists = nearest_cells(spark, mcells, wcells, F.col("l_n") + k, features).withColumn("_upto", upto)
    # A row per place that is asked for, at most k more than there are men.
    lists = lists.filter(F.col("_upto") - F.col("r_n") < F.col("l_n") + k).withColumn("_end", asked_for)
    places = cut_lineage(spark, lists.select(*mkeys, *rnames, F.explode(F.sequence(F.col("_upto") - F.col("r_n"), F.col("_end") - 1)).alias("_spot")))
    sizes = places.groupBy(*mkeys, F.floor(F.col("_spot") / k).alias("_block")).agg(F.count(F.lit(1)).alias("_width"))
    ranked = rank_by_draw(men, mkeys, "_draw", "man", "_rank").withColumn("_block", F.floor((F.col("_rank") - 1) / k))
    mixed = F.row_number().over(Window.partitionBy(*mkeys, "_block").orderBy(seeded_uniform(["man", "year"], event + "-pick", seed), "man")) - 1
    turn = F.floor(seeded_uniform([*mkeys, "_block"], event + "-turn", seed) * F.col("_width"))
    spots = (ranked.withColumn("_mixed", mixed).join(sizes, [*mkeys, "_block"])
             .withColumn("_spot", F.col("_block") * k + F.pmod(F.col("_mixed") + turn, F.col("_width"))))
    asked = cut_lineage(spark, spots.select(*mkeys, "man", "_draw", "_spot").join(places, [*mkeys, "_spot"]).select("man", "_draw", *wkeys))
    men_ranked = rank_by_draw(asked, wkeys, "_draw", "man", "_place").select(*wkeys, "man", "_place")
    women_ranked = rank_by_draw(women, wkeys, "_draw", "woman", "_place").select(*wkeys, "woman", "_place")
    return men_ranked.join(women_ranked, [*wkeys, "_place"]).select("year", "man", "woman")


def chosen_men(men: DataFrame, women: DataFrame, share: float, seed: int) -> DataFrame:
    """`share` of the smaller side, drawn from the men of each year."""
    sizes = (men.select("year", F.lit(1).alias("m"), F.lit(0).alias("w"))
                .unionByName(women.select("year", F.lit(0).alias("m"), F.lit(1).alias("w")))
                .groupBy("year").agg(F.sum("m").alias("_men"), F.sum("w").alias("_women"))
                .withColumn("_wanted", F.bround(F.least("_men", "_women") * F.lit(share)).cast("bigint")))
    drawn = men.withColumn("_u", seeded_uniform(["man", "year"], "chosen", seed))
    ranked = rank_by_draw(drawn, ["year"], "_u", "man", "_rank")
    with_size = ranked.join(sizes.select("year", "_wanted"), "year")
    return with_size.filter(F.col("_rank") <= F.col("_wanted")).drop("_u", "_rank", "_wanted")


def match_pairs(spark: SparkSession, men: DataFrame, women: DataFrame, share: float = 0.10, k: int = 5,
                seed: int = 2020, features: list[str] = FEATURES) -> DataFrame:
    """One-to-one pairs (year, man, woman) for `share` of the smaller side of each year.

    Men have an order by draw. In every round each waiting man asks for one of the k nearest free women that the
    earlier men of his cell leave; whoever loses his place to a lower draw asks again among the women still
    free, until nobody waits. A place is lost only where a whole cell of women is taken, so that at most k - 1
    women who stay free are nearer to a man than his partner. There are never fewer women than chosen men, so every
    chosen man is paired. Persons who lack a characteristic are not chosen and stay as they are.
    """
    draw = lambda role: seeded_uniform(["pid", "year"], role, seed).alias("_draw")
    known = lambda df: df.na.drop("any", subset=["pid", "year", *features])
    finite = lambda df, side, role: _comparable(df, side, features, F.col("pid").alias(role), draw(role)).na.drop("any")
    free = cut_lineage(spark, finite(known(women), "r", "woman"))
    able = finite(known(men), "l", "man")
    waiting = cut_lineage(spark, chosen_men(able, free, share, seed))
    made, number = None, 0
    while not waiting.isEmpty():
        number += 1
        pairs = cut_lineage(spark, _round(spark, waiting, free, k, features, seed, f"round{number}"))
        made = pairs if made is None else made.unionByName(pairs)
        waiting = cut_lineage(spark, waiting.join(pairs, ["year", "man"], "left_anti"))
        free = cut_lineage(spark, free.join(pairs, ["year", "woman"], "left_anti"))
    return waiting.select("year", "man", F.col("man").alias("woman")) if made is None else made
