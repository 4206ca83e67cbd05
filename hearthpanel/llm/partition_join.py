"""Exact Jaccard join of shingle sets by universe partitioning and the pigeonhole principle.

The shingles are hashed into segments, as many as the size band of a set allows differences. Sets X and Y that are
linked differ in at most H shingles. X gives its segments budgets v of 0, 1 or 2 that add up to more than H; then a
segment exists in which X and Y differ in fewer shingles than its budget: in none (equal segments), or with budget 2 in
at most one (one equals the other without one of its shingles). The index holds a key for every segment of every
set, and keys of all one-deletions for a few segments. How many sets have a key is counted over all sets, and each set
spends its budgets where they meet the fewest others; a key that nobody else has is free. Candidates are verified on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.llm.components import components
from hearthpanel.llm.store import saved
from hearthpanel.llm.texts import PARITY_WORDS, mixed, parities, shingle_set, word_hashes

SHINGLE = 4
NUMERATOR, DENOMINATOR = 85, 100
STARS = 3
"""Rounds that compare each set with one leader before what is still apart is compared in full."""
FIRST_PLACES = 32
"""A pair that meets in several keys is made in the first of them, as far as it is among so many first keys of both sets."""
BROADCAST_ROWS = 500_000
"""Up to so many wanted rows (three numbers each) are sent to the texts; beyond that the texts are shuffled to them."""
PARITIES = [f"s{k}" for k in range(PARITY_WORDS)]
"""A set's parity bits: two sets differ in at least as many shingles as bits, so that a pair with too many unequal bits
is no link, without exception."""
EXACT, DELETED, EMPTY = 0, 1, 2


def most_differences(together: int) -> int:
    """Shingles that are in one set only, at most, if two linked sets have `together` shingles in all."""
    return together * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


class Band:
    """Size band number `band`: its sizes, segments and the segments that have one-deletion keys."""

    def __init__(self, band: int, low: int):
        self.band, self.low, self.high = band, low, max(low + 1, low * 4 // 3)  # sizes low to high - 1
        # The largest set that may meet one of this band.
        most = most_differences(self.high - 1 + (self.high - 1) * DENOMINATOR // NUMERATOR)
        self.deleted = max(1, most // 32)
        self.segments = most + 1 + most // 8  # so that budgets of 1 are enough, with some to choose from


class Bands:
    """Bands by set size, made as they are needed."""

    def __init__(self):
        self._all = [Band(0, 1)]

    def of(self, size: int) -> Band:
        while self._all[-1].high <= size:
            self._all.append(Band(len(self._all), self._all[-1].high))
        low, high = 0, len(self._all) - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self._all[middle].high <= size else (low, middle)
        return self._all[low]

    def below(self, band: Band) -> Band | None:
        return self._all[band.band - 1] if band.band else None


def segment_keys(shingles: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and tags of a set in the scheme of a band, and how much budget its segments with shingles can take.

    A tag is segment * 16 + two * 8 + kind, where two marks segments whose deletions are indexed; those have two
    shingles at least. An empty segment has one key of that kind.
    """
    spread = mixed(shingles + np.uint64(band.band))
    segment = (spread % np.uint64(band.segments)).astype(np.int64)
    value = mixed(spread)
    order = np.argsort(segment, kind="stable")
    segment, value = segment[order], value[order]
    counts = np.bincount(segment, minlength=band.segments)
    sums = np.zeros(band.segments, dtype=np.uint64)
    filled = np.flatnonzero(counts)
    starts = np.cumsum(counts) - counts
    sums[filled] = np.add.reduceat(value, starts[filled])

    def named(total: np.ndarray, count: np.ndarray, where: np.ndarray) -> np.ndarray:
        place = (where + 1).astype(np.uint64) + (np.uint64(band.band) << np.uint64(24)) + (count.astype(np.uint64) << np.uint64(40))
        return mixed(total + mixed(place))

    places = np.arange(band.segments)
    keys = named(sums, counts, places)
    two = (counts > 1) & (places < band.deleted)
    inner = np.flatnonzero(two[segment])
    of, without = segment[inner], sums[segment[inner]] - value[inner]
    kinds = np.concatenate([np.where(counts > 0, EXACT, EMPTY), np.full(len(of), DELETED)])
    where = np.concatenate([places, of])
    tags = (where << 4) | (two[where] << 3) | kinds
    return np.concatenate([keys, named(without, counts[of] - 1, of)]), tags.astype(np.int32), len(filled) + int(two.sum())


def set_number(shingles: np.ndarray) -> int:
    """Equal sets get equal numbers, and different ones differ but for a chance of 2^-64."""
    total = mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])


_FIELDS = ([T.StructField(c, T.LongType()) for c in ("n", "vertex", *PARITIES, "need_own", "have_own", "need_low", "have_low")]
           + [T.StructField("keys", T.ArrayType(T.LongType(), False)), T.StructField("tags", T.ArrayType(T.IntegerType(), False))])


def _summaries(docs: DataFrame) -> DataFrame:
    """id, print and summary of each row (id, print, body); a task gives the keys of equal sets once.

    need is the sum of budgets that a set spends in the scheme of its own band and of the band below, if linked sizes
    reach it; have is what its segments with shingles can take. need is 0 where only equal sets can be linked. Tags
    are those of `segment_keys`, with 4 added in the scheme below.
    """
    schema = T.StructType([docs.schema["id"], docs.schema["print"], *_FIELDS])
    nothing = [0] * (PARITY_WORDS + 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(), set()
        for batch in batches:
            numbers, keys, tags, ends = [], [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [0]
            for text in batch.column("body"):
                shingles = shingle_set(word_hashes(text.as_py()), SHINGLE)
                size = len(shingles)
                ends.append(ends[-1])
                vertex = set_number(shingles) if size else None
                if not size or vertex in seen:
                    numbers.append([size, vertex, *nothing])
                    continue
                seen.add(vertex)
                own, budgets = bands.of(size), []
                low = bands.below(own) if -(-NUMERATOR * size // DENOMINATOR) < own.low else None
                for band, together, mark in ((own, 2 * size, 0), (low, size + own.low - 1, 4)):
                    need = most_differences(together) + 1 if band else 0
                    if band is None or band is low and need == 1:
                        budgets += [0, 0]
                        continue
                    key, tag, have = segment_keys(shingles, band)
                    budgets += [need, have] if need > 1 else [0, 0]
                    keys.append(key)
                    tags.append(tag | np.int32(mark))
                    ends[-1] += len(key)
                numbers.append([size, vertex, *parities(shingles).tolist(), *budgets])
            columns = list(zip(*numbers)) or [[] for _ in _FIELDS[:-2]]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
                     for x in (np.concatenate(keys).view(np.int64), np.concatenate(tags))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), *[pa.array(c, pa.int64()) for c in columns], *lists],
                                             names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([shingle_set(word_hashes(t), SHINGLE).view(np.int64) for t in batch])


def _tag() -> tuple[Column, Column, Column]:
    """Kind of a key, whether it is of the scheme below, and whether its segment can take two units."""
    tag = F.col("tag")
    return tag.bitwiseAND(3), tag.bitwiseAND(4) > 0, tag.bitwiseAND(8) > 0


def _each_key(rows: DataFrame) -> DataFrame:
    return rows.select("vertex", F.explode(F.arrays_zip("keys", "tags")).alias("k")).select("vertex", F.col("k.keys").alias("key"), F.col("k.tags").alias("tag"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """Saved table of vertex, key, tag, exact and deleted (index rows of these kinds) of keys that several sets have."""
    kind, low, _ = _tag()
    of_key = Window.partitionBy("key")
    count = lambda which: F.sum(F.when((kind == which) & ~low, 1).otherwise(0)).over(of_key)
    met = _each_key(rows).filter(kind != EMPTY).select("*", count(EXACT).alias("exact"), count(DELETED).alias("deleted"),
                                                       F.min("vertex").over(of_key).alias("least"), F.max("vertex").over(of_key).alias("most"))
    # Most keys belong to one set only and end here.
    return saved(met.filter("least < most").drop("least", "most").dropDuplicates(["key", "vertex", "tag"]), "shared_keys")


def _budgets(rows: DataFrame) -> DataFrame:
    """What each set needs and has in a scheme: vertex, low, need, have."""
    both = F.array(*[F.struct(F.lit(low).alias("low"), F.col(f"need_{s}").alias("need"), F.col(f"have_{s}").alias("have"))
                     for s, low in (("own", False), ("low", True))])
    return rows.filter("size(keys) > 0").dropDuplicates(["vertex"]).select("vertex", F.explode(both).alias("b")).select("vertex", "b.*").filter("need > 0")


def probes_and_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probes (key, target, x) and index rows (key, target, y) of their keys, both saved; a target is a kind of key.

    Every unit of budget costs what it meets: the first unit of a segment the sets with an equal one, the second the
    sets that differ in one shingle there. Units that meet nobody are free, and the cheapest of the others follow
    until the sum is reached; the second unit of a segment never comes before the first.
    """
    kind, low, two = _tag()
    shared, budgets = shared_keys(rows), saved(_budgets(rows), "budgets")
    segment = F.shiftright("tag", 4)
    zero = F.lit(0).cast("bigint")
    # The key of the set itself is counted in its own scheme.
    equal = F.coalesce(F.max(F.when(kind == EXACT, F.col("exact") - F.when(low, 0).otherwise(1))), zero)
    nearly = F.sum(F.when(kind == EXACT, F.col("deleted")).otherwise(F.col("exact")))
    costs = shared.groupBy("vertex", low.alias("low"), segment.alias("segment")).agg(equal.alias("one"), nearly.alias("more"), F.max(two).alias("two"))
    unit = lambda cost, level: F.struct(cost.alias("cost"), "segment", F.lit(level).alias("level"))
    units = F.array(unit(F.col("one"), 1), unit(F.when(F.col("two"), F.greatest("one", "more")).otherwise(zero), 2))
    paid = costs.select("vertex", "low", F.explode(units).alias("u")).filter("u.cost > 0").groupBy("vertex", "low").agg(
        F.sort_array(F.collect_list("u")).alias("units"))  # one set's segments
    left = (F.col("need") - (F.col("have") - F.size("units"))).cast("int")
    spent = paid.join(budgets, ["vertex", "low"]).filter(left > 0).select("vertex", "low", F.explode(F.slice("units", F.lit(1), left)).alias("u"))
    levels = spent.groupBy("vertex", "low", F.col("u.segment").alias("segment")).agg(F.max("u.level").alias("upto"), F.min("u.level").alias("since"))
    mine = shared.select("vertex", "key", kind.alias("kind"), low.alias("low"), segment.alias("segment")).join(levels, ["vertex", "low", "segment"])
    whole = F.col("kind") == EXACT
    sought = F.array(F.when((F.col("since") == 1) & whole, F.lit(EXACT)).when((F.col("upto") == 2) & ~whole, F.lit(EXACT)),
                     F.when((F.col("upto") == 2) & whole, F.lit(DELETED)))
    probes = mine.select("key", F.explode(F.array_compact(sought)).alias("target"), F.col("vertex").alias("x"))
    index = shared.filter(~low).select("key", kind.alias("target"), F.col("vertex").alias("y"))
    # Sets whose filled segments cannot take the whole budget spend the rest on empty segments.
    short = budgets.filter("have < need")
    if not short.isEmpty():
        empty = _each_key(rows).filter(kind == EMPTY)
        order = F.row_number().over(Window.partitionBy("vertex", "low").orderBy("tag"))
        extra = saved(empty.withColumn("low", low).join(short, ["vertex", "low"]).distinct().withColumn("rank", order)
                      .filter("rank <= need - have").select("key", F.lit(EMPTY).alias("target"), F.col("vertex").alias("x")), "empty_probes")
        probes = probes.union(extra)
        index = index.union(empty.filter(~low).select("key", F.lit(EMPTY).alias("target"), F.col("vertex").alias("y")))
    probes = saved(probes.distinct(), "probes")
    index = saved(index.join(probes.select("key", "target").distinct(), ["key", "target"], "left_semi").distinct(), "index")
    return probes, index


def _may_link(x: str, y: str) -> Column:
    """May sets x and y be linked, by their sizes and parity bits?"""
    unequal = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in PARITIES])
    n, k = F.col(f"{x}.n"), F.col(f"{y}.n")
    return ((DENOMINATOR * F.least(n, k) >= NUMERATOR * F.greatest(n, k))
            & (unequal * (DENOMINATOR + NUMERATOR) <= (n + k) * (DENOMINATOR - NUMERATOR)))


def _star_pairs(probes: DataFrame, index: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Each x with one of the leaders of its keys, where sizes and bits allow a link and no path leads there yet."""
    order = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    leaders = index.groupBy("key", "target").agg(F.min(F.struct(order("y").alias("order"), "y")).alias("leader"))
    picks = probes.join(leaders, ["key", "target"]).filter(F.col("x") != F.col("leader.y")).groupBy("x").agg(F.min("leader").alias("l"))
    a, b = sets.alias("a"), sets.alias("b")
    met = picks.select("x", F.col("l.y").alias("y")).join(a, F.col("x") == F.col("a.vertex")).join(b, F.col("y") == F.col("b.vertex"))
    met = met.filter((F.col("a.root") != F.col("b.root")) & _may_link("a", "b"))
    return saved(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "star_pairs")


def _rest_pairs(probes: DataFrame, index: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different components that meet in a key, where sizes and bits allow a link.

    Of each key the component with the most members is not compared with itself; a crowd of linked sets with few
    others makes as many comparisons as it has members. A pair that meets in many keys comes out of one of
    them, in either order at most.
    """
    place, yes, no = ["key", "target"], F.lit(True), F.lit(False)
    rows = probes.select(*place, F.col("x").alias("vertex"), yes.alias("asks"), no.alias("held")).union(
        index.select(*place, F.col("y").alias("vertex"), no.alias("asks"), yes.alias("held")))
    rows = rows.groupBy(*place, "vertex").agg(F.max("asks").alias("asks"), F.max("held").alias("held")).join(sets.select("vertex", "root"), "vertex")
    members = rows.groupBy("key", "target", "root").agg(F.count(F.lit(1)).alias("n"))
    keys = members.groupBy("key", "target").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    keys = saved(keys.filter("roots > 1").drop("roots"), "mixed_keys")
    rows = saved(rows.join(keys, place).withColumn("place", F.xxhash64(*place)), "mixed_places")
    # A set's places; a pair is left to an earlier place where the one asks too and the other is held too. Where the
    # lists are cut, it may come more than once but never not.
    first = lambda flag: F.slice(F.sort_array(F.collect_list(F.when(F.col(flag), F.col("place")))), 1, FIRST_PLACES).alias(f"first_{flag}")
    full = sets.drop("root").join(rows.groupBy("vertex").agg(first("asks"), first("held")), "vertex")
    earlier = lambda flag: F.filter(f"first_{flag}", lambda place: place < F.col("place")).alias("earlier")
    side = lambda flag: saved(rows.filter(flag).join(full, "vertex").select(*rows.columns, "n", *PARITIES, earlier(flag)), f"rest_{flag}")
    p, i = side("asks"), side("held")
    apart = lambda rows: rows.filter("root <> main")
    found = []
    for left, right in ((apart(p), i), (p.filter("root = main"), apart(i))):
        a, b = left.alias("a"), right.alias("b")
        # Of two sets that both ask and are held in a place, only the smaller number asks.
        once = ((F.col("a.vertex") < F.col("b.vertex")) | ~(F.col("a.held") & F.col("b.asks"))) & ~F.arrays_overlap("a.earlier", "b.earlier")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.target") == F.col("b.target")) & (F.col("a.root") != F.col("b.root"))
                     & _may_link("a", "b") & once)
        found.append(met.select(F.least("a.vertex", "b.vertex").alias("a"), F.greatest("a.vertex", "b.vertex").alias("b")))
    return saved(found[0].union(found[1]).distinct(), "rest_pairs")


def _full_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Saved table of the wanted vertices and all their shingles."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print")).alias("r")
    chosen = rows.filter("n > 0").select("vertex", "id", "print").join(wanted, "vertex").groupBy("vertex").agg(first)
    chosen = saved(chosen.select("vertex", F.col("r.id").alias("i"), F.col("r.print").alias("p")), "chosen_rows")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    found = docs.join(chosen, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p"))).select("vertex", _set_of("body").alias("shingles"))
    # Equal rows give their set more than once.
    return saved(found.dropDuplicates(["vertex"]), "full_sets")


def _confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = (full.select(F.col("vertex").alias(v), F.col("shingles").alias(s)) for v, s in (("a", "x"), ("b", "y")))
    common = F.size(F.array_intersect("x", "y"))
    linked = DENOMINATOR * common >= NUMERATOR * (F.size("x") + F.size("y") - common)
    return saved(pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b"), "links")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: `key`, n_shingles, component_id and kept.

    A document's set are the distinct runs of four words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) of its whole
    text; the text as a whole where it has fewer words. Documents are linked where the intersection is at least
    85 per cent of the union; component_id is the smallest key that links lead to, and kept marks it. The search
    loses no link: leaders are compared first, then every pair of different components that shares a key.

    Null, empty and blank texts have no set and are linked with nothing: component_id is their key. A component
    whose keys are all null has a null id; null counts as equal to null for kept. Rows with equal keys keep
    their rows. Other columns are ignored, whatever their names. No rows give no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("print"), body.alias("body"))
    rows = saved(_summaries(docs), "summaries")
    probes, index = probes_and_index(rows)
    wanted = saved(probes.select(F.col("x").alias("vertex")).union(index.select("y")).distinct(), "wanted")
    links = wanted.select(F.col("vertex").alias("a"), F.col("vertex").alias("b")).limit(0)
    if not wanted.isEmpty():
        full = _full_sets(docs, rows, wanted)
        bits = rows.filter("size(keys) > 0").select("vertex", "n", *PARITIES).join(wanted, "vertex", "left_semi").dropDuplicates(["vertex"])
        sets = saved(bits.withColumn("root", F.col("vertex")), "sets")
        for turn in range(STARS + 1):
            pairs = _star_pairs(probes, index, sets, turn) if turn < STARS else _rest_pairs(probes, index, sets)
            links = links.union(_confirmed(pairs, full))
            roots = components(links)
            if turn < STARS:
                known = roots.select(F.col("vertex"), F.col("root").alias("new"))
                sets = saved(bits.join(known, "vertex", "left").withColumn("root", F.coalesce("new", "vertex")).drop("new"), "rooted_sets")
    else:
        roots = links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    named = rows.select("id", "n", "vertex").join(roots, "vertex", "left").select("id", "n", F.coalesce("root", "vertex").alias("root"))
    named = saved(named, "rooted")
    smallest = named.filter("root is not null").groupBy("root").agg(F.min("id").alias("smallest"))
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return named.join(smallest, "root", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
