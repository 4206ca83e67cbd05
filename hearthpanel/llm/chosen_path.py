"""MinHash near-dedup by a chosen-path set similarity join.

Trees branch the documents recursively: a node picks some positions of the minwise signature, and its documents
go on to one child per picked position, by the token that is smallest there. Similar documents agree on most
tokens and so share many paths. All nodes are compared exhaustively, small ones by sketches and large ones by parity
bits, which bound the difference of two sets; independent trees repeat the search until a pair at the threshold is missed with negligible
probability. All links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthpanel.llm.components import components
from hearthpanel.llm.store import saved
from hearthpanel.llm.texts import PARITY_WORDS, mixed, parities, shingle_set, word_hashes

POSITIONS, SKETCH = 64, 512
"""Positions whose tokens paths can go by, and positions that the sketch has a bit of (the former among them)."""
TREES, ROOT_BRANCHES = 4, 4
"""A pair of similarity s agrees on none of the 16 root tokens with probability (1 - s)^16: 2e-10 at 0.75."""
BRANCHES = 2
SHRINK = 0.6
"""A node branches on if no child has more than this share of its sets. With two branches a pair of similarity 0.75 is lost
in a node with a chance below 0.12 however deep the tree, and so in all 16 first nodes with one of about 1e-8."""
SMALL = 200
"""Nodes of at most so many sets are compared by sketches."""
SLICE_SETS = 20_000
"""A larger node's sets are dealt to slices of about so many; each slice meets all sets of its node in a task of its own."""
FIRST_NODES = 32
"""A pair that shares several crowds is made in the first of them, as far as it is among so many first nodes of both sets."""
SHINGLE = 5
BROADCAST_ROWS = 500_000
"""Up to so many wanted rows (three numbers each) are sent to the texts; beyond that the texts are shuffled to them."""
NUMERATOR, DENOMINATOR = 75, 100
LEAST_AGREEMENT = 404
"""Of 512 positions, those that agree in one bit of the token: 448 are expected at similarity 0.75, 256 at 0. Fewer than
404 come by chance with a probability of 1e-7 at the threshold; such pairs are not confirmed."""
SKETCHES = [f"s{k}" for k in range(1, SKETCH // 64 + 1)]
PARITIES = [f"p{k}" for k in range(PARITY_WORDS)]

_RANDOM = np.random.default_rng(20240229)
_FLIP = _RANDOM.integers(0, 1 << 32, SKETCH, dtype=np.uint32)[:, None]
_TIMES = (_RANDOM.integers(0, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1))[:, None]
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("vertex", "n", *SKETCHES, *PARITIES)]
                        + [T.StructField("tokens", T.ArrayType(T.IntegerType()))])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest token at each of SKETCH positions, as a 32-bit hash; positions are independent orders of all shingles."""
    low = np.full(SKETCH, np.iinfo(np.uint32).max, dtype=np.uint32)
    halves = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(halves), 1024):
        part = halves[None, start:start + 1024]
        low = np.minimum(low, ((part ^ _FLIP) * _TIMES).min(axis=1))
    return mixed(low.astype(np.uint64)) & np.uint64(0xFFFFFFFF)


def _summary(text: str | None) -> tuple:
    shingles = shingle_set(word_hashes(text), SHINGLE)
    if len(shingles) == 0:
        return None, 0, *[0] * len(SKETCHES + PARITIES), None
    tokens = signature(shingles)
    # Equal sets get equal numbers, and different ones differ but for a chance of 2^-64.
    vertex = mixed(np.array([mixed(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], dtype=np.uint64))
    bits = [int((_BITS * (tokens[k:k + 64] & np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) for k in range(0, SKETCH, 64)]
    return int(vertex.view(np.int64)[0]), len(shingles), *bits, *parities(shingles).tolist(), tokens[:POSITIONS].astype(np.uint32).view(np.int32)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([shingle_set(word_hashes(t), SHINGLE).view(np.int64) for t in batch])


@F.pandas_udf(_SCHEMA)
def _summaries(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # As objects: a column of numbers with a null among them would go through floats, and equal sets get unequal vertices.
        out = pd.DataFrame([_summary(t) for t in batch], columns=["vertex", "n", *SKETCHES, *PARITIES, "tokens"], dtype=object)
        yield out.astype({"vertex": "Int64", "n": "int64"} | {c: "int64" for c in SKETCHES + PARITIES})


def _child(node: Column, position: Column) -> Column:
    return F.xxhash64(node, position, F.get("tokens", position))


def _differing() -> Column:
    """Positions at which the sketches of rows a and b differ."""
    return sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SKETCHES[1:]),
               F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))))


def _alike() -> Column:
    """May rows a and b be linked, by their sizes and sketches?"""
    return ((DENOMINATOR * F.least("a.n", "b.n") >= NUMERATOR * F.greatest("a.n", "b.n"))
            & (_differing() <= SKETCH - LEAST_AGREEMENT))


def _pairs_of(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """Candidate pairs (a < b) within equal nodes that are not known to be in one component."""
    low, high = F.col("a.vertex"), F.col("b.vertex")
    together = left.alias("a").join(right.alias("b"), (F.col("a.node") == F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
                                    & _alike() & ((low < high) if ordered else (low != high)))
    return together.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).distinct()


def _first_nodes(sets: DataFrame, *columns: str) -> DataFrame:
    """A row per set and root token: the nodes right below the roots of all trees."""
    tokens = F.array(*[F.xxhash64(F.lit(tree), F.lit(p), F.get("tokens", F.lit(p))) for tree in range(TREES)
                       for p in range(tree * ROOT_BRANCHES, (tree + 1) * ROOT_BRANCHES)])
    return sets.select(F.explode(tokens).alias("node"), *columns)


def shared_nodes(sets: DataFrame) -> DataFrame:
    """Saved table of node, size, leader and vertex: the first nodes that several sets are in.

    A leader is the member smallest in an order of the node's own. Of the many nodes that hold a single set, only
    the numbers are shuffled; signatures meet their nodes once those are gone.
    """
    rows = _first_nodes(sets, "vertex")
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("vertex").bitwiseXOR(F.col("node"))).alias("low"))
    leaders = saved(sizes.filter("size > 1").select("node", "size", F.col("low").bitwiseXOR(F.col("node")).alias("leader")), "leaders")
    return saved(rows.join(leaders, "node"), "shared_nodes")


def star_pairs(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """Each set with a leader of each of its first nodes (`shared_nodes`), where the sketches allow a link.

    These few pairs, once confirmed, join most of a crowd of near copies into one component, so that its many
    other pairs need no comparison.
    """
    heads = sets.select("vertex", "n", *SKETCHES)
    members = shared.filter("vertex <> leader").select("vertex", "leader").distinct().join(heads, "vertex")
    met = members.alias("a").join(heads.alias("b"), (F.col("a.leader") == F.col("b.vertex")) & _alike())
    low, high = F.col("a.vertex"), F.col("b.vertex")
    return saved(met.select(F.least(low, high).alias("a"), F.greatest(low, high).alias("b")).distinct(), "star_pairs")


def _nodes(sets: DataFrame, shared: DataFrame, whole: DataFrame, small: int, shrink: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a < b) within small nodes, and the members of large nodes that branching does not divide.

    A large node branches as long as each of its children has at most the share `shrink` of its sets. `whole` has the
    tokens of the sets.
    """
    lean = ["node", "vertex", "root", "n", *SKETCHES]
    members = saved(shared.select("node", "vertex", "size").join(sets.select(*lean[1:]), "vertex"), "members")
    found, crowds, tokens = [], [], whole.select("vertex", "tokens")
    while True:
        few = members.filter(F.col("size") <= small).select(*lean)
        found.append(saved(_pairs_of(few, few, True), "pairs"))
        many = members.filter(F.col("size") > small)
        if many.isEmpty():
            break
        tokens = saved(tokens.join(many.select("vertex").distinct(), "vertex", "left_semi"), "tokens")
        picks = F.array(*[_child(F.col("node"), F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POSITIONS)).cast("int")) for k in range(BRANCHES)])
        children = saved(many.join(tokens, "vertex").select(
            F.col("node").alias("parent"), "size", F.explode(F.array_distinct(picks)).alias("node"), *lean[1:]), "children")
        parts = children.groupBy("parent", "size", "node").agg(F.count(F.lit(1)).alias("part"))
        divided = saved(parts.groupBy("parent", "size").agg(F.max("part").alias("most")).filter(F.col("most") <= F.col("size") * shrink).select("parent"), "divided")
        crowds.append(many.select(*lean).join(divided.withColumnRenamed("parent", "node"), "node", "left_anti"))
        rows = children.join(divided, "parent", "left_semi").select(*lean)
        sizes = saved(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "node_sizes")
        members = saved(rows.join(sizes, "node"), "members")
    return reduce(DataFrame.union, found).distinct(), reduce(DataFrame.union, crowds) if crowds else None


def candidates(sets: DataFrame, small: int = SMALL, shrink: float = SHRINK) -> DataFrame:
    """Candidate pairs (a < b), by sketches, of a saved table of distinct sets (vertex, root, n, sketches, tokens).

    Sets with the same `root` are known to be in one component; their pairs are left out. Nodes of any size are
    compared exhaustively. A crowd gives as many candidates as it has pairs; `links` compares it without making them.
    """
    pairs, crowds = _nodes(sets, shared_nodes(sets), sets, small, shrink)
    return pairs if crowds is None else pairs.union(_pairs_of(crowds, crowds, True)).distinct()


def crowd_pairs(many: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a < b) of different components within large nodes that sizes and parity bits allow to be linked.

    Every pair is looked at, inside the join; only those that may be linked come out. The bits bound the difference
    of two full sets from below, so none that is linked is lost, and crowds that are merely alike make no rows. Sets
    of a node's most frequent component are compared with the others only, and nodes of one component not at all.
    A pair comes out of one of the nodes it shares and in one order, so that rows are as many as pairs.
    """
    roots = many.groupBy("node", "root").agg(F.count(F.lit(1)).alias("sets"))
    nodes = roots.groupBy("node").agg(F.max(F.struct("sets", "root")).alias("top"), F.sum("sets").alias("sets"))
    nodes = nodes.filter(F.col("sets") > F.col("top.sets")).select("node", F.col("top.root").alias("main"), F.ceil(F.col("sets") / SLICE_SETS).cast("int").alias("slices"))
    placed = saved(many.select("node", "vertex", "root", "n").join(nodes, "node"), "placed")
    # A set's nodes; a pair is left to an earlier node that both are in. Where the lists are cut, it may come twice but never not.
    first = placed.groupBy("vertex").agg(F.slice(F.sort_array(F.collect_list("node")), 1, FIRST_NODES).alias("first"))
    full = sets.select("vertex", *PARITIES).join(first, "vertex")
    earlier = F.filter("first", lambda node: node < F.col("node")).alias("earlier")
    mixed_nodes = saved(placed.join(full, "vertex").select(*placed.columns, *PARITIES, earlier), "mixed_nodes")
    others = F.col("root") != F.col("main")
    dealt = mixed_nodes.filter(others).withColumn("slice", F.pmod(F.xxhash64("vertex"), F.col("slices")).cast("int")).alias("a")
    all_sets = mixed_nodes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("b")
    unequal = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in PARITIES])
    n, k = F.col("a.n"), F.col("b.n")
    may = ((DENOMINATOR * F.least(n, k) >= NUMERATOR * F.greatest(n, k))
           & (unequal * (DENOMINATOR + NUMERATOR) <= (n + k) * (DENOMINATOR - NUMERATOR)))
    once = ((F.col("b.root") == F.col("b.main")) | (F.col("a.vertex") < F.col("b.vertex"))) & ~F.arrays_overlap("a.earlier", "b.earlier")
    met = dealt.join(all_sets, (F.col("a.node") == F.col("b.node")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.root") != F.col("b.root")) & may & once)
    low, high = F.least("a.vertex", "b.vertex"), F.greatest("a.vertex", "b.vertex")
    return saved(met.select(low.alias("a"), high.alias("b")).distinct(), "crowd_pairs")


def links(docs: DataFrame, rows: DataFrame, sets: DataFrame, key: str, text: str, small: int = SMALL,
          shrink: float = SHRINK, shared: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Links (a < b) that join the sets with different `root`; `rows` as summarised, `sets` as in `candidates`.

    `shared` are the `shared_nodes`, if there are any yet. Tokens and parity bits can be in a table of their own, `whole`.
    """
    whole = sets if whole is None else whole
    pairs, crowds = _nodes(sets, shared_nodes(whole) if shared is None else shared, whole, small, shrink)
    met = pairs if crowds is None else pairs.union(crowd_pairs(crowds, whole)).distinct()
    return confirmed(docs, rows, saved(met, "candidates"), key, text)


def _summarised(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Saved table of id, print and the summary of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("print"), _summaries(body).alias("s"))
    return saved(rows.select("id", "print", "s.*"), "summaries")


def full_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Saved table of the wanted vertices and all their shingles."""
    # One row of each wanted set gives its text; equal rows would give it more than once.
    some = rows.filter("n > 0").select("vertex", "id", "print").join(wanted, "vertex").groupBy("vertex", "id", "print").agg(F.count(F.lit(1)).alias("equal"))
    chosen = saved(some.groupBy("vertex").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "print", "equal")).alias("r"))
                   .select("vertex", F.col("r.id").alias("i"), F.col("r.print").alias("p"), F.col("r.equal").alias("equal")), "chosen_rows")
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("print"), body.alias("body"))

    def sets_of(chosen: DataFrame) -> DataFrame:
        if chosen.count() <= BROADCAST_ROWS:
            chosen = F.broadcast(chosen)
        found = texts.join(chosen, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p"))).select("vertex", "body")
        return found.select("vertex", _set_of("body").alias("shingles"))

    several = chosen.filter("equal > 1")
    if several.isEmpty():
        return saved(sets_of(chosen), "full_sets")
    # Only the sets of equal rows are shuffled.
    return saved(sets_of(chosen.filter("equal = 1")).union(sets_of(several).dropDuplicates(["vertex"])), "full_sets")


def confirmed(docs: DataFrame, rows: DataFrame, pairs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b, both vertices) whose full sets have the similarity asked for."""
    sets = full_sets(docs, rows, pairs.select(F.col("a").alias("vertex")).union(pairs.select("b")).distinct(), key, text)
    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    linked = DENOMINATOR * common >= NUMERATOR * (F.size("x") + F.size("y") - common)
    return saved(pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, print (hash of the text), n_shingles, component_id and kept.

    A document's set are the distinct runs of five words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) of its whole
    text; the text as a whole where it has fewer words. Documents are linked where the intersection is at
    least 75 per cent of the union; component_id is the smallest key that links lead to, and kept marks it.
    Equal sets are one vertex of the search.

    Null, empty and blank texts have no set and are linked with nothing: component_id is their key. A component
    whose keys are all null has a null id; null counts as equal to null for kept. Rows with equal keys keep
    their rows, all marked alike. Other columns are ignored. No rows give no rows.
    """
    rows = _summarised(docs, key, text)
    sets = saved(rows.filter("n > 0").dropDuplicates(["vertex"]).select("vertex", "n", *SKETCHES, *PARITIES, "tokens"), "sets")
    shared = shared_nodes(sets)
    stars = confirmed(docs, rows, star_pairs(sets, shared), key, text)
    known = components(stars).withColumnRenamed("vertex", "v")
    rooted_sets = saved(sets.select("vertex", "n", *SKETCHES).join(known, F.col("vertex") == F.col("v"), "left").withColumn(
        "root", F.coalesce("root", "vertex")).drop("v"), "rooted_sets")
    roots = components(stars.union(links(docs, rows, rooted_sets, key, text, shared=shared, whole=sets)))
    rooted = saved(rows.select("id", "print", "vertex", "n").join(roots.withColumnRenamed("vertex", "v"), F.col("vertex") == F.col("v"), "left")
                   .select("id", "print", "n", F.coalesce("root", "vertex").alias("root")), "rooted")
    smallest = saved(rooted.groupBy("root").agg(F.min("id").alias("smallest")).filter("root is not null"), "smallest")
    both = rooted.join(smallest, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("smallest"))
    return both.select("id", "print", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.col("id").eqNullSafe(component).alias("kept"), "root")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles, component_id and kept of every document; see `near_duplicates`."""
    return near_duplicates(docs, key, text).select(F.col("id").alias(key), "n_shingles", "component_id", "kept")


def unique_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `docs` per component, with all its columns whatever their names.

    Of a component the row with the smallest key stays (null only if all are), of several with that key one with
    the smallest hash of the text, of equal rows one. Documents without words all stay.
    """
    found = saved(near_duplicates(docs, key, text), "near_duplicates")
    none = F.col("id").isNull()
    stay = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(none.alias("none"), "id", "print")).alias("r")).select(
        F.col("r.id").alias("i"), F.col("r.print").alias("p"))
    stay = saved(stay, "stay")
    here = F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p"))
    with_words = found.filter("root is not null").select("id", "print")
    dropped = saved(with_words.distinct().join(stay, here, "left_anti"), "dropped").select(F.col("id").alias("i"), F.col("print").alias("p"))
    # Equal rows stay once; only they are shuffled with their texts.
    again = with_words.groupBy("id", "print").count().filter("count > 1").select(F.col("id").alias("i"), F.col("print").alias("p"))
    again = saved(again.join(stay.select(F.col("i").alias("j"), F.col("p").alias("q")), F.col("i").eqNullSafe(F.col("j")) & (F.col("p") == F.col("q")), "left_semi"), "again")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    small = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    once = keyed.join(small(dropped.union(again)), here, "left_anti").select("row.*")
    if again.isEmpty():
        return once
    return once.union(keyed.join(small(again), here).groupBy("id", "print").agg(F.first("row").alias("row")).select("row.*"))
