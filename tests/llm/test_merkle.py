"""The manifest against a plain recursive one, with nulls, ties, repeats, clashing columns and uneven groups."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hearthpanel.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, grp string, pos long, n long, hash string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fanout=3):
    """The last node and each node's (before, after) per level."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for i in run:
                for x in below[i]:
                    paths[x].append(("".join(nodes[k] for k in run if k < i), "".join(nodes[k] for k in run if k > i)))
        below = [[x for i in run for x in below[i]] for run in runs]
        nodes = [H(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        members = sorted(((r[0] is not None, r[0] or 0, leaf(r[:5])), r) for r in groups[name])
        subs[name] = members, *climb([m[0][2] for m in members])
    root, over = climb([subs[name][1] for name in names])
    out = []
    for name, above in zip(names, over):
        members, sub, paths = subs[name]
        for ((_, _, own), r), path in zip(members, paths):
            path = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].replace("\n", ""))) if changed else own
            for before, after in path:
                folded = H(before, folded, after)
            out.append((r[0], own, sub, root, H(*[b + a for b, a in path]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    extra = ("x", "y", 1, 2, "z")
    out = [(i, rng.choice(["big", "big", "big", "é", "a"]), rng.choice(["en", None]), rng.choice([None, 3]),
            rng.choice([None, "", "a\nb", "é\n\n", "plain", "long " * 50_000]), *extra) for i in range(260)]
    out += [(500 + i, "nine", "en", 1, "t\n", *extra) for i in range(9)] + [(600, "lone", "en", 1, "t\n", *extra)]
    out += [(700, "ten", "de", 1, str(i), *extra) for i in range(10)] + [out[0], out[0]]  # ties and repeats
    return out + [(None, None, None, None, None, None, None, None, None, None), (None, "", "en", 1, "\n", *extra), (800, None, "en", 1, "\n", *extra)]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_manifest_is_the_plain_one(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.judge(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = as_rows(got)
    assert found == plain(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2), (4, 3)])
def test_levels_per_shuffle_do_not_matter(spark, rows, fanout, levels):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.manifest(docs, ["doc_id", "text"], "source", "doc_id", fanout=fanout, levels=levels).select(
        "key", "leaf", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("again"))
    found = found.collect()
    assert len(found) == len(rows) and all(r.again == r.root for r in found) and len({r.root for r in found}) == 1


def test_no_rows(spark):
    assert merkle.judge(spark.createDataFrame([], SCHEMA)).collect() == []
