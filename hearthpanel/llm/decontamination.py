"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question with other numbers or persons keeps
its template. Windows of template tokens are joined with those of the benchmark; on each diagonal the
values behind the placeholders must correspond one to one (slot consistency). Items too short or too plain in
placeholders for that are looked for word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.store import saved
from hearthpanel.llm.texts import blocks, lowered, span_hashes, utf8, window_hashes, word_bounds

WIDTH = 8
LEAST_LITERAL = 5
"""A window counts if at least so many of its WIDTH tokens are plain words."""
LEAST_SHARE = 0.6
"""A document holds an item if it has this share of the item's windows."""
FILTER_WINDOWS = 4_000_000
"""Up to so many benchmark windows, their hashes (8 bytes each) go to the tasks as a filter."""

# Units of measure that may follow a number.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "feet", "miles", "meters", "metres", "mg", "g", "kg", "grams", "pounds",
         "tons", "ml", "l", "liters", "litres", "gallons", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
         "dollars", "euros", "cents", "usd", "eur", "percent", "degrees", "kmh", "mph", "watts", "volts"]

_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:256] = False
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?:\n"]] = True
_EXACT = np.uint64(0xA5A5_5A5A_C3C3_3C3C)
_NUMBER, _NAME, _UNIT = (np.uint64(k) for k in (1, 2, 3))


def _hash_word(word: str) -> int:
    data = utf8(word)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


_UNIT_HASHES = np.sort(np.array([_hash_word(u) for u in UNITS], dtype=np.uint64))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of `values` are in the sorted array `known`."""
    if len(values) == 0 or len(known) == 0:
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def template(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Template tokens and values of a whole text, as two arrays of hashes of the same length.

    A token is a run of letters and digits (all characters beyond ASCII count as letters). One with a digit
    is a number; `.` or `,` between digits does not end it. A unit of measure behind a number is a unit. A capital
    that does not begin a sentence makes a name; names with one space between are one. Others stand for themselves,
    A-Z lower-cased. The value is the hash of the token (of its first part for numbers and names of several).
    """
    parts = [_template_block(block) for block in blocks(utf8(text), _END)]
    if not parts:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    return np.concatenate([t for t, _ in parts]), np.concatenate([v for _, v in parts])


def _template_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_bounds(data, _GAP)
    if len(starts) == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    value = span_hashes(lowered(data), starts, ends)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    number = digits[ends] > digits[starts]
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    # Capital letters of ASCII and of the Latin-1 block in UTF-8.
    capital = ((first >= 65) & (first < 91)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    opening = np.ones(len(starts), dtype=bool)
    opening[1:] = stops[starts[1:]] > stops[ends[:-1]]
    name = capital & ~opening & ~number
    gap = np.zeros(len(starts), dtype=np.uint8)
    narrow = starts[1:] - ends[:-1] == 1
    gap[1:] = np.where(narrow, data[ends[:-1] % len(data)], 0)
    follows = np.zeros(len(starts), dtype=bool)
    follows[1:] = (number[1:] & number[:-1] & ((gap[1:] == 46) | (gap[1:] == 44))) | (name[1:] & name[:-1] & (gap[1:] == 32))
    unit = np.zeros(len(starts), dtype=bool)
    behind = np.flatnonzero(number[:-1] & ~number[1:]) + 1
    unit[behind] = _among(value[behind], _UNIT_HASHES)
    token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return token[~follows], value[~follows]


def windows(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the windows of a text that count, and its tokens and values."""
    token, value = template(text)
    hashes = window_hashes(token, WIDTH)
    literal = np.concatenate([[0], np.cumsum(token > _UNIT)])
    counts = literal[WIDTH:] - literal[:-WIDTH] if len(hashes) else np.empty(0)
    at = np.flatnonzero(counts >= LEAST_LITERAL)
    return at, hashes[at], token, value


def plain_words(text: str | None) -> np.ndarray:
    """Hash of each run of letters and digits of a whole text, A-Z lower-cased, without placeholders."""
    parts = [span_hashes(lowered(block), *word_bounds(block, _GAP)) for block in blocks(utf8(text), _END)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def exact_windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` plain words, apart from those of template windows."""
    return window_hashes(words, width) ^ _EXACT


_FOUND = "array<struct<at:int,hash:bigint,slots:array<bigint>,width:int>>"


def _with_windows(rows: DataFrame, wanted=None, widths: list[int] | None = None) -> DataFrame:
    """`rows` (with `body`) and `found`: their windows, only those with a hash in the broadcast `wanted` if given.

    `slots` has for each placeholder of the window its type, its place in the window and its value, in turn. With `widths`,
    also the runs of so many plain words; their `width` is not 0. Without, a text that has no window that counts has
    its runs of WIDTH plain words, or all its words if they are fewer.
    """
    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                at, hashes, token, value = windows(text)
                if wanted is not None and len(at):
                    keep = _among(hashes, wanted.value)
                    at, hashes = at[keep], hashes[keep]
                found = []
                for place, code in zip(at.tolist(), hashes.view(np.int64).tolist()):
                    inside = np.flatnonzero(token[place:place + WIDTH] <= _UNIT)
                    slots = np.stack([token[place + inside], inside.astype(np.uint64), value[place + inside]], axis=1)
                    found.append({"at": place, "hash": code, "slots": slots.reshape(-1).view(np.int64).tolist(), "width": 0})
                plain = plain_words(text) if (widths if widths is not None else not found) else np.empty(0, dtype=np.uint64)
                for width in widths if widths is not None else [min(WIDTH, len(plain))]:
                    hashes = exact_windows(plain, width) if 0 < width <= len(plain) else plain[:0]
                    at = np.flatnonzero(_among(hashes, wanted.value)) if wanted is not None else np.arange(len(hashes))
                    found += [{"at": place, "hash": code, "slots": [], "width": width}
                              for place, code in zip(at.tolist(), hashes[at].view(np.int64).tolist())]
                out.append(found)
            yield pd.Series(out)

    return rows.withColumn("found", find(F.coalesce("body", F.lit("")))).drop("body")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents as (id, print), and the found pairs as (id, print, item, share).

    A pair is found if the windows that the document shares with the item, on diagonals with consistent slots,
    are at least LEAST_SHARE of the item's windows. Slots of a diagonal are consistent if each value of the item
    stands for one value in the document and each value of the document for one of the item, per type. Items without
    a window that counts (fewer than WIDTH template tokens, or too few plain words) are looked for by the words themselves:
    all of them in a row, or LEAST_SHARE of their runs of WIDTH words.
    """
    spark = docs.sparkSession
    items = _with_windows(benchmark.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(item_text).alias("body")).distinct())
    items = saved(items.select("item", F.explode("found").alias("w")).select(
        "item", F.col("w.at").alias("place"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("given"), F.col("w.width").alias("width")), "benchmark_windows")
    sizes = saved(items.groupBy("item").agg(F.countDistinct("place").alias("windows")), "benchmark_sizes")
    widths = sorted(r.width for r in items.filter("width > 0").select("width").distinct().collect())
    wanted = None
    if items.count() <= FILTER_WINDOWS:
        hashes = [r.hash for r in items.select("hash").distinct().collect()]
        wanted = spark.sparkContext.broadcast(np.sort(np.array(hashes, dtype=np.int64).view(np.uint64)))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("print"), body.alias("body"))
    rows = saved(_with_windows(rows, wanted, widths), "document_windows")
    keys = ["id", "print", "item"]
    met = (rows.select("id", "print", F.explode("found").alias("w"))
           .select("id", "print", F.col("w.at").alias("at"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("slots")).distinct()
           .join(items.drop("width"), "hash").withColumn("diagonal", F.col("at") - F.col("place")))
    met = saved(met.select(*keys, "diagonal", "place", F.arrays_zip("slots", "given").alias("pairs")), "met_windows")
    # Every third entry is a value, behind its type and place.
    values = F.transform(F.sequence(F.lit(2), F.size("pairs") - 1, F.lit(3)), lambda i: F.struct(
        F.get(F.col("pairs"), i - 2)["slots"].alias("type"), F.get(F.col("pairs"), i)["slots"].alias("here"),
        F.get(F.col("pairs"), i)["given"].alias("there")))
    slots = met.filter(F.size("pairs") > 0).select(*keys, "diagonal", F.explode(values).alias("v")).select(
        *keys, "diagonal", "v.*").distinct()
    line = [*keys, "diagonal", "type"]
    several = lambda side, other: slots.groupBy(*line, side).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, "diagonal")
    # Numbers, names and units must each correspond one to one.
    broken = saved(several("there", "here").union(several("here", "there")).distinct(), "broken_diagonals")
    same = F.lit(True)
    for name in (*keys, "diagonal"):
        same = same & met[name].eqNullSafe(broken[name])
    shares = (met.join(broken, same, "left_anti").groupBy(*keys).agg(F.countDistinct("place").alias("seen"))
              .join(sizes, "item").withColumn("share", F.col("seen") / F.col("windows")))
    return rows.select("id", "print"), saved(shares.filter(F.col("share") >= LEAST_SHARE).select(*keys, "share"), "contaminated")


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key`, contaminated (boolean), n_items (long), items (ascending ids) and share (of the best item) of every document.

    Null and empty texts hold nothing. Items with a null id or without a word are not looked for; an item
    of one word is held by every document with that word. Rows equal in key and text share the answer, each
    keeps its row. Other columns are ignored. Without benchmark or documents nothing is found.
    """
    rows, pairs = contaminated(docs, benchmark, key)
    best = pairs.groupBy(F.col("id").alias("i"), F.col("print").alias("p")).agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    both = rows.join(best, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")), "left")
    return both.select(F.col("id").alias(key), F.col("items").isNotNull().alias("contaminated"),
                       F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), "items",
                       F.coalesce("share", F.lit(0.0)).alias("share"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, with all their columns whatever their names."""
    _, pairs = contaminated(docs, benchmark, key, text)
    bad = pairs.select(F.col("id").alias("i"), F.col("print").alias("p")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"))
    return keyed.join(bad, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p")), "left_anti").select("row.*")
