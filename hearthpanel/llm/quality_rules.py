"""Quality rules with risk-controlled thresholds.

Labelled documents are a holdout on which every candidate cutoff of every signal is tested: may it
wrongly reject more than an allowed share of good documents? Exact binomial tails answer, and only
cutoffs that stand the test under a correction for all tests become rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.llm.store import saved

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
RUN = 5
CELLS = 200
"""Signals are shares from 0 to 1; cutoffs lie on a grid of 1/CELLS."""

SIGNALS = ["symbols", "exclamations", "capitals", "duplicate_lines", "repeats"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations", "n_capitals"]


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("bigint")


def _window_hashes(words: Column) -> Column:
    """Hash of each run of RUN words, in order."""
    return bound(words, lambda w: F.when(F.size(w) >= RUN, F.transform(
        F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda i: F.xxhash64(F.slice(w, i, RUN)))))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = bound(ordered, lambda s: F.filter(s, lambda x, k: (
        F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, nothing, lambda a, s: F.struct(
        (a["n"] + F.least(F.lit(RUN), s + RUN - a["end"])).alias("n"), (s + RUN).alias("end")), lambda a: a["n"].cast("bigint"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """One struct column `row` with all columns of `docs`, and the counts of the whole text as bigints.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (words in runs of five words found twice or more), n_lines (lines
    with a word), n_exclamations, n_capitals. Null text counts as empty. No shuffle.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("body"))
    base = base.select("row", "body", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"),
                       F.filter(F.split("body", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    base = base.select("row", "body", "lines", F.size("words").cast("bigint").alias("n_words"),
                       _window_hashes(F.col("words")).alias("runs"))
    length = F.length("body").cast("bigint")
    repeated = F.size(F.array_distinct("runs")) < F.size("runs")
    return base.select(
        "row", "n_words",
        _without(F.col("body"), SPACES).alias("word_chars"),
        (length - _without(F.col("body"), SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.when(repeated, _covered(F.col("runs"))), F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (length - _without(F.col("body"), "!")).alias("n_exclamations"),
        (length - F.length(F.regexp_replace("body", r"\p{Lu}", ""))).cast("bigint").alias("n_capitals"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def signal_cells() -> dict[str, Column]:
    """Grid cell, 0 to CELLS, of each signal; a text without words or lines has cell 0."""
    share = {"symbols": ("n_symbols", "word_chars"), "exclamations": ("n_exclamations", "word_chars"),
             "capitals": ("n_capitals", "word_chars"), "duplicate_lines": ("n_dup_lines", "n_lines"),
             "repeats": ("n_repeat_words", "n_words")}
    return {name: F.coalesce(F.ceil(F.try_divide(F.col(a) * CELLS, F.col(b))), F.lit(0)).cast("int")
            for name, (a, b) in share.items()}


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1, by Stirling's series seven steps up."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), where k <= n p; 1.0 beyond.

    The largest term comes from log-gamma; the others follow by ratios until they are below the
    precision of a double, which takes in the order of sqrt(n p) steps.
    """
    k, n = k.cast("double"), n.cast("double")
    top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(9 * F.sqrt(n * p)) + 1).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    factor = F.aggregate(F.sequence(F.lit(0), steps), start, lambda a, i: F.struct(
        (a["term"] * (k - i) / (n - k + 1 + i) * ((1 - p) / p)).alias("term"), (a["total"] + a["term"]).alias("total")),
        lambda a: a["total"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top + F.log(factor))))


def fit_cutoffs(measures: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
                quality: str = "quality", false_rejection: float = 0.02, risk: float = 0.05) -> DataFrame:
    """Table of stratum and one cutoff cell per signal; a null cutoff is no rule.

    With probability 1 - `risk` over the labelled holdout, in every stratum at once, at most the share
    `false_rejection` of the good documents is rejected by all signals together. Each signal gets an
    equal part of that share (union bound). For a stratum and a signal the cutoffs are tested from the
    laxest to the strictest and the first failure ends the sequence, so its tests need no correction
    among themselves; Bonferroni corrects for strata times signals. The test is the exact binomial tail
    of the number of good documents beyond the cutoff. All labelled documents take part.

    `measures` is a saved table with `key`, `stratum` and the columns of `signal_cells`. Labels with a
    null key or quality say nothing; of several labels of a key the lowest quality counts, of repeated
    documents one. A null stratum is a stratum. Without labels there are no rules.
    """
    good = labels.filter(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(
        F.col(key).alias("_key")).agg(F.min(quality).alias("_quality")).filter("_quality = 1")
    cells = F.array(*[F.col(s) for s in SIGNALS])
    once = measures.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(F.col(stratum).alias("stratum"), cells.alias("cells"))).alias("m"))
    labelled = once.join(good, "_key").select("m.stratum", F.posexplode("m.cells").alias("signal", "cell"))
    counted = saved(labelled.groupBy("stratum", "signal", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    tests = counted.select("stratum", "signal").distinct().count()
    level = risk / max(1, tests)
    # One row per cutoff that changes anything: reject what lies above the cell.
    own = Window.partitionBy("stratum", "signal")
    above = own.orderBy(F.desc("cell"))
    tail = binomial_tail(F.col("beyond"), F.col("goods"), false_rejection / len(SIGNALS))
    tested = (counted.withColumn("goods", F.sum("n").over(own))
              .withColumn("beyond", F.sum("n").over(above) - F.col("n")).withColumn("tail", tail)
              .withColumn("failed", F.max(F.col("tail") > level).over(above)))
    cutoffs = tested.filter(~F.col("failed")).groupBy("stratum", "signal").agg(F.min("cell").alias("cell"))
    table = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == i, F.col("cell"))).alias(f"max_{s}")
                                             for i, s in enumerate(SIGNALS)])
    return saved(table, "cutoffs")


def _judged(measures: DataFrame, cutoffs: DataFrame, stratum: Column) -> DataFrame:
    """`measures` with base_failed and kept."""
    rules = measures.join(cutoffs, stratum.eqNullSafe(F.col("stratum")), "left")
    beyond = [F.coalesce(F.col(s) > F.col(f"max_{s}"), F.lit(False)) for s in SIGNALS]
    rejected = beyond[0]
    for one in beyond[1:]:
        rejected = rejected | one
    return rules.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | rejected))


def judge(docs: DataFrame, labels: DataFrame, false_rejection: float = 0.02, risk: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of `docs` (doc_id, text, lang).

    Base rules: fewer than 10 words, or over 20 per cent of the words in repeated runs of five. Others
    are the certified cutoffs of `fit_cutoffs`. Counts are taken once and written as a narrow table;
    the texts are read once and never shuffled. Null or empty text: counts 0, base_failed. Repeated
    rows and null ids are judged like any other; extra columns are ignored; no rows give no rows.
    """
    counts = measured(docs.select("doc_id", "text", "lang")).select("row.doc_id", "row.lang", *COUNTS)
    counts = saved(counts.withColumns(signal_cells()), "measures")
    cutoffs = fit_cutoffs(counts, labels, false_rejection=false_rejection, risk=risk)
    return _judged(counts, cutoffs, F.col("lang")).select("doc_id", *COUNTS[:5], "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, false_rejection: float = 0.02, risk: float = 0.05) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns whatever their names.

    The texts are read twice, once to count for the fit and once to judge, rather than written again.
    """
    counts = measured(docs)
    narrow = counts.select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("lang"), *COUNTS)
    cutoffs = fit_cutoffs(saved(narrow.withColumns(signal_cells()).select("doc_id", "lang", *SIGNALS), "measures"),
                          labels, false_rejection=false_rejection, risk=risk)
    return _judged(counts.withColumns(signal_cells()), cutoffs, F.col("row.lang")).filter("kept").select("row.*")
