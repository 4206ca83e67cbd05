"""Substring dedup on runs of sentences.

Every run of a few consecutive sentences is hashed and compared with all runs of all documents; sentences
inside a run that occurred before, in an earlier document or earlier in the same one, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.prefilter import maybe_among
from hearthpanel.llm.quality_rules import bound
from hearthpanel.llm.store import saved

RUN = 3
LONG_WORDS = 12
ENDINGS = "adty0-4ADTY"
# A sentence ends behind `.`, `!` or `?` and at a line break. One of more than LONG_WORDS words also ends behind each word
# whose last character is one of ENDINGS, the same words in every copy wherever it begins; what is left of it counts as
# a sentence again. Each character of a text belongs to one piece, a sentence with the white space behind it or a
# rest without words.
# White space is spelled out: Java looks a class of plain characters up in a table, one with \s inside is many times slower.
SPACE = r" \t\n\x0B\f\r"
_WORD, _GAP, _SPACES, _BEYOND = rf"[^{SPACE}.!?]++", r"[ \t\x0B\f\r]", rf"[{SPACE}]*+", rf"(?<![{ENDINGS}])"
PIECE = (rf"(?:{_WORD}{_GAP}*+){{1,{LONG_WORDS}}}+(?:[.!?]++{_SPACES}|\n{_SPACES}|\z)"
         rf"|(?:{_WORD}{_BEYOND}{_GAP}++)++(?:{_WORD})?+[.!?]*+{_SPACES}|{_WORD}[.!?]*+{_SPACES}|[.!?{SPACE}]++")
AFTER_IDS = 1 << 62


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def _sentences(pieces: Column) -> Column:
    """Place and wording (lower case, white space made even) of the pieces that hold more than signs."""
    even = F.transform(pieces, lambda p, i: F.struct(
        i.alias("at"), F.lower(F.trim(F.regexp_replace(p, r"\s+", " "))).alias("wording")))
    return F.filter(even, lambda s: s["wording"].rlike(r"[^.!? ]"))


def _occurrences(sentences: Column, sized: bool) -> Column:
    """Hash and first and last piece (one number, `span`) of each run, and whether the text has the run before (`again`).

    If asked, also `sizes`: place and words of each sentence.
    """
    def runs(s):
        return F.when(F.size(s) >= RUN, F.transform(F.sequence(F.lit(0), F.size(s) - RUN), lambda i: F.struct(
            F.xxhash64(*[F.get(s, i + k)["wording"] for k in range(RUN)]).alias("hash"),
            (F.shiftleft(F.get(s, i)["at"].cast("bigint"), 32) + F.get(s, i + RUN - 1)["at"]).alias("span"),
            *([F.array(*[F.shiftleft(F.get(s, i + k)["at"].cast("bigint"), 32) + F.size(F.split(F.get(s, i + k)["wording"], " "))
                         for k in range(RUN)]).alias("sizes")] if sized else []))))
    kept = ["hash", "span", *(["sizes"] if sized else [])]
    return bound(F.array_sort(bound(sentences, runs)), lambda s: F.transform(s, lambda r, k: F.struct(
        *[r[c].alias(c) for c in kept], F.coalesce(F.get(s, k - 1)["hash"] == r["hash"], F.lit(False)).alias("again"))))


def _first(run: Column) -> Column:
    return F.shiftright(run["span"], 32).cast("int")


def _last(run: Column) -> Column:
    return run["span"].bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _stretches(runs: Column, least_words: int) -> Column:
    """Pieces of the stretches of `least_words` words; a stretch is all runs (sorted) that overlap or adjoin."""
    pieces = lambda first, last: F.sequence(_first(first), _last(last))
    if not least_words:
        return F.array_distinct(F.flatten(F.transform(runs, lambda r: pieces(r, r))))

    def cut(r):
        starts = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: (k == 0) | (_first(F.get(r, k)) > _last(F.get(r, k - 1)) + 1))
        return bound(starts, lambda at: F.transform(at, lambda low, i: F.slice(r, low + 1, F.coalesce(F.get(at, i + 1), F.size(r)) - low)))

    def words(stretch):
        # Place and words in one number, as distinct structs are found by comparing all with all.
        sentences = F.array_distinct(F.flatten(F.transform(stretch, lambda r: r["sizes"])))
        return F.aggregate(sentences, F.lit(0).cast("bigint"), lambda total, s: total + s.bitwiseAND(F.lit((1 << 32) - 1)))
    long_enough = F.filter(bound(runs, cut), lambda stretch: words(stretch) >= least_words)
    return F.flatten(F.transform(long_enough, lambda t: pieces(F.get(t, F.lit(0)), F.get(t, F.size(t) - 1))))


def repeated_pieces(keyed: DataFrame, least_words: int = 0) -> DataFrame:
    """Pieces to remove: rank, print and `gone` (distinct piece places), one row per changed document.

    `keyed` has rank (order of the documents), print (hash of the text) and body.
    """
    spread = keyed.select("rank", "print", F.explode(_occurrences(_sentences(_pieces(F.col("body"))), least_words > 0)).alias("o")).select(
        "rank", "print", "o.*")
    # Sums per hash are taken before the shuffle, so a passage that a third of all documents share is cheap. Nothing else of all runs is
    # shuffled: those that a map of the frequent hashes lets pass are few more than those that do repeat.
    frequent = saved(spread.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "frequent_runs")
    passing = saved(maybe_among(spread, F.col("hash"), frequent).filter("maybe").drop("maybe"), "passing_runs")
    repeated = saved(passing.groupBy("hash").agg(F.min("rank").alias("holder"), F.max("rank").alias("other"), F.max("again").alias("twice"))
                     .filter("holder <> other or twice").select("hash", "holder"), "repeated_runs")
    # Both tables are read from storage, so that the join may split the parts of a hot hash.
    later = passing.join(repeated, "hash").filter("rank > holder or again")
    runs = later.groupBy("rank", "print").agg(F.array_sort(F.collect_set(F.struct("span", *(["sizes"] if least_words else [])))).alias("runs"))
    return runs.select("rank", "print", _stretches(F.col("runs"), least_words).alias("gone")).filter(F.size("gone") > 0)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 0) -> DataFrame:
    """`docs` as one struct column `row`, with n_sentences, n_removed (both long) and clean (the new text).

    A run is RUN consecutive sentences; over-long ones count in parts that are cut by content. Of equal runs (lower-cased, white space made even) the first stays: the
    one in the document with the smallest key, and of those in one document the first. Every sentence inside another
    occurrence goes, with the signs and white space between; the rest of the text stays as it is. With `least_words`
    occurrences that overlap or adjoin are one stretch, and stretches of fewer words stay.

    Null and empty texts: no sentences, nothing removed, the text stays null or empty. Texts of fewer than RUN
    sentences stay. Documents with a null key come after all others, in the order of a hash of their text. Rows
    with the same key are one document: runs are not removed for occurring in another of its rows. Equal
    rows are treated alike. Columns of `docs` may have any names.
    """
    print_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rank = F.coalesce(F.col(key).cast("bigint"), print_.bitwiseAND(F.lit(AFTER_IDS - 1)) + F.lit(AFTER_IDS))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), rank.alias("rank"), print_.alias("print"))
    runs = docs.select(F.col(text).alias("body"), rank.alias("rank"), print_.alias("print"))
    gone = saved(repeated_pieces(runs, least_words), "removed_pieces")
    # Only texts that may lose pieces are shuffled to them.
    marked = maybe_among(keyed, F.col("print"), saved(gone.select("print").distinct(), "changed_prints"))
    left = lambda body: F.when(F.col("gone").isNull(), body).otherwise(bound(_pieces(body), lambda p: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda i: F.get(p, i)), "")))
    count = lambda body: F.size(F.filter(_pieces(body), lambda p: p.rlike(r"[^.!?\s]")))
    answer = lambda rows: rows.select("row", count(F.col("row").getField(text)).cast("bigint").alias("n_sentences"),
                                      F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                                      left(F.col("row").getField(text)).alias("clean"))
    untouched = marked.filter(~F.col("maybe")).withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    return answer(marked.filter("maybe").join(gone, ["rank", "print"], "left")).union(answer(untouched))


def deduplicated_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeats removed from `text`; a column n_chars follows the new text."""
    found = remove_repeats(docs, key, text)
    new = {text: F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
