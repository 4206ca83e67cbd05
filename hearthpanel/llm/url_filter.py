"""URL filters: a rule list first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.licenses import LOWER, UPPER
from hearthpanel.llm.quality_rules import bound
from hearthpanel.llm.store import saved

# Fixed values: (verdict, host/path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
FEATURES = ["length", "host_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters",
            "fragment", "longest_part", "suffix_rows", "suffix_blocked"]
PRIOR_ROWS = 20.0
HELD_OUT_OF = 5
"""One labelled host in so many is held out to choose the cutoffs."""
FALSE_BLOCKS = 0.02
"""Share of the held-out allowed URLs that may be blocked, among those of seen suffixes and those of unseen ones."""


def host_of(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without a host part."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, null without one.

    A rule fits its host and all subdomains where the path begins with the rule's path.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, start = rule.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    def of(t):
        size = F.greatest(F.length(t), F.lit(1))
        counts = F.transform(F.array_distinct(F.split(t, "")), lambda c: F.length(t) - F.length(F.replace(t, c, F.lit(""))))
        return F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda a, n: a - n / size * F.log2(n / size))
    return bound(text, of)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that need nothing but `url`, `host` and `path`, all double."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    columns = {
        "length": size, "host_length": F.length("host"), "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), "."), "hyphens": count(F.col("host"), "-"),
        "digit_ratio": (size - F.length(F.translate(url, "0123456789", ""))) / F.greatest(size, F.lit(1)),
        "entropy": _entropy(url),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "longest_part": F.array_max(F.transform(F.split(url, r"[^A-Za-z]+"), lambda p: F.length(p))),
    }
    return pages.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in columns.items()} | {
        "suffix": F.regexp_extract("host", r"[^.]*$", 0)})


def _featured(urls: DataFrame, statistics: DataFrame, rate: float, counted: bool) -> DataFrame:
    """Adds the log of the labelled rows of the host's last label, and their share of blocked ones, drawn to the
    overall `rate`; then the vector of all features.

    `unseen` marks rows for which nothing is known of the suffix. Rows that were counted themselves leave their own label out.
    """
    own = (F.lit(1.0), F.col("label")) if counted else (F.lit(0.0), F.lit(0.0))
    known = lambda n, mine: F.when(F.col("unseen"), F.lit(0.0)).otherwise(n - mine)
    rows, blocked = known(F.col("suffix_all"), own[0]), known(F.col("suffix_hits"), own[1])
    joined = urls.join(statistics, "suffix", "left").withColumn("unseen", F.col("unseen") | F.col("suffix_all").isNull())
    joined = joined.withColumns({"suffix_rows": F.log1p(rows), "suffix_blocked": (blocked + rate * PRIOR_ROWS) / (rows + PRIOR_ROWS)})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(joined)


def _labelled(pages: DataFrame, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Pages with host, path and the rule that fits, and a saved table of the distinct URLs with a rule."""
    base = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules))
    distinct = base.filter("fit is not null").select("url", "host", "path", "fit.verdict").distinct()
    return base, saved(lexical(distinct).withColumn("label", (F.col("verdict") == "block").cast("double")), "labelled_urls")


def _fit(labelled: DataFrame, n: int, hits: float, trees: int, depth: int):
    """The trees, the suffix statistics, and the held-out URLs with `block` (the trees' probability), seen and unseen in turn.

    Half of the training URLs hide the statistics of their suffix, so that the trees learn to do without. Where either
    part lacks a class, the trees are fitted on all labelled URLs and nothing is held out (None).
    """
    rate = hits / n
    statistics = saved(labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("suffix_all"), F.sum("label").alias("suffix_hits")), "suffixes")
    weight = F.when(F.col("label") == 1.0, n / (2 * hits)).otherwise(n / (2 * (n - hits)))
    urls = labelled.withColumns({
        "held": F.pmod(F.xxhash64("host", F.lit("held")), F.lit(HELD_OUT_OF)) == 0, "weight": weight})
    parts = urls.groupBy("held").agg(F.countDistinct("label").alias("classes")).filter("classes = 2").count()
    training = urls.filter("not held") if parts == 2 else urls
    training = training.withColumn("unseen", F.pmod(F.xxhash64("url", F.lit("hidden")), F.lit(2)) == 0)
    training = saved(_featured(training, statistics, rate, True).select("features", "label", "weight"), "training_urls")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, weightCol="weight").fit(training)
    if parts < 2:
        return model, statistics, None
    views = urls.filter("held").withColumn("unseen", F.explode(F.array(F.lit(False), F.lit(True))))
    scored = _blocked(model, _featured(views, statistics, rate, True)).select("unseen", "label", "block")
    return model, statistics, saved(scored, "held_out_urls")


def _blocked(model, featured: DataFrame) -> DataFrame:
    return model.transform(featured).withColumn("block", F.get(vector_to_array("probability"), F.lit(1)))


def _cutoffs(scored: DataFrame | None) -> dict[bool, float]:
    """Probability from which on URLs of seen (False) and unseen suffixes are blocked: 0.5, or more if that blocks too many allowed ones."""
    out = {False: 0.5, True: 0.5}
    if scored is not None:
        high = scored.filter("label = 0").groupBy("unseen").agg(F.percentile("block", 1 - FALSE_BLOCKS).alias("high"))
        out |= {r.unseen: max(0.5, r.high) for r in high.collect()}
    return out


def held_out_errors(pages: DataFrame, rules: list[tuple[str, str]] = RULES, trees: int = 20, depth: int = 4) -> DataFrame:
    """Per view of the held-out URLs (`unseen`: without the statistics of their suffix) the cutoff, the allowed and blocked
    ones, and how many of them the trees block wrongly and miss. Empty where nothing could be held out."""
    schema = "unseen boolean, cutoff double, n_allowed bigint, n_blocked bigint, false_blocks bigint, misses bigint"
    _, labelled = _labelled(pages.select("url"), rules)
    classes = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("hits")).first()
    scored = _fit(labelled, classes.n, classes.hits, trees, depth)[2] if 0 < classes.hits < classes.n else None
    if scored is None:
        return pages.sparkSession.createDataFrame([], schema)
    cutoffs = _cutoffs(scored)
    cutoff = F.when(F.col("unseen"), cutoffs[True]).otherwise(cutoffs[False])
    of = lambda condition: F.count_if(condition)
    bad, block = F.col("label") == 1.0, F.col("block") > cutoff
    return scored.groupBy("unseen").agg(F.max(cutoff).alias("cutoff"), of(~bad).alias("n_allowed"), of(bad).alias("n_blocked"),
                                        of(~bad & block).alias("false_blocks"), of(bad & ~block).alias("misses"))


def judge(pages: DataFrame, key: str = "page_id", rules: list[tuple[str, str]] = RULES,
          trees: int = 20, depth: int = 4) -> DataFrame:
    """`key`, host, path, rule and verdict ('allow' or 'block') of every page's `url`.

    A URL that a rule fits has that rule's verdict. These URLs are also the labelled ones from which
    the trees learn; all other URLs get the verdict of the trees. The trees are fitted on all
    distinct labelled URLs but those of held-out hosts, both classes weighing the same; the statistics of host suffixes
    cover all distinct labelled URLs. The cutoffs for URLs of seen and unseen suffixes come from held-out hosts.
    Where the labelled URLs are all of one class, that is the verdict, and 'allow' where there are none.

    Null URLs and URLs without `://` have empty host and path and are judged by the trees. Repeated
    URLs train once and are all judged. Other columns are ignored. No rows give no rows.
    """
    base, labelled = _labelled(pages.select(F.col(key), "url"), rules)
    classes = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("hits")).first()
    if 0 < classes.hits < classes.n:
        model, statistics, scored = _fit(labelled, classes.n, classes.hits, trees, depth)
        cutoffs = _cutoffs(scored)
        rows = lexical(base).withColumn("unseen", F.lit(False))
        judged = _blocked(model, _featured(rows, statistics, classes.hits / classes.n, False))
        cutoff = F.when(F.col("unseen"), cutoffs[True]).otherwise(cutoffs[False])
        learned = F.when(F.col("block") > cutoff, "block").otherwise("allow")
    else:
        judged, learned = base, F.lit("block" if classes.hits else "allow")
    return judged.select(key, "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce(F.col("fit.verdict"), learned).alias("verdict"))
