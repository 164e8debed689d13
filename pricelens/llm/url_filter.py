"""URL filter: stated rules first, then association rules mined from labelled pages.

Spark's FP-growth mines sets of URL tokens that occur with bad pages. A set becomes a rule if its support
and confidence are high enough and no part of it is a rule of the same confidence or more.

Tokens of the same labelled pages (the parts of one path, say) would make every set of them frequent, 2^40 for a path
of 40 tokens. They are one class, and FP-growth sees one token of each class. That loses no rule: sets with
several tokens of a class are as sure as those with one, and go; and what is left is the rules of the classes, with any token of
each class in its place. So a rule is a list of classes, and fits a URL that has a token of each.

Rules are matched through an inverted index: each rule is listed under the tokens of its rarest class, the distinct URLs' tokens are
joined to that list, and a hit counts when the URL has a token of every class of the rule. DataFrame and ML functions only.

Labels are those of the pages: ``label_id`` names a page as ``page_id`` does (the given tables number both from 0, and no other
column connects them).

Defined cases: a null URL or one without ``://`` has an empty host and path, and no tokens, so that no rule
fits and the verdict is allow; repeated rows get the same verdict; labels of one page are merged (bad if any
is); without labels or pages no rules are mined. Extra columns are kept, and those named like an output replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import broadcast_if_small, lower_ascii, unused
from pricelens.session import cut_lineage

#: (action, host and path) of the stated rules
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.005     # share of labelled pages that are bad and have all tokens of the rule
MIN_ROWS = 20           # pages behind a rule, however few are labelled
MIN_CONFIDENCE = 0.6    # share of bad pages among those with all tokens
BAD = "=bad"            # the label as an item; no token begins with "="
RULE = "tokens array<string>, confidence double, support long, classes array<array<string>>"
INDEX_BROADCAST_ROWS = 50_000  # rules beyond this many are joined by shuffle


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, then words of path, query and fragment with digits as 0."""
    rest = F.regexp_replace(lower_ascii(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*(.*)$", 1)), "[0-9]+", "0")
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(rest, r"[^\p{L}0-9_-]+"), lambda x: F.concat(F.lit("w:"), x))
    both = F.array_distinct(F.concat(host, words))
    return F.coalesce(F.filter(both, lambda x: F.length(x) > 2), F.array().cast("array<string>"))


def stated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest of the stated rules that fits, as struct(rule, action); null if none does."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):  # a longer one later takes over
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, support, classes) from (url, bad), pruned by support, confidence and generality."""
    spark = labelled.sparkSession
    rows = cut_lineage(labelled.select(F.monotonically_increasing_id().alias("row"), tokens_of(F.col("url")).alias("own"), "bad"))
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if n_bad < MIN_ROWS:
        return spark.createDataFrame([], RULE)
    share = max(min_support, MIN_ROWS / n)
    each = rows.select("row", "bad", F.explode("own").alias("token"))
    classes = cut_lineage(token_classes(each, share * n))
    kept = each.join(broadcast_if_small(classes.select("token", "name").filter("token = name")), "token")
    items = (kept.groupBy("row", "bad").agg(F.collect_list("name").alias("items"))
             .select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    items = cut_lineage(items)
    # shares are of all labelled pages, also of those without a frequent token
    left = items.count()
    if not left:
        return spark.createDataFrame([], RULE)
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, share * n / left)).fit(items).freqItemsets
    sets = cut_lineage(sets.select(F.sort_array("items").alias("tokens"), F.col("freq").alias("support")))
    bad = sets.filter(F.array_contains("tokens", BAD)).select(F.array_remove("tokens", BAD).alias("tokens"), "support")
    rules = (bad.filter(F.size("tokens") > 0)
             .join(sets.withColumnRenamed("support", "all"), "tokens")
             .select("tokens", (F.col("support") / F.col("all")).alias("confidence"), "support")
             .filter(F.col("confidence") >= min_confidence))
    # a rule goes if the same tokens but one are a rule that is as sure (rules of all sizes are in the table)
    parts = (rules.select("tokens", "confidence", F.explode("tokens").alias("less"))
             .select("tokens", "confidence", F.array_remove("tokens", F.col("less")).alias("part")))
    wider = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("wider"))
    redundant = parts.join(wider, "part").filter(F.col("wider") >= F.col("confidence")).select("tokens").distinct()
    rules = rules.join(redundant, "tokens", "left_anti")
    members = classes.groupBy("name").agg(F.sort_array(F.collect_list("token")).alias("members"))
    whole = (rules.select("*", F.explode("tokens").alias("name")).join(members, "name")
             .groupBy("tokens", "confidence", "support").agg(F.array_sort(F.collect_list("members")).alias("classes")))
    return cut_lineage(whole)


def token_classes(each: DataFrame, least: float) -> DataFrame:
    """(token, name) of the tokens on ``least`` rows or more, from (row, token): tokens of the same rows share a name, the first of them.

    Row sets are told apart by their sizes and two sums of row hashes, of 64 bits each.
    """
    part = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(20,0)"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).filter(F.col("n") >= least)
    names = marks.groupBy("n", "a", "b").agg(F.min("token").alias("name"))
    return marks.join(names, ["n", "a", "b"]).select("token", "name")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct URLs that some mined rule fits."""
    listed = rules.select("classes", "confidence", F.explode("classes").alias("class"))
    per = rules.select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    rarest = (listed.join(per, "class").groupBy("classes", "confidence")
              .agg(F.min_by("class", F.struct("n", "class")).alias("class")))
    index = broadcast_if_small(rarest.select("classes", "confidence", F.explode("class").alias("token")), INDEX_BROADCAST_ROWS)
    own = urls.distinct().select("url", tokens_of(F.col("url")).alias("own"))
    return (own.select("url", "own", F.explode("own").alias("token")).join(index, "token")
            .filter(F.forall("classes", lambda c: F.arrays_overlap(c, F.col("own"))))
            .groupBy("url").agg(F.max("confidence").alias("confidence")))


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", label_id: str = "doc_id",
          quality: str = "quality", toxic: str = "toxic", rules: Sequence[tuple[str, str]] = RULES,
          min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` with host, path, rule, verdict and confidence (of the mined rule that fits best, if any)."""
    bad = F.coalesce(F.col(quality) == 0, F.lit(False)) | F.coalesce(F.col(toxic) == 1, F.lit(False))
    marks = labels.select(F.col(label_id).alias("_id"), bad.alias("bad")).groupBy("_id").agg(F.max("bad").alias("bad"))
    labelled = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("url")).join(marks, "_id")
    mined = mine_rules(labelled.select("url", "bad"), min_support, min_confidence)
    hits = fired(pages.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()), mined)
    hit_url, hit, stated = (unused(pages.columns, c) for c in ("_url", "_confidence", "_stated"))
    hits = hits.select(F.col("url").alias(hit_url), F.col("confidence").alias(hit))
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumn(stated, stated_rule(F.col("host"), F.col("path"), rules))
    out = out.join(hits, F.col(url) == F.col(hit_url), "left")
    mined_verdict = F.when(F.col(hit).isNotNull(), "block").otherwise("allow")
    return (out.withColumns({"rule": F.col(f"{stated}.rule"), "confidence": F.col(hit),
                             "verdict": F.coalesce(f"{stated}.action", mined_verdict)})
            .drop(stated, hit_url, hit))
