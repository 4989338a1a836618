"""Operator 3, URL filters: gradient-boosted trees on lexical features.

Rules decide the urls of their hosts: a rule fits its host and all subdomains
if the path starts with the rule's; the longest wins. The urls that rules
decide are the labelled ones. From them boosted trees learn to block or allow
by lexical features (length, depth, digit ratio, entropy, parameters, and how
often urls with the same suffix of the host, first folder or extension are
blocked), and judge the urls that no rule fits.

The trees are fitted on at most ``rows`` labelled urls, the first by hash, in
one partition, so that the same urls give the same trees. The suffix statistics
cover all labelled urls. Without labels of both kinds every url left is allowed.

Null urls, and those without ``://``, have an empty host and path; no rule fits
them. Repeated rows are judged alike. Further columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tables import small, stored

# Fixed values: (verdict, host, path) of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TRAIN_ROWS, TREES, DEPTH, STEP = 20_000, 12, 3, 0.3
#: Labelled urls that a suffix is credited with beforehand, at the overall rate.
PRIOR = 10.0
SUFFIXES = ("domain", "site", "folder", "extension")
FEATURES = (
    "length", "host_length", "host_labels", "depth", "digit_ratio", "host_digits", "mark_ratio", "entropy", "host_entropy", "parameters",
    "fragment", "longest_part", "secure",
)


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    ascii_lower = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return ascii_lower, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The rule that decides host and path, and its verdict; null where none fits. Longest first."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path) for _, host, path in longest]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return pick([h + p for _, h, p in longest]), pick([v for v, _, _ in longest])


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    counts = lambda own: F.transform(F.array_distinct(own), lambda c: F.size(F.filter(own, lambda x: x == c)) / F.size(own))
    bits = lambda shares: F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    bound = F.transform(F.array(chars), lambda own: bits(counts(own)))
    return F.coalesce(F.element_at(bound, 1), F.lit(0.0))


def described(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, label, the features and the suffixes."""
    host, path = parts()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, label = ruled(rules)
    url, labels = F.col("url"), F.split("host", r"\.")
    length = F.greatest(F.length(url), F.lit(1))
    folders = F.filter(F.split("path", "/"), lambda x: x != "")
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return rows.select(
        "*",
        rule.alias("rule"),
        label.alias("label"),
        F.length(url).cast("double").alias("length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(labels).cast("double").alias("host_labels"),
        F.size(folders).cast("double").alias("depth"),
        (F.length(F.regexp_replace(url, r"[^0-9]", "")) / length).alias("digit_ratio"),
        F.length(F.regexp_replace("host", r"[^0-9]", "")).cast("double").alias("host_digits"),
        (F.length(F.regexp_replace(url, r"[A-Za-z0-9]", "")) / length).alias("mark_ratio"),
        _entropy(url).alias("entropy"),
        _entropy(F.col("host")).alias("host_entropy"),
        F.size(F.regexp_extract_all(url, F.lit(r"[?&][^=&#]*="), F.lit(0))).cast("double").alias("parameters"),
        F.instr(url, "#").cast("boolean").cast("double").alias("fragment"),
        F.coalesce(F.array_max(F.transform(folders, lambda x: F.length(x))), F.lit(0)).cast("double").alias("longest_part"),
        url.startswith("https:").cast("double").alias("secure"),
        F.element_at(labels, -1).alias("domain"),
        F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), ".").alias("site"),
        F.coalesce(F.get(folders, F.lit(0)), F.lit("")).alias("folder"),
        F.lower(extension).alias("extension"),
    )


def suffix_rates(labelled: DataFrame, overall: float) -> DataFrame:
    """suffix kind, suffix, rate: the smoothed share of blocked urls among the labelled ones with this suffix."""
    blocked = (F.col("label") == "block").cast("double")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES))).alias("of")
    counts = labelled.select(blocked.alias("blocked"), kinds).groupBy("of.kind", "of.suffix").agg(F.sum("blocked").alias("blocked"), F.count(F.lit(1)).alias("n"))
    return counts.select("kind", "suffix", ((F.col("blocked") + PRIOR * overall) / (F.col("n") + PRIOR)).alias("rate"))


def _with_rates(rows: DataFrame, rates: DataFrame, overall: float) -> DataFrame:
    def one(df: DataFrame, kind: str) -> DataFrame:
        own = rates.where(F.col("kind") == kind).select(F.col("suffix").alias(kind), F.col("rate").alias(f"{kind}_rate"))
        return df.join(small(own), kind, "left").withColumn(f"{kind}_rate", F.coalesce(f"{kind}_rate", F.lit(overall)))

    return reduce(one, SUFFIXES, rows)


def judged(pages: DataFrame, rules=RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, p_block (null where a rule decides)."""
    urls = stored(described(pages, rules), "urls")
    labelled = urls.where("label IS NOT NULL")
    kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    free = urls.where("label IS NULL")
    decided = labelled.select("page_id", "host", "path", "rule", F.col("label").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    if len(kinds) < 2:
        return decided.union(free.select("page_id", "host", "path", "rule", F.lit("allow"), F.lit(None).cast("double")))
    overall = kinds["block"] / sum(kinds.values())
    rates = stored(suffix_rates(labelled, overall), "rates")
    assembler = VectorAssembler(inputCols=[*FEATURES, *(f"{k}_rate" for k in SUFFIXES)], outputCol="features")
    chosen = labelled.orderBy(F.xxhash64("url"), "url", "page_id").limit(rows).coalesce(1)
    ready = assembler.transform(_with_rates(chosen, rates, overall)).select("features", (F.col("label") == "block").cast("double").alias("target"))
    trees = GBTClassifier(featuresCol="features", labelCol="target", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, cacheNodeIds=False)
    model = trees.fit(stored(ready, "labelled").coalesce(1))
    scored = model.transform(assembler.transform(_with_rates(free, rates, overall)))
    p = vector_to_array("probability")[1]
    verdict = F.when(p >= 0.5, "block").otherwise("allow")
    return decided.union(scored.select("page_id", "host", "path", "rule", verdict, p))
