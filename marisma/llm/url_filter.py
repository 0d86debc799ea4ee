"""URL verdicts: rules first, gradient-boosted trees on lexical features for the rest. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.llm.scratch import keep

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The rules of the query (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels", "host_rate", "segment_rate", "tail_rate")
#: Parts of the labelled urls; the rates of a labelled url come from the other parts.
FOLDS = 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (host and path together) that fits, as struct of rule and verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    out = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
    for verdict, name, prefix in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits for each character of text; 0 for an empty one."""
    n = F.length(text).cast("double")
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical columns and the suffixes whose statistics are learned."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    return pages.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(segments).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n,
            "entropy": entropy(url),
            "params": F.size(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda s: s != "")).cast("double"),
            "hyphens": F.length(F.regexp_replace("host", "[^-]", "")).cast("double"),
            "labels": F.size(F.filter(F.split("host", r"\."), lambda s: s != "")).cast("double"),
            "host_suffix": F.substring_index("host", ".", -2),
            "segment_suffix": F.concat_ws("/", F.substring_index("host", ".", -1), F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit(""))),
            "tail_suffix": F.regexp_extract("path", r"(\.[A-Za-z0-9]+|/)$", 1),
        }
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, trees: int = 12, depth: int = 4) -> DataFrame:
    """Verdict for each url: the rule's where one fits, else that of boosted trees trained on the urls that rules fit.

    pages has page_id and url. Features: length, depth, digit ratio, entropy, parameter count and the like,
    and the share of allowed urls among those with the same host suffix, first path segment and path ending,
    smoothed towards the overall share, which a suffix without a labelled url has. These shares are sums over all labelled urls,
    combined before the exchange, one row a suffix; Spark broadcasts them where their files are small and splits hot suffixes
    where not. A labelled url's shares leave out the fifth of the labelled urls that it is in, so that none tells its own label. The
    trees are trained on all labelled urls, from a table of features that is written once.

    Returns page_id, host, path, rule, verdict, allow_score. Defined cases: a null url has empty host and path,
    no rule, and goes to the trees; a rule list whose hits are all of one verdict (or an empty one, or an empty table)
    leaves nothing to separate: then urls without a rule get that verdict ("allow" where there is none).
    Repeated rows are judged each; of rules of equal length the first by host and path wins; other columns are not read.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where("hit is not null").withColumn("label", (F.col("hit.rule_verdict") == "allow").cast("double"))
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("allowed")).first()
    allowed = seen["allowed"] or 0.0
    answer = rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.rule_verdict").alias("rule_verdict"))
    if allowed in (0.0, float(seen["n"])):
        only = "block" if seen["n"] and not allowed else "allow"
        return answer.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(only)).alias("verdict"), F.lit(float(only == "allow")).alias("allow_score"))
    prior = allowed / seen["n"]
    fold = F.when(F.col("hit").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    features = with_features(rows).withColumn("fold", fold)
    training = features.where("hit is not null").withColumn("label", (F.col("hit.rule_verdict") == "allow").cast("double"))
    for kind in ("host", "segment", "tail"):
        key = f"{kind}_suffix"
        parts = training.groupBy(key, "fold").agg(F.sum("label").alias("label"), F.count(F.lit(1)).alias("n"))
        sums = parts.groupBy(key).agg(F.sum("label").alias("rate_labels"), F.sum("n").alias("rate_all"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("label", "n")))).alias("rate_own"))
        own = F.try_element_at("rate_own", "fold")
        rate = (F.coalesce("rate_labels", F.lit(0.0)) - F.coalesce(own["label"], F.lit(0.0)) + 8 * prior) / (F.coalesce("rate_all", F.lit(0)) - F.coalesce(own["n"], F.lit(0)) + 8)
        features = features.join(keep(sums, "url-rates"), key, "left").withColumn(f"{kind}_rate", rate).drop("rate_labels", "rate_all", "rate_own")
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features)
    features = keep(features.select("page_id", "host", "path", "hit", "features"), "url-features")
    fit = features.where("hit is not null").select("features", (F.col("hit.rule_verdict") == "allow").cast("double").alias("label"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=7, maxMemoryInMB=64).fit(fit)
    judged = model.transform(features)
    score = vector_to_array("probability")[1]
    verdict = F.coalesce(F.col("hit.rule_verdict"), F.when(score >= 0.5, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), score.alias("allow_score"))
