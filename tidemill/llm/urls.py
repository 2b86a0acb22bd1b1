"""URL filtering by association rules and by host rules.

Labelled pages are baskets of URL tokens, with one more item where the page is bad. FP-growth mines
the token combinations in two thirds of them; rules that lead to the bad item and reach the wanted
confidence and support are candidates, and those whose share of bad pages among the other third is above
the base rate beyond chance (Wilson's lower bound) are kept. Tokens of the same baskets are one class. A rule is
filed under the rarest class of its left side; a URL looks up its own tokens' classes in that index and is blocked
if it has a token of each class of a rule that it finds. Explicit host
and path rules go first, the longest fitting one wins.

Defined results: a null url, and one without "://", has empty host and path, no tokens and is
allowed; repeated rows are judged alike; labels of null or unknown pages play no part; without
labelled pages nothing is mined; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import ascii_lower, table, written

BAD = "label=bad"
#: Deviations of Wilson's bound, and by how much it has to exceed the share of bad pages.
DEVIATIONS, LIFT = 2.5, 1.25


@dataclass(frozen=True)
class HostRule:
    rule: str
    verdict: str


HOST_RULES = (
    HostRule("com/", "allow"), HostRule("example.com/en/", "block"), HostRule("www.example.com/en/", "allow"),
    HostRule("net/es/", "block"), HostRule("net/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(F.regexp_extract(url, r"(?s)://.*", 0), 4, 2**31 - 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):  # the last one put around the others is asked first
        top, slash, start = r.rule.partition("/")
        fits = ((host == top) | host.endswith(f".{top}")) & path.startswith(slash + start)
        name, verdict = F.when(fits, r.rule).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct URL tokens, named by their place: the scheme, every host label, path segment and query key.

    Digits in paths count as 0, so numbered pages share tokens; a part of over 64 characters stands as its hash.
    """
    whole = lambda kind, x: F.when(F.length(x) > 64, F.concat(F.lit(f"{kind}#:"), F.sha2(F.encode(x, "UTF-8"), 256))).otherwise(F.concat(F.lit(f"{kind}:"), x))
    labels = F.transform(F.filter(F.split(host, r"\.", -1), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.filter(F.split(path, "/", -1), lambda x: x != ""), lambda x: whole("p", F.regexp_replace(ascii_lower(x), "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&", -1), lambda x: x != ""), lambda x: whole("q", F.substring_index(x, "=", 1)))
    scheme = F.array(whole("s", F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(scheme, labels, parts, keys)))


def with_tokens(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, tokens."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return out.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))


def alike(baskets: DataFrame, support: float) -> DataFrame:
    """token and twin, the least token with the same baskets, for tokens of at least the support (a count of baskets).

    Sets of baskets are told apart by their size and 128 bits, so no list of a token's baskets is made.
    """
    seen = baskets.select("basket", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("basket")).alias("h1"), F.bit_xor(F.xxhash64("basket", F.lit(1))).alias("h2")
    ).where(F.col("n") >= support)
    least = seen.groupBy("n", "h1", "h2").agg(F.min("token").alias("twin"))
    return seen.join(least, ["n", "h1", "h2"]).select("token", "twin")


def wilson(bad: Column, n: Column, z: float = DEVIATIONS) -> Column:
    """The lower end of Wilson's interval of the share bad / n."""
    p = bad / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(rows: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.5) -> DataFrame:
    """Rules (rule_id, side: tokens, classes: for each of them the tokens of the same baskets, confidence, support) that lead to bad.

    labels has page_id and bad (boolean); pages whose hash leaves 0 after division by 3 are held out to test
    the rules. A rule also needs three bad pages' worth of support; a rule
    whose left side holds that of another rule of at least its confidence is pruned. The
    number of rules is bounded by the support, not by the number of pages.

    A side with two tokens of the same baskets is always pruned, as one of the two does; so one token of
    each such set, the least, is mined and stands for the set, and there is one rule however large the sets are.
    Segments and keys that always come together would else double the number of combinations each.
    """
    spark = rows.sparkSession
    known = labels.where(F.col("bad").isNotNull()).groupBy(F.col("page_id").alias("__id")).agg(F.max("bad").alias("bad"))
    labelled = rows.join(known, rows["page_id"] == known["__id"]).where(F.size("tokens") > 0)
    labelled = labelled.select(F.monotonically_increasing_id().alias("basket"), "tokens", "bad", (F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0).alias("held"))
    labelled = written(labelled, "url-baskets")
    baskets, held = labelled.where("not held"), labelled.where("held")
    schema = "rule_id bigint, side array<string>, classes array<array<string>>, confidence double, support double"
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], schema)
    least = max(min_support, 3 / n)
    twins = written(alike(baskets, math.floor(least * n)), "url-twins")
    mined = baskets.select("basket", F.explode("tokens").alias("token")).join(twins, "token").where(F.col("token") == F.col("twin")).groupBy("basket").agg(F.collect_set("token").alias("own"))
    items = F.coalesce("own", F.array().cast("array<string>"))
    mined = baskets.join(mined, "basket", "left").select(F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(written(mined, "url-items"))
    rules = model.associationRules.where(F.element_at("consequent", 1) == BAD)
    rules = written(rules.select(F.array_sort("antecedent").alias("side"), "confidence", "support"), "url-rules")
    wider, narrow = rules.alias("w"), rules.alias("n")
    # A narrower rule is filed under each of its tokens, so only rules that share a token meet.
    by_token = narrow.select(F.explode("side").alias("t"), F.col("side").alias("n_side"), F.col("confidence").alias("n_confidence"))
    pruned = (
        wider.select("side", "confidence", F.explode("side").alias("t")).join(by_token, "t")
        .where((F.size("n_side") < F.size("side")) & (F.size(F.array_except("n_side", "side")) == 0) & (F.col("n_confidence") >= F.col("confidence")))
        .select("side").distinct()
    )
    kept = rules.join(pruned, "side", "left_anti")
    # A token's class is all tokens of the same baskets; a page fits a rule that has a token of each of its classes.
    sets = twins.groupBy("twin").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    out = kept.select("side", "confidence", "support", F.explode("side").alias("twin")).join(sets, "twin").groupBy("side", "confidence", "support").agg(F.collect_list("tokens").alias("classes"))
    out = written(out.select(F.xxhash64("side").alias("rule_id"), "side", "classes", "confidence", "support"), "url-candidates")
    # What the rules say about pages that they weren't mined from.
    base = held.agg(F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0))).first()[0]
    told = rule_hits(held.select(F.col("basket").alias("page_id"), "tokens"), out).join(held.select("basket", "bad"), F.col("page_id") == F.col("basket"))
    tested = told.groupBy(F.col("rule_id").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"))
    sure = tested.where(wilson(F.col("n_bad"), F.col("n")) > LIFT * base).select("r")
    return out.join(sure, F.col("rule_id") == F.col("r")).drop("r")


def rule_hits(own: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, rule_id and confidence of the rules that each row (page_id, tokens) fits, through an inverted index of token classes; only tokens that rules have are moved."""
    of_class = rules.select(F.explode("classes").alias("c")).select(F.explode("c").alias("t"), F.array_min("c").alias("class")).distinct()
    # Rows of one id, or without any, are told apart by their tokens.
    seen = own.select("page_id", F.xxhash64("tokens").alias("url"), F.explode("tokens").alias("token"))
    held = seen.join(of_class, F.col("token") == F.col("t")).groupBy("page_id", "url").agg(F.collect_set("class").alias("held"))
    held = written(held, "url-classes")
    counts = held.select(F.explode("held").alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("df"))
    rarest = rules.select("rule_id", "side", "confidence", F.explode("side").alias("class")).join(counts, "class", "left")
    rarest = rarest.groupBy("rule_id", "side", "confidence").agg(F.min_by("class", F.struct(F.coalesce("df", F.lit(0)), F.col("class"))).alias("class"))
    found = held.select("page_id", "held", F.explode("held").alias("class")).join(rarest, "class")
    return found.where(F.size(F.array_except("side", "held")) == 0).select("page_id", "rule_id", "confidence")


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id and the confidence and number of the rules that each URL fits, through an inverted index."""
    own = rows.select("page_id", "tokens").distinct()
    return rule_hits(own, rules).groupBy("page_id").agg(F.max("confidence").alias("confidence"), F.count_distinct("rule_id").alias("n_rules"))


def judge(pages: DataFrame, labels: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rules, confidence for every page."""
    rows = written(with_tokens(pages), "url-tokens")
    found = matches(rows, mine(rows, labels, **mining)).withColumnRenamed("page_id", "__id")
    rule, verdict = best_rule(F.col("host"), F.col("path"), host_rules)
    out = rows.join(found, rows["page_id"].eqNullSafe(found["__id"]), "left")
    mined = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("mined_rules"), "confidence")


def page_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents as labels of the pages of the same number: bad if of low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_labels(table(spark, sf_dir, "labels")))
