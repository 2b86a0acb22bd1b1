"""License scans by diagonal voting.

All rolling word k-grams of the documents are hashed and joined by Spark to the places where the
templates hold them. A hit votes for the diagonal document place minus template place. Votes are
aggregated by document, template and diagonal, into segments that end where the next hit on the diagonal
is more than `gap` words away. Segments on diagonals next to each other (at most `drift` apart) and near
each other in the text are merged, as inserted or dropped words move a passage to a neighbouring
diagonal; the merged spans are then verified on the words.

Phrases (the base) need all their k-grams on one diagonal and equal words. Templates need at least
`cover` of their words, in order and each at most `gap` places after the one before, in a passage that
has one of their k-grams. One vote is enough for that to be verified, and the passage is looked for as far
before and behind the votes as the template's other words can lie; the words alone decide.

Defined results: a null or blank text has no words and no labels, score 0; texts shorter than k words
hold no place; repeated rows get equal results; a null id is an id like others; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.license_texts import PASSAGES
from tidemill.llm.shared import ascii_lower, picked, table, written

K = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False


PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
NOT_A_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEMPLATES = tuple(Template(label, " ".join(w for w in NOT_A_WORD.split(text.lower()) if w)) for label, text in PASSAGES)
#: Places of templates that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_PLACES = 100_000


def license_words(text: Column) -> Column:
    """Words of [0-9a-z] and non-ASCII characters, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), lambda w: w != "")


def _places(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """template, at and hash of each k-gram of the templates: as many rows as the templates have words."""
    rows = [(i, at, w[at : at + k]) for i, t in enumerate(templates) for w in [t.words.split()] for at in range(len(w) - k + 1)]
    out = spark.createDataFrame(rows, "template int, at int, gram array<string>").select("template", "at", F.xxhash64("gram").alias("hash"))
    return F.broadcast(out) if len(rows) <= BROADCAST_PLACES else out


def hits(docs: DataFrame, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """key (doc_id, hash and length of the text), place, template, template place of every k-gram hit."""
    rows = docs.select(text_key().alias("key"), license_words(F.col("text")).alias("words"))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - (k - 1)), lambda i: F.xxhash64(F.slice("words", i, k)))
    rows = rows.where(F.size("words") >= k).select("key", F.posexplode(grams).alias("place", "hash"))
    return rows.join(_places(docs.sparkSession, templates, k), "hash").select("key", "place", "template", "at").distinct()


def text_key() -> Column:
    """Tells rows apart by id and text; rows that repeat both share their results."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64(t, F.lit(1)).alias("h1"), F.hash(t, F.lit(2)).alias("h2"), F.length(t).alias("n"))


def diagonals(found: DataFrame, length: Column, gap: int, drift: int) -> DataFrame:
    """Spans (key, template, first, last, votes, low, high): segments of near diagonals, merged.

    low and high are the first and the last place where the template's words can lie around the votes.
    """
    by = Window.partitionBy("key", "template", "d").orderBy("place")
    row = found.withColumn("d", F.col("place") - F.col("at"))
    row = row.withColumn("cut", F.coalesce(F.col("place") - F.lag("place").over(by) > gap, F.lit(True)).cast("int"))
    row = row.withColumn("segment", F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    segments = row.groupBy("key", "template", "d", "segment").agg(
        F.count(F.lit(1)).alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("at").alias("at0"), F.max("at").alias("at1"),
    )
    # Bands of diagonals next to each other, then stretches of a band without a wide gap.
    across = Window.partitionBy("key", "template").orderBy("d")
    band = segments.withColumn("new", F.coalesce(F.col("d") - F.lag("d").over(across) > drift, F.lit(True)).cast("int")).withColumn("band", F.sum("new").over(across.rangeBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("key", "template", "band").orderBy("first", "d")
    before = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    span = band.withColumn("new", F.coalesce(F.col("first") - before > gap, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return span.groupBy("key", "template", "band", "span").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.greatest(F.min(F.col("first") - F.col("at0") * gap), F.lit(0)).alias("low"), F.max(F.col("last") + (length - 1 - F.col("at1")) * gap).alias("high"),
    )


def best_passage(own: list[str], wanted: list[str], low: int, high: int, gap: int) -> tuple[int, int, int]:
    """Number, first and last place of the most words of `wanted` found in order in `own`.

    Each is at most `gap` places after the one before, and one lies from `low` to `high`; of equal numbers
    the shortest passage is taken.
    """
    places: dict[str, list[int]] = {}
    for i, w in enumerate(wanted):
        places.setdefault(w, []).append(i)
    met = [(j, i) for j, w in enumerate(own) for i in places.get(w, ())]

    def chains(met: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """For each place the longest chain that ends there, and its start, as near as it can be."""
        out: list[tuple[int, int]] = []
        for n, (j, i) in enumerate(met):
            best = (1, j)
            for m in range(n - 1, -1, -1):
                if j - met[m][0] > gap:
                    break
                if met[m][0] < j and met[m][1] < i:
                    best = max(best, (out[m][0] + 1, out[m][1]))
            out.append(best)
        return out

    to, back = chains(met), chains([(-j, -i) for j, i in reversed(met)])[::-1]
    n, _, first, last = max(((t[0] + b[0] - 1, t[1] + b[1], t[1], -b[1]) for (j, _), t, b in zip(met, to, back, strict=True) if low <= j <= high), default=(0, 0, 0, 0))
    return n, first, last


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES, k: int = K, cover: float = 0.8, gap: int = 8, drift: int = 3) -> DataFrame:
    """key, places (array of start, label) of phrases, spans (array of label, first, last, score) of templates, for texts with any."""
    every = (*phrases, *templates)
    length = F.element_at(F.array(*[F.lit(len(t.words.split())) for t in every]), F.col("template") + 1)
    label = F.element_at(F.array(*[F.lit(t.label) for t in every]), F.col("template") + 1)
    found = written(hits(docs, every, k), "license-hits")
    # Phrases: all k-grams on one diagonal.
    exact = found.where(F.col("template") < len(phrases)).groupBy("key", "template", (F.col("place") - F.col("at")).alias("first")).agg(F.count(F.lit(1)).alias("votes"))
    exact = exact.where(F.col("votes") == length - (k - 1)).select("key", "template", "first", (F.col("first") + length - 1).alias("last"))
    near = diagonals(found.where(F.col("template") >= len(phrases)), length, gap, drift)
    near = near.select("key", "template", "first", (F.col("last") + k - 1).alias("last"), "low", "high")
    exact = exact.withColumns({"low": F.col("first"), "high": F.col("last")})
    spans = exact.unionByName(near).groupBy("key").agg(F.collect_list(F.struct("template", "first", "last", "low", "high")).alias("spans"))
    # Verification on the words of the texts that have spans.
    own = picked(docs.select(text_key().alias("key"), "text"), spans.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("key", "text", "spans")
    own = own.select("key", license_words(F.col("text")).alias("words"), F.col("spans").alias("s")).select("key", F.explode(F.transform("s", lambda s: F.struct(
        s["template"].alias("template"), s["first"].alias("first"), s["last"].alias("last"), s["low"].alias("low"), F.slice("words", s["low"] + 1, s["high"] - s["low"] + 1).alias("own"),
    ))).alias("s")).select("key", "s.*").distinct()
    wanted = [t.words.split() for t in every]

    @F.udf("struct<n:int,first:int,last:int>", useArrow=True)
    def passage(template, words, low, high):
        return best_passage(words, wanted[template], low, high, gap)

    equal = F.col("own") == F.element_at(F.array(*[F.array(*map(F.lit, w)) for w in wanted]), F.col("template") + 1)
    base = own.where((F.col("template") < len(phrases)) & equal).select("key", "template", "first", "last", F.lit(1.0).alias("score"))
    near = own.where(F.col("template") >= len(phrases)).withColumn("p", passage("template", "own", F.col("first") - F.col("low"), F.col("last") - F.col("low")))
    near = near.select("key", "template", (F.col("low") + F.col("p.first")).alias("first"), (F.col("low") + F.col("p.last")).alias("last"), (F.col("p.n") / length).alias("score"))
    # Spans of one passage find the same words.
    kept = base.unionByName(near.where(F.col("score") >= cover)).distinct()
    one = F.struct("first", "last", label.alias("label"), "score", (F.col("template") < len(phrases)).alias("base"))
    spans = kept.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("spans"))

    def beaten(s: Column) -> Column:
        """Whether a template's span overlaps one of another template with a higher score, as versions of one license do."""
        return ~s["base"] & F.exists("spans", lambda o: ~o["base"] & (o["first"] <= s["last"]) & (s["first"] <= o["last"]) & (o["score"] > s["score"]))

    return spans.select("key", F.filter("spans", lambda s: ~beaten(s)).alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).withColumnRenamed("key", "k")
    slim = written(docs.select("doc_id", text_key().alias("key"), F.size(license_words(F.col("text"))).cast("long").alias("n_words")), "license-words")
    out = slim.join(found, F.col("key") == F.col("k"), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,label:string,score:double,base:boolean>>"))
    out = out.select("doc_id", "n_words", spans.alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).cast("long").alias("first_word"), F.array_max(F.transform(base, lambda s: s["first"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
