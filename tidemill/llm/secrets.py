"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. A ledger table holds, for each
blob, which rules in which versions have been applied to it and what they found. A scan takes only
the pairs of blob and rule version that the ledger doesn't have, adds them to it, and joins the
findings back to every path that holds the blob. A finding keeps the key of the rule version that made
it, so those of versions that are no longer asked for aren't returned. Only DataFrame functions are used.

Defined results: a null text counts as empty and has no findings; repeated rows and equal texts
share one blob, and each row gets its findings; a null id is an id like others; an empty table
gives no rows; other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import distinct_sorted, fresh_path, let, regex_spans, running, sha256, span_text, table, written

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A secret rule; `version` is raised when its pattern, value_group or min_value (which drops short matches) change."""

    kind: str
    pattern: str
    version: int = 1
    value_group: int = 0
    min_value: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: Column) -> Column:
        found = regex_spans(text, self.pattern)
        if self.min_value <= 1:
            return found
        value = (lambda x: F.regexp_extract(x["hit"], self.pattern, self.value_group)) if self.value_group else (lambda x: x["hit"])
        return F.filter(found, lambda x: F.length(value(x)) >= self.min_value)


#: The base kinds, in their order, then kinds that add spans.
BASE = (
    Rule("assign", _ASSIGN, value_group=1, min_value=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = (*BASE, *MORE)
_FOUND = "array<struct<start:int,ord:int,end:int,kind:string,rule:string>>"


def with_blob(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("__blob", F.unhex(sha256(F.coalesce(F.col(text), F.lit("")))))


def _seen(ledger: DataFrame) -> DataFrame:
    """One row for each blob; a blob has as many ledger rows as scans that touched it, all short."""
    return ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("__seen"))


def _applied(number: int, rule: Rule) -> Column:
    """The rule's spans in __text, where the blob still lacks them."""
    named = F.transform(rule.spans(F.col("__text")), lambda x: F.struct(x["start"], F.lit(number).alias("ord"), x["end"], F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule")))
    return F.when(F.array_contains("__todo", rule.key), named).otherwise(F.array().cast(_FOUND))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Brings the ledger at that path up to date with docs; returns the ledger.

    The ledger has blob, rules (keys applied) and spans, one row for each blob and scan.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(path).alias("__path"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    slim = with_blob(slim, "__text")
    reps = slim.groupBy("__blob").agg(F.min("__path").alias("__rep"))
    every = F.array(*[F.lit(r.key) for r in rules])
    old = ledger_table(spark, ledger)
    if old is None:
        todo = reps.withColumn("__todo", every)
    else:
        todo = reps.join(_seen(old), reps["__blob"] == F.col("blob"), "left").select(
            "__blob", "__rep", F.array_except(every, F.coalesce("__seen", F.array().cast("array<string>"))).alias("__todo")
        ).where(F.size("__todo") > 0)
    todo = todo.select(F.col("__blob").alias("__b"), "__rep", "__todo").hint("shuffle_hash")
    picked = slim.join(todo, (slim["__blob"] == todo["__b"]) & slim["__path"].eqNullSafe(todo["__rep"]))
    found = F.flatten(F.array(*[_applied(i, r) for i, r in enumerate(rules)]))
    rows = picked.select(F.col("__blob").alias("blob"), F.col("__todo").alias("rules"), found.cast(_FOUND).alias("spans")).dropDuplicates(["blob"])
    rows.write.mode("append").parquet(ledger)
    return ledger_table(spark, ledger)


def ledger_table(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger, or None where there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"blob binary, rules array<string>, spans {_FOUND}").parquet(ledger)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of each blob that has any, of the given rule versions, by start, then the rules' order."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    place = F.map_from_arrays(keys, F.array(*[F.lit(i) for i in range(len(rules))]))
    current = F.transform(F.filter("spans", lambda x: F.array_contains(keys, x["rule"])), lambda x: F.struct(x["start"], place[x["rule"]].alias("ord"), x["end"], x["kind"], x["rule"]))
    hit = ledger.select("blob", current.cast(_FOUND).alias("spans")).where(F.size("spans") > 0)
    return hit.groupBy("blob").agg(distinct_sorted(F.flatten(F.collect_list("spans"))).alias("found"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and found (start, ord, end, kind, rule) for every row of docs."""
    paths = with_blob(docs.select(F.col(path).alias("doc_id"), F.col(text).alias("__text")), "__text").select("doc_id", "__blob")
    found = blob_findings(ledger, rules)
    return paths.join(found, paths["__blob"] == found["blob"], "left").select("doc_id", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def redacted(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span, overlapping ones as one, replaced by a mark. Rows travel as one struct, whatever their columns' names."""
    found = blob_findings(ledger, rules)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), docs[f"`{text}`"].alias("t"))
    rows = rows.withColumn("own", F.unhex(sha256(F.coalesce("t", F.lit("")))))
    rows = rows.join(found, rows["own"] == found["blob"], "left")
    t = F.col("t")

    def marked(spans: Column) -> Column:
        # How far the spans before each one reach; what starts inside them is part of their mark.
        def pieces(reach: Column) -> Column:
            def piece(x: Column, i: Column) -> Column:
                done = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
                return F.when(x["start"] < done, "").otherwise(F.concat(t.substr(done + 1, x["start"] - done), F.lit(mark)))

            return F.concat(F.array_join(F.transform(spans, piece), ""), t.substr(F.element_at(reach, -1) + 1, F.length(t)))

        return let(running(F.transform(spans, lambda x: x["end"]), F.greatest), pieces)

    done = let(F.col("found"), marked)
    new = F.when(F.col("found").isNull(), t).otherwise(done)
    return rows.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in names])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scan(docs, fresh_path(spark, "secret-ledger"))
    rows = findings(docs, ledger)
    base = F.filter("found", lambda x: x["ord"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda x: x["ord"] == i)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        sha256(span_text(base)).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
    )
