"""Personal data: candidate spans scored by boosted trees.

High-recall generators propose spans, which may overlap: the base kinds' patterns, looser ones, and decoys
that only look like personal data (versions, dates, numbers, handles). Features describe a span's form
(length, digits, separators) and its surroundings (kind words before it, the characters on either side);
spelled-out marks such as "(at)" are read as the marks themselves. Gradient-boosted trees are trained in
Spark on all candidates, those of equal features as one row with their number: base candidates of valid
form (octets, check digit, number of digits) against invalid ones and decoys, without seeing those checks.
A few fixed seed candidates are always among them, so a table of any size gives a model. For each kind, a threshold is
calibrated on candidates that training didn't see and that pass the kind's check, as looser candidates have
to; a kind with few of them takes the threshold of all kinds together. Looser candidates that pass the
check, reach their threshold and overlap neither a base span nor a better looser one are added.
Only DataFrame functions and Spark ML touch the data.

Defined results: a null text is an empty one, without spans; repeated rows get equal results; a null
id is an id like others; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import regex_spans, sha256, span_text, table, written

#: What labelled candidates weigh in training together, at most.
TRAIN_ROWS = 20_000
PRECISION = 0.98
#: Held-out candidates of a kind and either label below which it takes the threshold of all kinds together.
FEW = 20
CONTEXT = 24


@dataclass(frozen=True)
class Generator:
    """Proposes spans of a kind. Its pattern runs only on texts that `hint` matches."""

    name: str
    kind: str
    pattern: str
    hint: str
    base: bool = False
    decoy: bool = False


_E = r"[A-Za-z0-9._%+-]"
#: A match can only start where a run starts or where the last match ended, so long runs aren't tried from each place.
GENERATORS = (
    Generator("email", "email", rf"(?:\G|(?<!{_E})){_E}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", True),
    Generator("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    Generator("card", "card", r"[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9]", True),
    Generator("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    Generator("loose_phone", "phone", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])", r"[0-9]{4}"),
    Generator("loose_email", "email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)+", r"[\[(]at[\])]"),
    Generator("loose_ip", "ip", r"(?<![0-9.])[0-9]++\[\.\][0-9]++\[\.\][0-9]++\[\.\][0-9]++(?![0-9])", r"[0-9]\[\.\]"),
    Generator("short_card", "card", r"(?<![0-9A-Za-z.+-])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9A-Za-z.-])", r"[0-9]{6}"),
    Generator("version", "ip", r"(?<![0-9A-Za-z.])[vV]?[0-9]++(?:\.[0-9]++){1,2}(?![0-9A-Za-z]|\.[0-9])", r"[0-9]\.[0-9]", decoy=True),
    Generator("date", "phone", r"(?<![0-9A-Za-z./+-])(?:[0-9]{4}[/-][0-9]{2}[/-][0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9A-Za-z/-])", r"[0-9]{4}", decoy=True),
    Generator("number", "phone", r"(?<![0-9A-Za-z.+-])[0-9]{6,14}(?![0-9A-Za-z.-])", r"[0-9]{6}", decoy=True),
    Generator("long_number", "card", r"(?<![0-9A-Za-z.+-])(?:[0-9]{15}|[0-9]{20,}+)(?![0-9A-Za-z.-])", r"[0-9]{15}", decoy=True),
    Generator("handle", "email", r"(?<![A-Za-z0-9._%+-])@[A-Za-z0-9_-]++(?!\.[A-Za-z0-9])", r"@[A-Za-z0-9_-]", decoy=True),
)
KINDS = ("email", "ip", "card", "phone")
#: Weight of the seeds together in training, as a share of the candidates' weight.
SEED_SHARE = 0.3
#: Seed candidates: generator, text before, span, text after, whether it is personal data.
SEEDS = (
    ("email", "write to ", "jane.roe@mail.example.org", ", p", True), ("email", "", "j_doe+list@example.com", "", True), ("email", "contact: ", "a.b@c.example.net", ".", True),
    ("email", "mail ", "team@sub.dept.example.edu", " f", True), ("email", "(", "first.last@example.co.uk", ")", True),
    ("handle", "thanks ", "@someone", " f", False), ("handle", "by ", "@user_name", ",", False), ("handle", "", "@decorator", "\n", False), ("handle", "see ", "@team-one", ".", False),
    ("ip", "host ", "10.20.30.40", " i", True), ("ip", "from ", "192.0.2.17", ".", True), ("ip", "address ", "203.0.113.9", ",", True), ("ip", "", "198.51.100.244", ":8", True),
    ("version", "version ", "2.0", ".", False), ("version", "python ", "3.11.4", " o", False), ("version", "release ", "v1.2", ",", False), ("ip", "oid ", "1.3.6.1", ".4", False), ("ip", "build ", "10.0.19041.1", " ", False),
    ("card", "card ", "4111 1111 1111 1111", " e", True), ("card", "visa: ", "5500000000000004", "", True), ("card", "paid with ", "4012-8888-8888-1881", ".", True), ("card", "number ", "6011000990139424", ",", True),
    ("long_number", "id ", "100200300400500", " ", False), ("long_number", "hash ", "31415926535897932384626", " ", False), ("long_number", "serial ", "900000000000001", ",", False), ("card", "order ", "1234567890123456", " s", False),
    ("phone", "tel ", "+1 (202) 555-0143", " o", True), ("phone", "call ", "+44 20 7946 0958", ".", True), ("phone", "phone: ", "+49 30 901820", ",", True), ("phone", "", "+1 202-555-0187", "", True), ("phone", "fax ", "+33 1 70 18 99 00", " ", True),
    ("loose_phone", "call ", "(202) 555-0143", " o", True), ("loose_phone", "", "202-555-0187", ".", True), ("loose_phone", "at ", "202.555.0166", " ", True), ("loose_phone", "or ", "202 555 0101", ",", True),
    ("loose_phone", "tel: ", "(303) 555-0119", "", True), ("loose_phone", "the ", "404-555-0175", " t", True), ("loose_phone", "", "505.555.0128", "", True),
    ("short_card", "card ", "3782 822463 10005", " e", True), ("short_card", "", "3714-496353-98431", ".", True), ("short_card", "amex ", "3787 344936 71000", ",", True), ("short_card", "the ", "3714 496353 98431", " t", True),
    ("date", "on ", "2024-03-17", ",", False), ("date", "dated ", "17.03.2024", " ", False), ("date", "since ", "1999-12-31", ".", False), ("number", "order ", "20240317001", " ", False), ("number", "page ", "1234567", ",", False), ("number", "ref ", "9988776655", ".", False),
)
KIND_WORDS = r"(?i)(mail|e-mail|ip|host|addr|card|visa|amex|account|phone|tel|call|fax|mobile|contact)\W{0,6}$"
_CANDIDATE = "array<struct<gen:int,start:int,end:int,hit:string,valid:boolean,before:string,after:string>>"
FEATURES = ("kind", "length", "digits", "dots", "dashes", "spaces", "brackets", "letters", "at", "parts", "longest_run", "longest_part", "kind_word", "left_word", "right_word", "left_sign", "right_sign")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    doubled = F.transform(each, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: (s + x).cast("int")) % 10 == 0


def valid(g: Generator, hit: Column) -> Column:
    """The base kinds' check of a match's form."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if g.kind == "ip":
        hit = F.replace(F.replace(hit, F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
        return F.forall(F.split(hit, r"\.", -1), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if g.kind == "card":
        low = 16 if g.base else 15
        return F.when(F.length(digits).between(low, 19), luhn(digits)).otherwise(False)
    if g.kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _proposed(number: int, g: Generator, t: Column) -> Column:
    """The candidate spans of one generator in a text."""

    def one(x: Column) -> Column:
        return F.struct(
            F.lit(number).alias("gen"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), valid(g, x["hit"]).alias("valid"),
            x["before"], x["after"],
        )

    return F.when(t.rlike(g.hint), F.transform(regex_spans(t, g.pattern, CONTEXT, 2), one)).otherwise(F.array().cast(_CANDIDATE))


def candidates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the column `found`: all candidate spans of all generators."""
    t = F.coalesce(F.col("text"), F.lit(""))
    each = [_proposed(i, g, t) for i, g in enumerate(GENERATORS)]
    return docs.select("doc_id", F.flatten(F.array(*each)).cast(_CANDIDATE).alias("found"))


def plain_form(hit: Column) -> Column:
    """A span with spelled-out marks as the marks, and without a leading plus."""
    out = F.regexp_replace(F.regexp_replace(hit, r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")
    return F.regexp_replace(F.replace(out, F.lit("[.]"), F.lit(".")), r"^\+", "")


def features(rows: DataFrame) -> DataFrame:
    """rows of one candidate each (gen, hit, before, after, ...) with a double column for each feature."""
    rows = rows.withColumn("plain", plain_form(F.col("hit")))
    hit = F.col("plain")
    count = lambda cls: F.length(hit) - F.length(F.regexp_replace(hit, cls, ""))
    longest = lambda rx: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(hit, F.lit(rx), F.lit(0)), lambda x: F.length(x))), F.lit(0))
    made = {
        "kind": F.element_at(F.array(*[F.lit(KINDS.index(g.kind)) for g in GENERATORS]), F.col("gen") + 1), "length": F.length(hit), "digits": count("[0-9]"), "dots": count(r"\."), "dashes": count("-"),
        "spaces": count(" "), "brackets": count(r"[()\[\]]"), "letters": count("[A-Za-z]"), "at": count("@"), "parts": F.size(F.split(hit, "[^0-9A-Za-z]+")), "longest_run": longest("[0-9]+"), "longest_part": longest("[A-Za-z]+"),
        "kind_word": F.col("before").rlike(KIND_WORDS), "left_word": F.col("before").rlike(r"\w$"), "right_word": F.col("after").rlike(r"^\w"),
        "left_sign": F.col("before").rlike(r"[-.:/#$+]$"), "right_sign": F.col("after").rlike(r"^[-.:/#%][0-9A-Za-z]"),
    }
    return rows.withColumns({f"f_{k}": v.cast("double") for k, v in made.items()}).drop("plain")


@dataclass
class Model:
    trees: object
    thresholds: dict[str, float]


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(features(rows))


def seeds(spark: SparkSession) -> DataFrame:
    """The seed candidates (gen, hit, before, after, valid: of valid form, label)."""
    number = {g.name: i for i, g in enumerate(GENERATORS)}
    rows = spark.createDataFrame([(number[g], hit, before, after, float(label)) for g, before, hit, after, label in SEEDS], "gen int, hit string, before string, after string, label double")
    checks = F.lit(False)
    for i, g in enumerate(GENERATORS):
        checks = F.when(F.col("gen") == i, valid(g, F.col("hit"))).otherwise(checks)
    return rows.withColumn("valid", checks)


def fit(found: DataFrame, train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Model:
    """Trains on all base candidates and decoys, and on the seeds.

    Candidates of equal features count as one row with their number, so that what is trained on grows with the forms
    that there are. Those of a kind and label weigh as many as they are, train_rows / 8 at most.
    """
    spark = found.sparkSession
    known = [i for i, g in enumerate(GENERATORS) if g.base or g.decoy]
    kind = F.element_at(F.array(*[F.lit(g.kind) for g in GENERATORS]), F.col("gen") + 1)
    label = (F.col("valid") & ~F.col("gen").isin([i for i, g in enumerate(GENERATORS) if g.decoy])).cast("double")
    rows = found.select(F.explode("found").alias("c")).select("c.*").where(F.col("gen").isin(known)).select("gen", "hit", "before", "after", "valid", label.alias("label"))
    made = [f"f_{n}" for n in FEATURES]
    rows = features(rows.withColumn("fold", F.abs(F.hash("hit", "before")) % 4))
    rows = written(rows.groupBy("gen", "valid", "label", "fold", *made).agg(F.count(F.lit(1)).alias("n")), "pii-forms")
    counts = {(r["kind"], r["label"]): r["n"] for r in rows.groupBy(kind.alias("kind"), "label").agg(F.sum("n").alias("n")).collect()}  # eight at most
    weight = F.lit(1.0)
    for (k, y), n in counts.items():
        weight = F.when((kind == k) & (F.col("label") == y), min(1.0, train_rows / 8 / n)).otherwise(weight)
    expected = sum(min(n, train_rows / 8) for n in counts.values())
    seed = max(1.0, SEED_SHARE * expected / len(SEEDS))
    taught = features(seeds(spark)).select("gen", "valid", "label", F.lit(1).alias("fold"), *made, F.lit(1).cast("long").alias("n"), F.lit(seed).alias("weight"))
    forms = rows.withColumn("weight", weight * F.col("n")).unionByName(taught)
    sample = VectorAssembler(inputCols=made, outputCol="features").transform(forms).select("gen", "valid", "label", "n", "weight", "fold", "features")
    trees = GBTClassifier(maxIter=16, maxDepth=4, seed=7, maxBins=32, weightCol="weight").fit(sample.where("fold > 0").repartition(4))
    scored = trees.transform(sample.where("fold = 0 and valid")).select("gen", "label", "n", vector_to_array("probability")[1].alias("p"))
    # Counts by kind and score, in 200 steps. A kind's threshold lies between the lowest score from which on its held-out candidates
    # are precise enough and the next lower one that any of them has.
    bins = scored.groupBy("gen", F.floor(F.col("p") * 200).alias("b")).agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    thresholds = {}
    for k in (None, *KINDS):
        sums: dict[int, tuple[int, float]] = {}
        for r in bins:
            if k in (None, GENERATORS[r["gen"]].kind):
                n, good = sums.get(r["b"], (0, 0.0))
                sums[r["b"]] = (n + r["n"], good + r["good"])
        own = [(b, *sums[b]) for b in sorted(sums, reverse=True)]
        if k is not None and min(sum(good for *_, good in own), sum(n - good for _, n, good in own)) < FEW:
            thresholds[k] = thresholds[None]
            continue
        thresholds[k], seen, right = (0.5 if k is None else 1.01), 0, 0.0
        for at, (b, n, good) in enumerate(own):
            seen, right = seen + n, right + good
            below = own[at + 1][0] if at + 1 < len(own) else 0
            if right >= precision * seen:
                thresholds[k] = (b + below) / 400
    return Model(trees, thresholds)


def selected(found: DataFrame, model: Model) -> DataFrame:
    """__id, __mark, added: the looser candidates that reach their threshold and overlap no base span and no better looser one."""
    loose = [i for i, g in enumerate(GENERATORS) if not (g.base or g.decoy)]
    base = F.filter("found", lambda c: c["gen"].isin([i for i, g in enumerate(GENERATORS) if g.base]) & c["valid"])
    free = F.filter("found", lambda c: c["gen"].isin(loose) & c["valid"] & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = found.select("doc_id", "mark", F.explode(free).alias("c")).select("doc_id", "mark", "c.*")
    kind = F.element_at(F.array(*[F.lit(g.kind) for g in GENERATORS]), F.col("gen") + 1)
    least = F.element_at(F.array(*[F.lit(model.thresholds[g.kind]) for g in GENERATORS]), F.col("gen") + 1)
    kept = model.trees.transform(assembled(rows)).withColumn("p", vector_to_array("probability")[1]).where(F.col("p") >= least)
    one = F.struct("start", "end", kind.alias("kind"), "p", "gen")
    spans = kept.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set(one).alias("all"))
    better = lambda o, s: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (F.struct(o["p"], -o["gen"], -o["start"]) > F.struct(s["p"], -s["gen"], -s["start"]))
    best = F.filter("all", lambda s: ~F.exists("all", lambda o: better(o, s)))
    return spans.select("__id", "__mark", F.transform(best, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (valid base spans) and added (spans the trees add): arrays of kind order, start, end, kind."""
    found = written(candidates(docs).withColumn("mark", F.xxhash64(F.to_json("found"))), "pii-candidates")
    order = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    kind = lambda gen: F.element_at(F.array(*[F.lit(g.kind) for g in GENERATORS]), gen + 1)
    base = F.transform(F.filter("found", lambda c: c["gen"].isin([i for i, g in enumerate(GENERATORS) if g.base]) & c["valid"]), lambda c: F.struct(order(kind(c["gen"])).alias("ord"), c["start"].alias("start"), c["end"].alias("end"), kind(c["gen"]).alias("kind")))
    extra = selected(found, fit(found))
    out = found.select("doc_id", "mark", F.array_sort(base).alias("base")).join(extra, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    added = F.transform("added", lambda s: F.struct(order(s["kind"]).alias("ord"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return out.select("doc_id", "base", F.coalesce(added, F.array().cast("array<struct<ord:bigint,start:int,end:int,kind:string>>")).alias("added"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], sha256(span_text(F.col("base"))).alias("base_sha256"), span_text(F.array_sort(F.array_distinct(F.concat("base", "added")))).alias("spans"))
