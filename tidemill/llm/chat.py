"""Chat formatting as relational work: sorted turn structs, same-role runs, one string per conversation.

The format has three marks, all starting with "<": `<turn:ROLE>` opens a run of turns of one role,
`<next>` stands between the turns of a run, `<end>` closes the run. In texts and roles a backslash
becomes `\\b`, "<" becomes `\\l` and ">" becomes `\\g`, so no mark can come from a text and every
text can be read back. The loss mask is a list of spans, in code points of the formatted string,
over the texts of the trained roles.

Defined results: a null text or role is an empty one; turns are ordered by turn (null last), then
role and text; repeated rows are turns of their own; a null conversation id is a conversation;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import let, sha256, table, totals

_MASK = "array<struct<start:int,end:int>>"
NEXT, END = "<next>", "<end>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chat_format(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted string and loss mask (array of start, end) of each conversation."""
    row = F.struct(F.col("turn").isNull().alias("late"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    # Each turn with what stands before its text: the mark of its run, or the one inside a run.
    def opened(all_turns: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            same = F.when(i > 0, F.get(all_turns, i - 1)["role"] == x["role"]).otherwise(False)
            head = F.concat(F.when(i > 0, END).otherwise(""), F.lit("<turn:"), escaped(x["role"]), F.lit(">"))
            return F.struct(x["role"].alias("role"), F.when(same, NEXT).otherwise(head).alias("mark"), escaped(x["text"]).alias("text"))

        return F.transform(all_turns, one)

    pieces = convs.select("conv_id", let(F.col("turns"), opened).alias("pieces"))
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(END))
    ends = totals(F.transform("pieces", lambda p: (F.length(p["mark"]) + F.length(p["text"])).cast("int")))
    spans = F.zip_with("pieces", ends, lambda p, end: F.struct((end - F.length(p["text"])).cast("int").alias("start"), end.alias("end"), p["role"].isin(*trained).alias("trained")))
    mask = F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["end"]))
    return pieces.select("conv_id", formatted.alias("formatted"), mask.cast(_MASK).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) in order, read back from a formatted string."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, ">", 1)
        role, body = head.substr(F.lit(7), F.length(b)), b.substr(F.length(head) + 2, F.length(b))
        return F.transform(F.split(body, NEXT, -1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(formatted.substr(m["start"] + 1, m["end"] - m["start"]))), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text"))
        for i, r in enumerate(("user", "assistant"))
    ])).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format(rows)
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(digest).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace(coalesce({0}, ''), '\\', '\\b'), '<', '\\l'), '>', '\\g')"
OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), placed AS (
  SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS opens FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format("text")})) + sum(CASE WHEN opens = 1 THEN 7 + length({_ESC.format("role")}) + 5 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
