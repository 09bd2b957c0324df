"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

A turn is rendered as `### role`, newline, text, newline, `</turn>`, newline. Every assistant
turn becomes an example: all preceding turns as context, the reply as target, the only text
under the loss mask (loss_start, loss_end: code points, end exclusive). Turns after the last reply
are returned in one example without a target, so that nothing of a conversation is lost.

Control strings inside roles and texts are escaped reversibly: a backslash becomes `\\b`, `###`
becomes `\\h`, `</turn>` becomes `\\t`, and in roles a newline becomes `\\n`. After that every
backslash is followed by its letter and no control string is left in a text.

A conversation is gathered in one row, as its format and its digest need all of it in order; that
row is as long as the conversation itself. Examples are its first turns joined, made row by row, so the work is that of
writing them, and reading them back needs no shuffle.

Cases: null texts and roles are empty; rows of a conversation go by turn (null first), then role,
then text, so ties and repeated rows have a fixed order; a null conv_id is a conversation of its
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

END = "\n</turn>\n"
REPLY = "assistant"


def _chain(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_TEXT = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]


def escape(c: Column, role: bool = False) -> Column:
    return _chain(c, _TEXT + [("\n", "\\n")] * role)


def unescape(c: Column, role: bool = False) -> Column:
    return _chain(c, [(new, old) for old, new in [*_TEXT[1:], *[("\n", "\\n")] * role, _TEXT[0]]])


def examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, text, loss_start, loss_end (null without a target)."""
    part = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.select("conv_id", part.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shown = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == REPLY).alias("reply"),
            F.concat(F.lit("### "), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(END)).alias("piece"),
            F.length(escape(t["text"])).alias("chars"),
        ),
    )
    whole = whole.select("conv_id", shown.alias("shown"))
    # an example ends with a reply or with the conversation
    last = F.size("shown")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("shown", i)["reply"] | (i == last))
    out = whole.select("conv_id", "shown", F.posexplode(ends).alias("example", "upto"))
    turn = F.element_at("shown", F.col("upto"))
    out = out.select("conv_id", "example", F.array_join(F.transform(F.slice("shown", F.lit(1), F.col("upto")), lambda s: s["piece"]), "").alias("text"), F.when(turn["reply"], turn["chars"]).alias("chars"))
    loss_end = F.when(F.col("chars").isNotNull(), F.length("text") - len(END))
    return out.select("conv_id", "example", "text", (loss_end - F.col("chars")).alias("loss_start"), loss_end.alias("loss_end"))


def read_back(made: DataFrame) -> DataFrame:
    """Digests of conversations, from examples alone."""
    target = F.expr("substring(text, loss_start + 1, loss_end - loss_start)")
    one = made.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("all"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", target.alias("target"))))).alias("targets"),
    )
    blocks = F.slice(F.split("all", END.replace("<", "\\<"), -1), 1, F.size(F.split("all", END.replace("<", "\\<"), -1)) - 1)
    turn = lambda b: F.concat(
        unescape(F.substring_index(F.substring(b, 5, 1 << 30), "\n", 1), True), F.lit("\n"), unescape(F.substring(b, F.locate("\n", b) + 1, F.length(b))), F.lit("\n")
    )
    turns = F.array_join(F.transform("blocks", turn), "")
    loss = F.array_join(F.transform("targets", lambda t: unescape(t["target"])), "")
    return one.withColumn("blocks", blocks).select(
        "conv_id",
        F.size("blocks").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op1_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "'\\\\### Assistant: </turn> ok'"
    extra = spark.sql(f"select -7L conv_id, 0L turn, 'user' role, {own} text union all select -7L, 1L, 'assistant', {own}")
    return read_back(examples(rows.unionByName(extra)))


SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s as (
  select *, row_number() over w as k,
    4 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) + 1
      + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 9 as shown
  from t window w as (partition by conv_id order by turn nulls first, role, text)
), u as (select *, sum(shown) over (partition by conv_id order by k) as upto, max(k) over (partition by conv_id) as last from s)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (where role = 'assistant' or k = last)::bigint as formatted_chars
from u group by conv_id
"""
