"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: the turns before it are the context, and its reply alone is
trainable. The text of an example is the template's rendering of all turns up to and including the reply, and
``loss_start``/``loss_end`` (code points, half open) bound the reply inside it.

Template, one block a turn::

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings inside a role or text can't be taken for marks: each opener (``<`` or ``[``) that is followed by
any number of backslashes and the rest of a control string gets one more backslash. So k backslashes become k + 1,
no bare control string is left, and taking one backslash away restores the text. A role, moreover, has its line
breaks and percent signs written as ``%0A`` and ``%25``.

Defined results: null text or role counts as empty; rows with the same turn are ordered by role, then text; a
conversation without assistant turns, or with turns after its last reply, has one last row with ``is_target`` false
that holds the whole conversation and no trainable span, so that nothing is lost; a null conv_id is a key of its
own; columns besides the four that are named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import read

START, END = "<|im_start|>", "<|im_end|>\n"
#: Rest of a control string behind its opener: special tokens between bars, sentence marks, instruction marks, system marks.
TAIL = r"\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?<SYS>>|</?SYS>>"
ESCAPE = rf"([<\[])(\\*)({TAIL})"
UNESCAPE = rf"([<\[])\\(\\*)({TAIL})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expand_prefix_targets(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, example (from 0), is_target, n_turns, text, loss_start, loss_end. The turns of a conversation are
    brought together once; its examples are cut from the one rendering as prefixes, in the same stage.
    """
    turns = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    blocks = turns.select(
        "conv_id",
        F.row_number().over(order).alias("k"),
        (F.col("role") == "assistant").alias("t"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    # The spans of the blocks inside the rendering, by a running sum over the same sort.
    upto = F.sum(F.length("head") + F.length("body") + len(END)).over(Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("e", upto - len(END)).withColumn("s", F.col("e") - F.length("body"))
    conv = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("k", F.concat("head", "body", F.lit(END)).alias("block")))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("t"), F.struct("k", "s", "e", "t")))).alias("out"),
        (F.max("e") + len(END)).alias("n"),
    )
    whole = F.concat_ws("", F.transform("b", lambda x: x["block"]))
    rest = F.struct(F.lit(0).alias("k"), F.col("n").alias("s"), F.col("n").alias("e"), F.lit(False).alias("t"))
    last = F.coalesce(F.try_element_at("out", F.lit(-1))["e"] + len(END), F.lit(0))
    plan = F.when(last < F.col("n"), F.concat("out", F.array(rest))).otherwise(F.col("out"))
    ex = conv.select("conv_id", whole.alias("whole"), "n", F.posexplode(plan).alias("i", "x"))
    text = F.substring("whole", F.lit(1), F.when(F.col("x.t"), F.col("x.e") + len(END)).otherwise(F.col("n")).cast("int"))
    return ex.select(
        "conv_id",
        F.col("i").cast("long").alias("example"),
        F.col("x.t").alias("is_target"),
        text.alias("text"),
        F.col("x.s").cast("long").alias("loss_start"),
        F.col("x.e").cast("long").alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """The turns of a rendering, read back: array of (role, text)."""
    blocks = F.filter(F.split(text, F.lit(r"<\|im_end\|>\n")), lambda b: b != "")
    body = lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b))
    return F.transform(
        F.transform(blocks, body),
        lambda b: F.struct(
            unescape_role(F.substring(b, F.lit(1), F.instr(b, F.lit("\n")) - 1)).alias("role"),
            unescape(F.substring(b, F.instr(b, F.lit("\n")) + 1, F.length(b))).alias("text"),
        ),
    )


def conversation_digest(examples: DataFrame) -> DataFrame:
    """One row a conversation, read back from the examples alone.

    turns_sha256 comes from parsing the longest example, the loss columns from the trainable spans of all examples,
    formatted_chars counts the code points of all examples.
    """
    reply = F.when(
        F.col("is_target"),
        unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))),
    )
    rows = examples.select("conv_id", "example", "text", reply.alias("reply"), F.length("text").cast("long").alias("chars"))
    per = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
        F.count("reply").alias("n_examples"),
    )
    per = per.withColumn("turns", parse_turns(F.col("longest"))).withColumn(
        "loss", F.concat_ws("", F.transform("replies", lambda r: r["reply"]))
    )
    flat = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_examples").cast("long").alias("n_examples"),
    )


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus the fixed conversation -7, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversation_digest(expand_prefix_targets(turns.unionByName(hard)))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS k,
    sum(24 + length(role) + length(text)
      + 2 * (length(role) - length(replace(replace(role, '%', ''), chr(10), '')))
      + len(regexp_extract_all(replace(replace(role, '%', '%25'), chr(10), '%0A'), '[<\[]\\*(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?<SYS>>|</?SYS>>)'))
      + len(regexp_extract_all(text, '[<\[]\\*(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?<SYS>>|</?SYS>>)')))
      OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    last_value(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (coalesce(sum(upto) FILTER (role = 'assistant'), 0) + CASE WHEN max(final) = 'assistant' THEN 0 ELSE max(upto) END)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM sized GROUP BY conv_id
"""
