"""Chat formatting by prefix-target expansion.

Each turn becomes one segment: a marked header with the role, the text, a marked end. Every
assistant turn becomes an example of its own: all segments before it are its context, and only
its reply is trainable. A conversation's examples are prefixes of one formatted stream, so an
example travels as its target segment and the length of its context in that stream, linear in the input. Where examples
are used they are expanded: ``format_report`` expands each one in its conversation's row and reads its
loss mask from the whole text, and ``expand`` writes them out as rows.

Escaping is reversible: the escape character (a private-use code point) is doubled with a 0, and a
1 behind it splits every control string of common chat templates, the template's own included. A
formatted text thus holds a marker only where the template put it, and splitting the stream
at markers reads all turns back.

Defined results: null texts and roles count as empty; null conversation ids form one conversation;
rows that repeat a turn number are ordered by role and text; a conversation without assistant
turns has no examples and an empty loss text. Very long texts are escaped whole; a conversation's stream is one
string. An empty table gives only the fixed conversation.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

START, END = "<|im_start|>", "<|im_end|>\n"
#: A private-use code point.
ESCAPE = "\ue000"
# fixed values: control strings of common chat templates, or how they begin, as a pattern: an
# opening bracket and what follows it
OPENING = r"[<\[]"
FOLLOWING = (
    r"\|im_start|\|im_end|\|endoftext|\|begin_of|\|end_of|\|start_header|\|end_header|\|eot|\|system|\|user|\|assistant|\|end|\|pad"
    r"|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>"
)


def escape(text: Column) -> Column:
    """A text in which no control string is left; unescape gives the text back."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(f"{ESCAPE}0"))
    return F.regexp_replace(doubled, f"({OPENING})(?={FOLLOWING})", f"$1{ESCAPE}1")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(f"{ESCAPE}1"), F.lit("")), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(f"{ESCAPE}2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(f"{ESCAPE}2"), F.lit("\n")))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and segment of every row, where in its conversation's stream the segment
    begins (context_chars, after context_turns segments) and, for the turns that are targets, the trainable span."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    target = F.col("role") == "assistant"
    return (
        conversations.select(
            "conv_id",
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.concat(head, escape(F.col("text")), F.lit(END)).alias("segment"),
            F.length(head).alias("head_chars"),
        )
        .withColumn("context_chars", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).cast("long"))
        .withColumn("context_turns", F.count("*").over(before))
        .withColumn("loss_start", F.when(target, F.col("context_chars") + F.col("head_chars")))
        .withColumn("loss_end", F.when(target, F.col("context_chars") + F.length("segment") - len(END)))
        .drop("head_chars")
    )


def example() -> Column:
    """The example of which a formatted turn is the target; null for other turns.

    context_turns and context_chars say how much of the conversation's stream comes before;
    target is the formatted reply; loss_start and loss_end bound the trainable text in the example,
    whose text is the first context_chars code points of the stream followed by the target.
    """
    columns = ("context_turns", "conv_id", "turn", "context_chars", F.col("segment").alias("target"), "loss_start", "loss_end")
    return F.when(F.col("loss_start").isNotNull(), F.struct(*columns))


def examples(conversations: DataFrame) -> DataFrame:
    """One row for each assistant turn, with the columns of ``example``."""
    return formatted_turns(conversations).select(example().alias("e")).where(F.col("e").isNotNull()).select("e.*")


def expanded(formatted: Column, context_chars: Column, target: Column) -> Column:
    """The whole text of an example: its context, which is a prefix of the conversation's stream, and its target."""
    return F.concat(F.substring(formatted, F.lit(1), context_chars.cast("int")), target)


def trainable(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """The unescaped text under the loss mask of an expanded example."""
    return unescape(F.substring(text, (loss_start + 1).cast("int"), (loss_end - loss_start).cast("int")))


def gathered(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the conversation's segments in order) and its examples in order, from one shuffle."""
    turns = formatted_turns(conversations).select("conv_id", F.struct("context_turns", "segment").alias("s"), example().alias("e"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("stream"), F.array_sort(F.collect_list("e")).alias("examples"))
    return rows.select("conv_id", F.array_join(F.transform("stream", lambda t: t["segment"]), "").alias("formatted"), "examples")


def streams(conversations: DataFrame) -> DataFrame:
    """conv_id and formatted."""
    return gathered(conversations).select("conv_id", "formatted")


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, example and loss span, each example with its whole context written out."""
    whole = streams(conversations).withColumnRenamed("conv_id", "s_id")
    made = examples(conversations)
    return made.join(whole, F.col("conv_id").eqNullSafe(F.col("s_id"))).select(
        "conv_id",
        "turn",
        expanded(F.col("formatted"), F.col("context_chars"), F.col("target")).alias("example"),
        "loss_start",
        "loss_end",
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) of every turn of a formatted stream."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END))).alias("text"),
        ),
    )


def format_report(conversations: DataFrame) -> DataFrame:
    """What can be read back from each conversation's stream and from the loss masks of its examples.

    Every example is expanded, context and target, and its loss is read by its mask from that text; one example is held at a time.
    """
    read = gathered(conversations).withColumn("turns", read_back(F.col("formatted")))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("examples", lambda e: trainable(expanded(F.col("formatted"), e["context_chars"], e["target"]), e["loss_start"], e["loss_end"])), "")
    return read.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("examples").cast("long").alias("n_examples"),
    )


def fixed_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of another template."""
    text = F.lit("</s>[INST] ok [/INST]").alias("text")
    turn = F.col("id").alias("turn")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn, role, text)


def op2_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_report(talks.unionByName(fixed_conversation(spark)))


_SQL_ESCAPED = f"regexp_replace(replace(coalesce({{0}}, ''), chr(57344), chr(57344) || '0'), '({OPENING})({FOLLOWING})', '\\1' || chr(57344) || '1\\2', 'g')"

ORACLE_SQL = f"""
WITH talks AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), clean AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         12 + len(replace({_SQL_ESCAPED.format("role")}, chr(10), chr(57344) || '2')) + 1 + len({_SQL_ESCAPED.format("text")}) + 11 AS chars
  FROM talks
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM clean GROUP BY conv_id
"""
