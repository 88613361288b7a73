r"""Chat formatting by prefix-target expansion, in built-in functions only.

Every assistant turn becomes an example of its own: all preceding turns are context and only that
reply is trainable. A conversation that does not end with an assistant turn also gives one example
without a target, so that the output holds every turn. One turn is written as

    <turn>ROLE\nTEXT\n</turn>\n

A control string (``<turn>`` or ``</turn>``) inside a text, with the k backslashes before it, gets one
backslash more, so a marker is exactly a control string without a backslash before it; removing one
backslash restores the text. Roles other than ``[A-Za-z0-9_]*`` are written as ``x-`` and their hex.

Defined cases: rows go by (turn, role, text), null turns first, rows with equal turn all count; a null
text or role is empty; rows with a null conv_id form one conversation; an empty table gives an empty
result. Only role 'assistant' is trainable. The contexts repeat earlier turns by definition, so the
output of one conversation is as large as the sum of its prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A run of backslashes is tried from its beginning only and never given back, so long runs cost their length.
CONTROL = r"(?<!\\)(\\*+</?turn>)"
ESCAPED = r"(?<!\\)\\(\\*+</?turn>)"
MARK = r"(?<!\\)<turn>"
OPEN, CLOSE = "<turn>", "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1"))


def escape_role(role: Column) -> Column:
    return F.when(role.rlike("^[A-Za-z0-9_]*$") & ~role.contains("\n"), role).otherwise(F.concat(F.lit("x-"), F.hex(role)))


def unescape_role(role: Column) -> Column:
    return F.when(role.startswith("x-"), F.decode(F.unhex(F.substring(role, 3, 1 << 30)), "UTF-8")).otherwise(role)


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, position, trainable, text, loss_start, loss_end: one row per example.

    ``text`` is the formatted example; code points loss_start (inclusive) to loss_end (exclusive) are
    the trainable reply, escaped as it stands there.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda x: x["role"]).alias("roles"),
        F.transform("turns", lambda x: F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda x: escape(x["text"])).alias("bodies"),
    ).withColumn("written", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))))
    wanted = F.filter(
        F.sequence(F.lit(0), F.size("roles") - 1),
        lambda i: (F.get(F.col("roles"), i) == "assistant") | (i == F.size("roles") - 1),
    )
    each = written.withColumn("position", F.explode(wanted))
    before = F.coalesce(F.array_join(F.slice("written", F.lit(1), F.col("position")), ""), F.lit(""))
    head, body = F.get("heads", F.col("position")), F.get("bodies", F.col("position"))
    trainable = F.get("roles", F.col("position")) == "assistant"
    start = F.length(before) + F.length(head)
    return each.select(
        "conv_id", "position", trainable.alias("trainable"), F.concat(before, head, body, F.lit(CLOSE)).alias("text"),
        F.when(trainable, start).otherwise(0).alias("loss_start"),
        F.when(trainable, start + F.length(body)).otherwise(0).alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted example: array of struct(role, text)."""
    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = part.substr(F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    parts = F.split(text, MARK, -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def digest(examples: DataFrame) -> DataFrame:
    """What a reader finds in the examples of each conversation; see the query's contract."""
    loss = unescape(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    found = examples.select("conv_id", "position", "text", F.when(F.col("trainable"), loss).otherwise("").alias("loss"))
    each = found.groupBy("conv_id").agg(
        F.max_by("text", "position").alias("longest"),
        F.sort_array(F.collect_list(F.struct("position", "loss"))).alias("losses"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    ).select(
        "conv_id", "formatted_chars", read_back(F.col("longest")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return each.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: The contract's extra conversation, whose texts hold control strings.
TRICKY = r"\### Assistant: </turn> ok"


def with_tricky(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    turns = F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.explode(turns).alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(TRICKY).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, 6 + length(role) + 1 + length(regexp_replace(text, '(\\*</?turn>)', '\\\1', 'g')) + 9 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end
  FROM c
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM t
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
