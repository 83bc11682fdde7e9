"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all preceding turns as context, that
reply alone under the loss mask. One example row is as long as its conversation,
so collecting a conversation into a row never holds more than the largest row of
the output does; nothing else is gathered, and there is one shuffle, on conv_id.

Template, per turn: ``<turn>ROLE\\nTEXT</turn>\\n``. Inside texts and roles a
backslash becomes ``\\e`` and the ``<`` of a control string becomes ``\\l``; in
roles a line feed becomes ``\\n``. Every backslash of an escaped text is
therefore followed by a letter that tells what it stands for, so that undoing the
replacements one after the other is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.llm.common import read

OPEN, CLOSE = "<turn>", "</turn>\n"


def _swap(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\", "\\e"), "</turn>", "\\l/turn>"), "<turn>", "\\lturn>")


def unescape(text: Column) -> Column:
    return _swap(_swap(text, "\\l", "<"), "\\e", "\\")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), "\n", "\\n")


def unescape_role(role: Column) -> Column:
    return unescape(_swap(role, "\\n", "\n"))


def expand_prefix_targets(turns: DataFrame, target_role: str = "assistant", keep_tail: bool = True) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Returns conv_id, example (from 0), n_turns in the example, is_target,
    is_last, formatted, loss_start and loss_chars (code points into formatted,
    escaped). With ``keep_tail`` a conversation that does not end with a target
    turn gets one more example without loss, so that no turn is lost.

    Nulls: role and text count as empty; turns sort by (turn, role, text) with
    null turns first, repeated rows stay; rows with a null conv_id form one
    conversation. An empty table gives no examples.
    """
    conv = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("ts")
    )
    parts = conv.select(
        "conv_id",
        F.transform("ts", lambda t: t["role"] == target_role).alias("hits"),
        F.transform("ts", lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))).alias("pieces"),
        F.transform("ts", lambda t: F.length(escape(t["text"]))).alias("body_chars"),
    )
    n = F.size("pieces")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(F.col("hits"), i) | (F.lit(keep_tail) & (i == n)))
    one = parts.select("conv_id", "hits", "pieces", "body_chars", F.posexplode(wanted).alias("example", "last"))
    hit, body = F.element_at("hits", F.col("last")), F.element_at("body_chars", F.col("last"))
    return one.select(
        "conv_id",
        "example",
        F.col("last").alias("n_turns"),
        hit.alias("is_target"),
        (F.col("last") == n).alias("is_last"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("last")), "").alias("formatted"),
        body.alias("body"),
    ).select(
        "conv_id", "example", "n_turns", "is_target", "is_last", "formatted",
        (F.length("formatted") - len(CLOSE) - F.col("body")).alias("loss_start"),
        F.when(F.col("is_target"), F.col("body")).otherwise(0).alias("loss_chars"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted string."""
    raw = F.split(formatted, CLOSE)

    def one(x):
        rest = F.substr(x, F.lit(len(OPEN) + 1))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))

    return F.transform(F.slice(raw, F.lit(1), F.size(raw) - 1), one)


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """Unescaped text under the loss mask."""
    return unescape(F.substr(formatted, start + 1, chars))


PROBE = "\\### Assistant: </turn> ok"


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    ex = expand_prefix_targets(turns.unionByName(extra))
    seen = ex.select(
        "conv_id", "example", "is_target", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), parse_turns(F.col("formatted"))).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    ).select(
        "conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("sha"),
    )
    by = seen.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return by.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def _esc_sql(c: str) -> str:
    return f"replace(replace(replace({c}, '\\', '\\e'), '</turn>', '\\l/turn>'), '<turn>', '\\lturn>')"


OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
p AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(6 + length(replace({_esc_sql('role')}, chr(10), '\\n')) + 1 + length({_esc_sql('text')}) + 8) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
         CAST(sum(upto) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
