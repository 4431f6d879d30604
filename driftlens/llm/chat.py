"""Chat formatting by rotating perspectives, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once more,
with that participant as the assistant and all others as named users. Turns of
the system role are context: they keep their role and have no perspective of
their own. A conversation with a third of all turns is no single task's work: its
participants are joined to blocks of chunks of turns, these to chunks, these to
turns; output has one row for each perspective and turn, and the places of turns
in the rendered dialogue come from sums by chunk of turns, then running sums
over chunks, then within each chunk. Turns that share a number, or have none,
are in one chunk.

Defined cases: turns are ordered by turn (nulls first), role and text; repeated
rows are repeated turns; a null text is empty; a null role is the participant
"unknown"; turns with a null conv_id form one conversation; roles and texts are
rendered as they are, so marks that a text spells itself look like those between
turns (start and mask columns tell them apart); an empty table gives no rows; columns other than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import table

#: Turns with equal turn div CHUNK are numbered together; BLOCK such parts are a block.
CHUNK, BLOCK = 64, 1024
_CONTEXT = "system"


def _segment(perspective: Column, role: Column, text: Column) -> tuple[Column, Column]:
    """The header and the body of a rendered turn."""
    header = (
        F.when(role == _CONTEXT, F.lit("<|system|>\n"))
        .when(role == perspective, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))
    )
    return header, F.concat(text, F.lit("<|end|>\n"))


def _meet(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left and right joined on key, where null conv_id is equal to itself."""
    right = right.select(*[F.col(c).alias(f"_{c}") if c in key else F.col(c) for c in right.columns])
    met = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for c in key[1:]:
        met &= F.col(c) == F.col(f"_{c}")
    return left.join(right, met).drop(*[f"_{c}" for c in key])


def perspectives(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation, perspective and turn.

    seq counts the turns of a conversation from 0. segment is the rendered
    turn; start is its first character in the rendered dialogue, which is the
    segments in order of seq. Training on this perspective takes loss on
    characters mask_start to mask_end: the body of the perspective's own turns,
    with its end mark. Both are null for other turns.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    part = F.floor(F.coalesce("turn", F.lit(-1)) / chunk).cast("long")
    clean = clean.withColumn("part", F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(part))
    people = clean.where(F.col("role") != _CONTEXT).select("conv_id", F.col("role").alias("perspective")).distinct()
    # participants reach turns by way of blocks and parts, so that no step gathers a conversation's turns
    parts = clean.select("conv_id", "part").distinct().withColumn("block", F.floor(F.col("part") / BLOCK))
    blocks = _meet(parts.select("conv_id", "block").distinct(), people, ["conv_id"])
    rows = _meet(clean, _meet(parts, blocks, ["conv_id", "block"]).drop("block"), ["conv_id", "part"])
    header, body = _segment(F.col("perspective"), F.col("role"), F.col("text"))
    rows = rows.withColumns({"header": header, "body": body}).withColumn("size", (F.length("header") + F.length("body")).cast("long"))
    key = ["conv_id", "perspective"]
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "part").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    sums = sums.select(
        *key, "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    inner = Window.partitionBy(*key, "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({
        "n": F.row_number().over(inner) - 1,
        "chars": F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    })
    rows = rows.alias("r").join(
        sums.alias("s"),
        F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.perspective") == F.col("s.perspective")) & (F.col("r.part") == F.col("s.part")),
    )
    start = F.col("r.chars") + F.col("s.chars_before")
    own = F.col("r.role") == F.col("r.perspective")
    return rows.select(
        F.col("r.conv_id").alias("conv_id"),
        F.col("r.perspective").alias("perspective"),
        (F.col("r.n") + F.col("s.seq_before")).cast("long").alias("seq"),
        F.col("r.turn").alias("turn"),
        F.col("r.role").alias("speaker"),
        F.concat("r.header", "r.body").alias("segment"),
        start.cast("long").alias("start"),
        F.when(own, start + F.length("r.header")).cast("long").alias("mask_start"),
        F.when(own, start + F.col("r.size")).cast("long").alias("mask_end"),
    )


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), r AS (
  SELECT t.*, p.perspective,
    CASE WHEN t.role = 'system' THEN '<|system|>' || chr(10)
         WHEN t.role = p.perspective THEN '<|assistant|>' || chr(10)
         ELSE '<|user name=' || t.role || '|>' || chr(10) END AS header,
    t.text || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    CAST(sum(length(header) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(header) - length(body) AS start
  FROM r WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role AS speaker, header || body AS segment, CAST(start AS BIGINT) AS start,
  CASE WHEN role = perspective THEN CAST(start + length(header) AS BIGINT) END AS mask_start,
  CASE WHEN role = perspective THEN CAST(start + length(header) + length(body) AS BIGINT) END AS mask_end
FROM s
"""
