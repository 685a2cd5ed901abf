"""Chat formatting with the perspective rotated, in DataFrame functions only.

Every participant of a dialogue becomes the assistant once; all others become named users and
system turns stay. Each turn of each rendering is one row with its place in the rendered text
and whether it is trained on, so a dialogue of any length needs no row or task that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYSTEM = "system"
#: Turns of a dialogue that are added up in one block.
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Text that can't open or close a turn: a space parts the signs with which every mark begins."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _named(speaker: Column) -> Column:
    """A speaker's name on one line of its own."""
    return escaped(F.translate(F.coalesce(speaker.cast("string"), F.lit("unknown")), "\n\r", "  "))


def _header(name: Column, as_role: Column) -> Column:
    return F.when(as_role == "user", F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n"))).otherwise(F.concat(F.lit(OPEN), as_role, F.lit("\n")))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, perspective, position, turn, speaker, as_role, segment, start, end, train_start, train_end, is_target).

    ``segment`` is the rendered turn; ``start`` and ``end`` are its places in the whole
    rendering, in characters. The text and closing mark of the perspective's own turns are
    trained on: there ``is_target`` holds and ``train_start`` to ``train_end`` is the span,
    which is empty elsewhere. In texts and names ``<|`` becomes ``< |``, so that neither can
    forge a turn; line ends in names become spaces. Null texts are empty, null speakers are called ``unknown``, a
    null conversation is one of its own. Turns go by number, nulls first, and of turns with
    the same number by speaker and text; repeated rows are all rendered. A conversation
    without participants has no perspective and gives no row.

    Order within a dialogue is found in two steps, within blocks of turns and among blocks,
    so that a long dialogue is spread over tasks. Turns of a number must fit a task.
    """
    base = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        _named(F.col(speaker_col)).alias("speaker"),
        escaped(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    speakers = base.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    mark = lambda c: c.select(*[F.col(x).alias("of" if x == "conv_id" else x) for x in c.columns])
    body = F.length("text") + len(CLOSE)
    # Widths under another speaker's perspective and under the speaker's own.
    widths = base.withColumns({
        "as_other": F.when(F.col("speaker") == SYSTEM, F.length(_header(F.col("speaker"), F.lit("system")))).otherwise(F.length(_header(F.col("speaker"), F.lit("user")))) + body,
        "as_own": F.when(F.col("speaker") == SYSTEM, F.length(_header(F.col("speaker"), F.lit("system")))).otherwise(F.length(_header(F.col("speaker"), F.lit("assistant")))) + body,
    })
    # What the blocks before a block hold: rows and widths for all, and the difference for each speaker.
    by_block = widths.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum("as_other").alias("width"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = by_block.select("conv_id", "block", zero(F.sum("rows").over(before)).alias("rows_before"), zero(F.sum("width").over(before)).alias("width_before"))
    own = widths.where(F.col("speaker") != SYSTEM).groupBy("conv_id", F.col("speaker").alias("perspective"), "block").agg(F.sum(F.col("as_own") - F.col("as_other")).alias("less"))
    grid = blocks.join(mark(speakers), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = own.select(F.col("conv_id").alias("c2"), F.col("perspective").alias("p2"), F.col("block").alias("b2"), "less")
    grid = grid.join(own, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("perspective") == F.col("p2")) & (F.col("block") == F.col("b2")), "left")
    each = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(F.col("conv_id").alias("c3"), F.col("block").alias("b3"), "perspective", "rows_before", (F.col("width_before") + zero(F.sum(zero(F.col("less"))).over(each))).alias("chars_before"))
    met = widths.join(grid, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("block") == F.col("b3"))).drop("c3", "b3")
    as_role = F.when(F.col("speaker") == SYSTEM, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    shaped = met.withColumn("as_role", as_role).withColumn("header", _header(F.col("speaker"), F.col("as_role")))
    shaped = shaped.withColumn("segment", F.concat("header", "text", F.lit(CLOSE)))
    inside = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "speaker", "text")
    placed = shaped.withColumn("start", F.col("chars_before") + zero(F.sum(F.length("segment")).over(inside))).withColumn("position", F.col("rows_before") + F.row_number().over(number) - 1)
    end = F.col("start") + F.length("segment")
    is_target = F.col("as_role") == "assistant"
    return placed.select("conv_id", "perspective", "position", "turn", "speaker", "as_role", "segment", "start", end.alias("end"), F.when(is_target, F.col("start") + F.length("header")).otherwise(end).alias("train_start"), end.alias("train_end"), is_target.alias("is_target"))


def rendered(rotated: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, spans) of whole dialogues, for those that are known to fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "train_start", "train_end", "is_target")))
    whole = rotated.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["is_target"]), lambda x: F.struct(x["train_start"].alias("start"), x["train_end"].alias("end")))
    return whole.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), spans.alias("spans"))


ROTATE_SQL = f"""
WITH t AS (SELECT conv_id, turn, replace(translate(coalesce(role, 'unknown'), chr(10) || chr(13), '  '), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.*, p.perspective, CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN as_role = 'user' THEN '{OPEN}user name=' || speaker || chr(10) ELSE '{OPEN}' || as_role || chr(10) END AS header FROM r),
s AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS position, sum(length(segment)) OVER w AS "end" FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, turn, speaker, as_role, segment, ("end" - length(segment))::BIGINT AS start, "end"::BIGINT AS "end",
  (CASE WHEN as_role = 'assistant' THEN "end" - length(segment) + length(header) ELSE "end" END)::BIGINT AS train_start, "end"::BIGINT AS train_end, as_role = 'assistant' AS is_target FROM o
"""
