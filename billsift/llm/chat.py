"""Preference formatting of chat conversations, in DataFrame functions only.

A chosen and a rejected conversation are compared turn by turn. The turns before
the first difference are their longest common prefix: they are rendered once, as
the prompt. What follows on either side is rendered as a completion, with a mask
of the characters to learn from: the content and the end mark of each assistant
turn in it.

Turns are rows, and they are compared under their place in their side, so no conversation
is gathered to find the prefix. Text is put together for CHUNK_TURNS turns at a
time, in as many tasks as a long pair has chunks; then a pair's chunks are joined
to its one row, each mask moved by the length of the chunks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_TURNS = 256
# The marks around a turn. "<|" inside a text or role is written "< |", and "|>" inside a role "| >", so
# neither can forge a turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"
LAST_TURN = (1 << 63) - 1


def _rows(chosen: DataFrame, rejected: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """(pair, turn, side, role, text) of both sides, with nulls filled."""
    one = lambda rows, side: rows.select(
        F.col(id).alias("pair"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST_TURN)).alias("turn"), F.lit(side).alias("side"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return one(chosen, "chosen").union(one(rejected, "rejected"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(F.replace(turn["role"], F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit(CLOSE))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit(END))


def first_differences(rows: DataFrame) -> DataFrame:
    """(pair, chosen, rejected): each side's number of the first turn that is not the same on both sides; null for a side that ends before, or if all are the same.

    Turns are compared by their place within their side, whatever numbers they have. Only digests are shuffled: the turns of a
    side are counted chunk by chunk, so no side is gathered to be numbered.
    """
    told = F.struct("role", F.sha2("text", 256).alias("text"))
    turns = rows.groupBy("pair", "side", "turn").agg(F.array_sort(F.collect_list(told)).alias("told"))
    chunks = turns.groupBy("pair", "side", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "told"))).alias("turns")
    )
    before = Window.partitionBy("pair", "side").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    each = chunks.withColumn(
        "before", F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0)),
    ).select("pair", "side", "before", F.posexplode("turns").alias("i", "t"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("t"))).alias(side)
    both = each.groupBy("pair", (F.col("before") + F.col("i")).alias("place")).agg(of("chosen"), of("rejected"))
    differs = ~F.col("chosen.told").eqNullSafe(F.col("rejected.told"))
    first = both.groupBy("pair").agg(
        F.min_by(F.struct(F.col("chosen.turn").alias("a"), F.col("rejected.turn").alias("b")), F.when(differs, F.col("place"))).alias("at")
    )
    return first.select("pair", F.col("at.a").alias("chosen"), F.col("at.b").alias("rejected"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, id: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(<id>, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask), a row for each pair.

    A mask is an array of (start, end): code points of the completion, end excluded. Equal
    conversations are all prompt, with empty completions; a pair with one side only has no prompt. Rows that share a
    pair, a side and a turn are one turn, rendered in order of role and text; a null turn comes last, a null role is
    `unknown`, a null text is empty, a null id is a pair like any other. Other columns of the inputs are not used.
    """
    rows = _rows(chosen, rejected, id, turn, role, text)
    chunks = rows.groupBy("pair", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "side"))).alias("turns")
    )
    first = first_differences(rows).select(F.col("pair").alias("_pair"), F.col("chosen").alias("_chosen"), F.col("rejected").alias("_rejected"))
    split = chunks.join(first, F.col("pair").eqNullSafe(F.col("_pair")))
    common = lambda x, side: F.coalesce(x["turn"] < F.col(f"_{side}"), F.lit(True))
    rest = lambda side: F.filter("turns", lambda x: ~common(x, side) & (x["side"] == side)).alias(side)
    prompt = F.filter("turns", lambda x: common(x, "chosen") & (x["side"] == "chosen")).alias("prompt")
    parts = split.select("pair", "chunk", prompt, rest("chosen"), rest("rejected"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(_rendered(x))
        learnt = F.array(F.struct((acc["at"] + F.length(_head(x))).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["role"] == LEARNT, F.concat(acc["mask"], learnt)).otherwise(acc["mask"]).alias("mask"))

    joined = lambda s: F.array_join(F.transform(s, _rendered), "").alias(s)
    mask = lambda s: F.aggregate(s, start, step, lambda acc: acc["mask"]).alias(f"{s}_mask")
    made = parts.select(
        "pair", "chunk", F.size("prompt").cast("long").alias("n"), joined("prompt"), joined("chosen"), mask("chosen"), joined("rejected"),
        mask("rejected"),
    )
    before = Window.partitionBy("pair").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shifted = lambda s: F.transform(
        f"{s}_mask", lambda m: F.struct(*[(m[k] + F.col(f"{s}_at")).alias(k) for k in ("start", "end")]),
    ).alias(f"{s}_mask")
    placed = made.withColumns({f"{s}_at": F.coalesce(F.sum(F.length(s)).over(before), F.lit(0)) for s in ("chosen", "rejected")})
    moved = placed.select("pair", "n", F.struct("chunk", "prompt", "chosen", shifted("chosen"), "rejected", shifted("rejected")).alias("part"))
    whole = moved.groupBy("pair").agg(F.sum("n").alias("n_prompt_turns"), F.array_sort(F.collect_list("part")).alias("parts"))
    text = lambda s: F.array_join(F.transform("parts", lambda x: x[s]), "").alias(s)
    masks = lambda s: F.flatten(F.transform("parts", lambda x: x[f"{s}_mask"])).alias(f"{s}_mask")
    return whole.select(F.col("pair").alias(id), "n_prompt_turns", text("prompt"), text("chosen"), masks("chosen"), text("rejected"), masks("rejected"))


def reply_swaps(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns for a table without preferences: every conversation is chosen, and its rejected
    twin has its last assistant turn replaced by that of the conversation next to it (ids 2k and 2k+1 are neighbours;
    an empty reply if that has none)."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where((F.col("role") == LEARNT) & F.col("turn").isNotNull()).groupBy("pair_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")
    )
    own = last.select("pair_id", F.col("last.turn").alias("_turn"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("_text"))
    swap = (F.col("role") == LEARNT) & (F.col("turn") == F.col("_turn"))
    swapped = turns.join(own.join(other, "pair_id", "left"), "pair_id", "left")
    return turns, swapped.select("pair_id", "turn", "role", F.when(swap, F.coalesce("_text", F.lit(""))).otherwise(F.col("text")).alias("text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair; masks as text (start:end, comma-joined)."""
    found = format_preferences(*reply_swaps(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    told = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias(c)
    return found.select("pair_id", "n_prompt_turns", "prompt", "chosen", told("chosen_mask"), "rejected", told("rejected_mask"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT pair_id, max(turn) AS turn, arg_max(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY pair_id),
r AS (SELECT t.pair_id, t.turn, t.role, CASE WHEN t.role = 'assistant' AND t.turn = l.turn THEN coalesce(o.text, '') ELSE t.text END AS other
      FROM t LEFT JOIN last l ON l.pair_id = t.pair_id LEFT JOIN last o ON o.pair_id = xor(t.pair_id, 1)),
j AS (SELECT t.*, r.other, min(CASE WHEN t.text <> r.other THEN t.turn END) OVER (PARTITION BY t.pair_id) AS first
      FROM t JOIN r USING (pair_id, turn)),
s AS (SELECT pair_id, turn, side, role = 'assistant' AS learnt, length('<|' || name || '|>' || chr(10)) AS head,
        '<|' || name || '|>' || chr(10) || replace(body, '<|', '< |') || '<|end|>' || chr(10) AS txt
      FROM (SELECT *, replace(replace(role, '<|', '< |'), '|>', '| >') AS name FROM (SELECT pair_id, turn, role, 'prompt' AS side, text AS body FROM j WHERE first IS NULL OR turn < first
            UNION ALL SELECT pair_id, turn, role, 'chosen', text FROM j WHERE turn >= first
            UNION ALL SELECT pair_id, turn, role, 'rejected', other FROM j WHERE turn >= first))),
o AS (SELECT *, coalesce(sum(length(txt)) OVER (PARTITION BY pair_id, side ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s),
m AS (SELECT *, (off + head)::VARCHAR || ':' || (off + length(txt))::VARCHAR AS span FROM o)
SELECT pair_id, count(*) FILTER (side = 'prompt') AS n_prompt_turns,
  coalesce(string_agg(txt, '' ORDER BY turn) FILTER (side = 'prompt'), '') AS prompt,
  coalesce(string_agg(txt, '' ORDER BY turn) FILTER (side = 'chosen'), '') AS chosen,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (side = 'chosen' AND learnt), '') AS chosen_mask,
  coalesce(string_agg(txt, '' ORDER BY turn) FILTER (side = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY turn) FILTER (side = 'rejected' AND learnt), '') AS rejected_mask
FROM m GROUP BY pair_id
"""
