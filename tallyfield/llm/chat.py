"""Preference pairs as one shared prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once. What follows in each
is its completion; the mask holds the places of what an assistant said there, with its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

BEGIN, END = "<|begin|>", "<|end|>"
ASSISTANT = "assistant"


def _turns(table: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the conversation as an array of turns in order; ties by role and text."""
    table = only(table, *dict.fromkeys([key, "turn", "role", "text"]))
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = F.array_sort(F.collect_list(turn))
    said = F.transform(rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return table.groupBy(F.col(f"`{key}`").alias("pair")).agg(said.alias(name))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def mask(turns: Column) -> Column:
    """start:end in code points of the assistants' words and end marks in the rendered turns, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + (len(BEGIN) + 1)
        end = begin + F.length(turn["text"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda s: s["spans"]), ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) for every key on either side.

    Both tables hold turns as key, turn, role, text. Turns are equal if role and text are; null ones count as empty. A
    key on one side only has an empty prompt and an empty completion for the other. Equal conversations have empty
    completions. Repeated turns stay; ties in turn go by role and text, and a null turn comes first. Rows with a null
    key form one pair. Other columns are ignored whatever their names, texts are taken whole, and empty tables give no
    rows.
    """
    both = _turns(chosen, key, "c").join(_turns(rejected, key, "r").withColumnRenamed("pair", "pair_r"), F.col("pair").eqNullSafe(F.col("pair_r")), "full")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = both.select(F.coalesce("pair", "pair_r").alias("pair"), F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & (a == b))
    differ = F.array_position(same, F.lit(False)).cast("int")
    cut = sides.withColumn("p", F.when(differ == 0, F.size("c")).otherwise(differ - 1))
    rest = lambda side: F.slice(side, F.col("p") + 1, F.size(side))
    return cut.select(
        F.col("pair").alias(key),
        F.col("p").cast("long").alias("prompt_turns"),
        render(F.slice("c", F.lit(1), F.col("p"))).alias("prompt"),
        render(rest("c")).alias("chosen"),
        render(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
    )


def with_borrowed_reply(conversations: DataFrame) -> DataFrame:
    """Rejected versions: each conversation with its last assistant turn said as its neighbour (id with the last bit turned) said its own.

    Where the neighbour has no assistant turn the reply is empty; conversations without one stay as they are, and so do
    rows with a null conv_id. Of repeated last turns every one is replaced; the neighbour lends the greatest text of
    its own. Other columns are dropped whatever their names, so that none can clash; empty tables give no rows.
    """
    conversations = only(conversations, "conv_id", "turn", "role", "text")
    said = F.when(F.col("role") == ASSISTANT, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    last = conversations.groupBy("conv_id").agg(F.max(said).alias("last"))
    lent = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("lent"))
    own = conversations.join(last.select("conv_id", F.col("last.turn").alias("last_turn")), "conv_id", "left").join(lent, "conv_id", "left")
    swap = (F.col("role") == ASSISTANT) & (F.col("turn") == F.col("last_turn"))
    return own.select("conv_id", "turn", "role", F.when(swap, F.coalesce("lent", F.lit(""))).otherwise(F.col("text")).alias("text"))


ORACLE_SQL = """
WITH base AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, struct_pack(t := turn, x := text)) AS reply FROM base WHERE role = 'assistant' GROUP BY conv_id),
rej AS (
  SELECT b.conv_id, b.turn, b.role, CASE WHEN b.role = 'assistant' AND b.turn = l.last_turn THEN coalesce(n.reply, '') ELSE b.text END AS text
  FROM base b LEFT JOIN last l ON b.conv_id = l.conv_id LEFT JOIN last n ON n.conv_id = xor(b.conv_id, 1)),
sides AS (SELECT 'c' AS side, * FROM base UNION ALL SELECT 'r', * FROM rej),
num AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) AS k FROM sides),
c AS (SELECT * FROM num WHERE side = 'c'),
r AS (SELECT * FROM num WHERE side = 'r'),
p AS (
  SELECT c.conv_id, coalesce(min(c.k) FILTER (WHERE r.k IS NULL OR c.role <> r.role OR c.text <> r.text), max(c.k) + 1) - 1 AS p
  FROM c LEFT JOIN r ON c.conv_id = r.conv_id AND c.k = r.k GROUP BY c.conv_id),
shown AS (
  SELECT side, num.conv_id, k, role, p, k <= p AS shared, '<|begin|>' || role || chr(10) || text || '<|end|>' || chr(10) AS t, length(role) AS lr FROM num JOIN p ON num.conv_id = p.conv_id),
placed AS (
  SELECT *, sum(length(t)) OVER (PARTITION BY side, conv_id, shared ORDER BY k) AS e FROM shown)
SELECT conv_id, CAST(any_value(p) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE side = 'c' AND shared), '') AS prompt,
  coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE side = 'c' AND NOT shared), '') AS chosen,
  coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE side = 'r' AND NOT shared), '') AS rejected,
  coalesce(string_agg(CAST(e - length(t) + lr + 10 AS BIGINT) || ':' || CAST(e - 1 AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(e - length(t) + lr + 10 AS BIGINT) || ':' || CAST(e - 1 AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
