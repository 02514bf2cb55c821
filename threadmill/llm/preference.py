"""Preference formatting: chosen and rejected conversations become one prompt and two completions with loss masks.

The longest common prefix of turns (role and text equal) is rendered once, as the prompt; the rest of each side is its completion.
A completion's mask lists the spans of its rendered text, in code points, that are trained on: the text and end mark of its assistant turns.

Turns are gathered by pair and side: what meets in one task is one conversation, which the result holds as one row anyway; nothing is
compared across pairs. The table has no pairs of its own. The query makes them with branches(): a conversation up to its last assistant turn is chosen, the same with that turn's text
from the next conversation (conv_id + 1) rejected. op7_preference_neighbours pairs conversations 2k (chosen) and 2k + 1 (rejected), which share no turn.

Turns are sorted by turn (null first), role and text, so repeated rows are repeated turns. A null role or text is rendered as empty, and is
equal to another null only. Rows with a null conv_id belong to no conversation. A pair without one of its sides has an empty completion for it
and its whole other side as completion (of a negative conv_id the pair is rounded down, too). A very long text is rendered whole; turns' further columns are left out, whatever
their names. usable says whether both completions hold an assistant turn. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import materialize, read

#: The template: before and after a turn's text. The mark after the text is part of what is trained.
ROLE_OPEN, ROLE_CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(ROLE_OPEN), F.coalesce(t["role"], F.lit("")), F.lit(ROLE_CLOSE), F.coalesce(t["text"], F.lit("")), F.lit(END))


def _mask(turns: Column) -> Column:
    """Spans of the rendered turns that are trained on."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(F.coalesce(t["role"], F.lit(""))) + len(ROLE_OPEN) + len(ROLE_CLOSE)
        end = begin + F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
        trained = t["role"].eqNullSafe(F.lit(TRAINED))
        return F.struct(end.cast("long").alias("at"), F.when(trained, F.array_append(a["spans"], F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_pairs(turns: DataFrame, pair: str = "pair_id", chosen: str = "is_chosen") -> DataFrame:
    """A row per pair: pair_id, prompt_turns, prompt, chosen and rejected (completions), their masks, and usable. turns: pair, chosen (boolean), turn, role, text."""
    known = turns.where(F.col(pair).isNotNull() & F.col(chosen).isNotNull())
    side = lambda is_chosen: F.transform(F.array_sort(F.collect_list(F.when(F.col(chosen) == is_chosen, F.struct("turn", "role", "text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = known.groupBy(F.col(pair).alias("pair_id")).agg(side(True).alias("c"), side(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    sides = sides.withColumn("n", F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int"))
    sides = sides.withColumns({"p": F.slice("c", 1, F.col("n")), "c": F.slice("c", F.col("n") + 1, F.greatest(F.size("c") - F.col("n"), F.lit(0))), "r": F.slice("r", F.col("n") + 1, F.greatest(F.size("r") - F.col("n"), F.lit(0)))})
    trains = lambda c: F.exists(c, lambda t: t["role"].eqNullSafe(F.lit(TRAINED)))
    return sides.select("pair_id", F.col("n").cast("long").alias("prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"), (trains("c") & trains("r")).alias("usable"))


def branches(turns: DataFrame) -> DataFrame:
    """Pairs as format_pairs takes them, of conversations (conv_id, turn, role, text): each one up to its last assistant turn (by turn, then text) against itself with that turn's text from the
    last assistant turn of conv_id + 1. A conversation without such a turn is no pair; where the next one has none, the rejected side ends before it. Turns after the last
    assistant turn, and without a number, are left out."""
    turns = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    last = turns.where((F.col("role") == TRAINED) & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = materialize(last, "preference-last")
    known = turns.join(last.select("conv_id", F.col("last.turn").alias("until")), "conv_id")
    row = lambda is_chosen: (F.col("conv_id").alias("pair_id"), F.lit(is_chosen).alias("is_chosen"), "turn", "role", "text")
    of = last.select("conv_id", F.col("last.turn").alias("turn"), F.lit(TRAINED).alias("role"))
    other = of.join(last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("text")), "conv_id")
    return known.where("turn <= until").select(*row(True)).union(known.where("turn < until").select(*row(False))).union(other.select(*row(False)))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(branches(read(spark, sf_dir, "conversations")))


def op7_preference_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(read(spark, sf_dir, "conversations").select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("is_chosen"), "turn", "role", "text"))


def _formatted(turns: DataFrame) -> DataFrame:
    done = format_pairs(turns)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return done.select("pair_id", "prompt_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"), "usable")


QUERIES = {"op7_preference": op7_preference, "op7_preference_neighbours": op7_preference_neighbours}

_TURN = f"'{ROLE_OPEN}' || coalesce(role, '') || '{ROLE_CLOSE.strip()}' || chr(10) || coalesce(text, '') || '{END.strip()}' || chr(10)"
_SIDE_SQL = """{s} AS (SELECT pair_id, string_agg(line, '' ORDER BY k) AS {s},
  string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(upto - length(coalesce(text, '')) - {end} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto AS BIGINT) AS VARCHAR) END, ',' ORDER BY k) AS {s}_mask, bool_or(coalesce(role = 'assistant', false)) AS {s}_ok
  FROM (SELECT *, sum(length(line)) OVER (PARTITION BY pair_id ORDER BY k) AS upto FROM turns JOIN prefix USING (pair_id) WHERE {where} AND k > n) GROUP BY pair_id)"""

_PAIRS_SQL = f"""turns AS (SELECT *, {_TURN} AS line, row_number() OVER (PARTITION BY pair_id, good ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM raw),
pairs AS (SELECT pair_id, count(*) FILTER (good) AS nc, count(*) FILTER (NOT good) AS nr FROM turns GROUP BY pair_id),
differ AS (SELECT a.pair_id, min(a.k) AS k FROM turns a JOIN turns b ON a.pair_id = b.pair_id AND a.k = b.k AND a.good AND NOT b.good
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
prefix AS (SELECT pair_id, coalesce(k - 1, least(nc, nr)) AS n FROM pairs LEFT JOIN differ USING (pair_id)),
prompts AS (SELECT pair_id, string_agg(line, '' ORDER BY k) AS prompt FROM turns JOIN prefix USING (pair_id) WHERE good AND k <= n GROUP BY pair_id),
{_SIDE_SQL.format(s="chosen", where="good", end=len(END))},
{_SIDE_SQL.format(s="rejected", where="NOT good", end=len(END))}
SELECT pair_id, CAST(n AS BIGINT) AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(chosen_mask, '') AS chosen_mask,
  coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask, coalesce(chosen_ok, false) AND coalesce(rejected_ok, false) AS usable
FROM prefix LEFT JOIN prompts USING (pair_id) LEFT JOIN chosen USING (pair_id) LEFT JOIN rejected USING (pair_id)"""
ORACLE_SQL = {
    "op7_preference": f"""
WITH last AS (SELECT * FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1),
raw AS (SELECT c.conv_id AS pair_id, true AS good, c.turn, c.role, c.text FROM conversations c JOIN last l USING (conv_id) WHERE c.turn <= l.turn
  UNION ALL SELECT c.conv_id, false, c.turn, c.role, c.text FROM conversations c JOIN last l USING (conv_id) WHERE c.turn < l.turn
  UNION ALL SELECT l.conv_id, false, l.turn, l.role, o.text FROM last l JOIN last o ON o.conv_id = l.conv_id + 1), {_PAIRS_SQL}""",
    "op7_preference_neighbours": f"WITH raw AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS good, turn, role, text FROM conversations WHERE conv_id IS NOT NULL), {_PAIRS_SQL}",
}
