"""Preference formatting of conversations, with DataFrame functions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as the prompt; the rest of each is a
completion with a mask that says which characters are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column) -> Column:
    """``start:end`` in code points of each assistant text with its end mark, comma-joined: the characters that carry loss."""
    start = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(rendered(t))).alias("at"),
            F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.concat_ws(":", (s["at"] + len(OPEN + MIDDLE) + F.length(t["role"])).cast("string"), (s["at"] + F.length(rendered(t))).cast("string"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: F.array_join(s["spans"], ","),
    )
    return start


def format_preferences(turns: DataFrame, chosen: Column, pair: Column) -> DataFrame:
    """One row per pair: ``pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, n_chosen_turns,
    n_rejected_turns, differs``.

    ``turns`` (conv_id, turn, role, text); ``pair`` numbers the pair a conversation belongs to and ``chosen`` tells its two sides apart.
    Turns are taken in the order (turn, role, text); repeated turn numbers are kept in that order, and a null turn number comes first.
    Null roles and texts count as empty. Turns of a null conversation or pair belong to no pair and are left out. A pair with one side
    only has no common prefix: its prompt is empty, and the absent side has a null id, no turns and empty text. Two like conversations
    give a prompt and empty completions; ``differs`` is false then. Further columns are ignored; an empty table gives an empty result.
    One shuffle, by pair: a pair is one row of the result, whatever else its first turn is shared with."""
    side = lambda is_chosen: F.array_sort(F.collect_list(F.when(F.col("side") == is_chosen, F.struct("turn", "role", "text"))))
    each = turns.filter(F.col("conv_id").isNotNull()).select(pair.alias("pair_id"), chosen.alias("side"), "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = each.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"), F.min(F.when(F.col("side"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("side"), F.col("conv_id"))).alias("rejected_id"))
    both = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(1), both), lambda i: (F.element_at("c", i)["role"] == F.element_at("r", i)["role"]) & (F.element_at("c", i)["text"] == F.element_at("r", i)["text"]))
    parting = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n", F.when(both == 0, F.lit(0)).when(parting == 0, both).otherwise((parting - 1).cast("int")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x), F.lit(1)))
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), joined(F.col("p")).alias("prompt"),
        joined(F.col("c")).alias("chosen"), trained_spans(F.col("c")).alias("chosen_mask"), joined(F.col("r")).alias("rejected"), trained_spans(F.col("r")).alias("rejected_mask"),
        F.size("c").alias("n_chosen_turns"), F.size("r").alias("n_rejected_turns"), ((F.size("c") > 0) | (F.size("r") > 0)).alias("differs"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """The two sides of a pair for each conversation: ``pair_id, side, conv_id, turn, role, text``.

    Chosen is the conversation itself. Rejected is the same conversation up to its last answer (the assistant's turn of the greatest number),
    with the answer that its neighbour (2k and 2k + 1 are neighbours) ends on in that place, and the neighbour's conv_id. A conversation without
    an answer is rejected unchanged; where the neighbour has none, the answer is left out. Of several answers of one turn number the greatest text counts."""
    turns = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", "role", "text")
    neighbour = F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))
    last = turns.filter((F.col("role") == "assistant") & F.col("turn").isNotNull()).groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).alias("last"))
    end, other = last.select("conv_id", F.col("last.turn").alias("end")), last.select(neighbour.alias("conv_id"), F.col("last.text").alias("text"))
    row = lambda side, conv, turn, role: [F.col("conv_id").alias("pair_id"), F.lit(side).alias("side"), conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), "text"]
    chosen = turns.select(*row(True, F.col("conv_id"), F.col("turn"), F.col("role")))
    before = turns.join(end, "conv_id", "left").filter("end is null or turn is null or turn < end").select(*row(False, neighbour, F.col("turn"), F.col("role")))
    answer = end.join(other, "conv_id").select(*row(False, neighbour, F.col("end"), F.lit("assistant")))
    return chosen.unionByName(before).unionByName(answer)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each against itself with another's last answer: their turns before it are the prompt."""
    return format_preferences(swapped_answers(table(spark, sf_dir, "conversations")), F.col("side"), F.col("pair_id"))


OP6_SQL = r"""
WITH a AS (SELECT conv_id, e, max(coalesce(text, '')) AS text FROM conversations JOIN (SELECT conv_id, max(turn) AS e FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1) USING (conv_id)
           WHERE role = 'assistant' AND turn = e GROUP BY 1, 2),
t AS (SELECT conv_id AS pair_id, true AS side, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
      UNION ALL SELECT c.conv_id, false, xor(c.conv_id, 1), turn, coalesce(role, ''), coalesce(c.text, '') FROM conversations c LEFT JOIN a USING (conv_id) WHERE c.conv_id IS NOT NULL AND (e IS NULL OR turn IS NULL OR turn < e)
      UNION ALL SELECT a.conv_id, false, o.conv_id, a.e, 'assistant', o.text FROM a JOIN a o ON o.conv_id = xor(a.conv_id, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS k,
             '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t),
parting AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(CASE WHEN c.k IS NULL OR r.k IS NULL OR c.role <> r.role OR c.text <> r.text THEN coalesce(c.k, r.k) END) AS k,
                   max(coalesce(c.k, r.k)) AS longest
            FROM (SELECT * FROM o WHERE side) c FULL JOIN (SELECT * FROM o WHERE NOT side) r ON c.pair_id = r.pair_id AND c.k = r.k GROUP BY 1),
n AS (SELECT pair_id, coalesce(k - 1, longest) AS n FROM parting),
placed AS (SELECT o.*, n.n, sum(CASE WHEN o.k > n.n THEN length(shown) ELSE 0 END) OVER (PARTITION BY o.pair_id, side ORDER BY o.k) - length(shown) AS start FROM o JOIN n USING (pair_id)),
spans AS (SELECT *, CASE WHEN k > n AND role = 'assistant' THEN CAST(start + 13 + length(role) AS VARCHAR) || ':' || CAST(start + length(shown) AS VARCHAR) END AS span FROM placed)
SELECT pair_id, min(conv_id) FILTER (side) AS chosen_id, min(conv_id) FILTER (NOT side) AS rejected_id, CAST(max(n) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side AND k <= n), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (side AND k > n), '') AS chosen, coalesce(string_agg(span, ',' ORDER BY k) FILTER (side), '') AS chosen_mask,
       coalesce(string_agg(shown, '' ORDER BY k) FILTER (NOT side AND k > n), '') AS rejected, coalesce(string_agg(span, ',' ORDER BY k) FILTER (NOT side), '') AS rejected_mask,
       CAST(count(*) FILTER (side AND k > n) AS INTEGER) AS n_chosen_turns, CAST(count(*) FILTER (NOT side AND k > n) AS INTEGER) AS n_rejected_turns,
       count(*) FILTER (k > n) > 0 AS differs
FROM spans GROUP BY pair_id
"""
