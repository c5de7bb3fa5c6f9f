"""Preference formatting of conversation pairs (DataFrame functions only).

Chosen and rejected conversation of a pair share a prefix of turns. It is found,
rendered once as the prompt, and what follows becomes two completions, with the spans of
them on which a loss counts. Pairs of a usual size meet in one shuffle and are compared
as arrays. Pairs of very many turns or characters are never brought together: their turns stay a row
each, the prefix is found by aggregation, and the result goes on over several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LAST = 2**63 - 1
PARTS = ("prompt", "chosen", "rejected")
#: Turn numbers, and places, of a bin of the two-level running sums.
BIN = 256
#: Characters after which a part of a pair goes on in another row, and turns of a pair that are compared in one.
ROW_CHARS, ROW_TURNS = 4 << 20, 1000


def neighbours(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conversations`` with ``pair_id`` and ``side``: conversation 2n is chosen over 2n + 1."""
    c = F.col(conv_col)
    return conversations.withColumn("pair_id", F.floor(c / 2).cast("long")).withColumn(
        "side", F.when(F.pmod(c, F.lit(2)) == 0, "chosen").otherwise("rejected")
    )


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"))


def messages(turns: DataFrame, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pair_id, side, at, role, text`` without null turns, roles and texts."""
    return turns.select(
        "pair_id", "side", F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST)).alias("at"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``messages`` with ``place``: that of their turn number among those of their conversation, from 1."""
    numbers = running(rows.select("pair_id", "side", "at").distinct(), ["pair_id", "side"], ["at"], F.floor(F.col("at") / BIN), {"place": ("count", F.lit(1))})
    own = numbers.select(F.col("pair_id").alias("p"), F.col("side").alias("s"), F.col("at").alias("a"), "place")
    return rows.join(own, F.col("pair_id").eqNullSafe(F.col("p")) & (F.col("side") == F.col("s")) & (F.col("at") == F.col("a"))).drop("p", "s", "a")


def preference_segments(turns: DataFrame, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pair_id, part, place, turn, role, segment, mask_start, mask_end``, a row per turn.

    ``turns`` has ``pair_id`` and ``side`` (chosen or rejected, or anything else for it). The two sides have turns in common up to
    the first place at which they don't hold the same messages, whatever the turns'
    numbers; all of those before are ``part`` prompt and stand once, with the chosen side's numbers, the
    others are chosen or rejected. Characters ``mask_start`` to before ``mask_end`` of a
    segment count for the loss: the text and end mark of an assistant's turn in a
    completion, else none. Equal conversations are all prompt; a pair of one side is all
    completion, and so are turns without a conversation, which are one side of the null pair. Null turn
    numbers come last, null roles and texts are empty and equal to each other; messages of
    one turn number share a place, and repeated rows are messages of their own. Other columns are
    ignored, whatever their names. No rows in, no rows out.
    """
    return _segments(messages(turns, turn_col, role_col, text_col))


def _segments(rows: DataFrame) -> DataFrame:
    rows = placed(rows)
    chosen = F.col("side") == "chosen"
    message = ["pair_id", "place", "role", F.sha2("text", 256).alias("key"), F.length("text").alias("n")]
    both = rows.groupBy(*message).agg(F.count_if(chosen).alias("c"), F.count_if(~chosen).alias("r"))
    cut = both.groupBy("pair_id").agg(F.min(F.when(F.col("c") != F.col("r"), F.col("place"))).alias("cut"))
    met = rows.join(cut.withColumnRenamed("pair_id", "p"), F.col("pair_id").eqNullSafe(F.col("p")))
    common = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
    met = met.withColumn("part", F.when(common, "prompt").otherwise(F.col("side"))).filter(~common | chosen)
    counts = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    start = F.length(F.concat(F.lit(OPEN), "role", F.lit("\n")))
    return met.select(
        "pair_id", "part", "place", F.nullif(F.col("at"), F.lit(LAST)).alias("turn"), "role", render(F.col("role"), F.col("text")).alias("segment"),
        F.when(counts, start).otherwise(0).alias("mask_start"), F.when(counts, start + F.length("text") + len(CLOSE)).otherwise(0).alias("mask_end"),
    )


def preference_pairs(turns: DataFrame, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", row_chars: int = ROW_CHARS, row_turns: int = ROW_TURNS) -> DataFrame:
    """``pair_id, piece, prompt, chosen, chosen_mask, rejected, rejected_mask``: a row per pair.

    What is common is as in ``preference_segments``. Segments stand in the order of their places, those of
    one place in that of role and text. A mask is the array of spans ``start, end`` (characters, end
    excluded) of the completion beside it. A pair is one row, ``piece`` 0, unless a part has more than
    ``row_chars`` characters: its segments then go on in piece 1, 2, ..., and spans count from the
    start of their piece. Turns without a pair are one side of the null pair. No rows in, no rows out.
    """
    rows = messages(turns, turn_col, role_col, text_col)
    sizes = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.sum(F.length(render(F.col("role"), F.col("text"))).cast("long")).alias("chars"))
    large = sizes.filter((F.col("n") > row_turns) | (F.col("chars") > row_chars)).select(F.col("pair_id").alias("p"))
    same = F.col("pair_id").eqNullSafe(F.col("p"))
    return _small(rows.join(large, same, "left_anti")).unionByName(_pieces(_segments(rows.join(large, same, "left_semi")), row_chars))


def _spans(items: Column) -> Column:
    """The masked spans of segments (``segment, mask_start, mask_end``) that stand one after another."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start: int, end: int>>").alias("s"))
    return F.aggregate(items, zero, lambda a, x: F.struct(
        (a["n"] + F.length(x["segment"])).alias("n"),
        F.when(x["mask_end"] > 0, F.concat(a["s"], F.array(F.struct((a["n"] + x["mask_start"]).alias("start"), (a["n"] + x["mask_end"]).alias("end"))))).otherwise(a["s"]).alias("s"),
    ))["s"]


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["segment"]), "")


def _small(rows: DataFrame) -> DataFrame:
    """Pairs as arrays: a pair's messages meet once, and nothing is joined."""
    segment = render(F.col("role"), F.col("text"))
    own, start = F.col("role") == "assistant", F.length(F.concat(F.lit(OPEN), "role", F.lit("\n")))
    item = F.struct("at", "role", F.md5(segment).alias("key"), segment.alias("segment"), F.when(own, start).otherwise(0).alias("mask_start"), F.when(own, F.length(segment) - 1).otherwise(0).alias("mask_end"))
    chosen = F.col("side") == "chosen"
    sides = {"c": F.when(chosen, item), "r": F.when(~chosen, item)}
    pairs = rows.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(x)).alias(n) for n, x in sides.items()])  # within ROW_TURNS and ROW_CHARS
    pairs = pairs.withColumns({f"{n}_at": F.array_distinct(F.transform(n, lambda x: x["at"])) for n in sides})
    # the messages of each place, as far as they tell messages apart
    at_place = lambda n: F.transform(f"{n}_at", lambda at: F.transform(F.filter(n, lambda x: x["at"] == at), lambda x: F.struct(x["role"], x["key"])))
    equal = F.zip_with(at_place("c"), at_place("r"), lambda a, b: a == b)
    pairs = pairs.withColumn("equal", F.transform(equal, lambda e: F.coalesce(e, F.lit(False))))
    common = F.array_position("equal", False)  # from 1; 0 if no place differs
    pairs = pairs.withColumn("common", F.when(common == 0, F.size("equal")).otherwise(common - 1))
    place = lambda n, x: F.array_position(F.col(f"{n}_at"), x["at"])
    prompt = F.filter("c", lambda x: place("c", x) <= F.col("common"))
    rest = {"c": F.filter("c", lambda x: place("c", x) > F.col("common")), "r": F.filter("r", lambda x: place("r", x) > F.col("common"))}
    return pairs.select(
        "pair_id", F.lit(0).cast("long").alias("piece"), _joined(prompt).alias("prompt"), _joined(rest["c"]).alias("chosen"), _spans(rest["c"]).alias("chosen_mask"),
        _joined(rest["r"]).alias("rejected"), _spans(rest["r"]).alias("rejected_mask"),
    )


def _pieces(segments: DataFrame, row_chars: int) -> DataFrame:
    rows = segments.withColumns({"__n": F.length("segment").cast("long"), "__key": F.md5("segment")})
    order = ["place", "role", "__key"]
    rows = running(rows, ["pair_id", "part"], order, F.floor(F.col("place") / BIN), {"__end": ("sum", F.col("__n"))})
    rows = rows.withColumn("__from", F.floor((F.col("__end") - F.col("__n")) / row_chars))
    # a long segment passes over some multiples of row_chars: pieces are numbered without gaps
    numbers = running(rows.select("pair_id", "__from").distinct(), ["pair_id"], ["__from"], F.floor(F.col("__from") / BIN), {"__piece": ("count", F.lit(1))})
    numbers = numbers.select(F.col("pair_id").alias("__p"), F.col("__from").alias("__f"), (F.col("__piece") - 1).alias("piece"))
    rows = rows.join(numbers, F.col("pair_id").eqNullSafe(F.col("__p")) & (F.col("__from") == F.col("__f"))).drop("__p", "__f")
    item = F.struct("place", "role", "__key", "segment", "mask_start", "mask_end")
    own = lambda p: F.sort_array(F.collect_list(F.when(F.col("part") == p, item))).alias(p)  # noqa: E731  no more than fits a row
    out = rows.groupBy("pair_id", "piece").agg(*[own(p) for p in PARTS])
    return out.select("pair_id", "piece", _joined("prompt").alias("prompt"), _joined("chosen").alias("chosen"), _spans("chosen").alias("chosen_mask"), _joined("rejected").alias("rejected"), _spans("rejected").alias("rejected_mask"))
