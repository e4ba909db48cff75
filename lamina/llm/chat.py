"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut each conversation into turn-aligned spans. A window holds the system turn, a limited
repeat of the turns before its span, and as many turns as its budget has room for after these; only assistant turns of
the span are under the loss mask, so each target is learned once. DataFrame functions only.

Format of a window: `<s>`, then per turn `<|role|>text</s>`. In roles and texts each of `<` `[` `|` `\\` is followed by
an added `\\`, so no control string of this or the common bracketed templates survives inside them, and removing the
character after each of the four restores the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 128
SEGMENT = 8192  # tokens of a conversation that are cut together; windows and history don't cross its ends


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[|\\])\\", "$1")


def turn_tokens(line: Column) -> Column:
    """An estimate for a turn as it is formatted, marks and escapes included: a token for every four characters begun."""
    return F.floor((F.char_length(line) + 3) / 4).cast("long")


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """conv_id, window (the place of its first learned turn, from 1), formatted, n_repeated (leading turns that an earlier window learned or the system turn), n_tokens, mask (array of start, length in characters).

    A window takes turns while its tokens stay within the budget: one for `<s>`, the system turn's, those of the repeated
    history and of its span. It goes beyond only where one turn with the system turn alone does; turns are never cut, and
    such a turn is a window by itself, without history. History is the longest run of turns before the span of no more
    than `history` tokens, left out where the span's first turn wouldn't fit beside it. The first turn is retained in
    every window if its role is `system`. A conversation is cut in segments of about `segment` tokens, so that no more
    than that is ever gathered (a longer turn aside). Null role and text count as empty; rows are ordered by turn (null
    first), role, text, so ties and repeated rows have one order; rows of null conv_id form one conversation; no turns
    give no windows. Further columns are ignored.
    """
    line = F.concat(F.lit("<|"), escape(F.coalesce("role", F.lit(""))), F.lit("|>"), escape(F.coalesce("text", F.lit(""))), F.lit("</s>"))
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), line.alias("line"))
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    system = F.when(F.col("role") == "system", F.struct("line", "tokens"))
    placed = (
        clean.withColumn("tokens", turn_tokens(F.col("line")))
        .withColumn("i", F.row_number().over(by))
        .withColumn("before", F.sum("tokens").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens"))
        .select(
            "conv_id", "i", "before", "tokens", F.floor(F.col("before") / segment).alias("segment"), (F.col("role") == "assistant").alias("target"), "line",
            (F.char_length(escape(F.col("role"))) + 4).alias("head"), F.first(system).over(by.rowsBetween(W.unboundedPreceding, 0)).alias("system"),
        )
    )
    # The prefix sums are already dealt by conversation, so segments are gathered where they are.
    parts = placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("i", "before", "tokens", "line", "target", "head"))).alias("turns"), F.first("system").alias("system"))
    parts = parts.withColumn("numbers", F.transform("turns", lambda x: F.struct(x["i"].alias("i"), x["before"].alias("before"), x["tokens"].alias("tokens"))))

    def cut(acc: Column, t: Column) -> Column:
        past = F.filter("numbers", lambda x: (x["i"] < t["i"]) & (x["before"] >= t["before"] - history) & ((x["i"] > 1) | F.col("system").isNull()))
        back = F.when(F.size(past) > 0, t["before"] - F.get(past, F.lit(0))["before"]).otherwise(F.lit(0).cast("long"))
        alone = F.lit(1) + t["tokens"] + F.when(t["i"] > 1, F.coalesce("system.tokens", F.lit(0))).otherwise(F.lit(0))
        beside = alone + back <= budget
        first = F.struct(t["i"].alias("i"), F.when(beside, F.size(past)).otherwise(F.lit(0)).alias("past"))
        used, fits = F.when(beside, alone + back).otherwise(alone), (F.size(acc["cuts"]) > 0) & (acc["used"] + t["tokens"] <= budget)
        tokens = F.when(fits, acc["used"] + t["tokens"]).otherwise(used)
        cuts = F.when(fits, F.concat(F.slice(acc["cuts"], 1, F.size(acc["cuts"]) - 1), F.array(F.struct(F.element_at(acc["cuts"], -1)["i"].alias("i"), F.element_at(acc["cuts"], -1)["past"].alias("past"), tokens.alias("tokens")))))
        cuts = cuts.otherwise(F.concat(acc["cuts"], F.array(F.struct(first["i"].alias("i"), first["past"].alias("past"), tokens.alias("tokens")))))
        return F.struct(tokens.alias("used"), cuts.alias("cuts"))

    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<i:int,past:int,tokens:bigint>>").alias("cuts"))
    spans = parts.withColumn("cuts", F.aggregate("numbers", none, cut, lambda a: a["cuts"])).select("conv_id", "turns", "system", "cuts", F.posexplode("cuts").alias("k", "cut"))
    start = F.col("cut.i") - F.get("turns", F.lit(0))["i"] + 1
    stop = F.coalesce(F.get("cuts", F.col("k") + 1)["i"], F.element_at("turns", -1)["i"] + 1)
    past = F.transform(F.slice("turns", start - F.col("cut.past"), F.col("cut.past")), lambda x: x["line"])
    lead = F.concat(F.when(F.col("system").isNotNull() & (F.col("cut.i") > 1), F.array("system.line")).otherwise(F.array().cast("array<string>")), past)
    begin = spans.select("conv_id", "cut", lead.alias("lead"), F.slice("turns", start, stop - F.col("cut.i")).alias("turns")).withColumn("opening", F.concat(F.lit("<s>"), F.array_join("lead", "")))
    zero = F.struct(F.char_length("opening").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask"))

    def place(acc: Column, t: Column) -> Column:
        size, head = F.char_length(t["line"]).cast("long"), t["head"].cast("long")
        span = F.struct((acc["at"] + head).alias("start"), (size - head - 4).alias("length"))
        return F.struct((acc["at"] + size).alias("at"), F.when(t["target"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    return begin.select(
        "conv_id", F.col("cut.i").alias("window"), F.concat("opening", F.array_join(F.transform("turns", lambda t: t["line"]), "")).alias("formatted"),
        F.size("lead").alias("n_repeated"), F.col("cut.tokens").alias("n_tokens"), F.aggregate("turns", zero, place, lambda a: a["mask"]).alias("mask"),
    )


def parse_window(formatted: Column) -> Column:
    """The turns of a window as array of (role, text), unescaped."""
    parts = F.split(F.substring(formatted, F.lit(4), F.char_length(formatted) - 7), "</s>", -1)
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>", 1)).alias("role"), unescape(F.regexp_extract(p, r"(?s)^<\|.*?\|>(.*)$", 1)).alias("text")
    ))


def digest(windows: DataFrame) -> DataFrame:
    """What the formatted windows of each conversation say, read back from them alone. One row per conversation."""
    read = windows.select(
        "conv_id", "window", F.char_length("formatted").cast("long").alias("chars"),
        F.slice(parse_window(F.col("formatted")), F.col("n_repeated") + 1, F.lit(2**31 - 1)).alias("turns"),
        F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "").alias("loss"),
    ).select(
        "conv_id", "window", "chars", "loss", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w")
    )
    said, loss = F.array_join(F.transform("w", lambda x: x["said"]), ""), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"
    )
