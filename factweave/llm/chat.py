"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are cut into spans of whole turns whose tokens fit a budget, by prefix sums of turn tokens. Each
window repeats the system turn and as many of the turns before its span as a history budget allows, then holds the span.
The loss mask covers the assistant texts of the span, so no target counts twice.

Control strings inside texts are escaped: one backslash is put (or one more, if there are some) after their first
character. Taking one away again gives the text back. Role names are percent-encoded.

Edge cases. A null text or role is empty; a conversation whose conv_id is null is a conversation. Turns are ordered by
turn, then role, then text, so repeated rows stay side by side and stay. A turn over the budget has a window to itself.
Empty tables give no rows. Extra columns are ignored. A window is one row; of a conversation only a few numbers for each
turn come together. Only read_back() puts the texts of a conversation side by side, for its digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: What follows the first character of a control string.
REST = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
#: More than an array holds.
MANY = 10**9
#: Tokens counted for the marks of a turn.
MARK_TOKENS = 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){REST}", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){REST}", "$1$2")


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """A row for each window: conv_id, window_no, repeated (turns that stand in an earlier window), n_tokens, formatted, and
    loss (start, from 1, and length in code points of each masked text of `formatted`).

    budget bounds the tokens of system turn, history and span together; a span gets what the other two may leave.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARK_TOKENS).withColumn("head", F.concat(F.lit(START), F.url_encode("role"), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n"))).drop("text")
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("pos", F.row_number().over(by_turn) - 1).withColumn("tokens_before", F.sum("tokens").over(by_turn) - F.col("tokens"))
    # history: turns before this one, from the last one back, as long as their tokens fit
    rows = rows.withColumn("back", F.count("*").over(Window.partitionBy("conv_id").orderBy("tokens_before").rangeBetween(-history, -1)).cast("int"))
    turns = rows.select("conv_id", "pos", "role", "tokens", "tokens_before", "back", F.length("head").alias("head"), F.length("body").alias("size"), "piece")
    # what places the spans are a few numbers for each turn, without its text
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tokens", "tokens_before", "back"))).alias("turns"), F.max((F.col("role") == "system") & (F.col("pos") == 0)).cast("int").alias("system"))
    # the first turn of each span: a turn that doesn't fit any more begins the next one
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("back"))
    first = F.struct(F.array(begin).alias("starts"), F.lit(0).cast("long").alias("from_tokens"), F.lit(budget).cast("long").alias("room"))
    room = F.lit(budget).cast("long") - F.lit(history) - F.when(F.col("system") == 1, F.col("turns")[0]["tokens"]).otherwise(F.lit(0))

    def place(state: Column, turn: Column) -> Column:
        fits = (turn["tokens_before"] == state["from_tokens"]) | (turn["tokens_before"] + turn["tokens"] - state["from_tokens"] <= state["room"])
        return F.struct(
            F.when(fits, state["starts"]).otherwise(F.array_append(state["starts"], F.struct(turn["pos"].alias("start"), turn["back"].alias("back")))).alias("starts"),
            F.when(fits, state["from_tokens"]).otherwise(turn["tokens_before"]).alias("from_tokens"), F.when(fits, state["room"]).otherwise(room).alias("room"),
        )

    convs = convs.select("conv_id", "system", F.size("turns").alias("n"), F.aggregate("turns", first, place, lambda state: state["starts"]).alias("starts"))
    stops = F.concat(F.transform(F.slice("starts", F.lit(2), F.size("starts")), lambda s: s["start"]), F.array("n"))
    spans = convs.select("conv_id", "system", F.posexplode(F.zip_with("starts", stops, lambda s, stop: F.struct(s["start"].alias("start"), s["back"].alias("back"), stop.alias("stop")))).alias("window_no", "span"))
    start, later = F.col("span")["start"], F.col("window_no") > 0
    lead = F.when(later & (F.col("system") == 1), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    past = F.when(later, F.least(F.col("span")["back"], start - F.col("system"))).otherwise(0)
    wanted = spans.select(F.col("conv_id").alias("of"), "window_no", start.alias("start"), F.explode(F.concat(lead, F.sequence(start - past, F.col("span")["stop"] - 1))).alias("at"))
    met = wanted.join(turns, F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("pos"))).withColumn("fresh", F.col("pos") >= F.col("start"))
    whole = met.groupBy("conv_id", "window_no").agg(F.sort_array(F.collect_list(F.struct("pos", "fresh", "role", "head", "size", "piece"))).alias("parts"), F.sum("tokens").alias("n_tokens"), F.sum(F.when(F.col("fresh"), 0).otherwise(1)).cast("int").alias("repeated"))
    placed = F.transform("parts", lambda t, i: F.struct(t.alias("turn"), F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["piece"])).alias("before")))
    masked = F.transform(F.filter(placed, lambda x: x["turn"]["fresh"] & (x["turn"]["role"] == "assistant")), lambda x: F.struct((x["before"] + x["turn"]["head"] + 1).alias("start"), x["turn"]["size"].alias("length")))
    return whole.select("conv_id", "window_no", "repeated", "n_tokens", F.array_join(F.transform("parts", lambda t: t["piece"]), "").alias("formatted"), masked.alias("loss"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted window."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, MANY)

    def turn(part: Column) -> Column:
        break_at = F.instr(part, "\n")
        return F.struct(F.url_decode(F.substring(part, F.lit(1), break_at - 1)).alias("role"), unescaped(F.substring(part, break_at + 1, F.length(part) - break_at - len(END) - 1)).alias("text"))

    return F.transform(parts, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows, all from the windows."""
    fresh = turns_of(F.col("formatted"))
    fresh = F.slice(fresh, F.col("repeated") + 1, MANY)
    targets = F.transform("loss", lambda m: unescaped(F.substring("formatted", m["start"], m["length"])))
    rows = formatted.select("conv_id", "window_no", fresh.alias("turns"), F.array_join(targets, "").alias("target"), F.length("formatted").cast("long").alias("chars"))
    rows = rows.withColumn("n", F.size("turns").cast("long")).withColumn("turns", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window_no", "turns", "target"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("target")).cast("long").alias("loss_chars"), F.sha2(joined("target"), 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def with_escape_case(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold control strings."""
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
