"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Equal lines are one text. Two texts are linked if they are within `distance` edits (of characters).

A text has distance + 1 segments that don't overlap; the edits leave one of them whole. Texts of a few neighbouring lengths
have segments of one size, the first ones placed from the start and the others from the end, so one key stands for all of
these lengths. Segments are indexed by lengths, number and content; a text probes, for its own lengths and those below that
are within `distance`, the substrings that the position and the edits left allow. Keys that stand once are left out before
letters are counted, so that only texts with a shared key have theirs counted. A pair that shares a segment and is close in
length is a candidate unless its counts of letters differ more than the edits can change. Candidates are verified by a
banded bit-parallel edit distance: for each number of edits, one bit for each diagonal of the band, moved on by one
character of the text at a time. What both texts begin or end with is compared in long runs and takes no part in it.

A line goes if its text, or one within the distance, stands earlier (by doc_id, then line). So the first of a group stays.

Edge cases. A null text has no lines; blank lines stay and are not compared. Texts of `distance` characters or fewer are
compared for equality only: that many edits turn any of them into any other. Rows that agree in doc_id and text count as
one and get the same result; a null doc_id comes before all others. Lines of any length are compared whole. Empty tables
give no rows. Extra columns pass through; `n_lines`, `n_removed` and `n_links` of an input are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.shared import release, stored, written


def lengths_of(length: Column) -> Column:
    """The smallest of the lengths whose texts have segments of one size."""
    return F.when(length < 32, length).when(length < 64, length.bitwiseAND(-4)).otherwise(length.bitwiseAND(-8))


def shifts(number: int, less: int, distance: int) -> list[int]:
    """How far a segment of a text may stand from its place in a text that is longer by `less` to `distance`.

    Before the first segment that is whole with all in front of it there are at most as many edits as segments. Segments
    of the second half are placed from the end. Of two texts of one length that two edits set apart, either's middle
    segment stands where it was, or one of them has the other's further on: so it is not looked for before its place.
    """
    found = set()
    for more in range(less, distance + 1):
        for shift in range(max(-number, more - (distance - number)), min(number, more + (distance - number)) + 1):
            if more or shift >= 0 or distance > 2:
                found.add(shift if 2 * number <= distance else shift - more)
    return sorted(found)


def keyed(texts: DataFrame, distance: int, index: bool) -> DataFrame:
    """h of every text with a key for each of its segments (index) or for each substring that may equal a segment; own: it is a segment of the text itself."""
    kinds = [(less, i, shift) for less in range(1 if index else distance + 1) for i in range(distance + 1) for shift in ([0] if index else shifts(i, less, distance))]
    kind = F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("number"), F.lit(shift).alias("shift")) for less, i, shift in kinds))
    length, less, number = F.col("length"), F.col("less"), F.col("number")
    rows = texts.select("h", "line", "length", F.inline(kind))
    lengths = lengths_of(length - less)
    # lengths that have their keys from a text nearer in length need no more
    rows = rows.where((less == 0) | ((length - less > distance) & (lengths != lengths_of(length - less + 1))))
    size = F.expr(f"lengths div {distance + 1}").cast("int")
    start = F.when(2 * number <= distance, number * size).otherwise(length - (distance + 1 - number) * size)
    rows = rows.withColumn("lengths", lengths)
    own = (less == 0) & (F.col("shift") == 0)
    return rows.select("h", F.xxhash64("lengths", "number", F.substr("line", start + F.col("shift") + 1, size)).alias("key"), own.alias("own"))


def holds_text(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\n\x0b\f\r")) != ""


def line_rows(docs: DataFrame) -> DataFrame:
    """did, version (of the text), pos, line, and two independent hashes h and g for every line that isn't blank."""
    rows = docs.select(doc_key().alias("did"), F.xxhash64("text").alias("version"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    return rows.where(holds_text(F.col("line"))).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def firsts_of(lines: DataFrame) -> DataFrame:
    """h, g, first (its first place) and copies of every distinct line."""
    return lines.groupBy("h", "g").agg(F.min(F.struct("did", "version", "pos")).alias("first"), F.count("*").alias("copies"))


#: Letters that are counted.
COUNTED = "abcdefhiklmnopru"


def letters(text: Column) -> Column:
    """Counts of sixteen letters modulo 16, in one number."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(COUNTED):
        count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(15).cast("long"), 4 * k))
    return out


def may_be_close(a: Column, b: Column, distance: int) -> Column:
    """Whether counts of letters leave it open that two texts are within so many edits; an edit changes two counts by one."""
    # counts modulo 16 are at most as far apart on the circle as the counts themselves
    turned = lambda k: (F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15)).bitwiseAND(15)
    apart = [F.least(turned(k), 16 - turned(k)) for k in range(len(COUNTED))]
    return sum(apart[1:], apart[0]) <= 2 * distance


#: Lengths of runs that are compared whole, the longest first.
RUNS = [2**k for k in range(20, 2, -1)]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, wherever the expression ends up."""
    return F.get(F.transform(F.array(value), use), 0)


def same_run(a: Column, b: Column, room: Column, front: bool) -> Column:
    """How many characters, of `room` at most, two texts have in common in front, or at the end; the rest that is less than the shortest of RUNS is left."""
    part = lambda text, done, size: F.substr(text, done + 1, size) if front else F.substr(text, F.length(text) - done - size + 1, size)
    longer = lambda done, size: F.when((done + size <= room) & (part(a, done, size) == part(b, done, size)), done + size).otherwise(done)
    return F.aggregate(F.array(*map(F.lit, RUNS)), F.lit(0), longer)


def within(a: Column, b: Column, distance: int) -> Column:
    """The edit distance of two texts if it is at most `distance`, else null.

    Bit delta + distance of the mask of level e says that the first j + delta characters of a and the first j of b are
    within e edits. A character of b keeps the diagonals where it equals a's; of the level below, its mask (another
    character), its mask one diagonal down (a character more in b) and its own new mask one up (one more in a) join.
    """
    width = 2 * distance + 1
    full = 2**width - 1
    # in front of a and behind it as many blanks as the band is wide to either side: none equals a character of b
    none = F.array_repeat(F.lit(""), distance)
    chars = lambda text: F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    start = F.struct(*(F.lit((2 ** (e + 1) - 1) << distance & full).alias(f"r{e}") for e in range(distance + 1)))

    def equals(chars: Column, c: Column, j: Column) -> Column:
        """The diagonals on which the j-th character of b, c, meets an equal one of a."""
        return sum((F.when(F.get(chars, j + k) == c, 1 << k).otherwise(0) for k in range(1, width)), F.when(F.get(chars, j) == c, 1).otherwise(0))

    def step(state: Column, equal: Column) -> Column:
        masks: list[Column] = [state["r0"].bitwiseAND(equal)]
        for e in range(1, distance + 1):
            below = state[f"r{e - 1}"]
            mask = state[f"r{e}"].bitwiseAND(equal).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(masks[-1], 1))
            masks.append(mask.bitwiseAND(F.lit(full)))
        return F.struct(*(m.alias(f"r{e}") for e, m in enumerate(masks)))

    apart = F.length(a) - F.length(b)

    def told(state: Column) -> Column:
        out = F.lit(None).cast("int")
        for e in range(distance, -1, -1):
            out = F.when(F.get(F.array(*(F.lit(1 << k) for k in range(width))), apart + distance).bitwiseAND(state[f"r{e}"]) > 0, e).otherwise(out)
        return out

    def run(before: Column, behind: Column) -> Column:
        middle = lambda text: F.substr(text, before + 1, F.length(text) - before - behind)
        long, own = F.concat(none, chars(middle(a)), none), chars(middle(b))
        return bound(long, lambda held: F.aggregate(F.transform(own, lambda c, j: equals(held, c, j)), start, step, told))

    # what both begin and end with takes no edits
    room = F.least(F.length(a), F.length(b))
    runs = bound(same_run(a, b, room, True), lambda before: bound(same_run(a, b, room - before, False), lambda behind: run(before, behind)))
    return F.when(F.abs(apart) <= distance, runs)


def line_links(docs: DataFrame, distance: int = 2) -> DataFrame:
    """a, b, first_a, first_b and edits for each pair of different texts within the distance, once. a and b: h and g of a text."""
    return links_of(docs, firsts_of(line_rows(docs)), distance)


def links_of(docs: DataFrame, firsts: DataFrame, distance: int) -> DataFrame:
    """line_links() with the first places at hand.

    The distinct texts are written once, as they are read for their keys and for verification.
    """
    texts = written(line_rows(docs).select("h", "g", "line").distinct().withColumn("length", F.length("line")).where(F.col("length") > distance))
    # what a text looks up includes its own segments, so the index needs no keys besides
    shared = written(keyed(texts, distance, index=False).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n"))
    met = texts.join(shared.select("h").distinct(), "h").withColumn("letters", letters(F.col("line"))).checkpoint()
    release(docs.sparkSession)
    keys = shared.join(met.select("h", "length", "letters"), "h")
    index = keys.where("own").select("key", *(F.col(c).alias(f"{c}_a") for c in ("h", "length", "letters")))
    probe = keys.select("key", *(F.col(c).alias(f"{c}_b") for c in ("h", "length", "letters")))
    close = (F.col("h_a") != F.col("h_b")) & F.col("length_b").between(F.col("length_a"), F.col("length_a") + distance)
    close &= may_be_close(F.col("letters_a"), F.col("letters_b"), distance)
    pairs = index.join(probe, "key").where(close).select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct().checkpoint()
    release(docs.sparkSession)
    side = lambda name: met.select(F.col("h").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("g", "line")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("edits", within(F.col("line_a"), F.col("line_b"), distance)).where("edits IS NOT NULL")
    links = both.select(F.struct(F.col("a").alias("h"), F.col("g_a").alias("g")).alias("a"), F.struct(F.col("b").alias("h"), F.col("g_b").alias("g")).alias("b"), "edits").checkpoint()
    ends = links.select("a.*").unionAll(links.select("b.*")).distinct()
    first = ends.join(firsts, ["h", "g"]).select(F.struct("h", "g").alias("end"), "first").checkpoint()
    place = lambda name: first.select(F.col("end").alias(name), F.col("first").alias(f"first_{name}"))
    return links.join(place("a"), "a").join(place("b"), "b").select("a", "b", "first_a", "first_b", "edits")


def dedup_lines(docs: DataFrame, distance: int = 2) -> DataFrame:
    """All columns, `text` without the lines that go, n_lines (not blank), n_removed and n_links (of the document's lines to other texts)."""
    docs = docs.drop("n_lines", "n_removed", "n_links")
    lines = stored(line_rows(docs).select("did", "version", "pos", "h", "g"))
    firsts = stored(firsts_of(lines))
    links = links_of(docs, firsts, distance).checkpoint()
    release(docs.sparkSession)
    ends = links.select("a.*", (F.col("first_b") < F.col("first_a")).alias("goes")).unionAll(links.select("b.*", (F.col("first_a") < F.col("first_b")).alias("goes")))
    ends = ends.groupBy("h", "g").agg(F.max("goes").alias("goes"), F.count("*").alias("links"))
    # texts that stand once and have no links decide nothing
    told = stored(firsts.join(ends, ["h", "g"], "left").where("copies > 1 OR links > 0"))
    marked = lines.join(told, ["h", "g"]).withColumn("out", F.coalesce("goes", F.lit(False)) | (F.struct("did", "version", "pos") != F.col("first")))
    # a set, as a repeated row has the same lines again
    told_lines = F.collect_set(F.struct("pos", "out", F.coalesce("links", F.lit(0)).alias("links")))
    removed = marked.groupBy("did", "version").agg(told_lines.alias("told"))
    removed = removed.select(
        "did", "version", F.transform(F.filter("told", lambda x: x["out"]), lambda x: x["pos"]).alias("removed"), F.aggregate("told", F.lit(0).cast("long"), lambda n, x: n + x["links"]).alias("n_links")
    ).checkpoint()
    release(docs.sparkSession)
    names = docs.columns
    keyed = docs.withColumns({"did ": doc_key(), "version ": F.xxhash64("text")}).join(removed.select(F.col("did").alias("did "), F.col("version").alias("version "), F.col("removed").alias("removed "), F.col("n_links").alias("links ")), ["did ", "version "], "left")
    keyed = keyed.withColumns({"parts ": F.split(F.col("text").cast("string"), "\n"), "removed ": F.coalesce("removed ", F.array().cast("array<int>"))})
    left_of = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed "))
    # a caller's condition on the text brings the split along: bound, a text is not split anew for each of its lines
    kept = bound(F.col("parts "), lambda parts: F.array_join(F.transform(left_of(parts), lambda i: F.get(parts, i)), "\n"))
    text = F.when(F.size("removed ") == 0, F.col("text")).otherwise(kept)
    return keyed.select(
        *(text.alias("text") if n == "text" else F.col(n) for n in names), F.coalesce(F.size(F.filter("parts ", holds_text)), F.lit(0)).cast("long").alias("n_lines"), F.size("removed ").cast("long").alias("n_removed"), F.coalesce(F.col("links "), F.lit(0)).cast("long").alias("n_links")
    )


def keep_fresh(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents with their columns, without repeated lines; a document of which nothing is left goes."""
    out = dedup_lines(docs, distance)
    return out.where(~((F.col("n_removed") > 0) & ~holds_text(F.col("text")))).select(docs.columns)
