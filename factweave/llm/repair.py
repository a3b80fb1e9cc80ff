"""Repair of damaged conversations: cheapest edits that make roles alternate, by Viterbi over chunks that converge.

A conversation's rows, in order, are edited (kept, given another role, deleted, or preceded by an inserted empty turn) until the
initials of their roles read `(s?(ua)+)?`. Four states follow that pattern; costs run backward: what the rest of a conversation
costs from each state. Conversations are cut into chunks of CHUNK rows. The last chunk of each starts from the costs of an
end, any other one from a speculative vector of zeros. Costs of a chunk for another vector at its end differ, after few rows,
by a constant only, and a constant changes no choice. So fix-up passes give each chunk the vector that the chunk after it has
come to, and run it again only until both runs differ by a constant; passes end when no vector moves. With the stitched costs
each chunk knows where it leads from each of the four states; the states at the borders follow, and every chunk traces its
edits from its own, taking the ASCII-least letter among the cheapest at each step.

No task holds a conversation: rows get places by ranges (ordered.places), chunks are groups of at most CHUNK + 1 rows, and
what meets for a conversation is four numbers for each chunk, its audit (a letter for each edit, which the result holds as one
text), and its repaired texts as a stream for the digest.

Damage, so that repair has work: by crc32(conv_id:turn) modulo 20, 0 drops a row, 1 empties its text, 2 removes `.!?` from it,
3 doubles it, 4 sets its role to user.

Edge cases. A null role, text, conv_id or turn counts as one space where texts are meant (so a null text is blank, and a null
role can't be kept); null turns come first and leave gaps alone; a null conv_id is a conversation. Rows of one turn are ordered
by role, then by the name of role and text. Repeated rows are duplicates. A role whose initial is none of s, u and a, or which is
empty, can't be kept. Conversations of which nothing is left have zeros, no audit and the digest of the empty text. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.ordered import digests, places, turn_name
from factweave.llm.shared import stored

#: Rows of a chunk.
CHUNK = 1024
SPACES = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. Where keeping an initial leads from each (None: it can't be kept).
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
#: Where a new user or assistant turn leads from each state.
NEXT = (2, 2, 3, 2)
#: Costs of the rest at the end of a conversation: nothing and an assistant may end it, else turns are inserted.
END = (0, 2 * INSERT, INSERT, 0)
UNKNOWN = (0, 0, 0, 0)
#: Place of what is inserted after the last row.
AFTER_ALL = 2**62

Vector = tuple[int, int, int, int]
#: For a row's letter: the initial of its role (x: any other), and whether it is whole, truncated, or must go.
LETTERS = {chr(97 + 4 * fault + k): (initial, fault) for fault in range(3) for k, initial in enumerate("suax")}


def steps(letter: str) -> list[tuple[str, int, tuple[int | None, ...]]]:
    """The edits that take a row away, cheapest letter first by ASCII: letter, cost, and where they lead from each state."""
    initial, fault = LETTERS[letter]
    out = [("D", DELETE, (0, 1, 2, 3))]
    if fault < 2:
        out += [("K", TRUNCATED * fault, KEEP[initial]), ("R", REROLE + TRUNCATED * fault, NEXT)]
    return out


STEPS = {letter: steps(letter) for letter in LETTERS}


def before(letter: str, rest: Vector) -> Vector:
    """Costs before a row, from those after it."""
    a, b, c, d = (min(cost + rest[to[state]] for _, cost, to in STEPS[letter] if to[state] is not None) for state in range(4))
    c, d = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + c), min(b, INSERT + c), c, d


def level(vector: Vector) -> Vector:
    """The vector without its constant."""
    least = min(vector)
    return tuple(x - least for x in vector)


def costs(letters: str, rest: Vector) -> list[Vector]:
    """Costs before each row of a chunk, and at its end."""
    out = [tuple(rest)]
    for letter in reversed(letters):
        out.append(before(letter, out[-1]))
    return out[::-1]


def rerun(letters: str, old: Vector, new: Vector, old_start: Vector) -> Vector:
    """Costs at the start of a chunk from those at its end, `new`; those from `old` are known. Both go back together until they
    differ by a constant only; then the known ones hold up to that."""
    for letter in reversed(letters):
        if level(old) == level(new):
            return level(old_start)
        old, new = before(letter, old), before(letter, new)
    return level(new)


def trace(letters: str, known: list[Vector], state: int, last: bool) -> tuple[str, list[str], str, int, int]:
    """Audit, edit of each row (what is inserted before it as u and a, then D, K, U or A), what is inserted after the last row,
    cost and the state at the end."""
    audit, edits, cost = [], [], 0

    def inserted(state: int) -> int:
        audit.append("I")
        lead.append(".sua"[NEXT[state]])
        return NEXT[state]

    for k, letter in enumerate(letters):
        lead: list[str] = []
        while True:
            delete, *others = STEPS[letter]
            if delete[1] + known[k + 1][state] == known[k][state]:
                step = delete
            elif INSERT + known[k][NEXT[state]] == known[k][state]:
                state, cost = inserted(state), cost + INSERT
                continue
            else:
                step = next(s for s in others if s[2][state] is not None and s[1] + known[k + 1][s[2][state]] == known[k][state])
            break
        state, cost = step[2][state], cost + step[1]
        audit.append(step[0])
        edits.append("".join(lead) + (step[0] if step[0] != "R" else ".SUA"[state]))
    lead = []
    while last and known[-1][state] > 0:
        state, cost = inserted(state), cost + INSERT
    return "".join(audit), edits, "".join(lead), cost, state


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after damage."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text")
    )
    fate = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "utf-8")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("fate", fate).where("fate <> 0").withColumn("text", text).withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fate", "copy")


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, pos, name, letter and fault (blank, duplicate, truncated or null) of every row."""
    tail = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    own = F.when(tail == "", "blank").when(tail.isin(".", "!", "?"), "none").otherwise("truncated")
    narrow = rows.select("conv_id", "turn", "role", turn_name(F.col("role"), F.col("text")).alias("name"), own.alias("fault"))
    placed = places(narrow, "conv_id", ["turn", "role", "name"])
    # the first row of each role and text, joined by its place, of which there is one
    first = placed.groupBy(F.col("conv_id").alias("of"), "name").agg(F.min("pos").alias("at")).select("of", "at", F.lit(True).alias("first"))
    placed = placed.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at")), "left")
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("first").isNull(), "duplicate").when(F.col("fault") == "truncated", "truncated")
    placed = placed.select("conv_id", "turn", "pos", "name", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    number = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    worst = F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)
    return placed.select("conv_id", "turn", "pos", "name", "fault", F.char(F.lit(97) + number + worst).alias("letter"))


def chunks_of(rows: DataFrame, size: int) -> DataFrame:
    """conv_id, chunk, letters, follow (the letter of the row after the chunk, or empty) and names (of its rows)."""
    own = F.floor(F.col("pos") / size)
    at = F.when((F.col("pos") % size == 0) & (F.col("pos") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    rows = rows.withColumn("chunk", F.explode(at)).groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "letter", "name"))).alias("rows"))
    letters = F.array_join(F.transform("rows", lambda r: r["letter"]), "")
    names = F.transform(F.slice("rows", 1, size), lambda r: r["name"])
    return rows.select("conv_id", "chunk", F.substring(letters, 1, size).alias("letters"), F.substring(letters, size + 1, 1).alias("follow"), names.alias("names"))


def first_guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [UNKNOWN if follow else END for follow in batch.column("follow").to_pylist()]
        start = [level(costs(letters, v)[0]) for letters, v in zip(batch.column("letters").to_pylist(), rest, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rest, pa.list_(pa.int64())), pa.array(start, pa.list_(pa.int64()))], [*batch.schema.names, "rest", "start"])


def fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest, start, moved = [], [], []
        for letters, old, known, new in zip(*(batch.column(c).to_pylist() for c in ("letters", "rest", "start", "wanted")), strict=True):
            again = known if new is None or new == old else list(rerun(letters, tuple(old), tuple(new), tuple(known)))
            rest.append(old if new is None else new)
            start.append(again)
            moved.append(again != known)
        kind = pa.list_(pa.int64())
        same = ["conv_id", "chunk", "letters", "follow"]
        new_columns = [pa.array(rest, kind), pa.array(start, kind), pa.array(moved, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), *new_columns], [*same, "rest", "start", "moved"])


def led_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        to = []
        for letters, rest in zip(batch.column("letters").to_pylist(), batch.column("rest").to_pylist(), strict=True):
            known = costs(letters, tuple(rest))
            to.append([trace(letters, known, state, False)[-1] for state in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(to, pa.list_(pa.int64()))], ["conv_id", "chunk", "to"])


def border_states(chunks: pa.Table) -> pa.Table:
    """The state at the start of each chunk of a conversation."""
    chunks = chunks.sort_by("chunk")
    states = [0]
    for to in chunks.column("to").to_pylist():
        states.append(to[states[-1]])
    return chunks.select(["conv_id", "chunk"]).append_column("state", pa.array(states[:-1], pa.int64()))


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for letters, follow, rest, state in zip(*(batch.column(c).to_pylist() for c in ("letters", "follow", "rest", "state")), strict=True):
            audit, edits, tail, cost, _ = trace(letters, costs(letters, tuple(rest)), state, not follow)
            out.append((audit, edits, tail, cost, illegal_pairs("".join(LETTERS[x][0] for x in letters + follow))))
        kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), *columns], ["conv_id", "chunk", "audit", "edits", "tail", "cost", "illegal"])


def same_chunk(other: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col(f"{other}.conv_id_")) & (F.col("chunk") == F.col(f"{other}.chunk_"))


def renamed(frame: DataFrame, alias: str) -> DataFrame:
    return frame.withColumnsRenamed({"conv_id": "conv_id_", "chunk": "chunk_"}).alias(alias)


def converged(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, letters, follow, rest (costs at the end of each chunk, up to a constant) and start."""
    columns = "conv_id long, chunk long, letters string, follow string, rest array<long>, start array<long>"
    now = stored(chunks.select("conv_id", "chunk", "letters", "follow").mapInArrow(first_guess, columns))
    while True:
        after = renamed(now.where("chunk > 0").select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("wanted")), "after")
        met = now.join(after, same_chunk("after"), "left").select("conv_id", "chunk", "letters", "follow", "rest", "start", "wanted")
        fixed = stored(met.mapInArrow(fix_up, columns + ", moved boolean"))
        now = fixed.drop("moved")
        if fixed.where("moved").isEmpty():
            return now


def edited(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, audit, edits, tail, cost and illegal (pairs of rows) of each chunk."""
    several = (F.col("chunk") > 0) | (F.col("follow") != "")
    at_end = F.array(*map(F.lit, END)).cast("array<long>")
    plain = chunks.where(~several).select("conv_id", "chunk", "letters", "follow", at_end.alias("rest"), F.lit(0).cast("long").alias("state"))
    stitched = converged(chunks.where(several))
    ways = stitched.mapInArrow(led_to, "conv_id long, chunk long, to array<long>")
    states = renamed(ways.groupBy("conv_id").applyInArrow(border_states, "conv_id long, chunk long, state long"), "states")
    met = stitched.join(states, same_chunk("states")).select("conv_id", "chunk", "letters", "follow", "rest", "state")
    return plain.unionByName(met).mapInArrow(traced, "conv_id long, chunk long, audit string, edits array<string>, tail string, cost long, illegal long")


def role_of(letter: Column) -> Column:
    return F.when(letter == "u", "user").otherwise("assistant")


def inserted_turns(letters: Column) -> Column:
    """array of empty turns."""
    return F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.concat(role_of(x), F.lit(":")))


def repaired_turns(rows: DataFrame, chunks: DataFrame, edits: DataFrame, size: int) -> DataFrame:
    """conv_id, pos and piece (role:text, after the turns inserted before it) of every repaired turn. rows: damaged rows."""
    named = renamed(chunks.select("conv_id", "chunk", "names"), "named")
    each = edits.join(named, same_chunk("named")).select("conv_id", "chunk", F.posexplode(F.arrays_zip("edits", "names")).alias("k", "e"))
    each = each.select("conv_id", (F.col("chunk") * size + F.col("k")).alias("pos"), F.col("e.names").alias("name"), F.col("e.edits").alias("edit")).where("edit <> 'D'")
    kept = each.where("NOT endswith(edit, 'D')")
    texts = rows.select("conv_id", turn_name(F.col("role"), F.col("text")).alias("name"), "role", "text")
    # a kept row is the only one of its role and text in its conversation
    met = texts.unionByName(kept, allowMissingColumns=True).groupBy("conv_id", "name").agg(*(F.max(c).alias(c) for c in ("role", "text", "pos", "edit"))).where("edit IS NOT NULL")
    letter = F.right("edit", F.lit(1))
    role = F.when(letter == "K", F.col("role")).otherwise(role_of(F.lower(letter)))
    lead = F.substring("edit", F.lit(1), F.length("edit") - 1)
    whole = lambda last: F.array_join(F.concat(inserted_turns(lead), last), "\n")
    out = met.select("conv_id", "pos", whole(F.array(F.concat(role, F.lit(":"), "text"))).alias("piece"))
    out = out.unionAll(each.where("endswith(edit, 'D')").select("conv_id", "pos", F.array_join(inserted_turns(lead), "\n")))
    return out.unionAll(edits.where("tail <> ''").select("conv_id", F.lit(AFTER_ALL), F.array_join(inserted_turns(F.col("tail")), "\n")))


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = damaged(conversations)
    marked = stored(judged(rows))
    chunks = stored(chunks_of(marked, chunk))
    edits = stored(edited(chunks))
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    counts = marked.groupBy("conv_id").agg(count("blank"), count("duplicate"), count("truncated"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda c: c["audit"])
    audits = edits.groupBy("conv_id").agg(F.array_join(in_order, "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    shas = digests(repaired_turns(rows, chunks, edits, chunk), "conv_id", ["pos"], "\n").withColumnRenamed("sha256", "repaired_sha256")
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (counts, audits, shas):
        whole = whole.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
