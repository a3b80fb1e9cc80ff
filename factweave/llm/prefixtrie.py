"""The trie of conversation prefixes, by van Emde Boas recursion.

Every conversation is rebuilt: it takes its first turns from the first conversation of its hundred. Each distinct sequence
of the first d rebuilt turns is a node of depth d. Depths are cut at half, again and again: at a cut, the part of each
sequence above it gets a name (of the name it started from and of the block of turns that it runs through), equal parts
become one sequence of the upper trie, with their number, and what is left below starts from that name. Upper tries and lower
forests of all cuts are worked on together, so a trie of depth n takes log2(n) rounds, whatever its shape. Blocks of turns are
named by pairs, the shortest first. Totals of subtrees go the other way: those of lower forests are grafted on the cut nodes
above them, from the shortest blocks to the longest, and what lies below a block is then added to the nodes in it. A node
keeps no list; a round is a few joins on names and sums by name, which aggregate before they shuffle. No task holds a group.

Edge cases. Rows whose conv_id is null have no conversation and take no part. A null role or text is empty; a null turn comes
first. Rows of one turn are ordered by role, then by the name of role and text; repeated rows are turns of their own. A
conversation that the rebuilding leaves without turns is a member of the root and ends there. Of a negative conv_id the
remainder has its sign. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.ordered import digests, name, places, turn_name
from factweave.llm.shared import stored

#: Name of the sequence without turns.
ROOT = bytes(16)
#: Conversations that share the turns of their first one, and the most turns that they take from it.
SHARE, MOST = 100, 5


def taken_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(F.encode(conv_id.cast("string"), "utf-8")) % (MOST + 1)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, symbol, size) and lengths (conv_id, length) of the rebuilt conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_name(role, text).alias("symbol"), F.length(text).cast("long").alias("size")
    )
    placed = places(rows, "conv_id", ["turn", "role", "symbol"]).select("conv_id", "pos", "symbol", "size")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("most", taken_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARE)
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lengths = convs.join(bases, "base", "left").withColumn("taken", F.least("most", F.coalesce("base_n", F.lit(0))))
    lengths = lengths.withColumn("own", F.greatest(F.col("n") - F.col("most"), F.lit(0)))
    lengths = stored(lengths.withColumn("length", F.col("taken") + F.col("own")))
    first = placed.where((F.col("pos") < MOST) & (F.col("conv_id") % SHARE == 0)).withColumnRenamed("conv_id", "base")
    head = lengths.join(first, "base").where("pos < taken").select("conv_id", "pos", "symbol", "size")
    rest = placed.where(F.col("pos") >= taken_turns(F.col("conv_id"))).join(lengths.select("conv_id", "taken", "most"), "conv_id")
    rest = rest.select("conv_id", (F.col("pos") - F.col("most") + F.col("taken")).alias("pos"), "symbol", "size")
    return stored(head.unionByName(rest)), lengths.select("conv_id", "length")


def named_blocks(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """For each k below `rounds`: conv_id, block and name of every whole block of 2^k turns."""
    blocks = [turns.select("conv_id", F.col("pos").alias("block"), F.col("symbol").alias("name"))]
    for _ in range(1, rounds):
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("half"))
        halves = pairs.agg(F.min_by("name", "block").alias("first"), F.max_by("name", "block").alias("second"), F.count("*").alias("n"))
        blocks.append(stored(halves.where("n = 2").select("conv_id", F.col("half").alias("block"), name(F.col("first"), F.col("second")).alias("name"))))
    return blocks


def cut(sequences: DataFrame, blocks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The sequences of blocks of 2^k turns that those of twice the length fall into, and the conversations (conv_id, node)
    that end at the cuts.

    sequences: root (the node it starts from) and depth (of the root), conv_id (the smallest of those that run through it),
    until (the depth where it ends), end (the node there; null where a conversation ends, which has no name yet) and n (how
    many conversations it stands for).
    """
    half = 2**k
    runs = sequences.where(F.col("until") >= F.col("depth") + half).withColumn("block", F.shiftright("depth", k))
    runs = stored(runs.join(blocks, ["conv_id", "block"]).withColumn("node", name(F.col("root"), F.col("name"))).drop("name", "block"))
    upper = runs.groupBy("root", "depth", "node").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    upper = upper.select("root", "depth", "conv_id", (F.col("depth") + half).alias("until"), F.col("node").alias("end"), "n")
    lower = runs.where(F.col("until") > F.col("depth") + half).select(F.col("node").alias("root"), (F.col("depth") + half).alias("depth"), "conv_id", "until", "end", "n")
    short = sequences.where(F.col("until") < F.col("depth") + half)
    ended = runs.where((F.col("until") == F.col("depth") + half) & F.col("end").isNull()).select("conv_id", "node")
    return stored(upper.unionByName(lower).unionByName(short)), ended


def added(*parts: DataFrame) -> DataFrame:
    """node, depth, leaves and saved, summed by node."""
    whole = parts[0].select("node", "depth", "leaves", "saved")
    for part in parts[1:]:
        whole = whole.unionByName(part.select("node", "depth", "leaves", "saved"))
    return whole.groupBy("node", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """node, leaves and saved, over subtrees. nodes: node, depth, leaves, saved of each node alone.

    jumps: for each k: node, up, of all nodes whose depth is a multiple of 2^k; `up` is 2^k nodes above.
    """
    on_grid = lambda k: F.col("depth") % 2**k == 0

    def carried(totals: DataFrame, k: int) -> DataFrame:
        met = totals.join(jumps[k], "node")
        return met.select(F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"), "leaves", "saved")

    within = [nodes]  # totals of the blocks of 2^k turns that start at a node
    for k in range(len(jumps)):
        grafts = carried(within[k].where(~on_grid(k + 1)), k)
        within.append(stored(added(within[k].where(on_grid(k + 1)), grafts)))
    whole = within[-1]
    for k in reversed(range(len(jumps))):
        # nodes at the cuts of this level: their own block, and the whole subtrees of the nodes where it ends
        below = carried(whole.where("depth > 0"), k)
        whole = stored(whole.unionByName(added(within[k].where(~on_grid(k + 1)), below)))
    return whole.select("node", "leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every
    node: how many conversations run through it, its children, the childless nodes and the saved code points of its subtree,
    and a digest of the conversations that end at it."""
    turns, lengths = rebuilt(conversations)
    rounds = int(lengths.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]).bit_length()
    blocks = named_blocks(turns, rounds)
    sequences = lengths.where("length > 0").select(
        F.lit(ROOT).alias("root"), F.lit(0).cast("long").alias("depth"), "conv_id", F.col("length").alias("until"), F.lit(None).cast("binary").alias("end"), F.lit(1).cast("long").alias("n")
    )
    ended = lengths.where("length = 0").select("conv_id", F.lit(ROOT).alias("node"))
    jumps = []
    for k in reversed(range(rounds)):
        sequences, ends = cut(sequences, blocks[k], k)
        ended = ended.unionByName(ends)
        jumps.insert(0, sequences.where("end IS NOT NULL").select(F.col("end").alias("node"), F.col("root").alias("up")))
    # each sequence is one turn now, from a node's parent to the node
    found = sequences.join(turns.select("conv_id", F.col("pos").alias("depth"), "size"), ["conv_id", "depth"])
    saved = (F.col("n") - 1) * F.col("size")
    found = found.select(F.col("end").alias("node"), F.col("root").alias("up"), "conv_id", (F.col("depth") + 1).alias("depth"), "n", saved.alias("saved"))
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0")
    top = top.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("up"), "conv_id", F.lit(0).cast("long").alias("depth"), "n", F.lit(0).cast("long").alias("saved"))
    nodes = stored(found.unionByName(top))
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(nodes.select("node", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved"), jumps)
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    lists = digests(ended.withColumn("piece", F.col("conv_id").cast("string")), "node", ["conv_id"], ",")
    out = nodes.drop("saved").join(totals, "node").join(lists, "node", "left").join(parents, "up", "left")
    ends = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends)
