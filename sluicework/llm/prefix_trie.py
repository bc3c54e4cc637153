"""The trie of conversation prefixes, rolled up by centroid decomposition.

Conversations are rebuilt first: conversation c takes its first h turns from conversation
``c - c % 100`` (all if that one has fewer, none if there is none), then its own turns after its first h,
where ``h = crc32(c) % 6``.  Each distinct sequence of the first d rebuilt turns is a node.

1. The turns are put in order by a range shuffle on (conversation, turn), so that a conversation with any
   share of the rows lies in many tasks; their places are running counts over these parts.
2. A prefix is named by two running XORs of 64-bit hashes, each of a depth and the SHA-256 of the turn there.
   They too are made within the parts and carried over from part to part.  This gives the ``path`` rows:
   (conversation, depth, node).
3. Nodes are counted with partial sums.  The conversation with the smallest id that has a prefix owns
   its node; the nodes below a node are its members' own nodes, so that one more sum gives the sizes.
4. Sums over subtrees: the parent edges are a forest, one tree at first.  In each round every component
   has a centroid, the deepest node whose part of the component is more than half of it.  Its total
   is added to itself and to all nodes on the way to the component's top, which are found on the owner's path rows.
   What is below each child of the centroid becomes a component of its own, and the rest stays one,
   so that components have at most half as many nodes as before, whatever the tree's depth.
   A node gets at most a summand per round.
5. Components of at most ``SMALL`` nodes are finished in the same way inside tasks.

Every step is a partial sum or an equality join.  Keys that many rows have (a component, a conversation, a
parent) are broadcast if they are at most a thousand, or are joins that Spark splits; a node's members are never collected:
their ids are joined to chunks of at most ``CHUNK`` and the digest is taken over these as they are read in order.

Nulls: a row without conv_id belongs to no conversation and is left out; a null turn is the first, null role or text
are empty.  Turns with one number, repeated rows too, all count, in the order of the SHA-256 of role and text.  Texts of any
length are read whole.  An empty table gives an empty result.  Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework.llm.common import tables, with_group, written

#: Turns that may be taken over: 0 to HEADS - 1; conversations that share a first one.
HEADS, SHARED = 6, 100
#: Nodes of a component that a task finishes.
SMALL = 50_000
#: Ids that are joined to one text.
CHUNK = 4_096


def _part(id_: str = "id") -> Column:
    return F.shiftright(F.col(id_), 33)


def _before(total: Column) -> Column:
    """A running total over the earlier parts of a conversation."""
    return total.over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def rebuilt(rows: DataFrame, table) -> DataFrame:
    """The rebuilt turns (conv, part, depth, digest, chars) of (conv_id, turn, role, text), and a row of depth 0 per conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.monotonically_increasing_id().alias("salt"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).alias("chars"))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    ordered = table(turns.repartitionByRange(*order, "salt").sortWithinPartitions(*order).select(
        "conv", F.monotonically_increasing_id().alias("id"), "digest", "chars"))

    parts = table(ordered.groupBy("conv", _part().alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first")))
    lengths = parts.groupBy("conv").agg(F.sum("n").alias("turns"))
    of = lengths.select("conv", "turns", (F.col("conv") - F.col("conv") % SHARED).alias("head"),
                        (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    heads = lengths.select(F.col("conv").alias("head"), F.col("turns").alias("there"))
    of = table(of.join(heads, "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))).cast("int")).drop("there"))
    parts = parts.withColumn("before", F.coalesce(_before(F.sum("n")), F.lit(0))).join(of.select("conv", "h", "taken"), "conv")
    at = F.col("before") + F.col("id") - F.col("first")
    own = table(ordered.withColumn("part", _part()).join(parts, ["conv", "part"]).select(
        "conv", "part", at.alias("at"), (at - F.col("h") + F.col("taken") + 1).alias("depth"), (at >= F.col("h")).alias("stays"),
        "digest", "chars"))

    first = own.where((F.col("at") < HEADS - 1) & (F.col("conv") % SHARED == 0)).groupBy(F.col("conv").alias("head")).agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"))
    start = F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("chars")))
    taken = F.slice(F.coalesce("firsts", F.filter(start, lambda x: x.at >= 0)), F.lit(1), F.col("taken"))
    borrowed = of.join(first.withColumnRenamed("turns", "firsts"), "head", "left").select(
        "conv", F.explode(F.concat(start, taken)).alias("t")).select(
        "conv", F.lit(-1).cast("long").alias("part"), (F.col("t.at") + 1).alias("depth"), "t.digest", "t.chars")
    return borrowed.unionByName(own.where("stays").select("conv", "part", "depth", "digest", "chars"))


def paths(turns: DataFrame, table) -> DataFrame:
    """The prefixes of all conversations (conv, depth, node, parent, chars), and whether one is the whole conversation (``ends``)."""
    turns = table(turns.select("conv", "part", "depth", "chars", *[
        F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "depth", "digest")).alias(f"h{k}") for k in (0, 1)]))
    sums = turns.groupBy("conv", "part").agg(F.bit_xor("h0").alias("h0"), F.bit_xor("h1").alias("h1"), F.max("depth").alias("deep"))
    carried = sums.select(
        "conv", "part", *[F.coalesce(_before(F.bit_xor(f"h{k}")), F.lit(0).cast("long")).alias(f"c{k}") for k in (0, 1)],
        F.max("deep").over(Window.partitionBy("conv")).alias("length"))
    inside = Window.partitionBy("conv", "part").orderBy("depth")
    running = turns.join(carried, ["conv", "part"])
    for k in (0, 1):
        running = running.withColumn(f"p{k}", F.bit_xor(f"h{k}").over(inside).bitwiseXOR(F.col(f"c{k}")))
    node = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    return table(running.select(
        "conv", "depth", node(F.col("p0"), F.col("p1")).alias("node"),
        F.when(F.col("depth") > 0, node(*[F.col(f"p{k}").bitwiseXOR(F.col(f"h{k}")) for k in (0, 1)])).alias("parent"),
        "chars", (F.col("depth") == F.col("length")).alias("ends")))


def nodes(path: DataFrame, table) -> DataFrame:
    """One row per node: node, conv (the owner), depth, parent, n_convs, chars, n_children, and size, the nodes in its subtree."""
    counted = table(path.groupBy("node").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"),
        *[F.first(c).alias(c) for c in ("depth", "parent", "chars")]))
    owned = table(counted.groupBy("conv").agg(F.count("*").alias("own"), F.min("depth").alias("top")))
    below = path.join(owned, "conv").groupBy("node").agg(F.sum("own").alias("below"))
    children = counted.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    size = F.col("below") - (F.col("depth") - F.col("top"))  # the owner's nodes above don't count
    return table(counted.join(below, "node").join(children, "node", "left").join(owned.select("conv", "top"), "conv").select(
        "node", "conv", "depth", "parent", "n_convs", "chars", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        size.alias("size")))


def gains(order: list[int], parent: list[int], values: list[tuple]) -> list[list[int]]:
    """The sums over all subtrees of one component by centroid decomposition.

    ``order`` has the nodes with parents before children, ``parent`` a node's parent or -1.
    """
    sums = [[0] * len(values[0]) for _ in values] if values else []
    inside = [-1] * len(values)  # the component a node is in now
    todo, number = [order], 0
    while todo:
        part = todo.pop()
        number += 1
        size = {}
        for v in part:
            inside[v], size[v] = number, 1
        for v in reversed(part[1:]):
            size[parent[v]] += size[v]
        centroid = part[0]
        for v in part:  # nodes with more than half are one way down
            if 2 * size[v] > len(part):
                centroid = v
        piece = {centroid: -1}  # the child of the centroid above each node below it
        total = list(values[centroid])
        rest, below = [], {}
        for v in part:
            if v == centroid:
                continue
            above = piece.get(parent[v]) if parent[v] >= 0 and inside[parent[v]] == number else None
            if above is None:
                rest.append(v)
                continue
            piece[v] = v if above == -1 else above
            below.setdefault(piece[v], []).append(v)
            for k, x in enumerate(values[v]):
                total[k] += x
        v = centroid
        while v >= 0 and inside[v] == number:
            for k, x in enumerate(total):
                sums[v][k] += x
            v = parent[v]
        todo.extend(p for p in (rest, *below.values()) if p)
    return sums


SUMS = ["n_leaves", "saved_tokens"]


def _finished(rows: DataFrame) -> DataFrame:
    """What the small components add to their nodes: (node, n_leaves, saved_tokens)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        number = {key: k for k, key in enumerate(zip(part["a"], part["b"], strict=True))}
        parent = [-1, *[number[key] for key in zip(part["pa"][1:], part["pb"][1:], strict=True)]]  # the first is the top
        sums = gains(list(range(len(part))), parent, list(zip(part["leaf"], part["saved"], strict=True)))
        return pd.DataFrame({"a": part["a"], "b": part["b"], **{c: [s[k] for s in sums] for k, c in enumerate(SUMS)}})

    def finish(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:  # sorted by component, then depth
            key = list(zip(batch["ca"], batch["cb"], strict=True))
            cuts = [k for k in range(1, len(key)) if key[k] != key[k - 1]]
            pieces = [batch.iloc[i:j] for i, j in zip([0, *cuts], [*cuts, len(key)], strict=True)]
            out = []
            for piece in pieces:
                if held and (held[-1]["ca"].iloc[0], held[-1]["cb"].iloc[0]) != (piece["ca"].iloc[0], piece["cb"].iloc[0]):
                    out.append(one(pd.concat(held, ignore_index=True)))
                    held = []
                held.append(piece)
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield one(pd.concat(held, ignore_index=True))

    flat = rows.select("node.a", "node.b", *[F.coalesce(f"parent.{c}", F.lit(0).cast("long")).alias(f"p{c}") for c in "ab"],
                       F.col("comp.a").alias("ca"), F.col("comp.b").alias("cb"), "depth", "leaf", "saved")
    sorted_ = flat.repartition("ca", "cb").sortWithinPartitions("ca", "cb", "depth")
    return sorted_.mapInPandas(finish, "a bigint, b bigint, n_leaves bigint, saved_tokens bigint").select(
        F.struct("a", "b").alias("node"), *SUMS)


def subtree_sums(found: DataFrame, path: DataFrame, table, small: int = SMALL) -> DataFrame:
    """Leaves and saved tokens of the subtrees of all nodes: (node, n_leaves, saved_tokens)."""
    root = F.struct(*[F.lit(0).cast("long").alias(c) for c in "ab"])
    state = found.select("node", "conv", "depth", "parent", "size", root.alias("comp"), (F.col("n_children") == 0).cast("long").alias("leaf"),
                         ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    added = []
    while True:
        sized = table(with_group(state, "comp").withColumnRenamed("_n", "whole"))
        added.append(table(_finished(sized.where(F.col("whole") <= small))))
        large = sized.where(F.col("whole") > small)
        if large.isEmpty():
            break
        most = F.when(2 * F.col("size") > F.col("whole"), F.col("depth"))
        centre = F.max_by(F.struct("node", "conv", "depth", "size"), most).alias("c")
        seen = with_group(large, "comp", centre, F.min("depth").alias("top")).drop("_n")
        step = path.select("conv", F.col("depth").alias("_depth"), F.col("node").alias("_child"), F.col("parent").alias("_parent"))
        seen = seen.withColumn("_depth", F.when(F.col("depth") > F.col("c.depth"), F.col("c.depth") + 1))
        seen = table(seen.join(step, ["conv", "_depth"], "left").withColumn(
            "to", F.when(F.col("_parent") == F.col("c.node"), F.col("_child"))).drop("_depth", "_child", "_parent"))

        is_centre = F.col("node") == F.col("c.node")
        totals = seen.where(is_centre | F.col("to").isNotNull()).groupBy("comp").agg(
            F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        centres = table(seen.where(is_centre).select("comp", "c.*", "top").join(totals, "comp"))
        way = centres.select("conv", F.col("depth").alias("c_depth"), "top", F.col("size").alias("less"), *SUMS)
        above = table(path.select("conv", "depth", "node").join(way, "conv").where(
            (F.col("depth") >= F.col("top")) & (F.col("depth") <= F.col("c_depth"))).select(
            "node", *SUMS, F.when(F.col("depth") < F.col("c_depth"), F.col("less")).otherwise(0).alias("less")))
        added.append(above.drop("less"))
        state = seen.where(~is_centre).join(above.select("node", "less"), "node", "left").select(
            "node", "conv", "depth", "parent", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"),
            F.coalesce("to", "comp").alias("comp"), "leaf", "saved")
    every = added[0]
    for more in added[1:]:
        every = every.unionByName(more)
    return every.groupBy("node").agg(*[F.sum(c).alias(c) for c in SUMS])


def end_digests(path: DataFrame, table) -> DataFrame:
    """(node, ends_sha256): the digest of the ids, in order, of the conversations that a node is the whole of."""
    last = path.where("ends").select("node", "conv")
    ordered = table(last.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").select(
        "node", "conv", F.monotonically_increasing_id().alias("id")))
    chunks = ordered.groupBy("node", _part().alias("part"), F.floor(F.col("id") / CHUNK).alias("chunk")).agg(
        F.sort_array(F.collect_list("conv")).alias("ids"))
    chunks = table(chunks.select("node.a", "node.b", F.col("ids")[0].alias("first"), F.array_join("ids", ",").alias("ids")))

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(batch["a"], batch["b"], batch["ids"], strict=True):
                if (a, b) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["a", "b", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["a", "b", "ends_sha256"])

    found = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInPandas(digest, "a bigint, b bigint, ends_sha256 string")
    return found.select(F.struct("a", "b").alias("node"), "ends_sha256")


def prefix_trie(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with tables(rows.sparkSession) as table:
        path = paths(rebuilt(rows.select("conv_id", "turn", "role", "text"), table), table)
        found = nodes(path, table)
        sums = subtree_sums(found, path, table, small)
        parents = found.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
        return written(
            found.join(sums, "node").join(end_digests(path, table), "node", "left").join(parents, "parent", "left").select(
                F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", *SUMS,
                F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
