"""Conversation prefix trie: vertical bitmaps of (position, turn) per shard, walked depth first, and merged.

Turns become two 64-bit hashes, and a node is told by its depth and by the two running exclusive ors of the hashes of
(position, turn); for 10^12 distinct nodes, 10^-14 chance collisions are expected. A shard is a range of conversation ids
and a block of positions, so neither many conversations with one start nor one very long conversation fill a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import cut_lineage

#: Conversation ids of a shard, positions of a block.
SHARD_IDS = 1024
BLOCK = 1024
NODE = ["depth", "node_a", "node_b"]


def numbered_turns(
    conversations: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, place, a, b, n_bytes, n_turns): each turn's place in its conversation from 0, two hashes of its role
    and text, its text's bytes in UTF-8 and the conversation's number of turns.

    Turns are ordered by `order`, null first; ties by the hashes, so repeated rows are turns of their own, next to each
    other. Null role and text are empty. Rows without an id are no one's and are left out. The sort is by ranges of
    (id, order, hashes, a row number), so one conversation may fill many tasks; places then need the number of its
    turns in the tasks before, one row for each conversation and task.
    """
    said = (F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    narrow = conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("conv_id"), F.col(order).alias("turn"), F.xxhash64(*said).alias("a"),
        F.xxhash64(F.lit(11), said[1], said[0]).alias("b"), F.octet_length(said[1]).cast("bigint").alias("n_bytes"),
        F.monotonically_increasing_id().alias("seat"),
    )
    by = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("a"), F.col("b"), F.col("seat")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            place = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if last == conv[0]:
                place[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(conv), task, np.int64)), pa.array(place), *(batch.column(i) for i in (2, 3, 4))],
                names=["conv_id", "task", "nth", "a", "b", "n_bytes"],
            )

    dealt = narrow.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = cut_lineage(dealt.mapInArrow(count, "conv_id bigint, task bigint, nth bigint, a bigint, b bigint, n_bytes bigint"))
    parts = rows.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n_turns")
    )
    return rows.join(parts, ["conv_id", "task"]).select(
        "conv_id", (F.col("nth") + F.col("before")).alias("place"), "a", "b", "n_bytes", "n_turns"
    )


def borrowed_starts(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of rebuilt conversations: the first h turns of conversation c - c % group, then c's own after its
    first h, with h = crc32 of c's decimal text % (most + 1). members (conv_id) has those that are left without a turn too.
    """
    turns = cut_lineage(turns)
    first = F.col("conv_id") - F.col("conv_id") % group
    lengths = turns.filter("place = 0").select("conv_id", "n_turns", first.alias("base"))
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.col("n_turns"))).over(Window.partitionBy("base"))
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    convs = lengths.withColumn("h", h).withColumn("taken", F.least("h", F.coalesce(lent, F.lit(0))))
    convs = cut_lineage(convs.select("conv_id", "base", "h", "taken"))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "n_bytes"
    )
    borrowed = turns.filter(F.col("place") < most).withColumnRenamed("conv_id", "base").join(convs, "base")
    borrowed = borrowed.filter("place < taken").select("conv_id", "place", "a", "b", "n_bytes")
    return own.unionByName(borrowed), convs.select("conv_id")


class _Shard:
    """The rows of one shard: conversations in order of their ids, each with its turns of the block in order."""

    def __init__(self, rows: dict[str, np.ndarray], depth: int) -> None:
        is_turn = rows["kind"] == 2
        self.ids = np.unique(rows["conv_id"])
        n = len(self.ids)
        conv = np.searchsorted(self.ids, rows["conv_id"])
        # What the block needs of the conversation's other blocks.
        self.a, self.b, self.after = (np.zeros(n, np.int64) for _ in range(3))
        self.more = np.zeros(n, bool)
        head = rows["kind"] == 1
        self.a[conv[head]], self.b[conv[head]] = rows["a"][head], rows["b"][head]
        self.after[conv[head]], self.more[conv[head]] = rows["n_bytes"][head], rows["flag"][head] > 0
        # Weights of the second walk: bytes of a conversation's own nodes, its own leaf, the depth they begin at.
        own = rows["kind"] == 0
        self.own, self.leaf, self.since = (np.zeros(n, np.int64) for _ in range(3))
        self.own[conv[own]], self.leaf[conv[own]], self.since[conv[own]] = rows["n_bytes"][own], rows["flag"][own], rows["place"][own]
        turn = np.flatnonzero(is_turn)
        turn = turn[np.lexsort((rows["place"][turn], conv[turn]))]
        self.turn_a, self.turn_b, self.bytes = rows["a"][turn], rows["b"][turn], rows["n_bytes"][turn]
        self.size = np.bincount(conv[turn], minlength=n)
        self.start = np.cumsum(self.size) - self.size
        total = np.concatenate([[0], np.cumsum(self.bytes)])
        # Bytes from each turn to the conversation's end.
        who = conv[turn]
        self.rest = total[(self.start + self.size)[who]] - total[:-1][: len(who)] + self.after[who]
        self.from_start = total[self.start + self.size] - total[self.start] + self.after
        self.depth = depth
        # The postings: conversations that have a turn at a position; both are in the turn's code.
        pair = np.stack([self.turn_a, self.turn_b], 1)
        code = np.unique(pair, axis=0, return_inverse=True)[1].ravel() if len(pair) else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        edge = np.searchsorted(code[order], np.arange(int(code.max()) + 2 if len(code) else 1))
        self.code = code.tolist()
        self.postings = [self.bits(who[order[x:y]]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        self.longer = [self.bits(np.flatnonzero(self.size > d)) for d in range(int(self.size.max(initial=0)) + 1)]

    def bits(self, members: np.ndarray) -> int:
        flags = np.zeros(len(self.ids), np.uint8)
        flags[members] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def members(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes(-(-len(self.ids) // 8), "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))

    def roots(self) -> list[tuple[int, int, int]]:
        """(bitset, a, b) of the conversations that enter the block with the same prefix."""
        pair, which = np.unique(np.stack([self.a, self.b], 1), axis=0, return_inverse=True)
        return [(self.bits(np.flatnonzero(which.ravel() == g)), int(p[0]), int(p[1])) for g, p in enumerate(pair)]

    def walk(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(bitset, depth in the block, a, b, parent's a, parent's b) of every node below the roots, depth first.

        A node's children: the smallest member not seen yet that goes on names a turn; its posting, intersected with
        the node's bitset, is a child. A node with one member leads to nothing but its own turns and is given once.
        """
        start, code, postings, longer = self.start.tolist(), self.code, self.postings, self.longer
        turn_a, turn_b = self.turn_a.tolist(), self.turn_b.tolist()
        stack = [(bits, 0, a, b) for bits, a, b in self.roots()]
        while stack:
            bits, d, a, b = stack.pop()
            left = bits & longer[d]
            while left:
                at = start[(left & -left).bit_length() - 1] + d
                child = bits & postings[code[at]]
                left &= ~child
                x, y = a ^ turn_a[at], b ^ turn_b[at]
                yield child, d + 1, x, y, a, b
                if child & (child - 1) and d + 1 < len(longer):
                    stack.append((child, d + 1, x, y))

    def chain(self, one: int, d: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """depths in the block, a, b and rows of the turns after the d-th of a conversation that goes on alone."""
        rows = np.arange(self.start[one] + d, self.start[one] + self.size[one])
        x = a ^ np.bitwise_xor.accumulate(self.turn_a[rows]) if len(rows) else self.turn_a[rows]
        y = b ^ np.bitwise_xor.accumulate(self.turn_b[rows]) if len(rows) else self.turn_b[rows]
        return d + 1 + np.arange(len(rows)), x, y, rows


_FOUND = ["depth", "node_a", "node_b", "up_a", "up_b", "n", "least", "n_bytes", "rest", "least_rest", "ends"]
_FOUND_TYPES = "depth bigint, node_a bigint, node_b bigint, up_a bigint, up_b bigint, n bigint, least bigint, n_bytes bigint, rest bigint, least_rest bigint, ends string"
_SUMS = ["depth", "node_a", "node_b", "later_bytes", "later_leaves"]


def _nodes_of(shard: _Shard) -> list[tuple]:
    """Rows of _FOUND: a shard's part of every node that its conversations pass."""
    out = []

    def ends(who: np.ndarray, d: int) -> str | None:
        own = shard.ids[who[(shard.size[who] == d) & ~shard.more[who]]]
        return ",".join(map(str, own.tolist())) if len(own) else None

    if shard.depth == 0:
        every = np.arange(len(shard.ids))
        out.append((0, 0, 0, None, None, len(every), int(shard.ids[0]), 0, int(shard.from_start.sum()), int(shard.from_start[0]), ends(every, 0)))
    for bits, d, a, b, up_a, up_b in shard.walk():
        who = shard.members(bits)
        at = shard.start[who] + d - 1
        rest = shard.rest[at]
        out.append((shard.depth + d, a, b, up_a, up_b, len(who), int(shard.ids[who[0]]), int(shard.bytes[at[0]]), int(rest.sum()), int(rest[0]), ends(who, d)))
        if len(who) == 1 and d < shard.size[who[0]]:
            one = int(who[0])
            depths, x, y, rows = shard.chain(one, d, a, b)
            n, name = len(rows), int(shard.ids[one])
            rest = shard.rest[rows].tolist()
            last = [None] * (n - 1) + [None if shard.more[one] else str(name)]
            x, y = x.tolist(), y.tolist()
            out += zip(
                (shard.depth + depths).tolist(), x, y, [a, *x[:-1]], [b, *y[:-1]], [1] * n, [name] * n,
                shard.bytes[rows].tolist(), rest, rest, last, strict=True,
            )
    return out


def _sums_of(shard: _Shard) -> list[tuple]:
    """Rows of _SUMS: per node, what its members have of their own that begins deeper than the node."""
    out = []

    def told(who: np.ndarray, depth: int, a: int, b: int) -> None:
        later = who[shard.since[who] > depth]
        own, leaf = int(shard.own[later].sum()), int(shard.leaf[later].sum())
        if own or leaf:
            out.append((depth, a, b, own, leaf))

    if shard.depth == 0:
        told(np.arange(len(shard.ids)), 0, 0, 0)
    for bits, d, a, b, _, _ in shard.walk():
        who = shard.members(bits)
        told(who, shard.depth + d, a, b)
        if len(who) == 1 and d < shard.size[who[0]]:
            one = int(who[0])
            depths, x, y, _ = shard.chain(one, d, a, b)
            own, leaf = int(shard.own[one]), int(shard.leaf[one])
            n = int((shard.depth + depths < shard.since[one]).sum()) if own or leaf else 0
            out += zip((shard.depth + depths[:n]).tolist(), x[:n].tolist(), y[:n].tolist(), [own] * n, [leaf] * n, strict=True)
    return out


def _by_shard(rows: DataFrame, each, names: list[str], schema: str, shard_ids: int, block_size: int) -> DataFrame:
    """each(shard) of every shard; rows of a shard arrive together and only one shard is held."""
    columns = ["kind", "conv_id", "place", "a", "b", "n_bytes", "flag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        kinds = None

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            found = each(_Shard({c: table[c].to_numpy() for c in columns}, current[1] * block_size))
            cells = list(zip(*found, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

        kinds = [pa.string() if t.endswith("string") else pa.int64() for t in schema.split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1])) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(shard)], strict=True):
                own = (int(shard[x]), int(block[x]))
                if own != current and held:
                    yield done()
                    held = []
                current = own
                held.append(batch.slice(x, y - x).select(range(2, 2 + len(columns))))
        if held:
            yield done()

    shard = F.expr(f"(conv_id - pmod(conv_id, {shard_ids})) div {shard_ids}").alias("shard")
    dealt = rows.select(shard, "block", *columns).repartition("shard", "block").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, schema)


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of lists of ids in pieces: a node's pieces go by their first id through one running digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            out = []
            for *node, _, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if node != current:
                    if digest is not None:
                        out.append((*current, digest.hexdigest()))
                    current, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield told(out)
        if digest is not None:
            yield told([(*current, digest.hexdigest())])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=[*NODE, "ends_sha256"])

    pieces = ends.select(*NODE, F.substring_index("ends", ",", 1).cast("bigint").alias("first"), "ends")
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(run, "depth bigint, node_a bigint, node_b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, shard_ids: int = SHARD_IDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of all conversations' prefixes.

    turns (conv_id, place, a, b, n_bytes), places gapless from 0; members (conv_id): all conversations, also those
    without turns. nodes: one row per distinct prefix: node_a, node_b, depth, conv_id (smallest member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens. Its text is turn depth - 1 of conv_id. ends (depth, node_a, node_b, ends): the ids of
    the members that end at the node, comma-joined, in pieces whose ids ascend and do not overlap.

    A first walk over all shards gives each shard's part of every node; parts are added up. A prefix is owned by its
    smallest member; a member owns its nodes from some depth on. So the sum over a node's subtree of members * bytes is
    that of its members' bytes from there on, and the sum of bytes is what its owner has from there on and what other
    members own; a second walk adds these up. No members: no nodes.
    """
    coded = turns.select(
        "conv_id", "place", F.expr(f"place div {block}").alias("block"), F.xxhash64("place", "a", "b").alias("a"),
        F.xxhash64(F.lit(1), "b", "place", "a").alias("b"), "n_bytes",
    )
    coded = cut_lineage(coded)
    blocks = coded.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n_bytes").alias("n"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(1, Window.unboundedFollowing)
    heads = cut_lineage(blocks.select(
        "conv_id", "block", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("a"),
        F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("n_bytes"),
        F.lead("block").over(order).isNotNull().cast("bigint").alias("flag"),
    ))

    def rows(df: DataFrame, kind: int) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        have = [F.col(c).cast("bigint").alias(c) if c in df.columns else zero.alias(c) for c in ("block", "conv_id", "place", "a", "b", "n_bytes", "flag")]
        return df.select(F.lit(kind).cast("bigint").alias("kind"), *have)

    walked = rows(coded, 2).unionByName(rows(heads.filter("block > 0 or flag > 0"), 1))
    # Each member enters block 0, with or without turns.
    first = walked.unionByName(rows(members.select("conv_id"), 0))
    found = cut_lineage(_by_shard(first, _nodes_of, _FOUND, _FOUND_TYPES, shard_ids, block))
    nodes = cut_lineage(found.groupBy(*NODE).agg(
        F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"), F.sum("n").alias("n_convs"), F.sum("rest").alias("rest"),
        F.min(F.struct("least", "least_rest", "n_bytes")).alias("owner"),
    ).select(*NODE, "up_a", "up_b", "n_convs", "rest", F.col("owner.least").alias("conv_id"), F.col("owner.least_rest").alias("own_rest"), F.col("owner.n_bytes").alias("n_bytes")))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("node_a"), F.col("up_b").alias("node_b")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = cut_lineage(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    owners = cut_lineage(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("place"), F.sum("n_bytes").alias("n_bytes"), F.max((F.col("n_children") == 0).cast("bigint")).alias("flag")
    ))
    weights = owners.join(heads.select("conv_id", "block"), "conv_id", "left").withColumn("block", F.coalesce("block", F.lit(0)))
    second = walked.unionByName(rows(weights, 0))
    sums = _by_shard(second, _sums_of, _SUMS, "depth bigint, node_a bigint, node_b bigint, later_bytes bigint, later_leaves bigint", shard_ids, block)
    sums = sums.groupBy(*NODE).agg(F.sum("later_bytes").alias("later_bytes"), F.sum("later_leaves").alias("later_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    leaf = owners.select("conv_id", F.col("flag").alias("own_leaf"))
    full = nodes.join(sums, NODE, "left").join(leaf, "conv_id").join(parents, ["depth", "up_a", "up_b"], "left")
    full = full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("own_leaf") + F.coalesce("later_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("rest") - F.col("own_rest") - F.coalesce("later_bytes", F.lit(0))).alias("saved_tokens"), "node_a", "node_b",
    )
    return full, found.filter("ends is not null").select(*NODE, "ends")


def trie_report(turns: DataFrame, members: DataFrame, shard_ids: int = SHARD_IDS, block: int = BLOCK) -> DataFrame:
    """The nodes of prefix_trie with ends_sha256, the digest of the comma-joined ids of the members that end there."""
    nodes, ends = prefix_trie(turns, members, shard_ids, block)
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(_digests(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
