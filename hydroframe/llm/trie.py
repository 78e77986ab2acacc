"""Conversation prefix trie (operator 13): every common beginning of conversations as a node, with sums over its subtree.

A turn is a 16-byte digest of role and text, and a conversation's path the digests in
a row, so sorted paths are the trie in depth-first order.

* Splitters, drawn from a sample of (path, conversation), cut the sorted order into
  even shards.  The conversation is part of a splitter, so a path that a third of all
  conversations take is cut as well.
* A node crosses a shard's border if and only if it is a beginning of the splitter
  there.  The trie of the splitters' paths, the skeleton, is broadcast, so that every
  task knows which of its nodes are of the skeleton.
* A task walks its sorted shards with one stack, as deep as the current path, and
  finishes all other nodes.  Of a skeleton node it only gives what its own rows add.
* Those partial sums are reduced by node, and then up the skeleton, deepest first.
* The identifiers of conversations that end at a skeleton node come in sorted pieces of
  bounded size, from which the digest is streamed; all others are digested on the walk.

A node's children are held until its least conversation is known; where too many would
be held, or the node belongs to the skeleton, they are given with a reference to it,
which a join resolves.

Bounds: the sample of splitters holds about 20 rows a shard and SAMPLE_BYTES at most;
it only moves borders.  The skeleton is bounded by it.  A conversation is one record,
of 36 bytes a turn, and its turns meet in one task; texts aren't shuffled.

Rules: null roles and texts are empty.  Turns are ordered by number, null first, then by
role and digest.  Rows without a conv_id take no part.  Conversations without turns are
members of the root alone.  An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.llm.dedup import WHITE
from hydroframe.llm.groups import MOST_HOT
from hydroframe.llm.textkit import Tables

#: Bytes of a turn's digest.
TURN = 16
#: Turns of a shard on average, and the least number of shards.
SHARD, LEAST_SHARDS = 20_000, 64
#: Rows and bytes of the sample that splitters are drawn from.
SAMPLE_ROWS, SAMPLE_BYTES = 20, 16 << 20
#: Children that a task holds at most until their parent is known.
HELD = 200_000
#: Bytes of a piece of conversations that end at a skeleton node.
PIECE = 1 << 16


def words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: an array of (digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256), 1, 2 * TURN)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), words(text).alias("words")).alias("t"))
    rows = rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % 20)
    ordered = rows.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("family", "conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("t"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path and words of its turns, after its first turns gave way to those of its family's head.

    A family are the conversations of one multiple of 20, their head: conv_id less its
    remainder, which has the sign of conv_id as in SQL.  h = crc32 of the decimal conv_id, modulo 4, turns are exchanged.
    """
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("t", 1, 3))).over(Window.partitionBy("family"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    new = F.concat(F.coalesce(F.slice(head, F.lit(1), h), F.slice("t", 1, 0)), F.slice("t", h + 1, F.size("t")))
    rows = turns(conversations).select("conv_id", new.alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))


def common(x: bytes, y: bytes) -> int:
    """How many turns two paths begin with in common."""
    n, d = min(len(x), len(y)) // TURN, 0
    if x[: n * TURN] == y[: n * TURN]:
        return n
    while x[d * TURN : (d + 1) * TURN] == y[d * TURN : (d + 1) * TURN]:
        d += 1
    return d


class Skeleton:
    """The trie of the splitters' paths.  Nodes are numbered from the root, 0; splitters are distinct, in order."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = splitters
        self.parent, self.depth = [-1], [0]
        self.nodes: list[list[int]] = []
        for i, (path, _) in enumerate(splitters):
            nodes = self.nodes[-1][: common(path, splitters[i - 1][0]) + 1] if i else [0]
            for d in range(len(nodes), len(path) // TURN + 1):
                self.parent.append(nodes[-1])
                self.depth.append(d)
                nodes.append(len(self.parent) - 1)
            self.nodes.append(nodes)

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


def splitters(rows: DataFrame, seed: int = 17) -> list[tuple[bytes, int]]:
    """Borders between shards of about SHARD turns, by a sample of the rows."""
    n, size = rows.agg(F.count("*"), F.sum(F.length("path"))).first()
    shards = max(LEAST_SHARDS, (size or 0) // TURN // SHARD)
    share = min(1.0, SAMPLE_ROWS * shards / max(n, 1), SAMPLE_BYTES / max(size or 0, 1))
    drawn = sorted((bytes(r["path"]), r["conv_id"]) for r in rows.sample(share, seed).select("path", "conv_id").collect())
    total, out, seen = sum(len(p) + TURN for p, _ in drawn), [], 0
    for path, conv in drawn:
        if seen * shards >= total * (len(out) + 1):
            out.append((path, conv))
        seen += len(path) + TURN
    return out


class Node:
    """A node on the stack of the walk."""

    __slots__ = ("children", "conv", "ends", "held", "leaves", "number", "open", "piece", "pieces", "saved", "skeleton", "size", "words")

    def __init__(self, skeleton: int, number: int, words: int) -> None:
        self.skeleton, self.number, self.words = skeleton, number, words
        self.conv, self.size, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.piece, self.pieces = None, [], 0
        self.held: list[list] = []
        self.open = False


#: What a walk gives: whole nodes, parts of skeleton nodes, pieces of the conversations that end there.
NODE, PART, ENDS = 0, 1, 2
SCHEMA = "kind int, number long, parent long, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, piece long, data binary"
_ARROW = pa.schema([(x.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
EMPTY = hashlib.sha256().digest()


class Walk:
    """One shard in order of (path, conv_id); rows of SCHEMA collect in `out`.

    Numbers of the skeleton's nodes are those of the skeleton, other nodes that need one
    have a negative number that no other shard gives.
    """

    def __init__(self, skeleton: Skeleton, shard: int) -> None:
        none: tuple[bytes, int] = (b"", 0)
        self.shard, self.out, self.last, self.held, self.made = shard, [], b"", 0, 0
        cut = skeleton.splitters
        self.left, self.right = (cut[shard - 1] if shard else none)[0], (cut[shard] if shard < len(cut) else none)[0]
        self.at_left, self.at_right = skeleton.nodes[shard - 1] if shard else [0], skeleton.nodes[shard] if shard < len(cut) else [0]
        self.stack = [Node(0, 0, 0)]

    def row(self, path: bytes, conv: int, words: list[int]) -> None:
        stack, n, d = self.stack, len(path) // TURN, common(path, self.last)
        while len(stack) > d + 1:
            self.pop()
        if d < n:
            left, right = common(path, self.left), common(path, self.right)
            for depth in range(d + 1, n + 1):
                node = self.at_left[depth] if depth <= left else self.at_right[depth] if depth <= right else -1
                self.made += 1
                stack.append(Node(node, node if node >= 0 else -((self.shard << 40) + self.made), words[depth - 1]))
        self.last = path
        end = stack[-1]
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.size += 1
        if end.skeleton >= 0:
            end.piece.append(str(conv))
            if len(end.piece) * 8 >= PIECE:
                self.give_piece(end)
        elif end.ends is None:
            end.ends = hashlib.sha256(str(conv).encode())
        else:
            end.ends.update(b",%d" % conv)

    def give_piece(self, node: Node) -> None:
        if node.piece:
            self.give(ENDS, node.number, piece=(self.shard << 32) + node.pieces, data=",".join(node.piece).encode())
            node.piece, node.pieces = [], node.pieces + 1

    def give(self, kind: int, number: int | None, parent: int | None = None, conv: int | None = None, depth: int | None = None, above: int | None = None, size: int | None = None, children: int | None = None, leaves: int | None = None, saved: int | None = None, words: int | None = None, piece: int | None = None, data: bytes | None = None) -> None:
        self.out.append([kind, number, parent, conv, depth, above, size, children, leaves, saved, words, piece, data])

    def pop(self) -> None:
        """Finish the last node of the stack and add it to the one above."""
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1] if self.stack else None
        if node.skeleton >= 0:
            self.give_piece(node)
            self.give(PART, node.number, conv=node.conv, size=node.size, children=node.children, leaves=node.leaves, saved=node.saved, words=node.words)
            if above is not None:  # of a skeleton node only the members are known below; sums go up the skeleton
                self.member(above, node)
            return
        for child in node.held:
            child[5] = node.conv
            self.out.append(child)
        self.held -= len(node.held)
        saved, leaves = node.saved + (node.size - 1) * node.words, node.leaves or 1
        self.member(above, node)
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        row = [NODE, node.number if node.open else None, None, node.conv, depth, None, node.size, node.children, leaves, saved, None, None, node.ends.digest() if node.ends else EMPTY]
        if above.skeleton >= 0:
            row[2] = above.number
            self.out.append(row)
        else:
            above.held.append(row)
            self.held += 1
            if self.held > HELD:
                self.let_go()

    @staticmethod
    def member(above: Node, node: Node) -> None:
        above.size += node.size
        above.conv = node.conv if above.conv is None else min(above.conv, node.conv)

    def let_go(self) -> None:
        """Give all children that are held, with the numbers of their parents."""
        for node in self.stack:
            for child in node.held:
                child[2], node.open = node.number, True
                self.out.append(child)
            node.held = []
        self.held = 0

    def end(self) -> None:
        while self.stack:
            self.pop()


def walked(rows: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The rows of SCHEMA of all shards, from rows (conv_id, path, words)."""
    sent = rows.sparkSession.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [sent.value.shard(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], names=[*b.schema.names, "shard"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Walk | None = None

        def given(walk: Walk) -> Iterator[pa.RecordBatch]:
            rows, walk.out = walk.out, []
            for i in range(0, len(rows), 10_000):
                part = list(zip(*rows[i : i + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, _ARROW, strict=True)], schema=_ARROW)

        for b in batches:
            for shard, path, conv, words in zip(*(b.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")), strict=True):
                if now is None or shard != now.shard:
                    if now is not None:
                        now.end()
                        yield from given(now)
                    now = Walk(sent.value, shard)
                now.row(path, conv, words)
                if len(now.out) >= 50_000:
                    yield from given(now)
        if now is not None:
            now.end()
            yield from given(now)

    dealt = rows.select("conv_id", "path", "words").mapInArrow(deal, "conv_id long, path binary, words array<long>, shard int")
    return dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walk, SCHEMA)


def _ends(pieces: DataFrame) -> DataFrame:
    """number, ends: the digest of each skeleton node's pieces in order, streamed."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for number, data in zip(b.column("number").to_pylist(), b.column("data").to_pylist(), strict=True):
                if number == now:
                    state.update(b"," + data)
                else:
                    done += [(now, state.digest())] if state else []
                    now, state = number, hashlib.sha256(data)
        done += [(now, state.digest())] if state else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary())], names=["number", "ends"])

    return pieces.repartition("number").sortWithinPartitions("number", "piece").select("number", "data").mapInArrow(digest, "number long, ends binary")


def reduced(parts: DataFrame, skeleton: Skeleton) -> list[list]:
    """(number, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved) of the skeleton's nodes.

    One row a node comes to the driver, and the skeleton is bounded by the sample of splitters.
    """
    total = lambda c: F.sum(c).alias(c)
    rows = parts.groupBy("number").agg(F.min("conv_id").alias("conv_id"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved"), F.max("words").alias("words")).collect()
    at = {r["number"]: [r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["words"]] for r in rows}
    for i in sorted(at, key=skeleton.depth.__getitem__, reverse=True):
        node, above = at[i], at.get(skeleton.parent[i])
        node[3] = node[3] or 1
        node[4] += (node[1] - 1) * node[5]
        if above:
            above[2], above[3], above[4] = above[2] + 1, above[3] + node[3], above[4] + node[4]
    return [[i, conv, skeleton.depth[i], at[skeleton.parent[i]][0] if i else None, size, children, leaves, saved] for i, (conv, size, children, leaves, saved, _) in at.items()]


def trie(paths: DataFrame, tables: Tables | None = None) -> DataFrame:
    """One row a node of the trie of paths (conv_id, path, words): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tables = tables or Tables(paths.sparkSession, "trie")
    rows = tables.write(paths, "paths")
    skeleton = Skeleton(splitters(rows))
    found = tables.write(walked(rows, skeleton), "walked")
    tables.drop(rows)
    spark = paths.sparkSession
    bones = reduced(found.where(F.col("kind") == PART), skeleton)
    bones = spark.createDataFrame(bones, "number long, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long")
    ends = _ends(found.where(F.col("kind") == ENDS))
    bones = tables.write(bones.join(ends, "number", "left").withColumn("data", F.coalesce("ends", F.lit(EMPTY))), "skeleton")
    nodes = found.where(F.col("kind") == NODE)
    opened = nodes.where("number is not null").select("number", "conv_id").unionByName(bones.select("number", "conv_id")).select(F.col("number").alias("parent"), F.col("conv_id").alias("_above"))
    if opened.limit(MOST_HOT + 1).count() <= MOST_HOT:
        opened = F.broadcast(opened)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "data"]
    told = nodes.where("parent is null").select(*columns)
    asked = nodes.where("parent is not null").join(opened, "parent").withColumn("parent_conv_id", F.col("_above")).select(*columns)
    out = told.unionByName(asked).unionByName(bones.select(*columns))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.lower(F.hex("data")).alias("ends_sha256"))
