"""The prefix trie of conversations, from adaptive radix trees over turn ids.

A turn is known by an id of ``WIDTH`` bytes: a digest of its role and text, then the number of bytes of the text, the
highest first. A conversation's key is its turn ids in a row. Each task puts the keys it has into adaptive radix trees
(Leis et al. 2013): nodes grow through layouts of 4, 16, 48 and 256 children, and bytes without a choice are held in one
path. Where a path passes a whole number of ids, there is a node of the trie; other bytes emit none.

No task sees all keys below a common beginning, so trees are bounded (a full one is given out and a new one begun), and
their nodes meet by a digest of the ids above them. A node belongs to the one tree that has its smallest member. What a
subtree sums up is then summed tree by tree: members times bytes over all nodes a tree has, and what counts once (leaves,
children, bytes) over those that belong to it. The sums of all trees are those of the whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm import shared

#: Bytes of a turn's id: 16 of the digest, 4 of the text's size.
WIDTH, DIGEST = 20, 16

#: A tree is given out when it has so many keys, or so many bytes of them.
TREE_KEYS, TREE_BYTES = 50_000, 32 << 20

#: Members that end at one node are listed in pieces of at most so many neighbouring ids.
PIECE = 4096

NOTHING = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.blake2b(digest_size=DIGEST).digest()


class Node:
    """A place with children by their next byte; ``path`` are the bytes from the one that led here on.

    Layouts: up to 4 and up to 16 children with sorted bytes, up to 48 by a table of places, 256 by their byte.
    """

    __slots__ = ("path", "layout", "bytes", "below", "ends", "count", "least")

    def __init__(self, path: bytes):
        self.path, self.layout, self.bytes, self.below, self.ends = path, 4, bytearray(), [], []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.below[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.below[at - 1] if at else None
        return self.below[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or put another in its place."""
        if self.layout <= 16:
            at = bisect_left(self.bytes, byte)
            if at < len(self.bytes) and self.bytes[at] == byte:
                self.below[at] = node
                return
            if len(self.bytes) < self.layout:
                self.bytes.insert(at, byte)
                self.below.insert(at, node)
                return
        elif self.layout == 48:
            if self.bytes[byte]:
                self.below[self.bytes[byte] - 1] = node
                return
            if len(self.below) < 48:
                self.below.append(node)
                self.bytes[byte] = len(self.below)
                return
        else:
            self.below[byte] = node
            return
        self._grow()
        self.put(byte, node)

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            table = bytearray(256)
            for k, byte in enumerate(self.bytes):
                table[byte] = k + 1
            self.layout, self.bytes = 48, table
        else:
            below = [self.below[k - 1] if k else None for k in self.bytes]
            self.layout, self.bytes, self.below = 256, bytearray(), below

    def children(self) -> list[tuple[int, Node]]:
        """By their bytes."""
        if self.layout <= 16:
            return list(zip(self.bytes, self.below, strict=True))
        if self.layout == 48:
            return [(byte, self.below[k - 1]) for byte, k in enumerate(self.bytes) if k]
        return [(byte, node) for byte, node in enumerate(self.below) if node is not None]


def _common(path: bytes, key: bytes, at: int) -> int:
    """Number of bytes that ``path`` shares with ``key`` from ``at``."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:  # the first ``low`` bytes agree
        half = (low + high + 1) // 2
        if path[low:half] == key[at + low : at + half]:
            low = half
        else:
            high = half - 1
    return low


class Tree:
    """Keys with the members that have them."""

    def __init__(self):
        self.root, self.keys, self.held = Node(b""), 0, 0

    def insert(self, key: bytes, member) -> None:
        self.keys += 1
        self.held += len(key) + 32
        above, byte, node, at = None, 0, self.root, 0
        while True:
            same = _common(node.path, key, at)
            if same < len(node.path):  # the path parts here
                fork = Node(node.path[:same])
                fork.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                above.put(byte, fork)
                node = fork
            at += same
            if at == len(key):
                node.ends.append(member)
                return
            above, byte, at = node, key[at], at + 1
            node = above.child(byte)
            if node is None:
                leaf = Node(key[at:])
                leaf.ends.append(member)
                above.put(byte, leaf)
                return

    def full(self) -> bool:
        return self.keys >= TREE_KEYS or self.held >= TREE_BYTES

    def _counted(self) -> None:
        """Sets the number of members at or below each node, and the smallest (null is the largest)."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += [child for _, child in node.children()]
        for node in reversed(order):
            of = [child for _, child in node.children()]
            node.count = len(node.ends) + sum(child.count for child in of)
            known = [x for x in node.ends if x is not None] + [child.least for child in of if child.least is not None]
            node.least = min(known, default=None)

    def nodes(self) -> Iterator[tuple]:
        """Nodes of the trie, each before those below it: node, depth, bytes, members, least, inner, ends."""
        self._counted()
        root = self.root  # its path is always empty
        yield (_ROOT, 0, 0, root.count, root.least, bool(root.children()), root.ends)
        todo = [(child, bytes([byte]), hashlib.blake2b(digest_size=DIGEST), 0) for byte, child in reversed(root.children())]
        while todo:
            node, rest, above, depth = todo.pop()
            rest += node.path
            of = node.children()
            whole = len(rest) // WIDTH
            for k in range(whole):
                turn = rest[k * WIDTH : (k + 1) * WIDTH]
                above = above.copy()
                above.update(turn)
                depth += 1
                last = (k + 1) * WIDTH == len(rest)
                yield (above.digest(), depth, int.from_bytes(turn[DIGEST:]), node.count, node.least, bool(of) or not last, node.ends if last else [])
            rest = rest[whole * WIDTH :]
            todo += [(child, rest + bytes([byte]), above, depth) for byte, child in reversed(of)]


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn; null role or text as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    size = F.octet_length(text)
    return F.concat(F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))), F.unhex(F.lpad(F.hex(size), 8, "0")))


def _tasks(df: DataFrame) -> int:
    """Tasks of a shuffle before Python work: those of the session, not joined to few because rows are small."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sequences(turns: DataFrame, family: Column | None = None) -> DataFrame:
    """A row per conversation of ``turns`` (conv_id, turn, role, text): family, conv_id, ``ids`` (its turns' ids in order).

    Turns are in order of ``turn``, null first; equal ones in order of their ids. Rows of one ``family`` (by default the
    conversation) come to one task. Texts stay where they are read: only ids are shuffled.
    """
    conv = F.col("conv_id").cast("long")
    slim = turns.select(
        (conv if family is None else family).alias("family"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        turn_id(F.col("role"), F.col("text")).alias("id"),
    )
    listed = F.sort_array(F.collect_list(F.struct("turn", "id")))
    return slim.repartition(_tasks(turns), "family").groupBy("family", "conv_id").agg(F.transform(listed, lambda t: t["id"]).alias("ids"))


def with_shared_heads(turns: DataFrame, group: int, shares: Column) -> DataFrame:
    """Conversations begun anew: conv_id, ``ids``; the first ``shares`` turns come from another conversation.

    Conversation c takes them from c - c mod ``group`` (all if that has fewer, none if it is absent), and goes on with its
    own turns after as many. A null conversation is of no group and stays as it is.
    """
    conv = F.col("conv_id").cast("long")
    first = conv - F.pmod(conv, F.lit(group))
    found = sequences(turns, first).withColumn("shares", shares)
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.col("ids"))).over(Window.partitionBy("family"))
    head = F.coalesce(head, F.array().cast("array<binary>"))
    rest = F.slice("ids", F.col("shares") + 1, F.greatest(F.size("ids") - F.col("shares"), F.lit(0)))
    anew = F.when(F.col("conv_id").isNull(), F.col("ids")).otherwise(F.concat(F.slice(head, F.lit(1), F.col("shares")), rest))
    return found.select("conv_id", anew.alias("ids"))


NODE = "tree string, nth long, node binary, depth long, bytes long, members long, least long, inner boolean, ends array<long>"


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, ids) -> nodes of trees that hold them."""
    from pyspark import TaskContext

    schema = pa.schema(
        [("tree", pa.string()), ("nth", pa.int64()), ("node", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64())]
        + [("members", pa.int64()), ("least", pa.int64()), ("inner", pa.bool_()), ("ends", pa.list_(pa.int64()))]
    )
    part, number, tree = TaskContext.get().partitionId(), 0, Tree()

    def given(tree: Tree, number: int) -> Iterator[pa.RecordBatch]:
        rows = ((f"{part}-{number}", nth, *row) for nth, row in enumerate(tree.nodes()))
        for some in batched(rows, 10_000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        ids = batch.column(1)
        flat = b"".join(ids.values[ids.offsets[0].as_py() : ids.offsets[-1].as_py()].to_pylist()) if len(ids) else b""
        edges = ((ids.offsets.to_numpy() - ids.offsets[0].as_py()) * WIDTH).tolist()
        for conv, a, b in zip(batch.column(0).to_pylist(), edges[:-1], edges[1:], strict=True):
            tree.insert(flat[a:b], conv)
            if tree.full():
                yield from given(tree, number)
                number, tree = number + 1, Tree()
    if tree.keys:
        yield from given(tree, number)


SUMS = "node binary, parent_least long, depth long, members long, least long, children long, leaves long, saved long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of trees, each tree in order -> what each tree adds to the sums of its nodes' subtrees.

    Only the nodes from the root to the present one are held.
    """
    names = [c.split()[0] for c in SUMS.split(", ")]
    kinds = [pa.binary(), *[pa.int64()] * 7]
    out: list[tuple] = []
    open_: list[list] = []  # tree, node, parent_least, depth, members, least, children, leaves, saved

    def close() -> None:
        done = open_.pop()
        out.append(tuple(done[1:]))
        if open_:
            open_[-1][7] += done[7]
            open_[-1][8] += done[8]

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        made = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        out.clear()
        return made

    for batch in batches:
        for tree, node, depth, size, members, least, inner, own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            while open_ and (open_[-1][0] != tree or open_[-1][3] >= depth):
                close()
            if open_ and own:
                open_[-1][6] += 1
            above = open_[-1][5] if open_ else None
            saved = members * size - (size if own else 0)
            open_.append([tree, node, above, depth, members, least, 0, int(own and not inner), saved])
            if len(out) >= 10_000:
                yield flushed()
    while open_:
        close()
    yield flushed()


def nodes(conversations: DataFrame) -> DataFrame:
    """A row per distinct beginning of ``conversations`` (conv_id, ids): a node of their prefix trie, the root included.

    node (a digest of the ids), depth, conv_id (the smallest member), parent_conv_id (its parent's; null for the root),
    n_convs, n_children, n_leaves, saved_tokens (over its subtree, members but one times bytes of the last text), and
    ends_sha256 (of the members that end here, in order, comma-joined). A conversation without turns is a member of the
    root alone. A null conv_id is larger than all; its text in a list is ``null``. conv_ids are distinct; equal
    conversations are members of the same nodes. No conversation gives no row. A conversation's ids (``WIDTH`` bytes a
    turn) are in one task; nothing else is.
    """
    shared.shipped(conversations.sparkSession)
    trees = shared.stored(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "ids").mapInArrow(_grown, NODE))
    same = Window.partitionBy("node")
    order = lambda c: F.struct(F.col(c).isNull().alias("unknown"), F.col(c).alias("id"))
    smallest = F.min(order("least")).over(same)
    known = trees.select(
        "tree", "nth", "node", "depth", "bytes", "members",
        smallest["id"].alias("least"), F.max("inner").over(same).alias("inner"), (order("least") == smallest).alias("own"),
    )
    sums = (
        known.repartition(_tasks(trees), "tree")
        .sortWithinPartitions("tree", "nth")
        .drop("nth")
        .mapInArrow(_summed, SUMS)
        .groupBy("node")
        .agg(
            F.max("depth").alias("depth"),
            F.max("least").alias("conv_id"),
            F.max("parent_least").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("members", "children", "leaves", "saved")],
        )
    )
    return sums.join(ends(trees), "node", "left").select(
        "node",
        "conv_id",
        "depth",
        "parent_conv_id",
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of lists (node, text), in order -> node, digest of its whole list; one piece is held at a time."""
    node, digest = None, None

    def made(nodes: list, digests: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        nodes, digests = [], []
        for found, text in zip(batch.column(0), batch.column(1), strict=True):
            found = found.as_py()
            if found == node:
                digest.update(b",")
            else:
                if digest is not None:
                    nodes.append(node)
                    digests.append(digest.hexdigest())
                node, digest = found, hashlib.sha256()
            digest.update(text.as_py().encode())
        yield made(nodes, digests)
    if digest is not None:
        yield made([node], [digest.hexdigest()])


def ends(trees: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the members that end at each node, where any do.

    Members are put in order piece by piece, so that no task sorts the members of a node; the pieces of one node then
    pass one task one after another, as the digest of a list asks for.
    """
    each = trees.where(F.size("ends") > 0).select("node", F.explode("ends").alias("conv_id"))
    listed = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = each.groupBy("node", F.expr(f"conv_id div {PIECE}").alias("piece")).agg(F.array_join(listed, ",").alias("text"))
    unknown = F.col("piece").isNull()  # one id at most
    return (
        pieces.select("node", F.coalesce("piece", F.lit((1 << 63) - 1)).alias("piece"), F.when(unknown, "null").otherwise(F.col("text")).alias("text"))
        .repartition(_tasks(trees), "node")
        .sortWithinPartitions("node", "piece")
        .select("node", "text")
        .mapInArrow(_chained, "node binary, ends_sha256 string")
    )
