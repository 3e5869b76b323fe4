"""The prefix trie against a trie built conversation by conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lapsewise.llm import queries, shared, trie

TURNS = "conv_id long, turn long, role string, text string"


def key_of(turn):
    """As turn_id orders equal turns."""
    role, text = ((x or "").encode() for x in turn)
    return hashlib.md5(str(len(role)).encode() + b":" + role + text).digest() + len(text).to_bytes(4)


def last(c):
    return (c is None, c or 0)


def brute(rows, group=5, most=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append(((turn is not None, turn or 0), key_of((role, text)), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        path = turns
        if c is not None:
            h = zlib.crc32(str(c).encode()) % most
            path = own.get(c - c % group, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    smallest = lambda path: min(members[path], key=last)

    def subtree(path):
        todo = [path]
        while todo:
            p = todo.pop()
            yield p
            todo += below[p]

    out = []
    for path, who in members.items():
        under = list(subtree(path))
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in under)
        listed = ",".join("null" if c is None else str(c) for c in sorted(ends[path], key=last))
        sha = hashlib.sha256(listed.encode()).hexdigest()
        parent = smallest(path[:-1]) if path else None
        out.append((smallest(path), len(path), parent, len(who), len(below[path]), sum(not below[p] for p in under), saved, sha))
    return sorted(out, key=repr)


def random_turns(seed, convs=120):
    rng = random.Random(seed)
    texts = ["hello", "", None, "wie geht's", "🙂 é", "a longer text of some words", "x" * 300]
    roles = ["user", "assistant", None]
    rows = []
    for c in rng.sample(range(400), convs):
        n = rng.choice([1, 2, 3, 4, 9, 12])
        rows += [(c, k, roles[k % 2], rng.choice(texts[:3] if k < 2 else texts)) for k in range(n)]
    rows += [(c, k, "user", f"copy {k}") for c in range(1000, 1040) for k in range(10)]
    rows += [(2000 + k, None, "user", "no turn") for k in range(4)]
    rows += [(2003, 1, None, None), (2003, 1, None, None), (2003, 1, "b", "tie"), (None, 3, "user", "hello"), (None, None, None, None)]
    rows += [(3000, k, "user", rng.choice(texts)) for k in range(500)]
    rng.shuffle(rows)
    return rows


def as_table(spark, rows, clashing=False):
    if not clashing:
        return spark.createDataFrame(rows, TURNS)
    extra = (1, "t", 2, b"n", [3], 4)
    return spark.createDataFrame([r + extra for r in rows], TURNS + ", family long, tree string, nth long, node binary, ids array<long>, depth long")


def nodes_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed, keys, clashing", [(1, 50_000, False), (2, 7, True), (3, 1, False)])
def test_query(spark, tmp_path, monkeypatch, seed, keys, clashing):
    rows = random_turns(seed)
    as_table(spark, rows, clashing).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    if keys < 50_000:  # tasks see the bound in a module of their own
        shared.shipped(spark)
        grown = trie._grown

        def bounded(batches):
            from lapsewise.llm import trie as module

            module.TREE_KEYS = keys
            yield from grown(batches)

        monkeypatch.setattr(trie, "_grown", bounded)
        monkeypatch.setattr(trie, "PIECE", 5)
    got = nodes_of(queries.op12_prefix_trie(spark, str(tmp_path)))
    want = brute(rows)
    assert len(got) == len(want)
    assert got == want


def test_no_conversations(spark, tmp_path):
    as_table(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("children", [1, 4, 5, 16, 17, 48, 49, 256])
def test_layouts_grow(children):
    tree = trie.Tree()
    order = list(range(children))
    random.Random(children).shuffle(order)
    for k in order:
        tree.insert(bytes([k]) * trie.WIDTH, k)
    tree.insert(b"", -1)
    size = next(n for n in (4, 16, 48, 256) if children <= n)
    assert tree.root.layout == size
    assert [b for b, _ in tree.root.children()] == list(range(children))
    assert all(tree.root.child(k).ends == [k] for k in range(children)) and children == 256 or tree.root.child(children) is None
    found = list(tree.nodes())
    assert [(depth, members, least, ends) for _, depth, _, members, least, _, ends in found] == [(0, children + 1, -1, [-1]), *[(1, 1, k, [k]) for k in range(children)]]


def test_paths_part_inside_an_id_and_emit_whole_ids_only():
    a, b = b"\x01" * 19 + b"\x02", b"\x01" * 19 + b"\x03"
    tree = trie.Tree()
    for member, key in enumerate([a + a + a, a + a + b, a + b, a, a + a + a]):
        tree.insert(key, member)
    found = [(depth, members, least, inner, ends) for _, depth, _, members, least, inner, ends in tree.nodes()]
    assert found == [(0, 5, 0, True, []), (1, 5, 0, True, [3]), (2, 3, 0, True, []), (3, 2, 0, False, [0, 4]), (3, 1, 1, False, [1]), (2, 1, 2, False, [2])]


def test_ids_tell_role_from_text(spark):
    pairs = [("a", "bc"), ("ab", "c"), ("", "abc"), ("1:", "a"), ("1", ":a"), (None, "x"), ("", "x")]
    df = spark.createDataFrame(pairs, "role string, text string")
    ids = [bytes(r[0]) for r in df.select(trie.turn_id(df.role, df.text)).collect()]
    assert ids == [key_of(p) for p in pairs]
    assert len(set(ids)) == len(pairs) - 1 and all(len(i) == trie.WIDTH for i in ids)
