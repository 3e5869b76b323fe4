"""Token ids, packing and the token store, against the library on whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from odd_tables import no_docs, odd_docs, odd_rows  # noqa: F401
from tokenizers import Tokenizer

from lapsewise.llm import bpe, pack, store
from lapsewise.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def whole():
    """Ids of a whole text and the end id."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_words_have_the_ids_of_the_whole_text(whole):
    rng = random.Random(1)
    letters = list("ab'sStdmrevl  \n\t  é1²,.!??<|>ßЖ漢字😀\x1c​ 　")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", None, "don't they've 's 't", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>'s", "<|endoftext", "|>", "end <|endoftext|>", "<|endoftext|>  two", "x'", "'", " '", "''s", "'reading", "a\n\n  b "]
    encoder = bpe.Encoder(VOCABULARY)
    texts += ["".join(rng.choices(["<|endoftext|>", "<|", "endoftext", "|>", " ", "'s", "a", "\n", "é"], k=rng.randint(1, 12))) for _ in range(1500)]
    for _ in range(2):  # the second time from memory
        ids, at = encoder.encode(pa.array(texts, pa.string()))
        assert at[-1] == len(ids)
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == whole(text).tolist(), repr(text)


def test_memory_begins_anew_when_full(whole, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 5)
    encoder = bpe.Encoder(VOCABULARY)
    for text in ["one two three four", "five six seven eight nine ten", "one two"]:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == whole(text).tolist()


def pieces_of(rows):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    return by_doc, by_sequence


@pytest.mark.parametrize("window", [1024, 16])
def test_packing_holds_every_id_once_without_padding(spark, odd_docs, whole, window):
    rows = pack.pack(odd_docs, VOCABULARY, window, with_ids=True).collect()
    _, by_sequence = pieces_of(rows)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        filled = sum(r.length for r in pieces)
        assert filled <= window and filled & (filled - 1) == 0
    texts = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        texts[doc_id].append(whole(text))
    got = defaultdict(lambda: defaultdict(int))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        assert any(len(t) == r.doc_tokens and (t[r.start : r.start + r.length] == ids).all() for t in texts[r.doc_id])
        got[r.doc_id][r.doc_tokens] += r.length
    for doc_id, found in texts.items():
        want = defaultdict(int)
        for t in found:
            want[len(t)] += len(t)
        assert got[doc_id] == want


def test_levels_take_the_smallest_sum_of_squares():
    rng = random.Random(2)
    window = 12
    levels = pack.Levels(window)
    counts = [0] * (window + 1)
    for number in range(400):
        size = rng.randint(1, window - 1)

        def cost(level, size=size):
            after = counts.copy()
            after[level] -= level > 0
            after[level + size] += level + size < window
            return sum(c * c for c in after)

        open_levels = [0] + [h for h in range(1, window - size + 1) if counts[h]]
        level, _ = levels.place(size)
        assert level in open_levels and cost(level) == min(map(cost, open_levels))
        counts[level] -= level > 0
        counts[level + size] += level + size < window
        levels.put(level + size, number)
        assert levels.counts[1:window].tolist() == counts[1:window]


def test_window_must_be_a_power_of_two(odd_docs):
    with pytest.raises(ValueError):
        pack.pack(odd_docs, VOCABULARY, 1000)


def test_nothing_to_pack(no_docs):
    assert pack.pack(no_docs, VOCABULARY).count() == 0


@pytest.mark.parametrize("kind", ["text", "one id", "two ids in turn", "random", "few", "runs"])
def test_grammar_round_trip_and_random_access(kind, whole):
    rng = np.random.default_rng(5)
    ids = {
        "text": whole("the cat sat on the mat and the dog sat on the log " * 400),
        "one id": np.full(5000, 7, np.uint32),
        "two ids in turn": np.tile(np.array([1, 2], np.uint32), 3000),
        "random": rng.integers(0, 50_257, 20_000).astype(np.uint32),
        "few": np.array([3], np.uint32),
        "runs": np.repeat(rng.integers(0, 5, 500), rng.integers(1, 9, 500)).astype(np.uint32),
    }[kind]
    grammar = store.compress(ids)
    assert (store.expand(grammar) == ids).all()
    for _ in range(50):
        low, high = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (store.expand(grammar, low, high) == ids[low:high]).all()
    if kind == "text":
        assert len(grammar["rules"]) and len(grammar["symbols"]) < len(ids) / 4
        assert grammar["lengths"][grammar["symbols"]].sum() == len(ids)


@pytest.mark.parametrize("kind", ["one id", "repeated", "runs"])
def test_no_frequent_pair_stays(kind):
    rng = np.random.default_rng(6)
    ids = {
        "one id": np.full(1 << 18, 7, np.uint32),
        "repeated": np.tile(rng.integers(0, 9, 30_000), 20).astype(np.uint32),
        "runs": np.repeat(rng.integers(0, 5, 5000), rng.integers(1, 40, 5000)).astype(np.uint32),
    }[kind]
    grammar = store.compress(ids)
    assert (store.expand(grammar) == ids).all()
    seen, left = defaultdict(int), None
    for pair in zip(grammar["symbols"][:-1].tolist(), grammar["symbols"][1:].tolist(), strict=True):
        left = None if left == pair and pair[0] == pair[1] else pair  # equal symbols do not overlap
        seen[pair] += left is not None
    assert max(seen.values(), default=0) < store.LEAST


def test_store_round_trip(spark, odd_docs, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SHARD_IDS", 700)
    path = str(tmp_path / "tokens")
    store.write(odd_docs, VOCABULARY, path)
    rows = sorted(store.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    known = sorted((r.doc_id is not None, r.doc_id or 0) for r in rows)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == known
    before = 0
    texts = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        texts[doc_id].append(whole(text).tobytes())
    for r in rows:
        assert r.start == before and r.n_tokens * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        texts[r.doc_id].remove(bytes(r.ids))
        before += r.n_tokens
    assert not any(texts.values())
    shard = next(s.asDict() for s in spark.read.parquet(path).collect() if 1003 in s.doc_ids)
    assert store.one_document(shard, 1003).tobytes() in {bytes(r.ids) for r in rows if r.doc_id == 1003}


def test_empty_store(spark, no_docs, tmp_path):
    store.write(no_docs, VOCABULARY, str(tmp_path / "none"))
    assert store.read(spark, str(tmp_path / "none")).count() == 0
