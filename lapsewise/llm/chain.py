"""Linear-chain conditional random fields over words, trained and run on whole arrays.

Words are runs of letters, lower-cased. A word's features are its spelling, its first and last letters, its runs of
three bytes and its place in lists of telling words; each has a learned weight for each label, and each pair of
neighbouring labels has a learned transition. Forward-backward gives the probability of each label for each word.
Features depend on the spelling alone, so they are computed once per distinct word of a chunk of texts.

Sequences of at most ``SEQUENCE`` words are worked on side by side, which bounds the steps of the recursion. Training
sequences are so long; a text's own chain is whole: what one stretch of it hands to the next, forward and backward, is
computed from the product of its steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lapsewise.llm import spans

SEQUENCE = 128
#: Hashed features.
BUCKETS = 1 << 18
AFFIX = 3
GRAM = 3
#: Occurrences from which a feature learns at the full rate.
RARE = 10
#: Occurrences among the training words from which a spelling is a feature. Rarer ones are told by their parts, in
#: training as later, so that parts learn what they say of words never seen.
KNOWN = 5


@dataclass
class Words:
    """Words of some texts: spans in the lower-cased bytes, index of spelling, and the spellings' bytes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    which: np.ndarray
    spelled: np.ndarray
    spelled_at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = spans.utf8(pc.utf8_lower(spans.texts(column)))
        starts, ends = spans.letter_words(data, offsets)
        which, spellings = spans.distinct(data, starts, ends)
        return cls(data, offsets, starts, ends, which, *spans.content_of(spellings))

    def hashes(self) -> np.ndarray:
        return spans.hashes(self.spelled, self.spelled_at, 3)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), spans.counts_by_text(self.starts, self.offsets))

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and length of each sequence: each text's words in stretches of SEQUENCE."""
        counts = spans.counts_by_text(self.starts, self.offsets)
        parts = -(-counts // SEQUENCE)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(np.cumsum(counts) - counts, parts) + nth * SEQUENCE
        length = np.minimum(np.repeat(counts, parts) - nth * SEQUENCE, SEQUENCE)
        return first, length

    def code_points(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Places in the bytes as code points from the start of their text (lower-casing keeps their number)."""
        leads = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=leads[1:])
        return leads[at] - leads[self.offsets[text]]


def _bucket(x: np.ndarray, seed: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (spans.mixed(x * odd + np.uint64(seed)) % np.uint64(BUCKETS)).astype(np.int32)


def features(data: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of spellings: a fixed number each, and byte n-grams with where each spelling's begin.

    Affixes that are as long as the word or longer are left to the word itself (the last bucket has no weight).
    """
    n, lengths = len(at) - 1, np.diff(at)
    fixed = np.full((n, 1 + 2 * AFFIX), BUCKETS, np.int32)
    fixed[:, 0] = _bucket(hashes, 0)
    left = np.zeros(n, np.uint64)
    right = np.zeros(n, np.uint64)
    for k in range(1, AFFIX + 1):
        some = lengths > k
        left[some] = left[some] << np.uint64(8) | data[at[:-1][some] + k - 1].astype(np.uint64)
        right[some] = right[some] << np.uint64(8) | data[at[1:][some] - k].astype(np.uint64)
        fixed[some, k] = _bucket(left[some], k)
        fixed[some, AFFIX + k] = _bucket(right[some], AFFIX + k)
    grams = np.maximum(lengths - GRAM + 1, 0)
    gram_at = np.concatenate([[0], np.cumsum(grams)])
    place = np.arange(gram_at[-1]) + np.repeat(at[:-1] - gram_at[:-1], grams)
    code = np.zeros(len(place), np.uint64)
    for k in range(GRAM):
        code = code << np.uint64(8) | data[place + k].astype(np.uint64)
    return fixed, _bucket(code, 50), gram_at


@dataclass
class Chain:
    """A trained field: weights of features by label, of lists of telling words, of labels and of transitions."""

    labels: list
    weights: np.ndarray
    listed: np.ndarray
    lists: list[np.ndarray]
    #: Hashes of the spellings that are features, sorted.
    known: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray

    def _in_lists(self, hashes: np.ndarray) -> np.ndarray:
        return np.stack([np.isin(hashes, x) for x in self.lists], 1).astype(np.float32)

    def features(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fixed, grams, gram_at = features(words.spelled, words.spelled_at, hashes)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            fixed[self.known[place] != hashes, 0] = BUCKETS
        else:
            fixed[:, 0] = BUCKETS
        return fixed, grams, gram_at

    def scores(self, words: Words) -> np.ndarray:
        """Score of each label for each spelling."""
        hashes = words.hashes()
        return _scores(self, *self.features(words, hashes), self._in_lists(hashes))

    def marginals(self, words: Words) -> np.ndarray:
        """Probability of each label for each word, by forward-backward."""
        if len(words.starts) == 0:
            return np.zeros((0, len(self.labels)), np.float32)
        first, length = words.sequences()
        nth = np.concatenate([[0], np.where(np.diff(words.text_of()[first]) == 0, 1, 0)]).astype(np.int64)
        nth = _counted(nth)
        scores = self.scores(words)
        entry, exit_ = _handed_on(scores, words.which, first, length, nth, self.transitions)
        return forward_backward(scores, words.which, first, length, self.transitions, entry, exit_)[0]


def _scores(model: Chain, fixed, grams, gram_at, listed) -> np.ndarray:
    out = model.bias + listed @ model.listed
    for k in range(fixed.shape[1]):
        out = out + model.weights[fixed[:, k]]
    some = np.diff(gram_at) > 0
    if some.any():
        out[some] += np.add.reduceat(model.weights[grams], gram_at[:-1][some], axis=0) / np.diff(gram_at)[some, None]
    return out


def _counted(goes_on: np.ndarray) -> np.ndarray:
    """Number of ones in a row up to each place."""
    total = np.cumsum(goes_on)
    return total - np.maximum.accumulate(np.where(goes_on == 0, total, 0))


def _factors(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of labels for each spelling and of steps between labels; at most 30 apart, so that no product of three vanishes."""
    emit = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30)).astype(np.float32)
    step = np.exp(np.maximum(transitions - transitions.max(), -30)).astype(np.float32)
    return emit, step


def _handed_on(scores, which, first, length, nth, transitions) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch gets from the one before it in its text, and from the one after it (ones at a text's ends).

    ``nth`` numbers the stretches of each text, which stand in order.
    """
    labels, n = scores.shape[1], len(first)
    entry, exit_ = np.ones((n, labels), np.float32), np.ones((n, labels), np.float32)
    if not nth.any():
        return entry, exit_
    emit, step = _factors(scores, transitions)
    # products of the steps into and through each stretch that follows another, and the state that a text's first leaves
    own = np.flatnonzero((nth > 0) | np.concatenate([nth[1:] > 0, [False]]))
    own = own[np.argsort(-length[own], kind="stable")]
    through = np.broadcast_to(np.eye(labels, dtype=np.float32), (n, labels, labels)).copy()
    inner = nth[own] > 0
    active = np.searchsorted(-length[own], -np.arange(int(length[own[0]])), side="left")
    for t, a in enumerate(active):
        rows = own[:a]
        moved = through[rows] @ step if t else np.where(inner[:a, None, None], through[rows] @ step, through[rows])
        moved = moved * emit[which[first[rows] + t]][:, None, :]
        through[rows] = moved / moved.sum((1, 2), keepdims=True)
    in_turn = np.argsort(nth, kind="stable")
    turns = np.split(in_turn, np.cumsum(np.bincount(nth))[:-1])
    for k, at in enumerate(turns[1:], 1):
        left = np.einsum("ij,ijk->ik", entry[at - 1] if k > 1 else np.ones((len(at), labels), np.float32), through[at - 1])
        entry[at] = left / left.sum(1, keepdims=True)
    for at in turns[:0:-1]:
        right = np.einsum("ijk,ik->ij", through[at], exit_[at])
        exit_[at - 1] = right / right.sum(1, keepdims=True)
    # the state before a first word is that after the step to it
    entry[nth > 0] = entry[nth > 0] @ step
    return entry, exit_


def forward_backward(scores, which, first, length, transitions, entry=None, exit_=None):
    """Marginals of all words, and expected numbers of each pair of neighbouring labels.

    ``entry`` and ``exit_`` weigh the labels of each sequence's first and last word by what stands around it.
    """
    labels = scores.shape[1]
    emit, step = _factors(scores, transitions)
    order = np.argsort(-length, kind="stable")
    entry = np.ones((len(first), labels), np.float32) if entry is None else entry[order]
    first, length = first[order], length[order]
    longest = int(length[0])
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than t
    forward = np.empty((len(which), labels), np.float32)
    backward = np.ones((len(which), labels), np.float32)
    if exit_ is not None:
        backward[first + length - 1] = exit_[order]
    state = entry
    for t in range(longest):
        a = active[t]
        state = emit[which[first[:a] + t]] * (state[:a] if t == 0 else state[:a] @ step)
        state /= state.sum(1, keepdims=True)
        forward[first[:a] + t] = state
    pairs = np.zeros((labels, labels))
    for t in range(longest - 2, -1, -1):
        a = active[t + 1]
        at = first[:a] + t
        later = emit[which[at + 1]] * backward[at + 1]
        back = later @ step.T
        total = (forward[at] * back).sum(1, keepdims=True)
        pairs += step * (forward[at].T @ (later / total))
        backward[at] = back / back.sum(1, keepdims=True)
    both = forward * backward
    return both / both.sum(1, keepdims=True), pairs


def train(words: Words, truth: np.ndarray, labels: list, lists: list[np.ndarray], rounds: int = 30, rate: float = 0.3,
          decay: float = 1e-3, joined: bool = False) -> Chain:
    """Fits a field to labelled words by Adam on the likelihood.

    Sequences are those of ``words``; with ``joined`` they run on from text to text.
    """
    k = len(labels)
    hashes = words.hashes()
    known = np.sort(hashes[np.bincount(words.which, minlength=len(hashes)) >= KNOWN])
    model = Chain(labels, np.zeros((BUCKETS + 1, k), np.float32), np.zeros((len(lists), k), np.float32), lists, known,
                  np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    fixed, grams, gram_at = model.features(words, hashes)
    listed = model._in_lists(hashes)
    if len(truth) == 0:
        return model
    first, length = words.sequences()
    if joined:
        first = np.arange(0, len(truth), SEQUENCE)
        length = np.minimum(len(truth) - first, SEQUENCE)
    one_hot = np.eye(k, dtype=np.float32)[truth]
    inside = np.ones(len(truth), bool)
    inside[first] = False
    second = np.flatnonzero(inside)
    seen = np.bincount(truth[second - 1] * k + truth[second], minlength=k * k).reshape(k, k)
    spellings = len(hashes)
    per_word = 1.0 / len(truth)
    gram_of = np.repeat(np.arange(spellings), np.diff(gram_at))
    gram_share = (1.0 / np.maximum(np.diff(gram_at), 1))[gram_of]
    parts = ["weights", "listed", "bias", "transitions"]
    moment = {p: [np.zeros_like(getattr(model, p)), np.zeros_like(getattr(model, p))] for p in parts}
    for turn in range(1, rounds + 1):
        found, pairs = forward_backward(
            _scores(model, fixed, grams, gram_at, listed), words.which, first, length, model.transitions
        )
        miss = one_hot - found
        by_spelling = np.stack([np.bincount(words.which, miss[:, c], spellings) for c in range(k)], 1) * per_word
        slope = np.zeros_like(model.weights)
        for c in range(k):
            slope[:, c] = np.bincount(fixed.ravel(), np.repeat(by_spelling[:, c], fixed.shape[1]), BUCKETS + 1)
            slope[:, c] += np.bincount(grams, by_spelling[gram_of, c] * gram_share, BUCKETS + 1)
        slope[BUCKETS] = 0
        slopes = {
            "weights": slope - decay * per_word * model.weights,
            "listed": (listed.T @ by_spelling).astype(np.float32),
            "bias": by_spelling.sum(0).astype(np.float32),
            "transitions": ((seen - pairs) * per_word).astype(np.float32),
        }
        for part in parts:
            mean, square = moment[part]
            mean += 0.1 * (slopes[part] - mean)
            square += 0.01 * (slopes[part] ** 2 - square)
            size = np.sqrt(square / (1 - 0.99**turn)) + RARE * per_word  # what is seen less often moves less
            getattr(model, part)[...] += rate * (mean / (1 - 0.9**turn)) / size
    return model
