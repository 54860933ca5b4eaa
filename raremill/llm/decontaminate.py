"""Benchmark decontamination by random-walk embedding and bit sampling (operator 5).

A CGK walk reads a word sequence from a start: step j emits the word at the cursor and
moves on by a random bit drawn from (repetition, j, word). Sequences at small edit distance
then agree in most steps. Each repetition samples a few steps of its own walk as a bucket
key, per class of lengths, so windows as long as the item meet it in some repetition
with the wanted recall. Walks of long sequences drift apart, so items of more than ``PIECE`` words are
sought by their pieces: one of them has at most its share of the edits. A fitting alignment of the whole item in the
text then decides exactly.

A lossless test comes first: an edit breaks at most two pairs of neighbouring words, so a
window can hold an item of n words with e edits only if n - 1 - 2e of its word pairs are
pairs of the benchmark.

Texts are compared as lower-cased runs of letters and digits. An item of n words is found
where a stretch of the text lies within floor(``max_ratio`` * n) word edits. Items of fewer
than ``min_words`` words cannot identify a text and are not searched. Null and empty texts
and items match nothing; repeated rows are each searched; an empty benchmark finds nothing.
Items go to the tasks in blocks of at most ``block_words`` words (one item at least), one
pass over the documents each.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import map_rows

_WORD = re.compile(r"\w+")
_STEPS = 3
_CLASS_RATIO = 1.15
#: Words of an item, or of a piece of one, that one walk reads.
PIECE = 24
LEAK_SCHEMA = "doc_id long, item_id long, start_word int, n_words int, edits int"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repetitions(recall: float, max_ratio: float) -> int:
    """Repetitions that reach ``recall`` when the walks differ in about 2.2 steps of a
    hundred for each edit in a hundred words (measured; see the tests)."""
    same = (1 - min(0.9, 2.2 * max_ratio)) ** _STEPS
    return math.ceil(math.log(1 - recall) / math.log(1 - same))


def fitting_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits between ``item`` and a stretch of ``text``; its start and end."""
    m = len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for word in item:
        new = cost + 1
        at = start.copy()
        hit = cost[:-1] + (text != word)
        better = hit <= new[1:]
        new[1:] = np.where(better, hit, new[1:])
        at[1:] = np.where(better, start[:-1], at[1:])
        # extra words in the text: running minimum of cost less position
        low = new - steps
        best = np.minimum.accumulate(low)
        origin = np.maximum.accumulate(np.where(low == best, steps, 0))
        cost, start = best + steps, at[origin]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Index:
    """Bucket keys of one block of items, and the search for them in texts."""

    def __init__(self, items: list[tuple[int, list[str]]], max_ratio: float, recall: float, seed: int):
        self.max_ratio, self.reps = max_ratio, repetitions(recall, max_ratio)
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        # pieces as (item, first word, words)
        self.pieces = [
            (k, int(a), c[a:b]) for k, c in enumerate(self.items)
            for a, b in itertools.pairwise(np.linspace(0, len(c), math.ceil(len(c) / PIECE) + 1).astype(int))
        ]
        sizes = np.array([len(c) for _, _, c in self.pieces])
        self.pairs = np.unique(np.concatenate([self._paired(c) for c in self.items]))
        # class c holds lengths from low[c] to below low[c + 1]
        low = [int(sizes.min())]
        while low[-1] <= sizes.max():
            low.append(max(low[-1] + 1, int(low[-1] * _CLASS_RATIO)))
        self.low = np.array(low)
        self.bags = [frozenset(c.tolist()) for c in self.items]
        self.used = np.unique(np.searchsorted(self.low, sizes, side="right") - 1)
        draw = np.random.default_rng(seed)
        self.salt = draw.integers(1, 1 << 63, size=self.reps, dtype=np.uint64)
        # a walk of n steps reads about n / 2 words
        self.steps = {
            int(c): np.sort(draw.integers(0, max(1, int(1.5 * self.low[c])), size=(self.reps, _STEPS)), axis=1)
            for c in self.used
        }
        keys, owners = [], []
        for c in self.used:
            own = [k for k, n in enumerate(sizes) if self.low[c] <= n < self.low[c + 1]]
            longest = max(len(self.pieces[k][2]) for k in own)
            padded = np.zeros((len(own), longest + 1), np.int64)
            for row, k in enumerate(own):
                padded[row, : len(self.pieces[k][2])] = self.pieces[k][2]
            starts = np.arange(len(own)) * (longest + 1)
            found = self._keys(padded.ravel(), {int(c): starts})[int(c)]
            keys.append(found.ravel())
            owners.append(np.tile(np.array(own), self.reps))
        self.keys, self.owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]

    def _paired(self, codes: np.ndarray) -> np.ndarray:
        return codes[:-1] * (len(self.vocabulary) + 1) + codes[1:]

    def _keys(self, codes: np.ndarray, starts: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Keys (repetition, start) of the walks from ``starts`` of each length class."""
        every = np.unique(np.concatenate(list(starts.values())))
        cursor = np.tile(every, (self.reps, 1))
        last = max(int(self.steps[c].max()) for c in starts)
        walk = np.empty((last + 1, *cursor.shape), np.int64)
        for j in range(last + 1):
            word = walk[j] = codes[np.minimum(cursor, len(codes) - 1)]
            mixed = _mix((word.astype(np.uint64) << np.uint64(20)) + np.uint64(j) + self.salt[:, None])
            cursor += (mixed >> np.uint64(63)).astype(np.int64)
        out, reps = {}, np.arange(self.reps)[:, None]
        for c, own in starts.items():
            place = np.searchsorted(every, own)
            key = np.tile((self.salt * np.uint64(c + 1))[:, None], (1, len(own)))
            for k in range(_STEPS):
                value = walk[self.steps[c][:, k : k + 1], reps, place]
                key = _mix(key * np.uint64(31) + value.astype(np.uint64))
            out[c] = key
        return out

    def find(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, start word, words, edits) of each place found."""
        get = self.vocabulary.get
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum():
            return
        codes = np.array([get(w, 0) for t in texts for w in t], np.int32).astype(np.int64)
        ends = np.cumsum(sizes)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        pairs = self._paired(codes)
        found = (codes[:-1] > 0) & (codes[1:] > 0)
        both = pairs[found]
        found[found] = self.pairs[np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)] == both
        known = np.concatenate([[0], np.cumsum(found), [found.sum()]])
        position = np.arange(len(codes))
        starts = {}
        for c in map(int, self.used):
            low, slack = int(self.low[c]), int(self.max_ratio * (self.low[c + 1] - 1))
            reach = np.minimum(position + low + slack, ends[text_of]) - 1
            enough = known[reach] - known[position] >= low - 1 - 2 * slack
            if enough.any():
                starts[c] = position[enough]
        if not starts:
            return
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for c, keys in self._keys(codes, starts).items():
            left = np.searchsorted(self.keys, keys, side="left")
            right = np.searchsorted(self.keys, keys, side="right")
            for r, k in zip(*np.nonzero(right > left), strict=True):
                at = int(starts[c][k])
                text = int(text_of[at])
                for piece in np.unique(self.owners[left[r, k] : right[r, k]]):
                    item, ahead, _ = self.pieces[piece]
                    seen = done.setdefault((text, item), [])
                    start = at - ahead  # but for edits before the piece
                    if any(a <= start < b for a, b in seen):
                        continue
                    n = len(self.items[item])
                    budget = int(self.max_ratio * n)
                    first = int(ends[text] - sizes[text])
                    a, b = max(first, start - budget - 2), min(int(ends[text]), start + n + 2 * budget + 2)
                    bag = self.bags[item]
                    if len(bag.intersection(codes[a:b].tolist())) < len(bag) - budget:
                        continue  # each edit loses one word at most
                    edits, s, e = fitting_edits(self.items[item], codes[a:b])
                    # from here on this stretch needs no second look
                    seen.append((start, start + 1))
                    placed = places.setdefault((text, item), [])
                    if edits <= budget and not any(a + s < y and x < a + e for x, y in placed):
                        placed.append((a + s, a + e))
                        # another place that starts here would overlap this one
                        seen.append((a + s - budget, a + e))
                        yield text, item, a + s - first, e - s, edits


def _blocks(benchmark: DataFrame, min_words: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        words = words_of(row.text)
        if len(words) < min_words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row.item_id, words))
        size += len(words)
    if block:
        yield block


def _indexes(docs, benchmark, id_col, text_col, max_ratio, recall, min_words, block_words, seed):
    items = benchmark.select(
        F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")
    )
    for block in _blocks(items, min_words, block_words):
        yield Index(block, max_ratio, recall, seed)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    max_ratio: float = 0.2,
    recall: float = 0.99,
    min_words: int = 5,
    block_words: int = 1_000_000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each place where a document holds a benchmark item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(docs, benchmark, item_col, item_text_col, max_ratio, recall, min_words, block_words, seed):

        # the index travels with the function, code and all
        def make(own=index):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column(0).to_pylist()
                hits = list(own.find([words_of(t) for t in batch.column(1).to_pylist()]))
                columns = zip(*((ids[t], own.ids[i], s, n, e) for t, i, s, n, e in hits), strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                names = ["doc_id", "item_id", "start_word", "n_words", "edits"]
                filled = list(columns) or [[]] * 5
                arrays = [pa.array(c, k) for c, k in zip(filled, kinds, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, names)

            return step

        found = map_rows(rows, make, LEAK_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAK_SCHEMA)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    max_ratio: float = 0.2,
    recall: float = 0.99,
    min_words: int = 5,
    block_words: int = 1_000_000,
    seed: int = 7,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay."""
    at = docs.columns.index(text_col)
    for index in _indexes(docs, benchmark, "item_id", "text", max_ratio, recall, min_words, block_words, seed):

        # the index travels with the function, code and all
        def make(own=index):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                texts = [words_of(t) for t in batch.column(at).to_pylist()]
                held = np.ones(len(texts), bool)
                held[[hit[0] for hit in own.find(texts)]] = False
                return batch.filter(pa.array(held))

            return step

        docs = map_rows(docs, make, docs.schema)
    return docs
