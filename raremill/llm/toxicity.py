"""Toxicity by nearest labelled examples (operator 7).

Terms are lower-cased words and, for words of more than five letters, their first five
letters with a mark. All terms of a bounded sample of labelled rows count. A term weighs
(1 + ln tf) * idf * strength in a vector: document frequencies are taken over all
documents, and the strength, between ``FAINT`` and 1, rises with the term's chi-square
among the examples if it leans to toxic ones. A text's score is a vote of its
``neighbours`` nearest examples by exact cosine, weighted by similarity and calibrated by
a logistic curve on votes that leave each example out of its own vote.

The search is exact: posting lists hold each term's examples, and all that a text's terms
meet are summed. Lists of frequent terms are dense rows, multiplied for a batch of texts at
once. Ties go to the smaller example number. ``train_and_score`` counts the terms of its texts
once, for the document frequencies and for their scores.

A text that shares no term with any example, among them null and empty ones, gets the
share of toxic examples among examples without terms, or among all if each has one.
Without labelled rows every score is 0. Repeated rows score alike; only the text is read
for a score, the whole of it however long. Labels that are null count as absent; of
several labels of one id the largest holds, and of several texts of one id the one whose
terms come first in order. Extra columns are ignored. The model is as large as the term
lists of its examples.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import int_lists, map_rows, stored

_WORD = re.compile(r"\w+")
_REMEMBERED = 50_000
#: A term of one example in this many has a dense row.
_DENSE = 8
#: Texts multiplied at once.
_AT_ONCE = 64
#: Least strength of a term, and the chi-square at which it is a half.
FAINT = 0.02
HALF = 30.0
#: Terms of this chi-square (one in a thousand by chance) are named as evidence.
TELLING = 10.83


def terms_of(word: str) -> list[str]:
    return [word, f"{word[:5]}~"] if len(word) > 5 else [word]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Vectors:
    """Term frequencies of texts over a fixed vocabulary; remembers words it has seen."""

    def __init__(self, vocabulary: list[str]):
        self.at = {t: k for k, t in enumerate(vocabulary)}
        self._seen: dict[str, tuple[int, ...]] = {}

    def _look(self, word: str) -> tuple[int, ...]:
        own = self._seen[word] = tuple(self.at[t] for t in terms_of(word) if t in self.at)
        return own

    def counts(self, text: str | None) -> dict[int, int]:
        if len(self._seen) > _REMEMBERED:
            self._seen = {}
        get, out = self._seen.get, {}
        for word, tf in Counter(words_of(text)).items():
            own = get(word)
            for k in self._look(word) if own is None else own:
                out[k] = out.get(k, 0) + tf
        return out

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The same as places in the vocabulary, rising, and frequencies."""
        return _arrays(self.counts(text))


def _arrays(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.fromiter(counts.keys(), np.int32, len(counts))
    tf = np.fromiter(counts.values(), np.int32, len(counts))
    by = np.argsort(at)
    return at[by], tf[by]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


class Postings:
    """Posting lists of the examples' terms. Terms of one example in ``_DENSE`` or more have
    a row of all examples instead."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n = n
        df = np.bincount(term, minlength=n_terms)
        frequent = np.flatnonzero((df * _DENSE >= n) & (df > 0))
        self.row = np.full(n_terms, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        dense = self.row[term] >= 0
        self._cells = self.row[term[dense]], example[dense].astype(np.int32), weight[dense]
        self._rows = len(frequent)
        example, term, weight = example[~dense], term[~dense], weight[~dense]
        by = np.lexsort((example, term))
        self.place = example[by].astype(np.int32)
        self.weight = weight[by]
        self.term = np.searchsorted(term[by], np.arange(n_terms + 1)).astype(np.int32)

    def __getstate__(self):
        return {name: own for name, own in self.__dict__.items() if name != "_dense"}

    @cached_property
    def _dense(self) -> np.ndarray:
        out = np.zeros((self._rows, self.n))
        row, place, weight = self._cells
        out[row, place] = weight
        return out

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Dot products over the frequent terms, of each vector with each example."""
        own = np.zeros((len(vectors), self._rows))
        for k, (at, w) in enumerate(vectors):
            row = self.row[at]
            own[k, row[row >= 0]] = w[row >= 0]
        return own @ self._dense

    def nearest(self, at, w, base: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and dot products of the ``k`` nearest examples that share a term; ``base``
        holds the vector's dot products over the frequent terms."""
        rare = self.row[at] < 0
        at, w = at[rare], w[rare]
        length = self.term[at + 1] - self.term[at]
        lists = _ranges(self.term[at], length)
        dots = np.round(np.bincount(self.place[lists], np.repeat(w, length) * self.weight[lists], self.n) + base, 12)
        if skip >= 0:
            dots[skip] = 0
        least = np.partition(dots, self.n - k)[self.n - k] if self.n > k else 0.0
        near = np.flatnonzero((dots > 0) & (dots >= least))
        best = near[np.lexsort((near, -dots[near]))[:k]]
        return best, dots[best]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray
    example_ids: np.ndarray
    toxic: np.ndarray
    postings: Postings | np.ndarray  # or the weights of each example's terms
    neighbours: int
    empty_score: float
    factor: np.ndarray | None = None  # of each term: idf * strength; None: idf
    telling: np.ndarray | None = None  # terms named as evidence
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        if isinstance(self.postings, np.ndarray):
            example, term = np.nonzero(self.postings)
            self.postings = Postings(example, term, self.postings[example, term], *self.postings.shape)
        if self.factor is None:
            self.factor = self.idf
        if self.telling is None:
            self.telling = np.zeros(len(self.terms), bool)

    def vector(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.factor[at]
        return at, w / np.sqrt((w * w).sum())

    def nearest(self, vectors, skip=None):
        """(numbers, cosines) of the nearest examples of each vector."""
        for a in range(0, len(vectors), _AT_ONCE):
            some = vectors[a : a + _AT_ONCE]
            for k, ((at, w), base) in enumerate(zip(some, self.postings.frequent(some), strict=True), a):
                yield self.postings.nearest(at, w, base, self.neighbours, -1 if skip is None else skip[k])

    def votes(self, vectors, skip=None):
        """(vote or None, numbers, cosines) for each vector."""
        for found, cos in self.nearest(vectors, skip):
            yield (float(cos @ self.toxic[found] / cos.sum()) if len(found) else None), found, cos

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, numbers, cosines) of texts given as places of terms and frequencies."""
        out = [(self.empty_score, np.empty(0, np.int64), np.empty(0))] * len(texts)
        some = [k for k, (at, _) in enumerate(texts) if len(at)]
        for k, (vote, found, cos) in zip(some, self.votes([self.vector(*texts[k]) for k in some]), strict=True):
            if vote is not None:
                out[k] = float(_logistic(self.slope * vote + self.offset)), found, cos
        return out

    def score(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        return self.scores([_arrays(counts)])[0]


def _logistic(x):
    return 1 / (1 + np.exp(-x))


def _calibrate(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve through votes, its slope held by a weak prior."""
    a, b = 4.0, -2.0
    x = np.column_stack([votes, np.ones(len(votes))])
    for _ in range(50):
        p = _logistic(a * votes + b)
        grad = x.T @ (p - toxic) + 0.05 * np.array([a - 4.0, b + 2.0])
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _examples(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, toxic, term, tf) of at most ``bound`` labelled documents, chosen by hash."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, y, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counts = Counter(t for w in words_of(text) for t in terms_of(w))
                rows.append((i, y, list(counts), list(counts.values())))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "terms", "tfs"])

        return step

    # the sample is bounded, so it may be broadcast; of rows that repeat an id one stays
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    counted = map_rows(rows, make, "doc_id long, toxic int, terms array<string>, tfs array<int>")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("toxic", "terms", "tfs")).alias("r"))
    return one.select("doc_id", "r.*")


def _labelled(docs: DataFrame, labels: DataFrame, max_examples: int) -> tuple:
    """Ids and labels of the examples, their (example, term, tf) triples and all their terms."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    examples = _examples(docs, labels, max_examples).toArrow().sort_by("doc_id").combine_chunks()
    ids = examples.column("doc_id").to_numpy()
    toxic = examples.column("toxic").to_numpy().astype(float)
    lists = examples.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    named = np.array(coded.dictionary.to_pylist(), dtype=object)
    order = np.argsort(named, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()] if len(named) else np.zeros(0, np.int64)
    terms = named[order].tolist()
    tf = examples.column("tfs").combine_chunks().flatten().to_numpy()
    lengths = lists.value_lengths().to_numpy()
    return ids, toxic, np.repeat(np.arange(len(ids)), lengths), term, tf, terms


def train(docs: DataFrame, labels: DataFrame, max_examples: int = 4096, neighbours: int = 25) -> Model:
    """Model from at most ``max_examples`` labelled documents (chosen by a hash of the id),
    with all their terms; document frequencies are taken over all of ``docs``."""
    examples = _labelled(docs, labels, max_examples)
    return fit(*examples, _idf(_counted(docs, examples[-1]), len(examples[-1])), neighbours)


def train_and_score(docs: DataFrame, labels: DataFrame, max_examples: int = 4096, neighbours: int = 25) -> DataFrame:
    """``docs`` scored by the model that they and ``labels`` train; their terms are counted once and stored."""
    examples = _labelled(docs, labels, max_examples)
    counted = stored(_counted(docs, examples[-1]), "counted", "zstd")
    return _scored(counted, fit(*examples, _idf(counted, len(examples[-1])), neighbours))


def _strength(df: np.ndarray, hits: np.ndarray, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Strength and chi-square (0 if the term does not lean to toxic examples) of terms
    in ``df`` of ``n`` examples, ``hits`` of them toxic."""
    expected = df * share
    spread = expected * (1 - share) * (1 - df / max(n, 1))
    chi2 = np.zeros(len(df))
    leans = (spread > 0) & (hits > expected)
    chi2[leans] = (hits[leans] - expected[leans]) ** 2 / spread[leans]
    return np.maximum(FAINT, chi2 / (chi2 + HALF)), chi2


def fit(ids, toxic, example, term, tf, terms: list[str], idf: np.ndarray, neighbours: int) -> Model:
    """Model of examples given as (example, term, tf) triples."""
    n, m = len(ids), len(terms)
    share = float(toxic.mean()) if n else 0.0
    df = np.bincount(term, minlength=m).astype(float)
    hits = np.bincount(term, toxic[example], m)
    strength, chi2 = _strength(df, hits, n, share)
    factor = idf * strength
    weight = (1 + np.log(tf)) * factor[term]
    weight /= np.sqrt(np.bincount(example, weight * weight, n))[example]
    bare = np.bincount(example, minlength=n) == 0
    empty = float(toxic[bare].mean()) if bare.any() else share
    postings = Postings(example, term, weight, n, m)
    model = Model(terms, idf, ids, toxic, postings, neighbours, empty, factor, chi2 >= TELLING)
    bounds = np.searchsorted(example, np.arange(n + 1))
    full = np.flatnonzero(~bare)
    vectors = [(term[a:b], weight[a:b]) for a, b in zip(bounds[full], bounds[full + 1], strict=True)]
    found = zip(model.votes(vectors, full), toxic[full], strict=True)
    votes = [(vote, y) for (vote, _, _), y in found if vote is not None]
    if votes:
        model.slope, model.offset = _calibrate(*map(np.array, zip(*votes, strict=True)))
    return model


def _counted(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, tf): the known terms of each text, rising, and how often each stands there."""

    def make():
        vectors = Vectors(terms)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [vectors.arrays(text) for text in batch.column(1).to_pylist()]
            sizes = [len(at) for at, _ in found]
            lists = [int_lists(np.concatenate([x[k] for x in found]), sizes) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "at", "tf"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, at array<int>, tf array<int>")


def _idf(counted: DataFrame, n_terms: int) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 1 with N and df over all documents."""

    def task(batches):
        n, df = 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            n += batch.num_rows
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        met = np.flatnonzero(df)
        k, df = np.append(met, -1).astype(np.int32), np.append(df[met], n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df, pa.int64())], ["k", "df"])

    found = counted.select("at").mapInArrow(task, "k int, df long").groupBy("k").agg(F.sum("df").alias("df"))
    df = {r.k: r.df for r in found.toLocalIterator()}
    counts = np.array([df.get(k, 0) for k in range(n_terms)], float)
    return np.log((1 + df.get(-1, 0)) / (1 + counts)) + 1


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, and as evidence the nearest examples and the terms met."""
    return _scored(_counted(docs, model.terms, id_col, text_col), model)


def _scored(counted: DataFrame, model: Model) -> DataFrame:
    own = model  # travels with the function, code and all

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends = batch.column(1).offsets.to_numpy()
            at, tf = (batch.column(k).values.to_numpy() for k in (1, 2))
            texts = [(at[a:b], tf[a:b]) for a, b in zip(ends, ends[1:])]
            found = own.scores(texts)
            score = np.array([s for s, _, _ in found])
            near = [np.concatenate([x[k] for x in found]) for k in (1, 2)]
            offsets = pa.array(np.cumsum([0, *(len(x[1]) for x in found)]), pa.int32())
            evidence = pa.StructArray.from_arrays(
                [pa.array(own.example_ids[near[0]], pa.int64()), pa.array(near[1])], ["doc_id", "cosine"]
            )
            terms = [[own.terms[k] for k in met[own.telling[met]]] for met, _ in texts]
            arrays = [
                batch.column(0), pa.array(score), pa.array(score >= 0.5).cast(pa.int32()),
                pa.ListArray.from_arrays(offsets, evidence), pa.array(terms, pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "nearest", "terms"])

        return step

    schema = (
        "doc_id long, score double, predicted int, "
        "nearest array<struct<doc_id: bigint, cosine: double>>, terms array<string>"
    )
    return map_rows(counted, make, schema)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay."""
    own = model
    at = docs.columns.index(text_col)

    def make():
        vectors = Vectors(own.terms)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = own.scores([vectors.arrays(t) for t in batch.column(at).to_pylist()])
            return batch.filter(pa.array([s[0] < 0.5 for s in scores], pa.bool_()))

        return step

    return map_rows(docs, make, docs.schema)
