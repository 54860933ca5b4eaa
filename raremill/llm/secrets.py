"""Secret scan: base patterns and a character convolution over candidates (operator 8).

Base spans come from three patterns. A candidate is a run of 12 or more characters of
``[A-Za-z0-9+/_.=-]`` with a digit. The network reads each candidate with its surrounding
characters: an embedding of character classes, a convolution, maximum and mean pooling, a
logistic output; long candidates are read in overlapping windows and keep the largest output.
It is trained in numpy on all findings, labelled by the patterns: candidates inside a base span
are secrets, the others are not. More than ``max_findings`` are dealt to shards; in every round each shard
trains from the same weights over its own findings, and their weights are averaged. In half of the secrets the text on their left is replaced
by that of other findings, so that the network learns the shape as well as the setting.
Outputs are calibrated by a logistic curve on held-out findings; the threshold is 0.5, or
less if that is needed to keep ``min_recall`` of their secrets. Candidates above it that touch no
base span are added as spans of kind "model".

Spans are whole matches in code points, end exclusive. Null and empty texts have none.
Repeated rows are scanned alike; extra columns are ignored. Without findings of both kinds
no network is trained and only base spans are returned.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.tasks import map_rows, stored
from raremill.sources.numbered import with_starts

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_NAMES = ("passw", "secret", "token", "api")

_LEFT, _BODY, _RIGHT = 20, 40, 6
_SIZE = _LEFT + _BODY + _RIGHT
#: Character classes: one each for letters and digits and marks of the candidates, then for others.
_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-\"': @(){}[]<>,;\n"
_CODE = {c: k + 2 for k, c in enumerate(_CHARS)}  # 0: nothing, 1: any other character
_CLASSES = len(_CHARS) + 2
_WIDTH, _EMBED, _FILTERS = 5, 8, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), ordered."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a run of 32 hexadecimal digits lies in a run of candidate characters
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= 32:
            for m in _HEX.finditer(text, run.start(), run.end()):
                if m.end() - m.start() >= 32:
                    out.append((m.start(), 2, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0])]


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate with its surroundings, in pieces of fixed width padded by zeros."""
    out = []
    for at in range(start, max(start + 1, end - _BODY // 2), _BODY // 2):
        stop = min(end, at + _BODY)
        left = text[max(0, at - _LEFT) : at].rjust(_LEFT, "\0")
        right = text[stop : stop + _RIGHT].ljust(_RIGHT, "\0")
        out.append(left + text[at:stop].ljust(_BODY, "\0") + right)
    return out


def _codes(texts: list[str]) -> np.ndarray:
    get = _CODE.get
    flat = [0 if c == "\0" else get(c, 1) for t in texts for c in t]
    return np.array(flat, np.int64).reshape(len(texts), _SIZE)


@dataclass
class Network:
    embed: np.ndarray  # class x dimension
    kernel: np.ndarray  # (width * dimension) x filter
    bias: np.ndarray
    out: np.ndarray  # 2 * filter
    base: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    seen: int = 0  # findings it was made of

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[a : a + 512])[0] for a in range(0, len(codes), 512)])

    def _forward(self, codes):
        steps = _SIZE - _WIDTH + 1
        cols = codes[:, np.arange(steps)[:, None] + np.arange(_WIDTH)]
        x = self.embed[cols].reshape(len(codes), steps, _WIDTH * _EMBED)
        h = np.maximum(x @ self.kernel + self.bias, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return pooled @ self.out + self.base, (cols, x, h, top, pooled)

    def gradients(self, codes, truth):
        z, (cols, x, h, top, pooled) = self._forward(codes)
        d = (_logistic(z) - truth) / len(truth)
        g_out, g_base = pooled.T @ d, d.sum()
        d_pool = d[:, None] * self.out
        d_h = np.repeat(d_pool[:, None, _FILTERS:] / h.shape[1], h.shape[1], axis=1)
        first = np.take_along_axis(d_h, top[:, None], 1) + d_pool[:, None, :_FILTERS]
        np.put_along_axis(d_h, top[:, None], first, 1)
        d_h *= h > 0
        g_kernel = np.einsum("nsi,nsf->if", x, d_h)
        d_x = (d_h @ self.kernel.T).reshape(-1, _EMBED)
        g_embed = np.zeros_like(self.embed)
        np.add.at(g_embed, cols.ravel(), d_x)
        return [g_embed, g_kernel, d_h.sum(axis=(0, 1)), g_out, np.array(g_base)]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * self.logits(codes) + self.offset)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(texts: list[str], truth: np.ndarray, min_recall: float, seed: int, rounds: int = 12) -> Network:
    """Adam on three quarters of the findings, calibration and threshold on the rest."""
    draw = np.random.default_rng(seed)
    held_x, held_y, x, y = _dealt(texts, truth, draw)
    state = _State(_new(draw))
    for _ in range(rounds):
        state.epoch(x, y, draw)
    net = state.net
    z = net.logits(held_x)
    net.slope, net.offset = _calibrate(z, held_y)
    secret = np.sort(net.scores(held_x)[held_y == 1])
    if len(secret):
        net.threshold = float(min(0.5, secret[int((1 - min_recall) * len(secret))]))
    net.seen = len(texts)
    return net


def _dealt(texts: list[str], truth: np.ndarray, draw):
    """A quarter of the findings held out, and the rest with its moved secrets: (codes, truth) of both."""
    order = draw.permutation(len(texts))
    codes, truth = _codes(texts)[order], truth[order].astype(float)
    held = max(1, len(texts) // 4)
    x, y = codes[held:], truth[held:]
    # every secret once as found, once in another finding's setting
    moved = x[y == 1].copy()
    moved[:, :_LEFT] = x[draw.integers(0, max(1, len(x)), len(moved)), :_LEFT]
    return codes[:held], truth[:held], np.concatenate([x, moved]), np.concatenate([y, np.ones(len(moved))])


def _new(draw) -> Network:
    return Network(
        draw.normal(0, 0.3, (_CLASSES, _EMBED)),
        draw.normal(0, (2 / (_WIDTH * _EMBED)) ** 0.5, (_WIDTH * _EMBED, _FILTERS)),
        np.zeros(_FILTERS), draw.normal(0, 0.1, 2 * _FILTERS), 0.0,
    )


class _State:
    """A network in training, with Adam's moments and steps."""

    def __init__(self, net: Network):
        self.net, self.t = net, 0.0
        self.weights = [net.embed, net.kernel, net.bias, net.out, np.array(net.base)]
        self.mean, self.var = ([np.zeros_like(w) for w in self.weights] for _ in range(2))

    def epoch(self, x, y, draw) -> None:
        weights, mean, var = self.weights, self.mean, self.var
        mixed = draw.permutation(len(x))
        for at in range(0, len(x), 128):
            part = mixed[at : at + 128]
            self.t += 1
            for k, g in enumerate(self.net.gradients(x[part], y[part])):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                var[k] = 0.999 * var[k] + 0.001 * g * g
                weights[k] -= 0.004 * (mean[k] / (1 - 0.9**self.t)) / (np.sqrt(var[k] / (1 - 0.999**self.t)) + 1e-8)
            self.net.base = float(weights[4])

    def flat(self) -> np.ndarray:
        return np.concatenate([*(np.ravel(a) for a in (*self.weights, *self.mean, *self.var)), [self.t]])

    @classmethod
    def of(cls, flat: np.ndarray) -> _State:
        state = cls(_new(np.random.default_rng(0)))
        at, parts = 0, []
        for _ in range(3):
            for w in state.weights:
                parts.append(flat[at : at + w.size].reshape(w.shape).copy())
                at += w.size
        net = Network(*parts[:4], float(parts[4]))
        state = cls(net)
        state.mean, state.var, state.t = parts[5:10], parts[10:], float(flat[at])
        return state


def _calibrate(z: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    x = np.column_stack([z, np.ones(len(z))])

    def sums(a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        p = _logistic(a * z + b)
        return x.T @ (p - truth), x.T @ (x * (p * (1 - p))[:, None])

    return _newton(sums)


def _newton(sums) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(30):
        grad, curve = sums(a, b)
        grad = grad + 0.1 * np.array([a - 1.0, b])
        step = np.linalg.solve(curve + 0.1 * np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def _findings(docs: DataFrame) -> DataFrame:
    """Every candidate of every text with the label that the base patterns give it."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, starts, labels, pieces = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = candidates(text) if text else []
                spans = base_spans(text) if found else []
                for a, b in found:
                    ids.append(i)
                    starts.append(a)
                    labels.append(int(any(s < b and a < e for s, _, e in spans)))
                    pieces.append(windows(text, a, b)[0])
            arrays = [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(labels, pa.int32()), pa.array(pieces, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "secret", "piece"])

        return step

    return map_rows(docs, make, "doc_id long, start int, secret int, piece string")


#: Tasks that shards are dealt to at most; each sends one sum of weights to the driver in a round.
_TASKS = 256


def train(docs: DataFrame, max_findings: int = 4000, min_recall: float = 0.99, seed: int = 3, rounds: int = 12) -> Network | None:
    """Network from all findings, in shards of about ``max_findings`` if there are more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = (F.xxhash64("doc_id", "start"), "doc_id", "start", "piece")
    found = stored(_findings(rows), "findings")
    size, secret = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("secret"), F.lit(0))).first()
    if min(secret, size - secret) < 8:
        return None
    if size <= max_findings:
        own = [r for label in (1, 0) for r in found.where(F.col("secret") == label).orderBy(*order).toLocalIterator()]
        return fit([r.piece for r in own], np.array([r.secret for r in own]), min_recall, seed, rounds)
    shards = -(-size // max_findings)
    shard = F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.lit(shards)).cast("int")
    dealt = found.withColumn("shard", shard).repartition(min(shards, _TASKS), "shard")
    dealt = stored(dealt.sortWithinPartitions("shard", F.desc("secret"), *order).select("shard", "secret", "piece"), "shards")
    return _fit_shards(dealt, min(shards, _TASKS), min_recall, seed, rounds)


def _over_shards(dealt: DataFrame, tasks: int, make, schema: str) -> DataFrame:
    """``make`` of each shard's number, pieces and labels: RecordBatches. A shard is brought together in one task."""

    def task(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield make(held[0][0], [r[2] for r in held], np.array([r[1] for r in held]))
                    held.clear()
                held.append(row)
        if held:
            yield make(held[0][0], [r[2] for r in held], np.array([r[1] for r in held]))

    together = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))
    return together.sortWithinPartitions("shard", F.desc("secret"), F.xxhash64("piece"), "piece").mapInArrow(task, schema)


def _fit_shards(dealt: DataFrame, tasks: int, min_recall: float, seed: int, rounds: int) -> Network:
    """The same as ``fit`` where no task has all findings."""
    state = _State(_new(np.random.default_rng(seed))).flat()
    for number in range(rounds):

        def epoch(shard: int, texts: list[str], truth: np.ndarray, number=number, start=state) -> pa.RecordBatch:
            _, _, x, y = _dealt(texts, truth, np.random.default_rng((seed, shard)))
            own = _State.of(start)
            own.epoch(x, y, np.random.default_rng((seed, shard, number)))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([len(texts)], pa.int64()), pa.array([own.flat() * len(texts)], pa.list_(pa.float64()))],
                ["shard", "n", "state"],
            )

        # summed where they are made; one row a task, of which all tasks train at the same time
        summed = _over_shards(dealt, tasks, epoch, "shard int, n long, state array<double>").mapInArrow(_summed, "n long, state array<double>")
        n, total = 0, np.zeros(len(state))
        for row in summed.collect():
            n, total = n + row.n, total + np.array(row.state)
        state = total / n
    net = _State.of(state).net
    net.seen = n

    def held(shard: int, texts: list[str], truth: np.ndarray) -> pa.RecordBatch:
        x, y, _, _ = _dealt(texts, truth, np.random.default_rng((seed, shard)))
        return pa.RecordBatch.from_arrays([pa.array(net.logits(x)), pa.array(y)], ["z", "y"])

    outputs = stored(_over_shards(dealt, tasks, held, "z double, y double"), "held")
    grouped = stored(outputs.groupBy("z", "y").agg(F.count(F.lit(1)).alias("n")), "held_counts")

    def sums(a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(a) * F.col("z") + F.lit(b)))))
        gap, w = F.col("n") * (p - F.col("y")), F.col("n") * p * (1 - p)
        parts = (gap * F.col("z"), gap, w * F.col("z") * F.col("z"), w * F.col("z"), w)
        g0, g1, c00, c01, c11 = grouped.agg(*[F.sum(x).alias(f"s{k}") for k, x in enumerate(parts)]).first()
        return np.array([g0, g1]), np.array([[c00, c01], [c01, c11]])

    net.slope, net.offset = _newton(sums)
    secrets = grouped.where("y = 1").select("z", "n")
    size = secrets.agg(F.sum("n")).first()[0]
    if size:
        at = int((1 - min_recall) * size)
        z = with_starts(secrets, ["z"]).where((F.col("start") <= at) & (F.col("start") + F.col("n") > at)).first().z
        net.threshold = float(min(0.5, _logistic(net.slope * z + net.offset)))
    return net


def _summed(batches):
    """The sums of a task's rows as one row."""
    n, total = 0, None
    for batch in batches:
        for k in range(batch.num_rows):
            own = batch.column("state")[k].values.to_numpy()
            total = own if total is None else total + own
            n += batch.column("n")[k].as_py()
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["n", "state"])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans, their digest, all spans and the score of each added one."""
    net = network  # travels with the function, code and all

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            asked, pieces = [], []
            if net is not None:
                for k, t in enumerate(texts):
                    for a, b in candidates(t):
                        if not any(s < b and a < e for s, _, e in base[k]):
                            own = windows(t, a, b)
                            asked += [(k, a, b)] * len(own)
                            pieces += own
            best: dict[tuple[int, int, int], float] = {}
            if pieces:
                for key, score in zip(asked, net.scores(_codes(pieces)).tolist(), strict=True):
                    best[key] = max(score, best.get(key, 0.0))
            every, scores = [list(b) for b in base], [[] for _ in texts]
            for (k, a, b), score in best.items():
                if score >= net.threshold:
                    every[k].append((a, 3, b))
                    scores[k].append(score)
            counts = [[sum(s[1] == kind for s in b) for b in base] for kind in range(3)]
            digests = [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base]
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests)]
            arrays += [pa.array([_joined(sorted(e)) for e in every]), pa.array(scores, pa.list_(pa.float64()))]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "model_scores"]
            return pa.RecordBatch.from_arrays(arrays, names)

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "model_scores array<double>"
    )
    return map_rows(rows, make, schema)
