import random
import re
import zlib
from collections import Counter

import numpy as np

from raremill.llm import catalog, toxicity

rnd = random.Random(4)
LABELS = "doc_id long, quality int, toxic int"
BAD = ["vile", "rotten", "wretch", "scoundrels"]


def prose(n=60, bad=0):
    words = ["w" + str(rnd.randint(0, 300)) for _ in range(n)]
    for _ in range(bad):
        words[rnd.randrange(n)] = rnd.choice(BAD)
    return " ".join(words)


def tables(spark, docs, n=400):
    toxic = {k: int(rnd.random() < 0.25) for k in range(n)}
    rows = [(k, prose(bad=4 * toxic[k])) for k in range(n)]
    labels = spark.createDataFrame([(k, 1, y) for k, y in toxic.items() if k % 2], LABELS)
    return rows, toxic, labels


def test_learns_and_finds(spark, docs):
    rows, toxic, labels = tables(spark, docs)
    rows += [(900, None), (901, ""), (None, prose(bad=5)), (902, prose(200_000) + " vile vile wretch"), (7, rows[7][1])]
    frame = docs(rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "toxic")
    model = toxicity.train(frame, labels)
    assert {"vile", "rotten", "wretch", "scoun~"} <= set(model.terms)
    got = toxicity.scored(frame, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 2 == 0]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in unseen]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[900].predicted == by[901].predicted == 0
    assert by[None].nearest and by[None].terms
    left = toxicity.without_toxic(frame, model)
    assert left.columns == frame.columns
    assert left.count() == sum(r.predicted == 0 for r in got)


def plain_terms(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(words) + Counter(f"{w[:5]}~" for w in words if len(w) > 5)


def plain_scores(rows, toxic, neighbours=25):
    """Scores of (id, text) rows by brute force; ``toxic`` holds the labels of the examples."""
    texts = dict(rows)
    ids = sorted(toxic)
    own = [plain_terms(texts[i]) for i in ids]
    y = np.array([toxic[i] for i in ids], float)
    at = {t: k for k, t in enumerate(sorted(set().union(*own)))}
    n, share = len(ids), y.mean()
    tf = np.zeros((n, len(at)))
    for k, c in enumerate(own):
        tf[k, [at[t] for t in c]] = list(c.values())
    df, hits = (tf > 0).sum(axis=0), (tf > 0).T @ y
    spread = df * share * (1 - share) * (1 - df / n)
    chi2 = np.where((spread > 0) & (hits > df * share), (hits - df * share) ** 2 / np.where(spread > 0, spread, 1), 0)
    everywhere = Counter(t for _, text in rows for t in plain_terms(text))
    idf = np.log((1 + len(rows)) / (1 + np.array([everywhere[t] for t in at]))) + 1
    factor = idf * np.maximum(toxicity.FAINT, chi2 / (chi2 + toxicity.HALF))

    def vector(tf):
        w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * factor
        return w / (np.sqrt((w * w).sum()) or 1)

    examples = np.array([vector(x) for x in tf])

    def vote(w, skip=-1):
        cos = np.round(examples @ w, 12)
        best = [k for k in np.lexsort((np.arange(n), -cos)) if cos[k] > 0 and k != skip][:neighbours]
        return (cos[best] @ y[best] / cos[best].sum() if best else None), best

    votes = [(v, y[k]) for k in range(n) if (v := vote(examples[k], k)[0]) is not None]
    slope, offset = toxicity._calibrate(*map(np.array, zip(*votes, strict=True)))
    bare = np.array([not c for c in own])
    out = {}
    for i, text in rows:
        tf = np.zeros(len(at))
        for t, c in plain_terms(text).items():
            if t in at:
                tf[at[t]] = c
        v, best = vote(vector(tf))
        empty = y[bare].mean() if bare.any() else share
        out[i] = (empty if v is None else 1 / (1 + np.exp(-slope * v - offset))), [ids[k] for k in best]
    return out


def test_scores_by_brute_force(spark, docs):
    rows, toxic, labels = tables(spark, docs, 600)
    rows += [(700, "vile"), (701, "of no known term"), (702, None), (703, prose(5000, 9))]
    rows += [(800 + k, rows[1][1]) for k in range(40)]  # ties
    labels = labels.union(spark.createDataFrame([(800 + k, 1, k % 2) for k in range(40)] + [(702, 1, 0)], LABELS))
    want = plain_scores(rows, {r.doc_id: r.toxic for r in labels.collect()})
    frame = docs(rows)
    for r in toxicity.scored(frame.repartition(3), toxicity.train(frame, labels)).collect():
        assert abs(r.score - want[r.doc_id][0]) < 1e-6
        assert [e.doc_id for e in r.nearest] == want[r.doc_id][1]


def test_one_count_of_terms_gives_the_same_scores(spark, docs):
    rows, _, labels = tables(spark, docs)
    rows += [(900, None), (901, ""), (None, prose(bad=5)), (7, rows[7][1]), (902, "of no known term")]
    frame = docs(rows)
    got = toxicity.train_and_score(frame, labels).collect()
    want = toxicity.scored(frame, toxicity.train(frame, labels)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)


def test_the_model_is_small(spark, docs):
    """It travels to every task: 16 bytes at most for each term of an example, and two words for each term."""
    rows, _, labels = tables(spark, docs, 2000)
    model = toxicity.train(docs(rows), labels)
    entries = sum(len(plain_terms(text)) for k, text in rows if k % 2)
    sent = model.postings.__getstate__()
    held = sum(a.nbytes for a in [*sent["_cells"], *(v for v in sent.values() if isinstance(v, np.ndarray))])
    assert held <= 16 * entries + 8 * len(model.terms) + 8


def test_document_frequencies_cover_all_rows(spark, docs):
    rows, _, labels = tables(spark, docs)
    model = toxicity.train(docs(rows), labels)
    own = toxicity.Vectors(model.terms)
    df = np.zeros(len(model.terms))
    for _, text in rows:
        df[list(own.counts(text))] += 1
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1)


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], LABELS)
    frame = docs(["a b", None])
    model = toxicity.train(frame, none)
    assert [r.score for r in toxicity.scored(frame, model).collect()] == [0.0, 0.0]
    odd = spark.createDataFrame([(0, 1, None), (None, 1, 1), (1, 0, 1), (1, 0, 0)], LABELS)
    toxicity.train(frame, odd)
    assert toxicity.scored(docs([]), model).count() == 0


def test_query(spark, folder):
    rows = catalog.QUERIES["op7_toxicity"](spark, folder).collect()
    texts = [(r.doc_id, r.text) for r in catalog.documents(spark, folder).collect()]
    assert len(rows) == len(texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    want = plain_scores(texts, {r.doc_id: r.toxic for r in labels if not held(r.doc_id)})
    assert all(abs(r.score - want[r.doc_id][0]) < 1e-6 for r in rows)
    assert np.mean([not near for _, near in want.values()]) < 0.01


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in catalog.QUERIES["op7_toxicity"](spark, data).collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.94
    caught = sum(b for a, b in held if a)
    assert caught >= 78 and sum(b for a, b in held if not a) <= 10
