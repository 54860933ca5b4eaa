import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from raremill.llm import catalog, secrets

rnd = random.Random(2)


def brute(text):
    low = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [
        (m.start(), 0, m.end())
        for m in re.finditer(low + "[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8
    ]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


WORDS = st.sampled_from([
    "token", "Token", "api_key", "APIKEY", " = ", ":", '"', "'", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "K", "ſ",
    "é", "\n", "passwd", "=", "xyz.1234567", "short",
])


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=12).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute(text)


def test_gradients():
    draw = np.random.default_rng(1)
    codes = draw.integers(0, secrets._CLASSES, (6, secrets._SIZE))
    truth = np.array([0, 1, 0, 1, 1, 0.0])
    net = secrets.fit(["\0" * secrets._SIZE] * 8, truth[[0, 1, 0, 1, 0, 1, 0, 1]], 0.9, 1, rounds=1)
    grads = net.gradients(codes, truth)
    for name, grad in (("kernel", grads[1]), ("embed", grads[0]), ("out", grads[3])):
        weights = getattr(net, name)
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        loss = []
        for eps in (1e-6, -1e-6):
            weights[at] += eps
            z = net.logits(codes)
            loss.append(np.mean(np.log1p(np.exp(z)) - truth * z))
            weights[at] -= eps
        assert abs((loss[0] - loss[1]) / 2e-6 - grad[at]) < 1e-5


def hexes(n):
    return "".join(rnd.choice("0123456789abcdef") for _ in range(n))


def make(k):
    kind = k % 4
    if kind == 0:
        return f"text before token = {hexes(40)} and after"
    if kind == 1:
        return f"see AKIA{''.join(rnd.choice('ABCDEFGHIJ234567') for _ in range(16))} there"
    if kind == 2:
        return f"call 555-{rnd.randint(1000, 9999)}-{rnd.randint(1000, 9999)} or write to mail{k}.example.com now"
    return f"order 2024-01-{rnd.randint(10, 28)}T10.00 number {rnd.randint(10**15, 10**16)} done"


def test_scan(spark, docs):
    rows = [(k, make(k)) for k in range(400)]
    rows += [(900, None), (901, ""), (902, f"the value {hexes(30)} stands alone"), (903, "plain words only"), (900, "again")]
    rows += [(904, "x" * 300_000 + " password=hunter2hunter2"), (None, make(0))]
    frame = docs(rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "start")
    net = secrets.train(frame)
    got = secrets.scan(frame, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id != 900}
    names = dict(zip(range(4), secrets.KINDS, strict=True))
    for i, text in rows:
        if i != 900:
            base = brute(text or "")
            whole = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
            assert by[i].base_sha256 == hashlib.sha256(whole.encode()).hexdigest()
            assert set(filter(None, whole.split(","))) <= set(by[i].spans.split(","))
    assert by[902].spans == "model:10:40" and by[902].n_hex == 0
    assert by[903].spans == by[901].spans == "" and by[904].n_assign == 1
    added = [r for r in got if r.doc_id is not None and r.doc_id < 400 and "model" in r.spans]
    assert len(added) <= 4


def test_no_findings(spark, docs):
    frame = docs(["plain", None])
    assert secrets.train(frame) is None
    assert [r.spans for r in secrets.scan(frame, None).collect()] == ["", ""]
    assert secrets.scan(docs([]), None).count() == 0


def test_query_keeps_base_spans(spark, folder):
    texts = {r.doc_id: r.text or "" for r in catalog.documents(spark, folder).collect()}
    for r in catalog.QUERIES["op8_secrets"](spark, folder).collect():
        base = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == k for b in base) for k in range(3))


def test_all_findings_are_learned_from(spark, docs):
    draw = random.Random(5)
    made = []
    for k in range(600):
        value = "".join(draw.choices("abcdefghijkmnpqrstuvwxyz0123456789", k=24)) + "7"
        made.append(f"the run password = {value} here" if k % 2 else f"see page report-2021/{k}-volume.{k} there")
    frame = docs(made)
    net = secrets.train(frame, max_findings=150)
    assert net.seen == 600
    z = [[net.scores(secrets._codes(secrets.windows(t, *c))).max() for c in secrets.candidates(t)][0] for t in made]
    assert np.mean([v >= net.threshold for v in z[1::2]]) >= 0.98
    assert np.mean([v >= net.threshold for v in z[0::2]]) <= 0.02


def test_shards_train_at_the_same_time(spark, docs):
    """A round is one job over all shards, not one for each."""
    made = [make(k) for k in range(1200)]
    spark.sparkContext.setJobGroup("secrets", "training")
    try:
        assert secrets.train(docs(made), max_findings=50, rounds=6).seen > 800
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("secrets")) < 80
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
