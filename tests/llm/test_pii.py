import hashlib
import random
import re
from collections import Counter
from math import log

import regex

from raremill.llm import catalog, pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


TEXTS = [
    None, "", "none here", "write a.b@mail.example.com now", "a@b.c_d@e.f x@y", "@ a@ @b.c a@b", "x@y.z@u.v-w.", "ä😀 é@b.co ß@x.y1",
    "1.2.3.4.5.6.7.8", "999.1.1.1 and 10.0.0.1, 007.08.09.255", "4539 1488 0343 6467", "4539-1488-0343-6467 1 2", "12345678901234567890123",
    "4539148803436467 4539148803436467", "+1 (988) 555-2485", "+1 988", "+12 345 678 901 234 567", "tel +49.30.1234567-",
    "😀 +1 (988) 555-2485 😀 a@b.cd 10.1.2.3", "99999999999999999999.1.2.3", "a+b@c.de+f@g.hi", "x" * 200_000 + " q@r.st",
]


def test_base_spans(spark, docs):
    frame = docs(TEXTS).withColumnRenamed("lang", "spans").withColumnRenamed("source", "terms")
    for r in pii.digests(pii.disclosures(frame.repartition(3))).collect():
        want = brute(TEXTS[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == k for w in want) for k in range(4)], TEXTS[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), TEXTS[r.doc_id]
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


def test_long_runs(spark, docs):
    """Digits and labels without end are no depth of the task's stack."""
    texts = ["1" * 9_000, "1 " * 9_000, "1-" * 9_000 + "x", "a@b" + ".c" * 9_000, "+1" + "(2" * 9_000]
    found = {r.doc_id: r for r in pii.digests(pii.disclosures(docs(texts))).collect()}
    for k, text in enumerate(texts):
        want = brute(text) if k != 3 else [(0, 0, len(text))]
        assert found[k].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()


def test_revealing_terms(spark, docs):
    rows = [(k, f"the keeper {k} from Zebulon about the bo@mail.example.com box and more") for k in range(3)]
    rows += [(10 + k, f"the box and more about words number{k} from the keeper") for k in range(40)]
    rows += [(60, "Zebulon alone, far away"), (61, "the of x@y.zz and"), (61, None), (None, "Zebulon bo@mail.example.com")]
    found = pii.disclosures(docs(rows))
    by = {r.doc_id: r for r in found.collect() if r.doc_id != 61}
    text = rows[0][1]
    at = text.index("Zebulon")
    n, seen, both, df = len(rows), 4, 4, 5
    want = log(both * n / (df * seen)) / -log(seen / n)
    assert [(t.start, t.end) for t in by[0].terms] == [(at, at + 7)]
    assert abs(by[0].terms[0].disclosure - want) < 1e-12
    assert [(t.start, t.end) for t in by[None].terms] == [(0, 7)]
    assert not by[60].terms and not by[10].terms
    clean = {r.doc_id: r.text for r in pii.sanitised(found, removal=0.99).collect()}
    assert clean[0] == text.replace("Zebulon", "[WORD]").replace("bo@mail.example.com", "[EMAIL]")
    clean = {r.doc_id: r.text for r in pii.sanitised(found, removal=0.5).collect()}
    assert clean[None] == " [EMAIL]" and clean[61] == "the of [EMAIL] and" and 60 not in clean


def brute_terms(texts, support=2, threshold=0.5):
    """Term spans of every text by the definition."""
    n = len(texts)
    word = regex.compile(r"[\p{L}\p{N}]+")
    df, seen, both, rows = Counter(), Counter(), Counter(), []
    for text in texts:
        text = text or ""
        spans = brute(text)
        df.update({m[0].lower() for m in word.finditer(text)})
        own = {(k, text[s:e].lower()) for s, k, e in spans}
        # spans are cut out, so words end at them
        masked = list(text)
        for s, _, e in spans:
            masked[s:e] = "\0" * (e - s)
        places = [(m.start(), m.end(), m[0].lower()) for m in word.finditer("".join(masked))]
        seen.update(own)
        both.update({(x, w) for x in own for _, _, w in places})
        rows.append((own, places))

    def disclosure(x, w):
        if both[x, w] < support or df[w] < support or seen[x] == n:
            return 0.0
        return log(min(both[x, w], df[w]) * n / (df[w] * seen[x])) / -log(seen[x] / n)

    return [sorted((s, e) for s, e, w in places if any(disclosure(x, w) >= threshold for x in own)) for own, places in rows]


def test_distance_does_not_matter(spark, docs):
    filler = lambda k: " ".join(f"f{k}x{i}" for i in range(900 if k == 3 else 12))
    rows = [(k, f"Zebulon {filler(k)} bo@mail.example.com") for k in range(20)]
    rows += [(100 + k, f"the box number{k} of the keeper, zebu{k}") for k in range(200)]
    found = {r.doc_id: [(t.start, t.end) for t in r.terms] for r in pii.disclosures(docs(rows)).collect()}
    assert all(found[k] == [(0, 7)] for k in range(20))
    assert not any(found[100 + k] for k in range(200))


def test_terms_beside_brute_force(spark, docs, monkeypatch):
    rnd = random.Random(9)
    mails = [f"u{k}@m{k % 3}.example.org" for k in range(6)]
    texts = [None, "", "a@b.cd", mails[0]] + [
        " ".join(rnd.choices([f"Wört{int(rnd.expovariate(0.03))}", rnd.choice(mails), "10.0.0.1", "x+1 (988) 555-2485y"], [30, 1, 0.3, 0.2], k=rnd.randint(1, 60)))
        for _ in range(150)
    ]
    texts += [texts[9]] * 3
    want = brute_terms(texts)
    assert sum(map(bool, want)) > 20
    frame = docs(list(enumerate(texts)))
    for salted in (100_000, 2):
        monkeypatch.setattr(pii, "SALTED", salted)
        for r in pii.disclosures(frame.repartition(5)).collect():
            assert [(t.start, t.end) for t in r.terms] == want[r.doc_id], texts[r.doc_id]


def test_empty_table(spark, docs):
    assert pii.digests(pii.disclosures(docs([]))).count() == 0


def test_query(spark, folder):
    texts = {r.doc_id: r.text or "" for r in catalog.documents(spark, folder).collect()}
    frame = catalog.QUERIES["op9_disclosures"](spark, folder)
    assert not any(w in frame._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
    rows = frame.collect()
    assert len(rows) == len(texts)
    terms = dict(zip(texts, brute_terms(list(texts.values())), strict=True))
    for r in rows:
        assert [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")] == terms[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed(brute(texts[r.doc_id])).encode()).hexdigest()
