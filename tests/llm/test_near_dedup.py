import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from raremill.llm import near_dedup
from raremill.llm.graph import components

rnd = random.Random(9)
WORDS = [f"w{k}" for k in range(3000)]


def prose(n):
    return [rnd.choice(WORDS) for _ in range(n)]


def brute_set(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width=3, percent=85):
    sets = [(i, brute_set(t, width)) for i, t in rows if i is not None]
    low = {k: i for k, (i, _) in enumerate(sets)}
    links = [
        (a, b) for a in range(len(sets)) for b in range(a)
        if sets[a][1] and sets[b][1]
        and 100 * len(sets[a][1] & sets[b][1]) >= percent * len(sets[a][1] | sets[b][1])
    ]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return sorted((i, len(s), low[k], low[k] == i) for k, (i, s) in enumerate(sets))


def changed(words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = rnd.choice(WORDS)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbÀß \t\n\x85\x1f"), max_size=40))
def test_set_sizes(text):
    assert len(near_dedup.shingles(text)) == len(brute_set(text))


def test_equals_brute_force(spark, docs):
    passage = prose(60)
    texts = []
    for size, length, edits in ((90, 150, 1), (12, 300, 3), (5, 40, 1), (3, 700, 10), (70, 100, 2)):
        first = prose(length)
        texts += [" ".join(changed(first, rnd.randint(0, edits))) for _ in range(size)]
    # many unlike documents around one common passage, some of it nearly all of them
    texts += [" ".join(prose(rnd.choice([3, 12, 80])) + passage + prose(rnd.choice([2, 9, 80]))) for _ in range(150)]
    texts += [" ".join(prose(rnd.randint(0, 6))) for _ in range(40)] + ["a", "A", "a b", "a B", "", " \n", None, None]
    texts += [" ".join(prose(120)) for _ in range(60)] + texts[:5] * 20
    # a chain: each is linked with the next, the ends are not
    link = prose(200)
    for _ in range(12):
        texts.append(" ".join(link))
        link = changed(link, 3)
    rnd.shuffle(texts)
    rows = [(7 * k % 10_007, t) for k, t in enumerate(texts)]
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], " ".join(prose(90)))]
    frame = docs([*rows, (None, texts[0]), (None, None)]).withColumnRenamed("lang", "label").withColumnRenamed("source", "n")
    got = near_dedup.near_duplicates(frame.repartition(5)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    kept = near_dedup.one_of_each(frame, near_dedup.Rule())
    assert kept.columns == frame.columns
    # of the row that is there twice one is enough
    twice = {r.kept for r in got if r.doc_id == rows[3][0]} == {True}
    assert kept.count() == sum(r.kept for r in got) - twice


def test_nothing_to_link(spark, docs):
    assert near_dedup.near_duplicates(docs([])).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(docs(["a b c d", None])).orderBy("doc_id").collect()] == [
        (0, 2, 0, True), (1, 0, 1, True)
    ]


def test_very_long_text(spark, docs):
    long = prose(200_000)
    rows = docs([" ".join(long), " ".join(changed(long, 2000)), " ".join(prose(200_000))])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (200, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90}


def test_links_within_a_common_template(spark, docs):
    # more texts than a list may hold share most shingles and are below 0.85 with each other
    template = prose(302)
    texts = []
    for _ in range(70):
        own = prose(45)
        texts += [" ".join(template + own), " ".join(template + own[:30] + prose(15))]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sum(not kept for *_, kept in want) >= 65
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs(rows)).collect()) == want


def test_usual_rule_equals_brute_force(spark, docs):
    """Five words and 0.8: copies with a block added go, others stay; small sets and long lists too."""
    common, texts = prose(300), []
    for size, length, edits in ((80, 120, 2), (20, 400, 8), (6, 30, 1)):
        base = prose(length)
        texts += [changed(base, edits) for _ in range(size)]
    for more in (75, 85, 90, 95, 110):
        base = prose(400)
        texts += [base, base + prose(more)]
    texts += [common + prose(60) for _ in range(90)] + [prose(k % 7) for k in range(30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    found = near_dedup.near_duplicates(docs(rows), rule=near_dedup.USUAL)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 5, 80)


def test_rows_are_decided_not_ids(spark, docs):
    """An id repeated with another text, rows repeated whole, and copies of both."""
    a, b, c = (" ".join(prose(80)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (4, c), (5, None), (5, None), (None, a), (6, "")]
    left = near_dedup.one_of_each(docs(rows))
    text = {a: "a", b: "b", c: "c"}
    got = sorted((r.doc_id or 0, text.get(r.text, r.text or "")) for r in left.collect())
    assert got == [(0, "a"), (1, "a"), (2, "b"), (4, "c"), (5, ""), (5, ""), (6, "")]
