import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from raremill.llm import catalog, spelling

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_count=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    return linked(n)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def linked(n):
    cuts = {}
    for w in n:
        for k in range(len(w)):
            cuts.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for cut, found in cuts.items():
        both = found | ({cut} & n.keys())
        for a in both:
            near[a] |= {b for b in both if b != a and one_edit(a, b)}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_equals_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in catalog.documents(spark, folder).collect()]
    assert rows_of(catalog.QUERIES["op13_spelling"](spark, folder)) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abÀÿ", min_size=3, max_size=4), min_size=1, max_size=12, unique=True))
def test_near_pairs(found):
    three, four = [w for w in found if len(w) == 3], [w for w in found if len(w) == 4]
    for a, b in ((three, three), (four, four), (three, four)):
        if a and b:
            i, j = spelling.near_pairs(a, b, a is b)
            got = {frozenset((a[x], b[y])) for x, y in zip(i, j, strict=True)}
            assert len(got) == len(i)
            assert got == {frozenset((x, y)) for x in a for y in b if one_edit(x, y)}


def test_many_words_in_few_small_blocks(spark):
    """A hub with hundreds of near words, a crowded cell, many groups of letters: nothing lost."""
    base = "abcdefghij"
    n = {base: 100_000}
    for k in range(len(base)):
        for c in "klmnopqrstuvwxyzé":
            n[base[:k] + c + base[k + 1 :]] = 20 + k
            n[base[:k] + c + base[k:]] = 5 + k
    n |= {"".join(sorted("aabbccdd", key=lambda c, s=s: (hash((c, s)) % 97, c))): 6 + s for s in range(40)}
    known = spark.createDataFrame(list(n.items()), "word string, n long")
    want = {(a, b) for a in n for b in n if a != b and one_edit(a, b)}
    for groups, size in ((1, 7), (3, 50), (12, 4)):
        parts = spelling.letter_groups(known, groups)
        assert sorted("".join(parts)) == sorted(spelling._LETTERS)
        spelling_groups, spelling.groups_for = spelling.groups_for, lambda _, g=groups: g
        try:
            got = [(r.word, r.near) for r in spelling.near_words(known, size).collect()]
        finally:
            spelling.groups_for = spelling_groups
        assert len(got) == len(set(got)) and set(got) == want


def test_chain_of_forms(spark, docs):
    """Each form is five times as common as the one before: the root is the end of the chain."""
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    text = " ".join(" ".join([w] * 5 ** (k + 1)) for k, w in enumerate(chain))
    got = {r.word: r for r in spelling.variants(docs([(None, text)])).collect()}
    assert all(got[w].root == chain[-1] for w in chain) and got[chain[0]].form == chain[1]
    assert spelling._rounds(5**5, 5, 5) == 2 and spelling._rounds(24, 5, 5) == 0


def test_odd_rows(spark, docs):
    long = "Wortlaut " * 100_000
    rows = [(1, None), (None, ""), (2, long), (2, long), (None, "short wordsx WORDSX ÉtéÉTÉ " * 6), (3, "x" * 50_000)]
    frame = docs(rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    assert rows_of(spelling.variants(frame)) == brute(rows)
    assert spelling.variants(docs([])).count() == 0
