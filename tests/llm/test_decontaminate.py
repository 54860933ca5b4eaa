import random

import numpy as np
import pytest

from raremill.llm import catalog, decontaminate
from raremill.llm.decontaminate import Index, fitting_edits, words_of

ITEM = "item_id long, text string"
rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 6))) for _ in range(800)]


def prose(n):
    return [rnd.choice(WORDS) for _ in range(n)]


def edited(words, edits):
    out = list(words)
    for _ in range(edits):
        at, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out[at] = rnd.choice(WORDS)
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rnd.choice(WORDS))
    return out


def slow_edits(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_fitting_edits():
    for _ in range(300):
        item, text = ([rnd.randrange(4) for _ in range(rnd.randint(1, 9))] for _ in range(2))
        text = text + [rnd.randrange(4) for _ in range(4)]
        edits, start, end = fitting_edits(np.array(item), np.array(text))
        assert edits == slow_edits(item, text) == slow_edits_exact(item, text[start:end])


def slow_edits_exact(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_recall_within_the_budget():
    items = [(k, prose(rnd.randint(12, 60))) for k in range(150)]
    index = Index(items, 0.2, 0.99, 7)
    found = total = 0
    for k, words in items:
        for share in (0.0, 0.1, 0.2):
            text = prose(60) + edited(words, int(share * len(words))) + prose(60)
            hits = {items[h[1]][0] for h in index.find([text])}
            total += 1
            found += k in hits
            for h in index.find([text]):
                own = items[h[1]][1]
                assert h[4] <= int(0.2 * len(own))
                assert slow_edits_exact(own, text[h[2] : h[2] + h[3]]) == h[4]
    assert found / total >= 0.97


KINDS = {
    "replaced": lambda w, at: w[:at] + [rnd.choice(WORDS)] + w[at + 1 :],
    "inserted": lambda w, at: w[:at] + [rnd.choice(WORDS)] + w[at:],
    "deleted": lambda w, at: w[:at] + w[at + 1 :],
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("length", [20, 40, 60, 150, 300])
def test_recall_at_the_full_budget(kind, length):
    """A fifth of the words edited, of one kind, at places spread by chance."""
    items = [(k, prose(length)) for k in range(40)]
    index = Index(items, 0.2, 0.99, 7)
    found = 0
    for k, words in items:
        text = words
        for at in sorted(rnd.sample(range(length), length // 5), reverse=True):
            text = KINDS[kind](text, at)
        found += k in {items[h[1]][0] for h in index.find([prose(30) + text + prose(30)])}
    assert found >= 38


def test_two_places_side_by_side():
    items = [(k, prose(n)) for k, n in enumerate((10, 70, 200))]
    index = Index(items, 0.2, 0.99, 7)
    for k, words in items:
        text = prose(9) + words + words + prose(40) + words
        got = sorted((h[2], h[3], h[4]) for h in index.find([text]) if items[h[1]][0] == k)
        n = len(words)
        assert got == [(9, n, 0), (9 + n, n, 0), (49 + 2 * n, n, 0)]


def test_clean_texts_are_left_alone():
    index = Index([(k, prose(30)) for k in range(100)], 0.2, 0.99, 7)
    assert not list(index.find([prose(400) for _ in range(100)]))


def test_leaks_and_clean(spark, docs):
    item = prose(20)
    text = " ".join(prose(30) + item + prose(30))
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " ".join(prose(100))), (None, text), (5, " ".join(item[:10]))]
    rows.append((6, " ".join(prose(60_000) + item)))
    frame = docs(rows).withColumnRenamed("source", "item_id").withColumnRenamed("lang", "edits")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "a b"), (None, " ".join(prose(9)))], ITEM)
    for block in (1_000_000, 10):
        got = decontaminate.leaks(frame, items, block_words=block).collect()
        assert sorted((r.doc_id or 0, r.item_id, r.start_word) for r in got) == [(0, 7, 30), (1, 7, 30), (1, 7, 30), (6, 7, 60_000)]
        left = decontaminate.clean(frame, items, block_words=block)
        assert left.columns == frame.columns
        assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]
    assert decontaminate.leaks(frame, items.limit(0)).count() == 0
    assert decontaminate.clean(frame, items.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs([]), items).count() == 0


def test_query_finds_every_exact_copy(spark, folder):
    texts = [(r.doc_id, " ".join(words_of(r.text))) for r in catalog.documents(spark, folder).collect()]
    items = [(r.item_id, " ".join(words_of(r.text))) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in texts for i, x in items if f" {x} " in f" {t} "}
    rows = catalog.QUERIES["op5_benchmark_leaks"](spark, folder).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}
    assert {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == want
