import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from raremill.llm import catalog, line_rules

PROSE = "The river ran low that year, and nobody in the village knew why it did. "


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0
    for k, line in enumerate(lines):
        dup += line in lines[:k]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t|#é\x85 \x1c"), max_size=60))
def test_base_counts(text):
    got = line_rules.judge(text, 0.5)
    assert tuple(got[:6]) == brute(text)
    assert not got[6] or not got[5]


def different(n, tail="", start=0):
    return " ".join(f"word{k}a" for k in range(start, start + n)) + tail


def test_each_rule():
    rule = lambda line, seen=False: line_rules.line_rule(line, seen)
    assert rule(PROSE.strip()) is None and rule("A title") is None
    assert rule("Bu$$y %%%% ne&& lo## te** st") == 0
    assert rule("THIS!! IS!! ALL!! SHOUT!! NOW!!") == 0
    assert rule(different(60)) == 0 and rule(different(60, ".")) is None
    assert rule("Home | News | Sport | Login") == 1
    assert rule("Licensed under the Apache License, Version 2.0.") == 2
    assert rule(PROSE.strip(), True) == 3


def test_documents(spark, docs):
    good = "\n".join(different(20, ".", 20 * k) for k in range(4))
    shout = "\n".join([good, " ".join(f"W{k}X!!" for k in range(200))])
    rows = [(1, good), (2, shout), (3, None), (4, ""), (5, "short"), (6, good), (None, good), (7, "x " * 200_000)]
    frame = docs(rows).withColumnRenamed("lang", "kept")
    got = {r.doc_id: r for r in line_rules.line_quality(frame).collect()}
    assert {k for k, r in got.items() if r.kept} == {1, 6, None}
    assert got[2].punctuation_lines == 1 and "W1X" not in got[2].cleaned
    assert got[3].n_words == got[4].n_words == 0 and got[3].base_failed
    assert line_rules.line_quality(docs([])).count() == 0


def test_query_equals_brute_force(spark, folder):
    texts = {r.doc_id: r.text or "" for r in catalog.documents(spark, folder).collect()}
    rows = catalog.QUERIES["op3_line_quality"](spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {k: brute(t) for k, t in texts.items()}
