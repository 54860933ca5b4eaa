import zlib
from hashlib import md5

import numpy as np
import pandas as pd
import test_near_dedup
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from raremill.llm import catalog, toxicity
from raremill.llm.bpe import default_vocabulary
from raremill.llm.decontaminate import fitting_edits, words_of


def leaking(text, items):
    codes = {}
    own = np.array([codes.setdefault(w, len(codes)) for w in words_of(text)], np.int64)
    for words in items:
        item = np.array([codes.get(w, -1) for w in words], np.int64)
        if len(words) >= 5 and fitting_edits(item, own)[0] <= int(0.2 * len(words)):
            return True
    return False


def mixed(rows):
    """Raking and draws restated with pandas."""
    df = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    df["t"] = df.text.fillna("").str.split(r"[ \t\n\v\f\r]+", regex=True).map(lambda w: sum(map(bool, w)))

    def topic(text, t):
        if t == 0:
            return "empty"
        for name, mark in (("licence", "icens"), ("table", " | "), ("contact", "@"), ("assignment", "=")):
            if mark in text:
                return name
        return "short" if t < 100 else "medium" if t < 1000 else "long"

    df["topic"] = [topic(x, t) for x, t in zip(df.text.fillna(""), df.t)]
    dims = ["source", "lang", "topic"]
    df[dims[:2]] = df[dims[:2]].fillna("(none)")
    cells = df.groupby(dims).t.sum().astype(float).reset_index()
    w = cells.t.copy()
    goals = {d: cells.groupby(d).t.sum() ** catalog.MIX_TARGETS[d] for d in dims}
    for _ in range(400):
        for d in dims:
            total = w.groupby(cells[d]).transform("sum")
            w = w * (goals[d] / goals[d].sum()).loc[cells[d]].to_numpy() / total.where(total > 0, 1)
    share = (w / cells.t.where(cells.t > 0, 1)).to_numpy()
    low, high = 0.0, 1e12
    for _ in range(300):
        x = (low + high) / 2
        enough = (np.minimum(1, x * share) * cells.t).sum() >= catalog.MIX_RATE * cells.t.sum()
        low, high = (low, x) if enough else (x, high)
    cells["p"] = np.where(cells.t == 0, 1, np.minimum(1, high * share))
    df = df.merge(cells.drop(columns="t"), on=dims)
    draw = df.doc_id.map(lambda i: int(md5(f"mixing:7:{i}".encode()).hexdigest()[:8], 16) / 2**32)
    return set(df.doc_id[draw < df.p])


def test_pipeline_equals_its_restatement(spark, folder):
    docs = catalog.documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = catalog.toxicity_model(docs, labels)
    fine = {r.doc_id for r in toxicity.scored(docs, model).collect() if not r.predicted}
    rows = {r.doc_id: r for r in docs.collect()}
    groups = test_near_dedup.brute([(i, rows[i].text) for i in fine], 5, 80)
    fine = {i for i, _, _, kept in groups if kept}
    items = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    fine = {i for i in fine if not leaking(rows[i].text, items)}
    fine = mixed([(i, rows[i].text, rows[i].lang, rows[i].source) for i in sorted(fine)])
    plain, start, want = Tokenizer.from_file(default_vocabulary()), 0, []
    for i in sorted(fine):
        ids = np.array([*plain.encode(rows[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert len(want) > 50 and got == want


def test_stages_keep_the_columns_and_stand_odd_rows(spark, docs, tmp_path):
    rows = docs([(1, None), (2, ""), (None, "some words"), (3, "a " * 60_000), (3, "b c d e"), (4, "b c d e")])
    rows = rows.withColumnRenamed("n_chars", "score")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (rows, rows.limit(0)):
            assert stage(spark, frame, folder).columns == rows.columns, name
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "benchmark_leaks", "mixing", "token_files"]


def test_every_operator_has_its_query():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
