import numpy as np

from raremill.llm import catalog, mixing

SPEC = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def rows_of(spark):
    rows = []
    for k in range(900):
        source = "hot" if k % 3 == 0 else f"s{k % 7}"
        rows.append((k, "word " * (1 + k % 40) + (" | " if k % 5 == 0 else ""), ["en", "de", None][k % 3 if k % 4 else 0], source, k))
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_marginals_meet_their_targets(spark):
    docs = spark.createDataFrame(rows_of(spark), DOCS)
    cells = mixing.described(docs).groupBy("_mix.source", "_mix.lang", "_mix.topic").agg({"_mix.tokens": "sum"})
    cells = cells.toDF("source", "lang", "topic", "tokens")
    raked = mixing.rake(cells, SPEC).toPandas()
    assert abs(raked.weight.sum() - 1) < 1e-9
    for dim, power in SPEC.items():
        own = raked.groupby(dim)[["tokens", "weight"]].sum()
        goal = own.tokens.astype(float) ** power
        assert np.allclose(own.weight, goal / goal.sum(), atol=1e-7)
    chances = mixing.calibrate(spark.createDataFrame(raked), 0.4).toPandas()
    assert abs((chances.tokens * chances.probability).sum() / chances.tokens.sum() - 0.4) < 1e-6
    assert chances.probability.between(0, 1).all()


def test_explicit_targets_and_capping(spark):
    docs = spark.createDataFrame(rows_of(spark), DOCS)
    goal = spark.createDataFrame([("hot", 1.0), ("s1", 3.0), ("absent", 9.0)], "value string, weight double")
    got = mixing.drawn(docs, {"source": goal}, 0.5).select("_mix.*").toPandas()
    assert (got[~got.source.isin(["hot", "s1"])].probability == 0).all()
    assert (got[got.source == "s1"].probability == 1).all()
    assert got[got.source == "hot"].probability.nunique() == 1


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "some words", "en", "a", 1), (3, "x " * 100_000, "en", "b", 1), (3, "again", "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "topic")
    got = mixing.drawn(docs, SPEC, 0.9)
    assert got.columns == [*docs.columns, "_mix"] and got.count() == len(rows)
    by = {(r.doc_id, r.text): r["_mix"] for r in got.collect()}
    assert by[(1, None)].kept and by[(1, None)].source == "(none)" and by[(1, None)].topic == "empty"
    left = mixing.sampled(docs, SPEC, 0.9)
    assert left.columns == docs.columns
    assert mixing.sampled(docs, SPEC, 1.0).count() == len(rows) - sum(r["_mix"].probability < 1 and not r["_mix"].kept for r in mixing.drawn(docs, SPEC, 1.0).collect())
    assert mixing.sampled(docs.limit(0), SPEC, 0.5).count() == 0


def test_no_python_runs(spark, folder):
    plan = catalog.QUERIES["op1_mixture"](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_draw_follows_the_chance(spark, folder):
    got = catalog.QUERIES["op1_mixture"](spark, folder).toPandas()
    assert len(got) == catalog.documents(spark, folder).count()
    expected = (got.n_tokens * got.probability).sum()
    assert abs(got[got.kept].n_tokens.sum() / expected - 1) < 0.15
