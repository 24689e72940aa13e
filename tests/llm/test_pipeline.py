import duckdb
import numpy as np

import corpus_pipeline as cp
from skein.llm import catalog, decontamination, packing, shared
from skein.llm.decontamination import words


def test_stages(spark, sf):
    docs = shared.table(spark, sf, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = shared.materialize(stage(spark, docs, sf), name)
        assert out.columns == cp.COLUMNS
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name in ("language_id", "simhash_near_dedup"):
            assert all(before[k] == t for k, t in after.items()) and len(after) > 0.8 * len(before)
        if name == "simhash_near_dedup":
            assert len(set(after.values())) == len(after)
        if name == "decontamination":
            items = [words(r.text) for r in shared.table(spark, sf, "benchmark").collect()]
            wins = {tuple(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
            left = sum(tuple(w[i : i + 8]) in wins for w in map(words, after.values()) for i in range(len(w) - 7))
            assert left == 0
        docs, before = out, after
    pieces = cp.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(before)


def test_stages_take_empty_tables(spark, sf):
    docs = shared.table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stages_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (None, "the other thing within order", "en", "s", 3), (2, "", "en", "s", 0), (3, "the other thing within order", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", docs_extra())
    same = "the other thing within order"

    def left(name):
        out = dict(cp.STAGES)[name](spark, docs, sf)
        assert name == "packing" or out.columns == cp.COLUMNS
        return sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str) if name != "packing" else out.collect()

    # One language is learned: what has no letter goes, all else stays as it is.
    assert left("language_id") == sorted([(None, same, 3), (3, same, 3)], key=str)
    # The null text is a copy of the empty one, and the row of null id a copy of row 3's.
    assert left("simhash_near_dedup") == sorted([(1, None, None), (3, same, 3)], key=str)
    # No text has three pieces of 20 words: nothing is cut, n_chars is made anew.
    assert left("substring_dedup") == sorted([(1, None, None), (2, "", 0), (3, same, 28), (None, same, 28)], key=str)
    assert left("decontamination") == left("substring_dedup")
    pieces = left("packing")
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in pieces) == [("1", 1, 1), ("2", 1, 1), ("3", 6, 6), ("None", 6, 6)]
    assert sorted(r.offset for r in pieces) in ([0, 1, 2, 8], [0, 1, 7, 8], [0, 1, 7, 13], [0, 6, 7, 8], [0, 6, 12, 13], [0, 6, 7, 13])


def test_near_dedup_tells_rows_apart(spark, sf):
    """Rows of null id, of one id in two groups, and listed twice: one row a group stays."""
    from pyspark.sql import functions as F

    rows = [(1, "x"), (None, "x"), (None, "y"), (2, "y"), (2, "z"), (2, "z"), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang string", "source string", "n_chars long"):
        name, kind = c.split()
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    out = dict(cp.STAGES)["simhash_near_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "x"), (2, "y"), (2, "z")]


def test_decontamination_is_one_step(spark, sf):
    """Texts are cut by the worker that finds the hits: a task holds one Python worker, as in the packing."""
    from pyspark.sql import functions as F

    bench = shared.table(spark, sf, "benchmark")
    item = bench.where(F.length("text") > 100).first().text
    rows = [(1, f"Before it, {item} and after."), (2, "nothing of it"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang string", "source string", "n_chars long"):
        name, kind = c.split()
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    out = cp.decontaminate(spark, docs, sf)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {r.doc_id: r for r in decontamination.search(docs, bench, cut="rest").collect()}
    assert found[1].spans and found[1].text == rows[0][1]
    want = {k: decontamination.cut_spans(r.text, r.spans) if r.spans else r.text for k, r in found.items()}
    assert {k: r.rest for k, r in found.items()} == want
    assert {r.doc_id: r.text for r in out.collect()} == {k: t for k, t in want.items() if len(found[k].item_ids) < 2}


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("x")


def test_oracles(spark, sf):
    c = duckdb.connect()
    for t in shared.TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in catalog.ORACLE_SQL.items():
        got = catalog.QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        want = c.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_projection_is_fixed():
    assert np.allclose(packing.signs(3, 2), packing.signs(10, 2)[:3]) and abs(packing.signs(10_000).mean()) < 0.05
