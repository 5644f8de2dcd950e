import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.queries import queries
from tests.llm.test_dedup_leaks import brute_components, brute_leaks


def test_stages_take_effect_in_order(spark):
    data = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            assert set(rows) == {r.doc_id for r in queries()["op10_toxicity"](spark, data).collect() if not r.predicted}
        if name == "near_dedup":
            found, _ = brute_components([(d, r.text) for d, r in before.items()], 5, 80)
            assert set(rows) == {d for d, c in found.items() if d == c}
        if name == "decontamination":
            assert set(rows) == {d for d, r in before.items() if not brute_leaks(r.text, items)[2]}
        if name == "bpe":
            assert set(rows) == set(before) and all(len(r.ids) == r.n_tokens for r in rows.values())
        else:
            assert out.columns == columns and set(rows) <= set(before) and all(before[d] == r for d, r in rows.items())
            assert len(rows) < len(before) or name == "decontamination"
            docs, before = spark.createDataFrame([*rows.values()], docs.schema), rows
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == set(rows)


def test_stages_take_an_empty_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_stages_take_odd_rows(spark, data):
    """Nulls in any column, empty and very long texts, repeated rows."""
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", None), (3, "word " * 5000, "en", None, 1), (4, "some text of a few words here", "de", "b", 2), (4, "some text of a few words here", "de", "b", 2), (None, "without an id", None, None, None), (5, "x" * 20000, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        got = out.collect()
        assert len(got) <= len(rows) and set(r.doc_id for r in got) <= {r[0] for r in rows}
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "5", "None"]
        if name == "decontamination":
            assert len(got) == len(rows)
        if name == "bpe":
            assert {r.doc_id: r.n_tokens for r in got}[1] == 0


@pytest.mark.parametrize("names", [["score", "predicted", "offending", "Items", "__hit", "k", "rep"], ["contaminated", "items", "row", "n_words", "N_HIT", "__row", "__c1", "a.b", "x`y", "__found", "__k", "__place"]])
def test_stages_keep_columns_of_any_name(spark, data, names):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    plain = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        got = {r[0]: r for r in out.collect()}
        assert out.columns == docs.columns and set(got) == {r.doc_id for r in stage(spark, plain, data).collect()}
        place = out.columns.index(names[0])
        assert all([*r][place:] == [f"{n}{d}" for n in names] for d, r in got.items()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()
