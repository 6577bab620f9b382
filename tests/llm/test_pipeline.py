"""The pipeline against a brute-force version of its decisions."""

import corpus_pipeline
from pathloom.llm._common import table
from pathloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    start = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= set(before)
        if name != "mixing":
            assert len({r.doc_id for r in rows}) == len(rows) > 0.7 * len(before)
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id].text)
        if name == "minhash_dedup":
            from tests.llm.test_operators import shingle_set

            sets = {r.doc_id: shingle_set(r.text) for r in rows}
            ids = [i for i in sets if sets[i]]
            assert not any(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
        docs = spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in docs.collect()} <= set(start)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.where("offset = 0").count() == out.select("sequence_id").distinct().count()


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert sorted({k.split("_")[0] for k in QUERIES if k.startswith("op")}, key=lambda k: int(k[2:])) == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)


def test_stages_take_odd_and_empty_tables(spark):
    """Nulls in each column, empty texts, ties, equal rows and rows that share an id, through each stage and all of them."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, base, "en", "a", 5), (1, base, "en", "a", 5), (1, base + " once more", None, "a", 5), (2, base, "en", None, None), (None, base, "en", "b", 1), (None, base, "en", "b", 1), (3, None, "de", "b", 0), (4, "", "de", "c", 0), (5, " \n ", None, "c", 3), (6, "word " * 9000, "en", "c", 45000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            left = out.collect()
            assert bool(left) == bool(data)
            docs = spark.createDataFrame(left, schema)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert bool(out) == bool(data)
    alone = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sum(r.text is not None and r.text.startswith("the quick") for r in alone) == 1  # 12 of 14 shingles are shared
