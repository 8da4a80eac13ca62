import corpus_pipeline
from mercata.llm import language, queries, sketch, tiling

from . import helpers as h

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark, tmp_path):
    docs = queries.documents(spark, SF)
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        own = {r.doc_id: r.text for r in before.collect()}
        after = {r.doc_id: r for r in docs.collect()}
        if n < 4:
            assert docs.columns == columns
        if name == "language_id":
            gone = {r.doc_id for r in language.identify(before, queries.language_model(before)).collect() if r.rejected}
            assert set(own) - set(after) == gone
        elif name == "near_dedup":
            groups = h.near_groups(own.items())
            assert set(after) == {d for d, (_, c) in groups.items() if c == d}
        elif name == "suffix_array_dedup":
            want = {r[0]: r[4].decode("utf-8", "ignore") for r in h.repeated_bytes(list(own.items()), 50)}
            assert {d: r.text for d, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != own[r.doc_id])
        elif name == "decontamination":
            bad = {r.doc_id for r in tiling.contaminated(before, queries.table(spark, SF, "benchmark")).collect()}
            assert set(after) == set(own) - bad
        else:
            assert set(after) == set(own)


def test_run_gives_pieces(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and rows.count() > 0


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(h.odd_documents(), h.SCHEMA)
    empty = docs.limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        assert found.count() <= 200_000
        if n < 4:
            assert found.columns == docs.columns
        assert stage(spark, empty, SF).collect() == []


def test_stages_keep_columns_with_clashing_names(spark):
    """Columns named like those the operators make; a text without n_chars beside it."""
    docs = h.with_clashes(spark, h.odd_documents())
    plain = spark.createDataFrame(h.odd_documents(), h.SCHEMA)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF)
        if n == 4:
            assert found.count() == stage(spark, plain, SF).count()
            break
        assert found.columns == docs.columns
        rows = found.collect()
        assert h.ordered(tuple(r)[:5] for r in rows) == h.ordered(tuple(r) for r in stage(spark, plain, SF).collect())
        assert all(r["chunk"] == "chunk" and r["node"] == "node" for r in rows)
        short = plain.drop("n_chars")
        assert stage(spark, short, SF).columns == short.columns


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([r for r in h.odd_documents() if r[0] in (10, 11, 12, 13, 17, 19, 21)], h.SCHEMA)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in sketch.near_duplicates(docs).collect() if r.kept} == {10, 17, 21}
