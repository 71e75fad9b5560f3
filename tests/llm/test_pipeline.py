"""The corpus pipeline: each stage on what the one before kept."""

import brute
import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        seen[name] = rows
        before, docs = docs, spark.createDataFrame(rows, out.schema)
        if name == "quality rules":
            assert all(not brute.quality(r["text"])[5] for r in rows)
        if name == "near-dedup":
            kept = {i for i, c in brute.near_duplicates([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80).items() if i == c}
            assert {r["doc_id"] for r in rows} == kept
        if name == "pii":
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            assert len(rows) == len(old)
            assert all((r["text"] == old[r["doc_id"]]) == (not brute.spans(old[r["doc_id"]])) and not brute.spans(r["text"]) for r in rows)
        if name == "mixing":
            words = lambda rs: sum(len(brute.words(r["text"])) for r in rs)
            assert abs(words(rows) - words(seen["pii"])) < 0.1 * words(seen["pii"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}
    tokens = sum(r["length"] for r in seen["packing"])  # the pieces themselves depend on how the input is cut into partitions
    assert sum(r["length"] for r in corpus_pipeline.run(spark, sf).collect()) == tokens


def test_stages_odd(spark, sf, odd, none, clash):
    """Nulls, blank and very long texts, ties, repeated rows, clashing names, and an empty table, stage by stage."""
    for docs in (odd, clash):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            before, out = rows, stage(spark, rows, sf)
            if name == "packing":
                assert out.agg({"length": "sum"}).first()[0] >= before.count()
                continue
            assert out.columns == docs.columns
            rows = spark.createDataFrame(out.collect(), out.schema)
            if name == "quality rules":
                assert rows.where("text is null").count() == 0
            if name == "near-dedup":
                assert rows.where("doc_id = 14").count() <= 1 and rows.count() == rows.dropDuplicates(["doc_id", "text"]).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_run_empty(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
