"""Rows that share an id but not their text."""

from dunlin.llm import passages, toxicity


def test_passages_of_an_ambiguous_id_stay(spark):
    passage = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, passage), (5, "short"), (5, "before " + passage), (7, passage + " end"), (9, None), (9, "x"), (None, passage)], "doc_id long, text string")
    found = passages.passages_by_document(passages.repeated_passages(docs))
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_removed"]) for r in passages.remove_passages(docs, found).collect())
    want = sorted([(1, passage, 0), (5, "short", 0), (5, "before " + passage, 0), (9, "", 0), (9, "x", 0), (0, passage, 0)])
    assert [g for g in got if g[0] != 7] == want
    assert [g[2] >= 80 for g in got if g[0] == 7] == [True]       # an unambiguous id still loses its passage


def test_only_toxic_rows_go_and_all_columns_stay(spark, odd):
    folder, docs = odd
    table = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.learn(table, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = toxicity.keep_clean(table, machine, 0.5)
    assert kept.columns == table.columns
    clean = [r["doc_id"] for r in toxicity.score(table, machine).collect() if r["score"] < 0.5]
    assert sorted(map(str, clean)) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert toxicity.keep_clean(table.limit(0), machine, 0.5).collect() == []
