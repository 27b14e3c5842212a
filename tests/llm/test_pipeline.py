"""The pipeline's stages, each against what it should keep of its own input."""

import duckdb
import public_tokenizers  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from sylvan.llm import leaks, near_duplicates, privacy, quality
from sylvan.llm.common import documents

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, kept = documents(spark, FOLDER), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER).persist()
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept.append({r.doc_id: r.text for r in out.collect()})
        docs = out
    whole = {r.doc_id: r.text for r in documents(spark, FOLDER).collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall())
    good, one, clean, private = kept
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    assert sum(i in good for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    assert set(one) <= set(good) and all(one[i] == whole[i] for i in one)
    first = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    assert set(one) <= set(first.values())
    sets = {i: set(near_duplicates.shingles(t, 5)) for i, t in good.items()}
    gone = set(first.values()) - set(one)
    assert all(any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items() if j != i) for i in gone)
    items = [t for (t,) in duckdb.sql(f"select text from '{FOLDER}/benchmark.parquet'").fetchall()]
    assert not any(x in t for t in clean.values() for x in items) and len(clean) >= len(one) - sum(any(x in t for x in items) for t in one.values()) - 5
    assert set(private) == set(clean) and docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert docs.where(privacy.able(F.col("text"))).count() == documents(spark, FOLDER).join(docs.select("doc_id"), "doc_id").where(privacy.able(F.col("text"))).count()


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and rows.count() > 100
    assert callable(leaks.contaminated) and callable(quality.train)


def written_tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit("x") for c in CLASH}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


CLASH = ["entities", "score", "hits", "_score", "_hits", "_row", "_id", "_key", "text_key", "digest", "bands", "row", "first", "known", "shard", "piece", "length", "sequence_id"]
ROWS = [
    (1, "Some plain words of a first document.", "en", "s", 37), (1, "Some plain words of a first document.", "en", "s", 37), (2, None, None, None, None), (3, "", "en", None, 0), (None, "A text without an id, by Mr Smith.", None, "s", 34),
    (4, "long " * 60_000, "en", "s", 300_000), (5, "mail a@b.org now " * 300, "en", "s", 5_100), (6, "Été \U0001f600\n\n\t日本語", "fr", "s", 9),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and columns whose names the operators use: every stage gives the columns of documents, and the last one all tokens."""
    written_tables(spark, tmp_path, ROWS, [(1, 1), (4, 1), (None, 0), (5, None)], [(1, None), (None, "plain words"), (2, "")])
    docs = documents(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6, None} <= set(ids) and len({2, 3} & set(ids)) == 1  # of the two empty texts one stays
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(ids) and all(r.length <= 2048 for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    written_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
