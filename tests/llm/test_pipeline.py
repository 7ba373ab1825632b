from pyspark.sql import functions as F

import corpus_pipeline
from loomq.llm import decontamination, queries
from loomq.llm.language_id import languages

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert after.columns == columns and 0 < after.count() <= before.count()
        if name == "language_id":
            sure = languages(before).filter("lang_pred != 'und' and score >= 0.3")
            assert after.count() == sure.count()
        if name == "near_duplicates":
            classes = queries.jaccard_join.jaccard_classes(before).select("class_id").distinct().count()
            assert after.count() == classes
        if name == "decontamination":
            flagged = decontamination.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated")
            assert after.count() == before.count() - flagged.count()
            assert after.join(flagged, "doc_id").count() == 0
        if name == "secret_scans":
            assert after.filter(F.length("text") != F.col("n_chars")).count() == 0 and after.filter(F.col("text").contains("[SECRET]")).count() > 0
        if name == "packing":
            assert after.agg(F.sum("length")).first()[0] == after.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()


def test_run_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, empty and long texts, and columns with clashing names go through all stages."""
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        pieces = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if name == "empty":
            assert pieces == []
        else:  # letterless and null texts go, of the three copies one stays
            assert {p["doc_id"] for p in pieces} <= {3, 4, 6, None} and {4, 6} <= {p["doc_id"] for p in pieces}
            assert sum(p["length"] for p in pieces if p["doc_id"] in (3, None)) == next(p["doc_tokens"] for p in pieces if p["doc_id"] in (3, None))


def test_oracles(spark):
    import duckdb

    connection = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        result = connection.execute(sql)
        at = [[d[0] for d in result.description].index(c) for c in columns]
        expected = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == expected, name
