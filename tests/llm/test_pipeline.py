import corpus_pipeline as p
from pyspark.sql import functions as F

from episcope.llm.decontamination import plain


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        rows = docs.collect()
        left = {r["doc_id"] for r in rows}
        assert left <= ids and len(left) == len(rows) and len(left) > 0.7 * len(ids)
        ids = left
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    items = [plain(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in plain(r["text"]) for r in rows for i in items)
    packed = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_empty_and_null_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [docs.limit(0), spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)]
    for frame in rows:
        for name, stage in p.STAGES:
            frame = p.saved(stage(spark, frame, sf_dir), f"test-{name}")
        frame.count()


def test_run_is_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in p.STAGES:
        docs = p.saved(stage(spark, docs, sf_dir), f"test-{name}")
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in df.collect())
    assert key(p.run(spark, sf_dir)) == key(docs)


def test_extra_columns_with_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain_rows, names = docs, ("n_lines", "N_Dropped", "_key", "label", "score", "doc", "wanted")
    extra = docs.select("*", *((F.col("doc_id") * 10 + i).alias(c) for i, c in enumerate(names)))
    for name, stage in p.STAGES[:-1]:
        columns = extra.columns
        plain_rows, extra = (p.saved(stage(spark, df, sf_dir), f"test-{name}") for df in (plain_rows, extra))
        assert extra.columns == columns
        rows = extra.collect()
        assert all(r[c] == r["doc_id"] * 10 + i for r in rows for i, c in enumerate(names)), name
        key = lambda r: (r["doc_id"], r["text"])
        assert sorted(map(key, rows)) == sorted(map(key, plain_rows.collect())), name
