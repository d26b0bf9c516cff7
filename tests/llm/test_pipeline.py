"""The pipeline: its stages keep the columns, their decisions take effect, and clean documents stay."""

import random

from pyspark.sql import functions as F


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeghijkmnp") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") for _ in range(n)) + "."
    items = [(k, text(30)) for k in range(3)]
    rows, drop = [], set()
    for k in range(120):
        t = text(r.randint(40, 90))
        if k % 12 == 1:
            t, _ = t.upper(), drop.add(k)
        elif k % 12 == 2:
            t, _ = t + " " + items[k % 3][1], drop.add(k)
        elif k % 12 == 3:
            t, _ = rows[k - 3][1] + " end.", drop.add(k)
        elif k % 12 == 4:
            t = t + " mail me at some.one@mail.example.com"
        rows.append((k, t, "en", f"s{k % 4}", len(t)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    masked = {x["doc_id"]: x["text"] for x in at.collect()}
    assert set(masked) == set(range(120)) - drop
    assert all(("<EMAIL>" in t) == (k % 12 == 4) and "@" not in t for k, t in masked.items())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in out.select("doc_id").collect()} == set(masked)
    total = out.agg(F.sum("size"), F.sum("taken")).first()
    assert abs(total[1] - 1.5 * total[0]) <= 4
