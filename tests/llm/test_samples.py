"""Training samples stay bounded where rows repeat, and learn every language."""

from pyspark.sql import functions as F

from webloom.llm import byte_cnn, skip_chain_crf


def test_every_language_is_learned(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 100).alias("lang"))
    assert byte_cnn.trained(docs, rows=2).langs == sorted(f"l{k}" for k in range(100))
    assert byte_cnn.trained(docs, rows=2, langs=3).langs == ["l0", "l1", "l10"]


def test_samples_do_not_grow_with_one_id_or_one_row(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(byte_cnn.ByteCNN, "train", lambda self, ids, labels: seen.update(cnn=len(ids)))
    monkeypatch.setattr(skip_chain_crf.SkipChainCRF, "fit", lambda self, rows: seen.update(crf=len(rows)))
    rows = spark.range(40000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("mail a@b.cd number "), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(1)).alias("text"), F.lit("en").alias("lang"))
    byte_cnn.trained(rows, rows=50)
    skip_chain_crf.trained(rows, rows=50)
    assert 5 <= seen["cnn"] <= 100 and 10 <= seen["crf"] <= 300
