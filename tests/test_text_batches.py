"""What a Python worker gets of the texts at once is bounded by the reader of the tables."""

from folioscope.sources import corpus


def test_batches_of_a_table(spark, tmp_path):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus.table(spark, str(tmp_path), "documents").count() == 3
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
