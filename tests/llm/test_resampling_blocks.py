"""Blocks of the matrix and their row groups are small, however many texts a task reads."""

import glob

import pyarrow.parquet as pq

from folioscope.llm import resampling
from folioscope.llm.common import stored


def test_blocks_are_bounded(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(700)], "doc_id long, text string").coalesce(1)
    made = resampling.blocks(docs, 10_000, 1)
    rows = made.selectExpr("size(ids) as n", "size(bucket) as cells").collect()
    assert sum(r.n for r in rows) == 700 and max(r.n for r in rows) * len(text) <= resampling.BLOCK_BYTES
    table = stored(made.unionByName(made).unionByName(made).coalesce(1), "blocks", resampling.ROW_GROUP)
    (path,) = glob.glob(table.inputFiles()[0].removeprefix("file:"))
    meta = pq.read_metadata(path)
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) * resampling.BLOCK_BYTES < 64 << 20
