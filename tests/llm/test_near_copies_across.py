"""Components that belong together meet by a few pairs of each node, not by all."""

import numpy as np
import pyarrow as pa

from folioscope.llm import near_copies as nc


def test_nearest_pairs_grow_with_the_nodes():
    n = 60  # one key, two components of alike sets
    columns = [pa.array(np.full(2 * n, 5, np.int64)), pa.array(np.arange(2 * n)), pa.array(np.full(2 * n, 100, np.int32)), pa.array(np.zeros(2 * n, np.int32)), pa.array(np.arange(2 * n) // n)]
    columns += [pa.array(np.zeros(2 * n, np.int64)) for _ in nc.PARITIES]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "node", "size", "place", "part", *nc.PARITIES])
    count = lambda made: sum(b.num_rows for b in made)
    assert count(nc._met_across(iter([batch]), nearest=False)) == n * n
    assert n <= count(nc._met_across(iter([batch]), nearest=True)) <= 2 * n
