"""DuckDB SQL of those queries of the training-data operators that SQL can express."""

from __future__ import annotations

from folioscope.llm import clusters, resampling

#: A text with A-Z in lower case.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
#: crc32, bit by bit, of a word's bytes in the column b.
CRC = "xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: list_reduce([xor(c, x)] || CAST(range(0, 8) AS UBIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)), 4294967295::UBIGINT)"


def resampling_sql(buckets: int = resampling.BUCKETS, seed: int = resampling.SEED, least_words: int = resampling.LEAST_WORDS, percent: int = resampling.PERCENT) -> str:
    of = lambda name, table, key: f"""{name} AS MATERIALIZED (SELECT {key} AS id, word, count(*) AS n FROM (SELECT {key}, unnest({WORDS}) AS word FROM {table}) GROUP BY ALL)"""
    return f"""
WITH {of("own", "documents", "doc_id")}, {of("wanted", "benchmark", "item_id")},
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION SELECT word FROM wanted)),
bytes AS (SELECT word, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)) AS b FROM words),
bucket_of AS MATERIALIZED (SELECT word, {CRC} % {buckets} AS bucket FROM bytes),
s AS (SELECT bucket, sum(n) AS s FROM own JOIN bucket_of USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM wanted JOIN bucket_of USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM own) AS ss, (SELECT coalesce(sum(n), 0) FROM wanted) AS tt),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss::DOUBLE + {buckets}) / ((coalesce(s, 0)::DOUBLE + 1) * (tt::DOUBLE + {buckets})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sums),
sums_of AS (SELECT id AS doc_id, sum(n) AS n, sum(n * gain) AS total FROM own JOIN bucket_of USING (word) JOIN gains USING (bucket) GROUP BY id),
weighed AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN sums_of USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= {percent} * n // 100 THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


def repeats_sql(least: int = 50) -> str:
    return rf"""
WITH split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {least} + 2)) AS i FROM split WHERE len(words) >= {least}),
windows AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(words[i:i + {least - 1}], ' ')) AS name FROM starts),
again AS (SELECT name, min(doc_id) AS least FROM windows GROUP BY name HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {least})) AS i FROM windows JOIN again USING (name) WHERE doc_id > least),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def clusters_sql(k: int = clusters.K, rounds: int = clusters.ROUNDS, seed: int = clusters.SEED, dims: int = clusters.DIMS, scale: int = clusters.SCALE) -> str:
    def nearest(step: int) -> str:
        return f"""near{step} AS MATERIALIZED (
  SELECT id, arg_min(c, d * {k} + c) AS cluster, min(d) AS distance
  FROM (SELECT id, c, sum((x - y) * (x - y)) AS d FROM parts JOIN at{step} USING (i) GROUP BY id, c) GROUP BY id)"""

    steps = []
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"""at{r + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m, y) AS y FROM at{r}
  LEFT JOIN (SELECT cluster AS c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM near{r} JOIN parts USING (id) GROUP BY ALL) USING (c, i))""")
    steps.append(nearest(rounds))
    return f"""
WITH held AS (
  SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
points AS MATERIALIZED (SELECT id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS point FROM held),
parts AS MATERIALIZED (SELECT id, unnest(point) AS x, unnest(range(1, {dims} + 1)) AS i FROM points),
starts AS (SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), point) - 1 AS c FROM points QUALIFY c < {k}),
at0 AS MATERIALIZED (SELECT c, i, x AS y FROM starts JOIN parts USING (id)),
{", ".join(steps)},
centroids AS (SELECT c AS cluster, sha256(string_agg(CAST(y AS BIGINT)::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM at{rounds} GROUP BY c)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN points USING (id) JOIN centroids USING (cluster)
"""
