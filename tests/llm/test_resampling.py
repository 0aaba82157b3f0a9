"""Importance resampling against a version that goes text by text."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from folioscope.llm import resampling

KIND = "doc_id long, text string, weight string, score string, rank string, ids string, place string"


def brute(docs, target, buckets, longest, least_words, percent):
    def features(text):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = ([features(t) for t in texts] for texts in ([t for _, t in docs], target))
    s, t = (Counter(at(f) for _, fs in side for f in fs) for side in (own, wanted))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    rows = []
    for (doc_id, _), (n, fs) in zip(docs, own):
        weight = sum(gain(at(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(str, (r[:5] for r in rows)))


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice(["Alpha", "beta", "Ärger", "ärger", "x1", "日本", "a-b", "c_d", "Ж", " "]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 50)])
def test_scores_and_ranks(spark, monkeypatch, longest, percent):
    monkeypatch.setattr(resampling, "pieces", lambda data: __import__("folioscope.llm.common", fromlist=["pieces"]).pieces(data, 40))  # many pieces a text
    docs = [*enumerate(texts(1, 150)), (None, None), (None, "one two three " * 9), (7, "tie " * 30), (7, "tie " * 30), (900, ""), (901, "long words here " * 40_000)]
    target = [*texts(2, 20), None, ""]
    table = spark.createDataFrame([(i, t, "w", "s", "r", "i", "p") for i, t in docs], KIND).repartition(3)
    got = resampling.resample(table, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), 97, longest, percent=percent)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(str([*r]) for r in got.collect()) == brute(docs, target, 97, longest, 20, percent)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([(1, "word " * 30), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert sorted(str([*r]) for r in resampling.resample(docs, target, percent=100).collect()) == brute([(1, "word " * 30), (2, None)], [], 10_000, 1, 20, 100)


def test_a_block_is_a_sparse_matrix(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c")], "id long, text string").coalesce(1)
    block = resampling.blocks(rows, 1 << 30).first()
    number = lambda w: zlib.crc32(w) % (1 << 30)
    assert block["ids"] == [1, 2, 3] and block["ptr"] == [0, 2, 2, 3] and block["features"] == [3, 0, 1]
    assert dict(zip(block["bucket"], block["count"])) == {number(b"a"): 1, number(b"b"): 2, number(b"c"): 1}
