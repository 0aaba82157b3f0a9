"""The pipeline's near-copy stage against all pairs of texts."""

import random

import numpy as np

import corpus_pipeline
from folioscope.llm import near_copies, simhash
from test_operators import documents

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """The ids that stay of rows(id, text), ascending in id."""
    sets = [set(simhash.shingles(t or "", 5)) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both * 5 >= either * 4:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [rows[i][0] for i in range(len(rows)) if root(i) == i]


def test_kept_are_brute_forces(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLED", 2)
    monkeypatch.setattr(near_copies, "ROUTED", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, "A b", "a B", "a b c"]
    for base in range(4):
        text = [r.choice(words) for _ in range(200)]
        for _ in range(25):
            copy = list(text)
            for _ in range(r.randrange(7)):
                copy[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(copy))
    texts += [f"one very common line that many texts have and {' '.join(r.choice(words) for _ in range(r.randrange(5)))}" for _ in range(80)]
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()] + list(zip(range(90_000, 90_000 + len(texts)), texts))
    rows.sort()
    frame = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    want = brute_kept(rows)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, frame, SF).collect()) == want
    assert len(want) < len(rows) - 100


def test_parities_never_tell_similar_sets_apart():
    r = random.Random(4)
    for _ in range(300):
        text = [str(r.randrange(10**6)) for _ in range(r.choice([5, 9, 40, 300, 2000]))]
        copy = list(text)
        for _ in range(r.randrange(1, 2 + len(text) // 60)):
            copy[r.randrange(len(copy))] = "new"
        a, b = (near_copies.shingle_set(" ".join(t)) for t in (text, copy))
        both = len(set(a.tolist()) & set(b.tolist()))
        if near_copies.similar(a, b):
            apart = int(np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum())
            assert apart <= len(a) + len(b) - 2 * both <= (len(a) + len(b)) / 9
            assert near_copies.may_be_similar(near_copies.sketch(a).tobytes(), len(a), near_copies.sketch(b).tobytes(), len(b))
            assert len(np.intersect1d(near_copies.prefix(a, a[:0]), near_copies.prefix(b, a[:0])))
