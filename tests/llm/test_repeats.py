"""Removal of repeated passages against all windows of all texts."""

import hashlib
import random
import re

import numpy as np
import pytest

from folioscope.llm import repeats

KIND = "doc_id long, text string, id string, at string, spans string, n_words string, name string"


def brute(docs, least):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    order = lambda i: repeats.LAST if i is None else i
    first = {}
    for i, words in split:
        for a in range(len(words) - least + 1):
            w = tuple(words[a : a + least])
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - least + 1):
            if first[tuple(words[a : a + least])] < order(i):
                gone.update(range(a, a + least))
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    return sorted(map(str, out))


def removed(spark, docs, least, parts=3):
    table = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in docs], KIND).repartition(parts)
    got = repeats.without_repeats(table, least)
    assert [c for c, _ in got.dtypes] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(str(tuple(r)) for r in got.collect())


def corpus(seed, n, words):
    """Texts of shared passages, edited copies, low-entropy stretches and own words."""
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(5, 40))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [r.choice([r.choice(passages), " ".join(str(r.randrange(words)) for _ in range(r.randrange(9))), "z " * r.randrange(30), "\n\t"]) for _ in range(r.randrange(7))]
        text = r.choice([" ", "  \n"]).join(parts)
        if out and r.random() < 0.3:
            text = out[r.randrange(len(out))][1].split() or [""]
            text[r.randrange(len(text))] = "edit"
            text = " ".join(text)
        out.append((i, text))
    return out


@pytest.mark.parametrize("seed, least", [(1, 8), (2, 9), (3, 12), (4, 2), (5, 1)])
def test_removed_words(spark, seed, least):
    docs = corpus(seed, 120, 6)
    assert removed(spark, docs, least) == brute(docs, least)


def test_awkward_rows(spark):
    same = " ".join(f"w{i}" for i in range(70))
    docs = [(None, None), (None, same), (None, same), (3, same), (3, same), (3, "x " + same), (2, ""), (9, same.replace("w60", "other")), (10, "y " * 60), (11, "y " * 49), (12, "y " * 50), (13, " ".join(f"w{i}" for i in range(49)))]
    docs += [(20, " ".join(f"q{i % 977}" for i in range(30_000))), (21, " ".join(f"q{i % 977}" for i in range(500, 9_000)))]
    assert removed(spark, docs, 50) == brute(docs, 50)
    assert removed(spark, [], 50) == []
    assert removed(spark, [(1, None), (2, None)], 50) == brute([(1, None), (2, None)], 50)


def test_blocks_and_pieces(monkeypatch):
    """Windows across the borders of blocks of words and of pieces of a text."""
    from folioscope.llm import common

    monkeypatch.setattr(repeats, "BLOCK", 64)
    monkeypatch.setattr(repeats, "PLACE", np.uint64(1023))
    monkeypatch.setattr(repeats, "pieces", lambda data: common.pieces(data, 50))
    names = repeats.Names()
    words = [f"w{i % 150}" for i in range(400)]
    numbers = [names.sequence(" ".join(words).encode()), names.sequence(b""), names.sequence(" ".join(words[3:180]).encode())]
    assert [len(n) for n in numbers] == [400, 0, 177]
    text, gram, name, first, last = repeats.stretches(numbers, names, 50)
    for t, n in ((0, 400), (2, 177)):
        own = [s for k, a, b in zip(text, first, last) if k == t for s in range(a, b + 1)]
        assert own == list(range(n - 49))  # each full window once
    assert set(gram[text == 2][1:-1]) <= set(gram[text == 0])  # its first and last may stand for fewer windows


def test_whole_pieces():
    from folioscope.llm.common import pieces

    data = b" a  bb ccc\n\tdddd " * 30 + b"e" * 200
    assert [w for p in pieces(data, 7) for w in p.split()] == data.split()
    assert max(len(p) for p in pieces(data, 7)) >= 200 and len(list(pieces(data, 7))) > 20 and list(pieces(b"")) == [b""]
