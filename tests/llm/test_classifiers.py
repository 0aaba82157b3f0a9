"""The classifiers' queries against versions that go through each text plainly, word by word and line by line."""

import math
import re
import zlib

import numpy as np
import pytest

from folioscope.llm import quality, toxicity
from folioscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def rows_of(spark, table):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{table}.parquet").collect()]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def training(spark, label, folds, held):
    texts = {}
    for r in rows_of(spark, "documents"):
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    labels = [(r["doc_id"], r[label]) for r in rows_of(spark, "labels") if r[label] is not None and fold(r["doc_id"], folds) != held]
    return [(t, int(y > 0)) for i, y in labels for t in texts.get(i, [])]


def best_stretch(scores):
    best, total, start = (0.0, 0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best[0] + 1e-12:
            best = (total, start, i + 1)
    return best


def all_stretches(scores):
    total, a, b = best_stretch(scores)
    return [*all_stretches(scores[:a]), total, *all_stretches(scores[b:])] if total > 0 else []


def word_scores(text, lexicon, loss):
    out = []
    for w in re.findall(r"\w+", text.lower()):
        odds = [lexicon.get(f, 0.0) for f in [w, *(w[:n] + "-" for n in (4, 5, 6, 7) if len(w) >= n)]]
        out.append((max(odds) if max(odds) > 0 else odds[0]) - loss)
    return out


def test_toxicity_is_the_plain_versions(spark):
    sample = training(spark, "toxic", 4, 2)
    n = [sum(y == k for _, y in sample) for k in (0, 1)]
    seen, words = {}, {}
    for text, y in sample:
        for w in set(re.findall(r"\w+", text.lower())):
            for f in [w, *(w[:k] + "-" for k in (4, 5, 6, 7) if len(w) >= k)]:
                seen.setdefault(f, [set(), set()])[y].add(id(text))
                words.setdefault(f, set()).add(w)
    lexicon = {}
    for f, (y0, y1) in seen.items():
        y0, y1 = len(y0), len(y1)
        prior = 20 * (y0 + y1) / sum(n)
        odds = math.log((y1 + prior) / max(n[1] + 20 - y1 - prior, 0.5)) - math.log((y0 + prior) / max(n[0] + 20 - y0 - prior, 0.5))
        z = odds / math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        if y0 + y1 >= 4 and (z >= 4 and (f[-1] != "-" or len(words[f]) > 1) or z <= -4 and f[-1] != "-"):
            lexicon[f] = odds
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model.lexicon == pytest.approx(lexicon) and lexicon and model.loss in toxicity.LOSSES

    clean = [word_scores(t, lexicon, model.loss) for t, y in sample if not y]
    flat = [s for x in clean for s in x]
    found = [s for x in clean for s in all_stretches(x)]
    if found:
        assert sum(math.exp(model.rate * s) for s in flat) / len(flat) == pytest.approx(1, abs=1e-6) or model.rate > 19.9
        assert model.k == pytest.approx(len(found) / (len(flat) * math.exp(-model.rate * min(found))))

    def evidence(text):
        scores = word_scores(text, lexicon, model.loss)
        each = [max(0.0, model.rate * s - math.log(max(model.k * len(scores), 1e-9))) for s in all_stretches(scores)]
        return math.log1p(max(each, default=0.0)), math.log1p(sum(each)), 1.0

    x, y = np.array([evidence(t) for t, _ in sample]), np.array([y for _, y in sample])
    p = 1 / (1 + np.exp(-x @ model.weights))
    assert np.abs(x.T @ (y - p) - np.array([1, 1, 1e-3]) * model.weights).max() < 1e-4  # the ridge-penalised likelihood is at its top
    got = sorted(QUERIES["op6_toxicity"](spark, SF).collect(), key=lambda r: r["doc_id"])
    docs = sorted(rows_of(spark, "documents"), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        want = sigmoid(float(np.dot(evidence(d["text"] or ""), model.weights)))
        assert (r["doc_id"], r["held_out"]) == (d["doc_id"], fold(d["doc_id"], 4) == 2)
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3)


def plain_line(line):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
    if not words:
        return [0.0] * 9 + [1.0]
    count = lambda pattern: len(re.findall(pattern, line))
    upper, lower, symbols, kinds = count("[A-Z]"), count("[a-z]"), count(r"[!#$%&*+/<=>@\\^_`{|}~]"), len(set(words))
    n, size = len(words), len(line)
    return [math.log1p(n) / 5, upper / (upper + lower + 1), float(upper > lower), min(1.0, symbols / n), float(symbols * 3 > n), count("[0-9]") / size, 1 - kinds / n, float(kinds * 2 < n), min(2.0, size / n / 10), 0.0]


def plain_quality(text, model):
    lines = text.split("\n")
    own, none = [plain_line(x) for x in lines], [0.0] * 10
    good = []
    for i, line in enumerate(lines):
        row = own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(lines) else none)
        row += [float(lines.count(line) > 1 and line != ""), float(i == 0), float(i == len(lines) - 1)]
        good.append(float(np.dot(row, model.chain.emit[:-1]) + model.chain.emit[-1]))
    add = np.logaddexp
    forward, back = [[0.0, good[0]]], [[0.0, 0.0]]
    for g in good[1:]:
        forward.append([add(forward[-1][0] + model.chain.move[0, y], forward[-1][1] + model.chain.move[1, y]) + y * g for y in (0, 1)])
    for g in good[:0:-1]:
        back.append([add(model.chain.move[y, 0] + back[-1][0], model.chain.move[y, 1] + g + back[-1][1]) for y in (0, 1)])
    marginals = [sigmoid(f[1] + b[1] - f[0] - b[0]) for f, b in zip(forward, back[::-1])]
    sizes = [len(x.encode()) + 1 for x in lines]
    return sigmoid(model.weights[0] * sum(m * s for m, s in zip(marginals, sizes)) / sum(sizes) + model.weights[1])


def test_quality_is_the_plain_versions(spark):
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op2_quality"](spark, SF).collect()}
    docs = rows_of(spark, "documents")
    assert len(got) == len(docs) and model.chain is not None
    for d in docs:
        r = got[d["doc_id"]]
        assert r["score"] == pytest.approx(plain_quality(d["text"] or "", model), abs=1e-6)
        assert (r["held_out"], r["predicted"]) == (fold(d["doc_id"], 5) == 0, int(r["score"] >= 0.3))


def test_sample_bounds_whole_texts(spark):
    """The bounds choose documents in the order of their hashes, whole ones whatever their length; the last may pass the bound."""
    from pyspark.sql import functions as F

    from folioscope.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * 10) for i in range(100)] + [(200, "y" * 390), (201, "z" * 401), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 1), (201, 1), (None, 1), (7, 0)], "doc_id long, toxic int")
    sample = lambda d, most=1000, size=400: labelled_sample(d, labels, "toxic", 4, 2, most, F.length("text"), size).collect()
    some = sample(docs)
    total = sum(len(r["text"]) for r in some)
    assert {r["text"] for r in some} <= {"x" * 10, "y" * 390, ""} and 400 <= total < 400 + 390
    assert sorted(map(tuple, some)) == sorted(map(tuple, sample(docs.repartition(5))))
    assert len(sample(docs, 5)) <= 6 and "y" * 390 in {r["text"] for r in sample(docs, size=100_000)}


def test_the_loss_is_chosen_in_the_training_rows(spark, monkeypatch):
    """Labels of the held-out fold change nothing of the model."""
    from pyspark.sql import functions as F

    from folioscope.llm.common import crc_fold

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(crc_fold("doc_id", 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a == b and a.loss in toxicity.LOSSES
    # a clean text's one doubtful word: with the small loss alone it makes a passage
    train = [("bad awful words here", 1), ("fine words here", 0)] * 40
    sample = spark.createDataFrame([(f"{t} n{i}", y) for i, (t, y) in enumerate(train)], "text string, label int")
    assert toxicity.chosen_loss(sample) in toxicity.LOSSES and toxicity.chosen_loss(sample.where("label = 0")) == toxicity.LOSSES[-1]


def test_one_labelled_text_over_any_bound(spark, monkeypatch):
    """The fits go on without it."""
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    monkeypatch.setattr(quality, "SAMPLE_LINES", 300)
    rows = [(i, "awful nasty words\n" * 3 if i % 2 else "quiet fine words\nof a day") for i in range(80)] + [(500, "long line of words\n" * 3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels).lexicon and quality.fit(docs, labels).chain is not None


def test_texts_without_a_beginning_are_skipped(spark):
    """The scan that passes over clean texts gives the same scores as the one that splits every text."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    memory = toxicity.Odds(model)
    texts = [r["text"] or "" for r in rows_of(spark, "documents")] + ["", "ΑΣ İ"] + [f.removesuffix("-").upper() + " x" for f in model.lexicon] + ["x" + f.removesuffix("-") for f in model.lexicon] + [f"😀{f.removesuffix('-')}x _{f.removesuffix('-')}" for f in model.lexicon]
    skipped = 0
    for t in texts:
        n, found = model.passages(t, memory)
        m, own = model.scanned(t, memory)
        assert own == found and model.score(n, found) == model.score(m, own) and (m == n or not own)
        skipped += m != n
    assert skipped > len(texts) / 4 and toxicity.ToxicModel({}, 1.0, 1.0, [0.0, 0.0, 0.0]).scanned("a b", toxicity.Odds(toxicity.ToxicModel({}, 1.0, 1.0, []))) == (0, [])


def test_batches_are_one_size_for_all(spark):
    """Building one operator doesn't change how another one's plan, built before, runs."""
    from folioscope.llm import common

    docs = spark.range(20).selectExpr("id doc_id", "'a' text")
    sizes = lambda: [spark.conf.get(f"spark.sql.execution.arrow.{c}") for c in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    common.id_and_text(docs)
    before = sizes()
    from folioscope.llm.bpe import encode_decode, with_ids
    from folioscope.llm.queries import tokenizer_file

    for made in (encode_decode, with_ids):
        made(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), r"\S+")
        assert sizes() == before
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (3, 4, 5, 1)]
    assert [b.num_rows for b in common.joined(iter(batches), 8, 1 << 20)] == [7, 6] and [b.num_rows for b in common.joined(iter(batches), 100, 1)] == [3, 4, 5, 1]
