"""Toxicity by maximum-scoring segments.

Words, and the beginnings of words (for coined compounds), get log-odds between toxic and other labelled documents with an
informative Dirichlet prior (the pooled frequencies), which keeps rare ones near zero; those that aren't significant count
as zero, those typical of clean documents are negative. A word's score is its log-odds less a constant, what it must bring to go
on with a passage; the constant is chosen within the training rows, by fitting on one half and scoring the other. One linear scan (Ruzzo and Tompa) over the scores finds all maximal segments: the toxic passages. Their
scores follow an extreme-value law whose parameters come from the clean labelled documents (lambda solves
sum p exp(lambda s) = 1; K counts their segments), so that a passage's significance accounts for the text's length; the
significances are summed and calibrated to a probability.

The labels' sample is bounded (SAMPLE documents; whole texts, until they have SAMPLE_CHARS characters together); so are, with it, the
significant words, each in LEAST_DOCS documents of the sample or more, which is why they may be sent to all executors. Nulls
count as empty texts; these have no passage and the lowest score. Repeated rows each give a row; an empty table gives none.
Without labelled documents of both kinds, or significant words, every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import alone, crc_fold, doc_slices, durable, id_and_text, labelled_sample, sized_batches
from folioscope.llm.logistic import fit_logistic, sigmoid

FOLDS, HELD = 4, 2
#: Labelled documents that the model is fitted on at most, and the characters that they have together at most.
SAMPLE, SAMPLE_CHARS = 12_000, 48_000_000
#: Lengths of word beginnings that count as features beside the whole word, marked by a trailing hyphen.
BEGINNINGS = (4, 5, 6, 7)
#: Weight of the Dirichlet prior, in documents; least z value, either way, and least documents of a word with log-odds.
PRIOR, LEAST_Z, LEAST_DOCS = 20.0, 4.0, 4
#: What may be taken off each word's log-odds; the last where the halves can't tell.
LOSSES = (0.25, 0.5, 1.0)
THRESHOLD = 0.3

_words = re.compile(r"\w+").findall


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of words with these scores, in linear time. Only positive
    scores are visited: a segment starts and ends with one, and running sums tell what lies between."""
    sums = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    found: list[list] = []  # first, last, sum before the segment, sum with it, place of the nearest candidate with a smaller sum before it
    for i, before, total in zip(at.tolist(), (sums[at] - scores[at]).tolist(), sums[at].tolist()):
        first = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append([first, i, before, total, j])
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


#: Words whose log-odds a worker keeps.
MEMORY = 200_000


class Odds(dict):
    """The log-odds of each word, by its spelling."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.begins = ahocorasick.Automaton()  # what a word that can begin a passage has in it
        for feature, odds in model.lexicon.items():
            if odds > model.loss:
                self.begins.add_word(feature.removesuffix("-"), 1)
        if len(self.begins):
            self.begins.make_automaton()

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = odds = self.model.log_odds(word)
        return odds

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _words(text.lower())), float)


@dataclass
class ToxicModel:
    lexicon: dict[str, float]
    rate: float  # lambda of the extreme-value law
    k: float
    weights: list[float]
    loss: float = LOSSES[-1]

    def log_odds(self, word: str) -> float:
        """The highest of the word and its beginnings, if that's positive, else the word's own."""
        own, *beginnings = (self.lexicon.get(f, 0.0) for f in features(word))
        return max([x for x in (own, *beginnings) if x > 0], default=own)

    def found(self, odds: np.ndarray) -> list[tuple[int, int, float]]:
        """The segments of a text whose words have these log-odds."""
        return segments(odds - self.loss) if odds.max(initial=0.0) > self.loss else []

    def scanned(self, text: str, memory: Odds) -> tuple[int, list[tuple[int, int, float]]]:
        """passages(), but a text in which no word can begin a passage isn't split into words, and has 0 of them here: their number
        counts beside a passage alone."""
        low = text.lower()
        if not len(memory.begins) or next(memory.begins.iter(low), None) is None:
            return 0, []
        return self.passages(low, memory)

    def passages(self, text: str, memory: dict[str, float] | None = None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, segments)."""
        odds = (memory if isinstance(memory, Odds) else Odds(self)).of(text)
        return len(odds), self.found(odds)

    def significance(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        """-log of each passage's expected number in a clean text of n words, where that's below one."""
        base = math.log(max(self.k * n, 1e-9))
        return [max(0.0, self.rate * s - base) for _, _, s in found]

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        each = self.significance(n, found)
        return math.log1p(max(each, default=0.0)), math.log1p(sum(each))

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        if not self.lexicon:
            return 0.0
        best, total = self.evidence(n, found)
        return float(sigmoid(self.weights[0] * best + self.weights[1] * total + self.weights[2]))


def log_odds(y1: Column, y0: Column, n1: float, n0: float) -> tuple[Column, Column]:
    """(log-odds ratio, its z value) of a feature in y1 of n1 toxic and y0 of n0 other documents, under the Dirichlet prior."""
    prior = F.lit(PRIOR) * (y1 + y0) / (n1 + n0)
    side = lambda y, n: F.log(y + prior) - F.log(F.greatest(n + PRIOR - y - prior, F.lit(0.5)))
    odds = side(y1, n1) - side(y0, n0)
    return odds, odds / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, y1, y0, kinds): in how many toxic and other texts a feature occurs, and whether in several words."""

    @alone("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list] = {}  # number of toxic and of other texts, least word, greatest word
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: dict[str, list] = {}
                for w in set(_words(text.lower())):
                    for f in features(w):
                        own.setdefault(f, []).append(w)
                for f, ws in own.items():
                    x = seen.setdefault(f, [0, 0, ws[0], ws[0]])
                    x[0 if label else 1] += 1
                    x[2], x[3] = min(x[2], *ws), max(x[3], *ws)
            kinds = {"y1": pa.int64(), "y0": pa.int64(), "low": pa.string(), "high": pa.string()}
            yield pa.RecordBatch.from_pydict({"feature": pa.array(seen, pa.string()), **{k: pa.array([x[i] for x in seen.values()], t) for i, (k, t) in enumerate(kinds.items())}})

    each = sample.select("text", "label").mapInArrow(run, "feature string, y1 long, y0 long, low string, high string")
    return each.groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"), (F.min("low") != F.max("high")).alias("kinds"))


def rated(sample: DataFrame, n1: float, n0: float) -> DataFrame:
    """(feature, odds) of the significant features of sample(text, label). The beginning of one word alone says no more than
    the word; beginnings count only for the toxic side."""
    odds, z = log_odds(F.col("y1"), F.col("y0"), n1, n0)
    each = _counted(sample).where(F.col("y1") + F.col("y0") >= LEAST_DOCS).select("feature", "kinds", odds.alias("odds"), z.alias("z"))
    whole = ~F.col("feature").like("%-")
    return each.where((F.col("z") >= LEAST_Z) & (F.col("kinds") | whole) | (F.col("z") <= -LEAST_Z) & whole).select("feature", "odds")


def _measured(clean: DataFrame, models: list[ToxicModel]) -> DataFrame:
    """(odds, loss, words, segments, least) of parts of the clean texts, for models of the same lexicon: how many words have these
    log-odds; and for each loss, with null odds, the numbers of words and segments, and the least segment's score."""

    @alone("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Odds(models[0])
        for batch in batches:
            texts = [memory.of(t) for t in batch.column(0).to_pylist()]
            values, counts = np.unique(np.concatenate(texts), return_counts=True)
            rows = [(x, None, n, 0, math.inf) for x, n in zip(values.tolist(), counts.tolist())]
            for m in models:
                each = [x for odds in texts for _, _, x in m.found(odds)]
                rows.append((None, m.loss, int(counts.sum()), len(each), min(each, default=math.inf)))
            kinds = {"odds": pa.float64(), "loss": pa.float64(), "words": pa.int64(), "segments": pa.int64(), "least": pa.float64()}
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})

    each = clean.select("text").mapInArrow(run, "odds double, loss double, words long, segments long, least double")
    return each.groupBy("odds", "loss").agg(F.sum("words").alias("words"), F.sum("segments").alias("segments"), F.min("least").alias("least"))


def _evidence(sample: DataFrame, models: list[ToxicModel]) -> DataFrame:
    """(label, loss, best, total) of each text of the sample, by models of the same lexicon."""

    @alone("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Odds(models[0])
        for batch in batches:
            texts = [memory.of(t) for t in batch.column(0).to_pylist()]
            for m in models:
                rows = [m.evidence(len(odds), m.found(odds)) for odds in texts]
                columns = [batch.column(1), pa.array([m.loss] * len(rows), pa.float64()), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(2))]
                yield pa.RecordBatch.from_arrays(columns, ["label", "loss", "best", "total"])

    return sample.select("text", "label").mapInArrow(run, "label int, loss double, best double, total double")


def _collected(sample: DataFrame, models: list[ToxicModel]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """(evidence, labels) for each loss, a row for each document of the bounded sample."""
    out: dict[float, list] = {m.loss: [] for m in models}
    for label, loss, best, total in sorted(map(tuple, _evidence(sample, models).collect())):
        out[loss].append((best, total, label))
    return {loss: (np.array([r[:2] for r in rows]).reshape(-1, 2), np.array([r[2] for r in rows], float)) for loss, rows in out.items()}


def extreme_value(scores: list[tuple[float, int]], n_segments: int, least: float) -> tuple[float, float]:
    """(lambda, K) for words that score so much so often and have so many segments, the least of which scores `least`:
    sum p exp(lambda s) is below one between zero and lambda, and K n exp(-lambda s) segments of n words score s or more."""
    values, counts = np.array([s for s, _ in scores], float), np.array([n for _, n in scores], float)
    low, high = 1e-3, 20.0
    for _ in range(80):
        rate = (low + high) / 2
        mean = (counts * np.exp(np.minimum(rate * values, 700))).sum() / counts.sum()
        low, high = (rate, high) if mean < 1 else (low, rate)
    return rate, n_segments / max(counts.sum() * math.exp(-rate * least), 1e-9)


def fit_models(sample: DataFrame, losses: tuple[float, ...]) -> list[ToxicModel]:
    """A model of the sample(text, label) for each loss; none if it lacks a kind of documents."""
    sizes = dict(sample.groupBy("label").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        return []
    lexicon = {r["feature"]: r["odds"] for r in rated(sample, float(sizes[1]), float(sizes[0])).collect()}
    models = [ToxicModel(lexicon, 1.0, 1.0, [], loss) for loss in losses]
    measured = _measured(sample.where("label = 0"), models).collect()  # a row for each log-odds that a feature gives
    words = sorted((r["odds"], r["words"]) for r in measured if r["odds"] is not None)
    for m in models:
        scores = [(x - m.loss, n) for x, n in words]
        n_segments, least = next(((r["segments"], r["least"]) for r in measured if r["loss"] == m.loss), (0, 0.0))
        if not n_segments:  # as if the clean documents had one word of the highest score
            least = max([1.0, *lexicon.values()]) - m.loss
            scores, n_segments = [*scores, (least, 1), (-m.loss, 1)], 1
        m.rate, m.k = extreme_value(scores, n_segments, least)
    for m, (x, y) in zip(models, _collected(sample, models).values()):
        m.weights = fit_logistic(x, y).tolist()
    return models


def chosen_loss(sample: DataFrame, losses: tuple[float, ...] = LOSSES) -> float:
    """The loss whose model of one half of the sample's texts gives the other half's labels the highest likelihood. Equal texts
    are in the same half."""
    half = F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))
    models = fit_models(sample.where(half == 0), losses)
    worst: list[tuple[float, float]] = []
    for m, (x, y) in zip(models, _collected(sample.where(half == 1), models).values() if models else []):
        p = np.clip(sigmoid(x @ np.array(m.weights[:2]) + m.weights[2]), 1e-6, 1 - 1e-6)
        worst.append((-float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), -m.loss))
    return -min(worst)[1] if worst else losses[-1]


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, losses: tuple[float, ...] = LOSSES) -> ToxicModel:
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD, sample_size, F.length("text"), SAMPLE_CHARS)
    sample = sized_batches(durable(sample.withColumn("label", F.when(F.col("label") > 0, 1).otherwise(0))))
    models = fit_models(sample, (chosen_loss(sample, losses),))
    return models[0] if models else ToxicModel({}, 1.0, 1.0, [0.0, 0.0, 0.0])


def score_texts(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) of every row of docs(doc_id, text); a passage is its
    first and last word's numbers with its score."""

    @alone("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Odds(model)
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
        for ids, texts in doc_slices(batches):
            rows = [model.scanned(t, memory) for t in texts]
            found = [[{"first_word": a, "last_word": b, "score": s} for (a, b, s), e in zip(p, model.significance(n, p)) if e > 0] for n, p in rows]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "score": pa.array([model.score(n, p) for n, p in rows], pa.float64()), "passages": pa.array(found, kind)})

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double, passages array<struct<first_word:long,last_word:long,score:double>>")
    return scored.select(
        "doc_id",
        (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
        "passages",
    )


def without_toxic(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of docs, all columns kept, whose text isn't predicted toxic."""

    @alone("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Odds(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(*model.scanned(t or "", memory)) < THRESHOLD for t in texts], pa.bool_()))

    return sized_batches(docs).mapInArrow(run, docs.schema)
