"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features describe its letters, symbols, repetition and length, and
those of the lines beside it; the chain's transition weights let labels of neighbours support each other. The document's
quality is the mean of its lines' forward-backward marginals weighted by length, calibrated to a probability.

Only documents carry labels, so lines of bad documents get theirs in two rounds: a regression on the documents' labels,
then bad where it agrees (the worst line always). The labels' sample is bounded (SAMPLE documents of
SAMPLE_LINES lines together, whole texts), and only its numeric features reach the driver.

Nulls count as empty texts; an empty text is one empty line. Repeated rows each give a row; an empty table gives none.
Without labels of both kinds every score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import alone, crc_fold, doc_slices, id_and_text, labelled_sample, sized_batches
from folioscope.llm.logistic import fit_logistic, sigmoid

FOLDS, HELD = 5, 0
#: Labelled documents that the model is fitted on at most, and the lines that they have together at most.
SAMPLE, SAMPLE_LINES = 4_000, 200_000
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL = b"!#$%&*+/<=>@\\^_`{|}~"
_HIGH = bytes(range(128, 192))  # continuation bytes: no characters of their own
OWN = 10


def line_features(line: bytes) -> tuple[float, ...]:
    size = len(line.translate(None, _HIGH))
    words = line.split()
    n = len(words)
    if not n:
        return (0.0,) * (OWN - 1) + (1.0,)
    upper = size - len(line.translate(None, _UPPER + _HIGH))
    lower = size - len(line.translate(None, _LOWER + _HIGH))
    digits = size - len(line.translate(None, _DIGIT + _HIGH))
    symbols = size - len(line.translate(None, _SYMBOL + _HIGH))
    return (
        np.log1p(n) / 5,
        upper / (upper + lower + 1),
        float(upper > lower),
        min(1.0, symbols / n),
        float(symbols * 3 > n),
        digits / size,
        1 - len(set(words)) / n,
        float(len(set(words)) * 2 < n),
        min(2.0, size / n / 10),
        0.0,
    )


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features by line, lengths of lines): those of the line, of the line before and of the line after; repetition."""
    lines = text.encode().split(b"\n")
    own = np.array([line_features(x) for x in lines])
    before, after = np.vstack([np.zeros(OWN), own[:-1]]), np.vstack([own[1:], np.zeros(OWN)])
    again = np.zeros(len(lines))
    if len(lines) > 1:
        count: dict[bytes, int] = {}
        for x in lines:
            count[x] = count.get(x, 0) + 1
        again[:] = [count[x] > 1 and len(x) > 0 for x in lines]
    ends = np.zeros((len(lines), 2))
    ends[0, 0] = ends[-1, 1] = 1
    return np.column_stack([own, before, after, again, ends]), np.array([len(x) + 1.0 for x in lines])


WIDTH = 3 * OWN + 3


@dataclass
class Chain:
    """Emission weights (for good against bad, with a constant) and transition weights between bad (0) and good (1)."""

    emit: np.ndarray
    move: np.ndarray

    def marginals(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability that each line is good, expected transitions 2 x 2) of texts with so many consecutive rows each.

        Texts go in order of their number of lines, so that each step of the recursion covers all that are as long."""
        good = rows @ self.emit[:-1] + self.emit[-1]
        order = np.argsort(-counts, kind="stable")
        start, length = (np.cumsum(counts) - counts)[order], counts[order]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right") if len(length) else np.empty(0, int)
        forward, norm = np.zeros((len(rows), 2)), np.zeros(len(rows))
        move = np.exp(self.move)
        scaled = np.column_stack([sigmoid(-good), sigmoid(good)])  # emissions, each line's scaled to a sum of one
        state = np.ones((len(length), 2))
        for t, m in enumerate(alive):
            at = start[:m] + t
            state = (state[:m] @ move if t else state[:m]) * scaled[at]
            norm[at] = state.sum(1)
            state = forward[at] = state / norm[at][:, None]
        back, pairs = np.zeros((len(rows), 2)), np.zeros((2, 2))
        after = np.ones((len(length), 2))
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            at, n = start[:m] + t, alive[t + 1] if t + 1 < len(alive) else 0
            back[at] = 1.0
            if n:
                nxt = start[:n] + t + 1
                ahead = scaled[nxt] * back[nxt] / norm[nxt][:, None]
                back[start[:n] + t] = ahead @ move.T
                pairs += move * (forward[start[:n] + t].T @ ahead)
        both = forward * back
        return both[:, 1] / both.sum(1), pairs


@dataclass
class QualityModel:
    chain: Chain | None
    weights: list[float]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(score of each text, marginals of its lines)."""
        if self.chain is None:
            return np.ones(len(texts)), [np.ones(t.count("\n") + 1) for t in texts]
        made = [text_features(t) for t in texts]
        counts = np.array([len(x) for x, _ in made])
        good, _ = self.chain.marginals(np.concatenate([x for x, _ in made]), counts)
        lines = np.split(good, np.cumsum(counts)[:-1])
        share = np.array([(g * n).sum() / n.sum() for g, (_, n) in zip(lines, made)])
        return sigmoid(self.weights[0] * share + self.weights[1]), lines


def fit_chain(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray, ridge: float = 2.0, rounds: int = 150) -> Chain:
    """Maximum conditional likelihood of fully labelled chains, by Adam steps on the whole sample."""
    firsts = np.zeros(len(rows), bool)
    firsts[np.cumsum(counts) - counts] = True
    inner = np.flatnonzero(~firsts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
    x = np.column_stack([rows, np.ones(len(rows))])
    start = fit_logistic(rows, labels.astype(float), ridge=ridge)
    chain = Chain(start, np.zeros((2, 2)))
    theta = np.append(start, np.zeros(4))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        chain = Chain(theta[:-4], theta[-4:].reshape(2, 2))
        good, pairs = chain.marginals(rows, counts)
        grad = np.append(x.T @ (labels - good), (seen - pairs).ravel()) - ridge * theta
        grad /= len(counts)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.05 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-8)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def fit_lines(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> QualityModel:
    if len(set(labels.tolist())) < 2:
        return QualityModel(None, [0.0, 0.0])
    counts = np.array([len(x) for x, _ in docs])
    rows, sizes = np.concatenate([x for x, _ in docs]), np.concatenate([n for _, n in docs])
    owner = np.repeat(np.arange(len(docs)), counts)
    share = sizes / np.bincount(owner, sizes)[owner]
    first = fit_logistic(rows, labels[owner].astype(float), share)
    guess = sigmoid(rows @ first[:-1] + first[-1])
    worst = np.minimum.reduceat(guess, np.cumsum(counts) - counts)
    bad = (labels[owner] == 0) & ((guess < 0.5) | (guess == worst[owner]))
    chain = fit_chain(rows, (~bad).astype(int), counts)
    good, _ = chain.marginals(rows, counts)
    w = fit_logistic((np.bincount(owner, good * share))[:, None], labels.astype(float), ridge=0.1)
    return QualityModel(chain, w.tolist())


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE) -> QualityModel:
    @alone("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, n = text_features(text)
                yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "x": [x.astype("<f4").tobytes()], "n": [n.astype("<f4").tobytes()]})

    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sample = sized_batches(labelled_sample(docs, labels, "quality", FOLDS, HELD, sample_size, lines, SAMPLE_LINES))
    got = sorted((r["label"], bytes(r["x"]), bytes(r["n"])) for r in sample.mapInArrow(run, "label int, x binary, n binary").collect())
    made = [(np.frombuffer(x, "<f4").reshape(-1, WIDTH).astype(float), np.frombuffer(n, "<f4").astype(float)) for _, x, n in got]
    return fit_lines(made, np.array([int(y > 0) for y, _, _ in got]))


def score_texts(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, n_bad_lines) of every row of docs(doc_id, text)."""

    @alone("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in doc_slices(batches):
            scores, lines = model.scores(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids,
                    "score": pa.array(scores, pa.float64()),
                    "n_lines": pa.array([len(x) for x in lines], pa.int64()),
                    "n_bad_lines": pa.array([int((x < 0.5).sum()) for x in lines], pa.int64()),
                }
            )

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double, n_lines long, n_bad_lines long")
    return scored.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def without_bad(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs, all columns kept, whose text isn't predicted bad."""

    @alone("quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(model.scores(texts)[0] >= THRESHOLD)) if texts else batch

    return sized_batches(docs).mapInArrow(run, docs.schema)
