"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbol ids. In each round every sequence contracts
its own lowest-rank pair (the leftmost, if several); sequences without a mergeable pair leave the array, and the symbols
that survive are the tokens. All sequences take a round at the same time, so a batch needs as many rounds as its longest
chain of merges, not as it has words.

A pre-token ends wherever no vocabulary piece holds the two adjoining characters side by side: no merge can cross such
a place. For the usual vocabularies this includes the place before a space mark that follows another character.

Nulls count as empty texts (0 tokens); repeated rows and ids each give a row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import alone, doc_slices, id_and_text

SPACE = "▁"
NONE = np.int64(1) << 40
#: Entries of a worker's memory of counted pre-tokens; a full memory starts anew, which costs time only.
REMEMBERED = 400_000
#: Sequences of more symbols than this contract all equal lowest pairs of a round at once where that is safe.
LONG = 512


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            length = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + length]
            at += length


class PieceRanks:
    """The merge table of a sentencepiece BPE model with identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(x for number, v in top if number == 2 for x in _fields(v))
        norm = dict(x for number, v in top if number == 3 for x in _fields(v))
        if trainer.get(3) != 2 or not trainer.get(35) or norm.get(1) != b"identity" or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only BPE models with byte fallback, identity normalisation and kept, escaped white space")
        self.prefix = SPACE if norm.get(3, 1) else ""
        model = SentencePieceProcessor(model_file=path)
        kinds = [dict(_fields(v)).get(3, 1) for number, v in top if number == 1]
        pieces = [model.id_to_piece(i) for i in range(len(kinds))]
        scores = [model.get_score(i) for i in range(len(kinds))]
        if any(k not in (1, 2, 3, 6) for k in kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.single = {p for p, k in zip(pieces, kinds) if k == 1 and len(p) == 1}
        normal = [(p, s) for p, s, k in zip(pieces, scores, kinds) if k == 1]
        names = dict.fromkeys(p for p, _ in normal) | dict.fromkeys(c for p, _ in normal for c in p)
        ids = {name: i for i, name in enumerate(names)}
        order = {s: i for i, s in enumerate(sorted({s for _, s in normal}, reverse=True))}
        self.size = len(ids) + 1  # the last id stands for characters of no piece
        keys, ranks, merged = [], [], []
        for piece, score in normal:
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ranks.append(order[score])
                    merged.append(ids[piece])
        at = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[at], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int64)[at], NONE)
        self.merged = np.append(np.array(merged, np.int64)[at], self.size - 1)
        self.char_id = np.full(0x110000, self.size - 1, np.int32)
        for c, i in ids.items():
            if len(c) == 1:
                self.char_id[ord(c)] = i
        beside = {(ord(a) << 21) | ord(b) for p, _ in normal for a, b in zip(p, p[1:])}
        self.beside = np.append(np.array(sorted(beside), np.int64), np.iinfo(np.int64).max)
        #: Whether a space mark after another character always starts a pre-token.
        self.splits_at_space = not any(pair & 0x1FFFFF == ord(SPACE) and pair >> 21 != ord(SPACE) for pair in beside)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], self.size - 1)

    def cost(self, chars: np.ndarray) -> np.ndarray:
        """Tokens of a character that stays alone: one, or its bytes if it's no piece."""
        if not hasattr(self, "_single"):
            self._single = np.zeros(0x110000, bool)
            self._single[[ord(c) for c in self.single]] = True
        width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        return np.where(self._single[chars], 1, width)

    def count(self, chunks: list[str]) -> np.ndarray:
        """The tokens of each chunk, which must hold whole pre-tokens."""
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        out = np.zeros(len(chunks), np.int64)
        chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(chars):
            return out
        owner = np.repeat(np.arange(len(chunks)), lengths)
        joint = (chars[:-1] << 21) | chars[1:]
        joined = (self.beside[np.searchsorted(self.beside, joint)] == joint) & (owner[:-1] == owner[1:])
        # single characters cost what they cost; each merge then takes the place of two symbols, of known cost
        np.add.at(out, owner, self.cost(chars))
        starts = np.flatnonzero(np.append(True, ~joined))
        spans = np.diff(np.append(starts, len(chars)))
        loose = self.cost(chars)
        ids = self.char_id[chars].astype(np.int64)
        for s, n in zip(starts[spans > LONG], spans[spans > LONG]):
            out[owner[s]] += self._long(ids[s : s + n], loose[s : s + n])
        use = (spans > 1) & (spans <= LONG)
        keep = np.repeat(use, spans)
        if keep.any():
            self._short(ids[keep], loose[keep], spans[use], owner[starts[use]], out)
        return out

    def _short(self, ids: np.ndarray, cost: np.ndarray, spans: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Rounds over all sequences at once; out gets the change of cost by every merge."""
        starts = np.cumsum(spans) - spans
        rank, new = self.pair(ids, np.append(ids[1:], 0))
        last = starts + spans - 1
        rank[last] = NONE
        while len(spans):
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                keep = np.repeat(live, spans)
                ids, rank, new, cost = ids[keep], rank[keep], new[keep], cost[keep]
                spans, owner, low = spans[live], owner[live], low[live]
                starts = np.cumsum(spans) - spans
                if not len(spans):
                    return
            seq = np.repeat(np.arange(len(spans)), spans)
            hits = np.flatnonzero(rank == low[seq])
            hits = hits[np.append(True, seq[hits[1:]] != seq[hits[:-1]])]
            np.add.at(out, owner, 1 - cost[hits] - cost[hits + 1])
            ids[hits], cost[hits] = new[hits], 1
            end = hits + 1 == starts + spans - 1
            rank[hits] = NONE
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            ids, rank, new, cost = ids[stay], rank[stay], new[stay], cost[stay]
            spans = spans - 1
            starts = np.cumsum(spans) - spans
            hits = hits - np.arange(len(hits))
            right = hits[~end]
            rank[right], new[right] = self.pair(ids[right], ids[right + 1])
            left = hits[hits > starts] - 1
            rank[left], new[left] = self.pair(ids[left], ids[left + 1])

    def _long(self, ids: np.ndarray, cost: np.ndarray) -> int:
        """The change of cost of one long sequence. Equal lowest pairs contract together unless a contraction would
        make a pair of that rank or a lower one, which must then go first; such a round contracts the leftmost alone."""
        change = 0
        while len(ids) > 1:
            rank, new = self.pair(ids[:-1], ids[1:])
            low = rank.min()
            if low == NONE:
                break
            hits = np.flatnonzero(rank == low)
            first = np.append(True, np.diff(hits) > 1)
            place = np.arange(len(hits)) - np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
            hits = hits[place % 2 == 0]
            made, got = new[hits], ids.copy()
            got[hits] = made
            before = got[hits - 1 - (np.isin(hits - 2, hits) & (hits > 1))]
            after = ids[np.minimum(hits + 2, len(ids) - 1)]
            risky = ((hits > 0) & (self.pair(before, made)[0] <= low)) | ((hits + 2 < len(ids)) & (self.pair(made, after)[0] <= low))
            if risky.any():
                hits, made = hits[:1], made[:1]
            change += int((1 - cost[hits] - cost[hits + 1]).sum())
            ids, cost = ids.copy(), cost.copy()
            ids[hits], cost[hits] = made, 1
            stay = np.ones(len(ids), bool)
            stay[hits + 1] = False
            ids, cost = ids[stay], cost[stay]
        return change


_loaded: dict[str, PieceRanks] = {}


def forget() -> None:
    """Drops what this worker keeps from task to task (a function of the module, since a closure would get a copy)."""
    _loaded.clear()
_runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def ranks(path: str) -> PieceRanks:
    """The table of a model file, built once in a worker."""
    if path not in _loaded:
        _loaded[path] = PieceRanks(path)
    return _loaded[path]


def pretokens(text: str, table: PieceRanks) -> tuple[str, list[str]]:
    """A mark and words: the mark stands before each of the words."""
    if not text:
        return "", []
    text = table.prefix + text.replace(" ", SPACE)
    if not table.splits_at_space:
        return "", [text]
    if SPACE * 2 in text or text[0] != SPACE or text[-1] == SPACE:
        return "", _runs.findall(text)
    return SPACE, text[1:].split(SPACE)


def count_texts(texts: list[str], table: PieceRanks, memory: dict[str, dict[str, int]]) -> list[int]:
    """The number of tokens of each text."""
    split = [pretokens(t, table) for t in texts]
    own = {m: memory.setdefault(m, {}) for m in ("", SPACE)}
    if sum(map(len, own.values())) > REMEMBERED:
        for known in own.values():
            known.clear()
    for mark, known in own.items():
        new = list({x for m, words in split if m == mark for x in words if x not in known})
        known.update(zip(new, table.count([mark + x for x in new]).tolist()))
    return [sum(map(own[m].__getitem__, words)) for m, words in split]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs(doc_id, text)."""

    @alone("tokens", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memory = ranks(model_path), {}
        for ids, texts in doc_slices(batches):
            tokens = count_texts(texts, table, memory)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
