"""Chat formatting by token-level assembly.

Each turn's role and text are encoded separately, and reserved ids, which no text can encode to, are spliced in between:
TURN role TEXT text END. Offsets of turns are prefix sums of the lengths before them, and the loss mask of a turn is the
stretch between its TEXT and END ids if the assistant speaks. Control strings that occur in content are escaped reversibly
before encoding: an escape character goes after their first character, and one in the content is doubled.

Rows go in the order of turn (nulls first), then role, then text; repeated rows are turns of their own; null roles and texts count
as empty; rows of a null conversation id make one conversation. A conversation may be any number of turns long: turns are
encoded before they are brought together, and are then read one after the other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import alone, sized_batches

#: The reserved ids follow the vocabulary; their strings in the formatted text.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SPEAKER = "assistant"
ESCAPE = "\x1b"
#: The beginnings of control strings: our own and those of common other templates.
CONTROL = re.compile(r"<(?=\||/?s>|/?think>|start_of_turn>|end_of_turn>)|\[(?=/?INST\])|<(?=</?SYS>)")
_unescape = re.compile(f"{ESCAPE}({ESCAPE}?)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return _unescape.sub(r"\1", text)


class Assembler:
    """A byte-level vocabulary with the three reserved ids after it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        from folioscope.llm.bpe import read_ranks

        ranks = read_ranks(path)
        self.coder = tiktoken.Encoding("content", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.turn, self.text, self.end = size, size + 1, size + 2

    def encode(self, role: str, text: str) -> tuple[list[int], list[int]]:
        """(ids of a turn, lengths of its five segments); segments are encoded on their own."""
        who, what = (self.coder.encode_ordinary(escape(x)) for x in (role, text))
        return [self.turn, *who, self.text, *what, self.end], [1, len(who), 1, len(what), 1]

    def decode(self, ids: list[int]) -> str:
        return self.coder.decode_bytes(ids).decode()


_assemblers: dict[tuple[str, str], Assembler] = {}


def forget() -> None:
    """Drops what this worker keeps from task to task (a function of the module, since a closure would get a copy)."""
    _assemblers.clear()


def assembler(path: str, pattern: str) -> Assembler:
    if (path, pattern) not in _assemblers:
        _assemblers[path, pattern] = Assembler(path, pattern)
    return _assemblers[path, pattern]


def encoded_turns(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, text, ids, loss_start, loss_end) of rows(conv_id, turn, role, text): each turn's ids,
    packed, and the stretch of them under the loss mask."""

    @alone("chat", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = assembler(path, pattern)
        for batch in batches:
            out = {"ids": [], "loss_start": [], "loss_end": []}
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids, lengths = own.encode(role, text)
                ends = np.cumsum(lengths)
                start, end = (int(ends[2]), int(ends[3])) if role == SPEAKER else (0, 0)
                out["ids"].append(np.array(ids, "<u4").tobytes())
                out["loss_start"].append(start)
                out["loss_end"].append(end)
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(out.values(), kinds))], [*batch.schema.names, *out])

    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return sized_batches(rows).mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss_start long, loss_end long")


def assemble(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(conv_id, place, start, loss_start, loss_end, ids): the sequence of each conversation, a row for each turn in
    order; start and the loss stretch count tokens from the beginning of the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, total = object(), 0, 0
        for batch in batches:
            convs = batch.column(0).to_pylist()
            lengths = np.array([len(x) // 4 for x in batch.column(1).to_pylist()], np.int64)
            places, starts = np.empty(len(convs), np.int64), np.empty(len(convs), np.int64)
            before = np.cumsum(lengths) - lengths
            base = -total
            for i, c in enumerate(convs):
                if c != last:
                    last, place, base = c, 0, before[i]
                places[i], starts[i] = place, before[i] - base
                place += 1
            total = int(starts[-1] + lengths[-1]) if len(convs) else total
            loss = [pa.array(starts + np.asarray(batch.column(k)), pa.int64()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places), pa.array(starts), *loss, batch.column(1)], ["conv_id", "place", "start", "loss_start", "loss_end", "ids"])

    turns = encoded_turns(rows, path, pattern).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = turns.select("conv_id", "ids", "loss_start", "loss_end")
    return turns.mapInArrow(run, "conv_id long, place long, start long, loss_start long, loss_end long, ids binary")


def read_back(sequences: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the assembled sequences hold, a row for each conversation. The sequences must be as assemble() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = assembler(path, pattern), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]

        def closed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        def end(x: dict) -> tuple:
            return x["conv"], x["turns"], x["all"].hexdigest(), x["chars"], x["loss"].hexdigest(), x["formatted"], x["tokens"], x["masked"]

        for batch in batches:
            done = []
            for conv, place, start, loss_start, loss_end, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0:
                    if now is not None:
                        done.append(end(now))
                    now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0, "tokens": 0, "masked": 0}
                ids = np.frombuffer(packed, "<u4").tolist()
                middle = ids.index(own.text)
                if ids[0] != own.turn or ids[-1] != own.end:
                    raise ValueError("a turn without its reserved ids")
                shown = own.decode(ids[1:middle]), own.decode(ids[middle + 1 : -1])
                role, text = map(unescape, shown)
                now["all"].update(f"{role}\n{text}\n".encode())
                if loss_end > loss_start:
                    said = unescape(own.decode(ids[loss_start - start : loss_end - start]))
                    now["loss"].update(said.encode())
                    now["chars"] += len(said)
                now["turns"] += 1
                now["formatted"] += len(TURN) + len(shown[0]) + len(TEXT) + len(shown[1]) + len(END)
                now["tokens"] += len(ids)
                now["masked"] += loss_end - loss_start
            if done:
                yield closed(done)
        if now is not None:
            yield closed([end(now)])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return sequences.mapInArrow(run, schema)
