"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Texts come in batches of bounded size. A batch's distinct words (matches of the pre-tokenizer's pattern) become token lists:
of one token, where the whole word is one, else of single bytes. Short words stay in the worker, up to a bound, with what they gave. A recursive query unnests them into token-position rows,
joins neighbouring tokens to the merge table, contracts each word's leftmost pair of minimum rank, and repeats until no word
has a pair to contract. Decoding joins token-position rows to the vocabulary and concatenates the bytes in the order of
positions, again grouped by word; a document's ids and bytes are those of its words in order, gathered by word numbers. Both
queries run in an in-memory database without spilling; how much one of them holds is bounded by the words' bytes and rounds.

Words of over LONG bytes take a query that contracts all occurrences of a word's lowest pair in a round (every other one of
a run of overlapping ones), unless one of the new tokens would at once have a neighbour to contract with that ranks as low
or lower: then the leftmost alone. Both queries give the same.

Nulls count as empty texts (no ids, the digests of nothing); repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import alone, doc_batches, id_and_text, joined, sized_batches, trim

#: Bytes of text that are coded together, beside one document. A batch's words are coded once each.
AT_ONCE = 4 << 20
#: The same in a pipeline, where executors have less memory to spare.
AT_ONCE_BESIDE = 2 << 20
#: Words that a worker keeps from batch to batch at most, and their bytes at most: what is kept isn't coded again.
KEPT, KEPT_BYTES = 200_000, 32
#: Words of more bytes than this contract all equal lowest pairs of a round.
LONG = 256
#: List entries that a query of short words makes in all its rounds, and bytes of the words of a query of long ones.
ENTRIES, LONG_BYTES = 24_000_000, 400_000

ENCODE = """
create or replace table coded as
with recursive s(i, w, t) as (
    select 0, w, t from bytes_in
    union all (
        with pairs as (select w, unnest(t) as t, unnest(t[2:]) as nt, generate_subscripts(t, 1) as p from s),
        best as (
            select w, min(m.merged::bigint * 4294967296 + pairs.p) as x
            from pairs join merges m on m.pair = pairs.t::bigint * 4294967296 + pairs.nt group by w)
        select i + 1, w, t[:x % 4294967296 - 1] || [(x // 4294967296)::int] || t[x % 4294967296 + 2:]
        from s join best using (w)))
select w, t from s join (select w, max(i) as i from s group by w) using (w, i)
"""
ENCODE_LONG = """
create or replace table coded as
with recursive s(w, t) using key (w) as (
    select w, t from bytes_in
    union (
        with rows as (select w, unnest(t) as t, unnest(t[2:]) as nt, generate_subscripts(t, 1) as p from s),
        pairs as (select rows.*, m.merged from rows left join merges m on m.pair = rows.t::bigint * 4294967296 + rows.nt),
        low as (select w, min(merged) as m, min_by(p, merged::bigint * 4294967296 + p) as first from pairs where merged is not null group by w),
        spots as (select pairs.w, p, m, first, p - row_number() over (partition by pairs.w order by p) as run from pairs join low using (w) where merged = m),
        every as (select w, p, m, first, (p - min(p) over (partition by w, run)) % 2 = 0 as chosen from spots),
        chosen as (select w, p, m, first from every where chosen),
        made as (
            select a.w, a.p, coalesce(c.m, a.t) as t, c.m, lag(coalesce(c.m, a.t)) over (partition by a.w order by a.p) as before
            from rows a left join chosen c on a.w = c.w and a.p = c.p left join chosen d on a.w = d.w and a.p = d.p + 1
            where d.p is null),
        risky as (
            select distinct x.w from made x left join rows r on r.w = x.w and r.p = x.p + 2
            left join merges l on l.pair = x.before::bigint * 4294967296 + x.t left join merges n on n.pair = x.t::bigint * 4294967296 + r.t
            where x.m is not null and (l.merged <= x.m or n.merged <= x.m)),
        taken as (select c.* from chosen c left join risky using (w) where risky.w is null or c.p = c.first)
        select a.w, list(coalesce(c.m, a.t) order by a.p) as t
        from rows a join low on a.w = low.w left join taken c on a.w = c.w and a.p = c.p left join taken d on a.w = d.w and a.p = d.p + 1
        where d.p is null group by a.w))
select w, t from s
"""
DECODE = """
select unhex(string_agg(v.hex, '' order by p)) as b
from (select w, unnest(t) as id, generate_subscripts(t, 1) as p from coded) join vocabulary v using (id)
group by w order by w
"""

#: White space of the pattern, or of Python; a single space between two other characters is where a text can be cut.
_SPACE = r"[\t-\r \x1c-\x1f\x85\pZ]"
_UNUSUAL = f"(?:^|{_SPACE}) | (?:{_SPACE}|$)"
_cut = re.compile(r"(?<=\S) (?=\S)").split


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def cut_pieces(texts: pa.Array) -> pa.Array:
    """Each text's pieces, which no match of the pattern crosses; a space stood before all but the first.

    A single space between two characters that aren't white space starts a match, alone or with what follows it."""
    unusual = pc.match_substring_regex(texts, _UNUSUAL)
    pieces = pc.split_pattern(texts, " ")
    if not pc.any(unusual).as_py():
        return pieces
    found = pa.array([_cut(t) for t in texts.filter(unusual).to_pylist()], pieces.type)
    rank = np.cumsum(np.asarray(unusual)) - 1
    return pa.concat_arrays([pieces, found]).take(pa.array(np.where(np.asarray(unusual), len(texts) + rank, np.arange(len(texts)))))


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(the number of each value, the distinct values)."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def gathered(lists: pa.Array, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the entries of the lists or the bytes of the binaries `at`, one after the other; where each ends, from 0 on)."""
    if pa.types.is_large_list(lists.type):
        got = lists.take(pa.array(at))
        return got.flatten(), got.offsets.to_numpy() - got.offsets[0].as_py()
    got = lists.take(pa.array(at))
    _, offsets, data = got.buffers()
    ends = np.frombuffer(offsets, np.int64)[got.offset : got.offset + len(got) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8), ends - ends[0]


class Coder:
    """An in-memory database with the merge table and the vocabulary of one file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.ids = read_ranks(path)
        merges = {"pair": [], "merged": []}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    merges["pair"].append(left << 32 | right)
                    merges["merged"].append(rank)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        self._table("merges", pa.table({"pair": pa.array(merges["pair"], pa.int64()), "merged": pa.array(merges["merged"], pa.int32())}))
        self._table("vocabulary", pa.table({"id": pa.array(self.ids.values(), pa.int32()), "hex": [t.hex() for t in self.ids]}))
        self.known: dict[bytes, int] = {}  # the place of each kept word in
        self.kept = pa.array([], pa.large_list(pa.int32())), pa.array([], pa.large_binary())
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        del merges
        trim()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"create or replace table {name} as select * from given")
        self.db.unregister("given")

    def encode(self, words: list[bytes]) -> None:
        """Fills the table coded with the number and the ids of each word, which must not be empty."""
        whole = [self.ids.get(w, -1) for w in words]  # a token's own bytes are that token, as in the usual libraries
        flat = self.single[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.array([len(w) for w in words])
        firsts = np.cumsum(lengths) - lengths
        known = np.flatnonzero(np.array(whole) >= 0)
        stay = np.ones(len(flat), bool)
        stay[np.repeat(firsts[known], lengths[known] - 1) + _counting(lengths[known] - 1) + 1] = False
        flat[firsts[known]] = np.array(whole, np.int32)[known]
        lengths[known] = 1
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat[stay]))
        self._table("bytes_in", pa.table({"w": np.arange(len(words), dtype=np.int32), "t": lists}))
        self.db.execute(ENCODE_LONG if max(map(len, words)) > LONG else ENCODE)

    def coded(self, words: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """(ids, decoded bytes) of each word."""
        self.encode(words)
        ids = self.db.sql("select t from coded order by w").to_arrow_table()["t"].combine_chunks()
        back = self.db.sql(DECODE).to_arrow_table()["b"].combine_chunks()
        self.db.execute("drop table coded; drop table bytes_in")
        return ids.cast(pa.large_list(pa.int32())), back.cast(pa.large_binary())

    def learn(self, words: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """coded() of any number of words: queries hold what ENTRIES and LONG_BYTES bound, or one word."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        sizes = lengths[order]
        cost = np.where(sizes > LONG, ENTRIES * sizes // LONG_BYTES, sizes * (sizes + 1) // 2)
        group = np.cumsum(cost) // ENTRIES + (np.cumsum(sizes > LONG) > 0)
        cuts = np.flatnonzero(np.diff(group)) + 1
        made = [self.coded([words[i] for i in part]) for part in np.split(order, cuts) if len(part)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, back = (pa.concat_arrays(list(x)).take(pa.array(place)) for x in zip(*made))
        return ids, back

    def learned(self, words: list[bytes]) -> tuple[pa.Array, pa.Array]:
        """learn() of distinct words, of which those kept from former batches aren't coded again."""
        before = len(self.known)
        at = np.array([self.known.get(w, -1) for w in words], np.int64)
        fresh = np.flatnonzero(at < 0)
        parts = self.kept
        if len(fresh):
            at[fresh] = before + np.arange(len(fresh))
            made = self.learn([words[i] for i in fresh])
            parts = tuple(pa.concat_arrays([old, new]) for old, new in zip(self.kept, made))
            short = [i for i, j in enumerate(fresh) if len(words[j]) <= KEPT_BYTES][: max(0, KEPT - before)]
            if short:
                self.known.update((words[fresh[i]], before + n) for n, i in enumerate(short))
                self.kept = tuple(pa.concat_arrays([old, new.take(pa.array(short))]) for old, new in zip(self.kept, made))
        ids, back = (p.take(pa.array(at)) for p in parts)
        return ids, back

    def code(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end, their decoded bytes, where each text's end); ends start with 0."""
        cut = cut_pieces(texts)
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        number, distinct = numbered(cut.flatten())
        kind = number.astype(np.int64) * 2
        kind[ends[:-1][np.diff(ends) > 0]] += 1  # a text's first piece has no space before it
        used = np.zeros(2 * len(distinct), bool)
        used[kind] = True
        names = distinct.to_pylist()
        found = [self.find(names[k >> 1] if k & 1 else " " + names[k >> 1]) for k in np.flatnonzero(used).tolist()]
        counts = np.array([len(f) for f in found], np.int64)
        word, words = numbered(pa.array([w for f in found for w in f], pa.large_string()))
        del names, found
        if not len(words):
            none = np.zeros(len(texts) + 1, np.int64)
            return np.empty(0, np.int32), none, np.empty(0, np.uint8), none
        ids, back = self.learned(words.cast(pa.large_binary()).to_pylist())
        piece = (np.cumsum(used) - 1)[kind]
        starts = np.cumsum(counts) - counts
        at = word[np.repeat(starts[piece], counts[piece]) + _counting(counts[piece])]
        word_ends = np.append(0, np.cumsum(counts[piece]))[ends]
        flat, id_ends = gathered(ids, at)
        data, data_ends = gathered(back, at)
        return flat.to_numpy(), id_ends[word_ends], data, data_ends[word_ends]


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


_coders: dict[tuple[str, str], Coder] = {}


def forget() -> None:
    """Drops what this worker keeps from task to task (a function of the module, since a closure would get a copy)."""
    _coders.clear()


def coder(path: str, pattern: str) -> Coder:
    """The coder of a vocabulary file, built once in a worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs(doc_id, text)."""

    @alone("bpe", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in doc_batches(joined(batches, 4_000, AT_ONCE), AT_ONCE):  # a query of many words costs less than many queries
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **_digests(own.code(_texts(batch.column(1))))})

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).fill_null("")


def _digests(coded: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> dict[str, pa.Array]:
    flat, id_ends, data, data_ends = coded
    flat = np.ascontiguousarray(flat, "<u4")
    digest = lambda values, ends: pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())
    return {"n_tokens": pa.array(np.diff(id_ends), pa.int64()), "ids_sha256": digest(flat, id_ends), "decoded_sha256": digest(data, data_ends)}


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without its text, with ids (array<int>), n_tokens, ids_sha256 and decoded_sha256 of it; a text whose ids don't
    decode to it again ends the run. Columns of docs with those names give way."""
    made = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    kept = [c for c in docs.columns if c not in (*made, "text")]

    @alone("bpe", forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in doc_batches(joined(batches, 2_000, AT_ONCE_BESIDE), AT_ONCE_BESIDE, -1):
            texts = _texts(batch.column(batch.num_columns - 1))
            coded = own.code(texts)
            if coded[2].tobytes() != "".join(texts.to_pylist()).encode():
                raise ValueError("a text doesn't come back from its ids")
            ids = pa.ListArray.from_arrays(pa.array(coded[1], pa.int32()), pa.array(coded[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, *_digests(coded).values()], [*batch.schema.names[:-1], *made])

    rows = docs.select(*kept, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return sized_batches(rows).mapInArrow(run, schema)
