"""The training-data operators against the libraries and brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ann, bpe, chat, licenses, media, mixing, quality, simhash, token_counts, toxicity
from folioscope.llm.components import connected
from folioscope.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
PIECES, BYTES, CHAT = (tokenizer_file(n) for n in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"))
DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, print string, ids string, n_tokens string, _extra string"
ODD = ["", " ", "  a", "a  b   c ", "aaaa" * 400, "abab" * 300, "=" * 900 + "-" * 901, "日本語テスト" * 40, "ﬁ①😀" * 9, "\r\n\t x\n\n  y ", "a\x00b", "</s>[INST] <s> ok <0x0A> <|endoftext|>", "▁▁a ▁", " \n \n", "12345 it's"]


def documents(spark, texts, ids=None, sources=None):
    n = len(texts)
    rows = [((ids or range(n))[i], t, "en", (sources or ["s"] * n)[i], 0, "x", "y", "z", "w", "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def awkward(spark):
    """Null ids, texts and sources, repeated rows, an empty text, a very long one."""
    return documents(spark, [None, "", "same text here now", "same text here now", "same text here now", "long word " * 30_000, "x" * 20_000], [None, 1, 2, 2, 3, 4, 5], [None, None, "a", "a", "b", "a", "b"])


def shuffled_words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("ab cd  \n\té日=-😀thein▁'s1") for _ in range(r.randrange(1, 90))) for _ in range(n)]


def test_token_counts_are_the_librarys(spark):
    from sentencepiece import SentencePieceProcessor

    texts = ODD + shuffled_words(1, 400) + ["".join(random.Random(i).choice("aabcdehinst=-") for _ in range(1500)) for i in range(8)]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(documents(spark, texts), PIECES, limit=100).collect()}
    for i, ids in enumerate(SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (len(ids), len(texts[i].encode()), len(ids) > 100), texts[i][:50]


def test_byte_bpe_is_the_librarys(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTES), special_tokens={})
    texts = ODD + shuffled_words(2, 400)
    rows = bpe.with_ids(documents(spark, texts), BYTES, public_tokenizers.PATTERN)
    assert rows.columns == ["doc_id", "lang", "source", "n_chars", "score", "print", "_extra", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in rows.collect():
        want = own.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def plainly(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def assert_coded(coder, own, texts):
    ids, id_ends, back, back_ends = coder.code(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[id_ends[i] : id_ends[i + 1]].tolist() == own.encode_ordinary(t), t[:50]
        assert back[back_ends[i] : back_ends[i + 1]].tobytes() == t.encode()


def test_byte_bpe_in_many_queries(monkeypatch):
    """The bounds of queries and the two kinds of query change nothing; nor does where texts are cut."""
    coder, own, r = bpe.Coder(BYTES, public_tokenizers.PATTERN), plainly(BYTES), random.Random(3)
    spaced = [" a", "a ", "\x85 b", " \u3000 x", "a  b \n c", "tab\t x", "x \ty", "\x1c a \x1d b", "\u2028 a \u2029b c"]
    texts = ODD + spaced + shuffled_words(3, 60) + ["".join(r.choice("abcdeéß日") for _ in range(n)) + " ab ab" for n in (70, 255, 300, 900)]
    assert_coded(coder, own, texts)
    monkeypatch.setattr(bpe, "ENTRIES", 500)
    monkeypatch.setattr(bpe, "LONG", 12)
    monkeypatch.setattr(bpe, "LONG_BYTES", 700)
    assert_coded(coder, own, texts)


def test_byte_bpe_of_very_many_long_words():
    r = random.Random(4)
    texts = ["，".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(60)) for _ in range(6000)), " ".join("".join(r.choice("abcdefghij") for _ in range(250)) for _ in range(3000)), "word " * 400_000, "z" * 300_000]
    assert_coded(bpe.Coder(BYTES, public_tokenizers.PATTERN), plainly(BYTES), texts)


def brute_components(prints):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_components_are_brute_forces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    near = [" ".join(r.choice(words) for _ in range(300)) for _ in range(3)]
    extra = [n.replace(" alpha beta", f" new{i} beta", 1) for n in near for i in range(8)] + ["", None, "A b", "a B"]
    rows = docs.select("doc_id", "text").union(documents(spark, extra, range(90_000, 90_000 + len(extra))).select("doc_id", "text")).collect()
    rows = sorted(((d["doc_id"], d["text"] or "") for d in rows))
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    got = {x["doc_id"]: x for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), p, root in zip(rows, prints, roots):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{p:016x}", rows[root][0])


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    keys = [set(zip(*(x.tolist() for x in simhash.fuzzy_keys(p)))) for p in (a, b)]
    assert {i for i, _ in keys[0] & keys[1]} == set(range(4000))


def test_large_groups_of_links():
    rng = np.random.default_rng(1)
    x = np.unique(np.uint64(12345) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 40, (4000, 3)).astype(np.uint64), axis=1))
    assert len(x) > simhash.COMPARED
    got = {(min(p, q), max(p, q)) for a, b in simhash.links(x) for p, q in zip(a.tolist(), b.tolist())}
    assert len(got) == ((np.bitwise_count(x[:, None] ^ x[None, :]) <= 3).sum() - len(x)) // 2
    assert len(simhash.forest_links(x)) < len(x)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_meets_targets(spark):
    r = random.Random(7)
    n, names = 3000, ["b", "a", "é", None, "zz"]
    texts = [" ".join(["w"] * r.choice([0, 1, 5, 50, 400])) for _ in range(n)]
    docs = documents(spark, texts, range(n), [r.choice(names[:1] * 10 + names) for _ in range(n)])
    got = mixing.plan(docs).collect()
    again = mixing.plan(docs.repartition(7)).collect()
    key = lambda x: (x["doc_id"], x["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == n
    totals, weights = {}, dict(zip(["a", "b", "zz", "é", None], [5, 2, 1, 5, 2]))
    for x in got:
        t = totals.setdefault(x["source"], [0, 0, x["target"], x["source_size"]])
        t[0], t[1] = t[0] + x["size"], t[1] + x["taken"]
        assert x["size"] == len(texts[x["doc_id"]].split()) and 0 <= x["taken"] <= 3 * x["size"]
    total = sum(t[0] for t in totals.values())
    capped, left = set(), float(total)
    while True:  # the definition: what is above its cap stops there, the rest is shared again
        share = {s: left * weights[s] / sum(weights[x] for x in totals if x not in capped) for s in totals if s not in capped}
        over = [s for s in share if share[s] > 3 * totals[s][0]]
        if not over:
            break
        capped |= set(over)
        left = total - sum(3.0 * totals[s][0] for s in capped)
    for s, (size, taken, target, source_size) in totals.items():
        assert size == source_size and target == pytest.approx(3.0 * size if s in capped else share[s]) and abs(taken - target) <= 400


def test_mixing_keeps_expectations(spark):
    """Over many seeds a document is taken target / source size times, and each source's words stay beside its target."""
    r, runs = random.Random(9), 40
    docs = documents(spark, [" ".join(["w"] * r.choice([1, 3, 10, 60, 300])) for _ in range(90)], range(90), ["a" if i % 3 else "b" for i in range(90)])
    sized = mixing.sized_documents(docs)
    taken, goal = {}, {}
    for seed in range(runs):
        words = {}
        for x in mixing.copies(sized, seed=seed, chunk=8).collect():
            goal[x["doc_id"]] = x["target"] / x["source_size"]
            assert x["copies"] in (int(goal[x["doc_id"]]), int(goal[x["doc_id"]]) + 1)
            taken[x["doc_id"]] = taken.get(x["doc_id"], 0) + x["copies"]
            words[x["source"]] = words.get(x["source"], -x["target"]) + x["copies"] * x["size"]
        assert all(abs(w) <= 300 for w in words.values())
    off = [(taken[i] / runs - f) / np.sqrt((f % 1) * (1 - f % 1) / runs) for i, f in goal.items()]
    assert abs(np.mean(off)) < 0.35 and np.mean(np.square(off)) < 1.5 and max(map(abs, off)) < 4.5


def test_mixing_repeats_rows(spark):
    docs = documents(spark, ["one two", "one two", "one two", "three", "", None], [1, 1, 1, 2, 3, 4], ["a", "a", "a", "b", "b", None])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    planned = {r["doc_id"]: r["c"] for r in mixing.plan(docs).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()}
    taken = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert taken == {k: v for k, v in planned.items() if v}


def plain_labels(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licences(spark):
    texts = [
        "Released CC-BY, cc by cc by; All Rights  Reserved.", "Licensed under the Apache License, Version 2.0 (the License)", "general public licence", "GENERAL\npublic LICENSE all rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and the associated documentation files", "nothing here", "", None, "ÉCC BY by cc",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_labels(t or ""), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[1]["labels"] == "apache-2.0" and got[4]["labels"] == "mit" and got[5]["labels"] == ""


def labels_of_all_starts(words):
    """The labels of all passages that some start gives enough coverage and a key phrase near, every start tried."""
    out = set()
    for label, passage, key in (*licenses.PASSAGES, *licenses.TEXTS):
        want, key = [w.encode() for w in passage.split()], [w.encode() for w in key.split()]
        keys = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        for s in range(-len(want), len(words)) if keys else ():
            near = any(max(0, s - 2) <= i and i + len(key) <= s + len(want) + 2 for i in keys)
            if near and sum(w in words[max(0, s + i - 2) : max(0, s + i + 3)] for i, w in enumerate(want)) >= 0.6 * len(want) - 1e-9:
                out.add(label)
                break
    return out


def test_licence_labels_are_those_of_all_starts():
    """Whole texts and passages with words changed, dropped, doubled and moved, against a search through every start."""
    r = random.Random(11)
    common = {w: 900 for _, p, _ in licenses.TEXTS for w in licenses.words_of(p)} | {b"sublicense": 2, b"relinquishment": 1, b"misrepresented": 3}
    index, kept = licenses.Index(common, 1000), 0
    for _ in range(220):
        words = []
        for _ in range(r.randrange(1, 3)):
            words += ["filler"] * r.randrange(9)
            _, passage, key = r.choice((*licenses.PASSAGES, *licenses.TEXTS))
            own, loss = passage.split(), r.choice([0, 0.02, 0.2, 0.38, 0.42])
            at = [i for i in range(len(own)) if own[i : i + len(key.split())] == key.split()][0]
            for i in range(len(own)):
                if not at <= i < at + len(key.split()) and r.random() < loss:
                    own[i] = r.choice(["filler", "the", "software"])
            if r.random() < 0.3:
                own.insert(r.randrange(len(own)), "more")
            words += own
        words = [w.encode() for w in words]
        got = {label for _, label, _ in index.scan(words)[1]}
        assert got == labels_of_all_starts(words)
        kept += bool(got)
    assert 100 < kept < 220


def test_whole_licence_texts(spark):
    """Each whole text is found by its label, with all of its words in place."""
    texts = ["words before. " + p.capitalize() + " and after" for _, p, _ in licenses.TEXTS]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    for i, (label, passage, _) in enumerate(licenses.TEXTS):
        assert len(passage.split()) >= 60 and label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        assert (2, label, 1.0) in [(x["start"], x["label"], x["coverage"]) for x in got[i]["passages"]]


@pytest.mark.parametrize(("label", "passage", "key"), licenses.PASSAGES)
def test_every_licence_passage(label, passage, key):
    """Found as it is, in capitals, between punctuation and with a word changed; not by its key phrase or its words alone."""
    common = {w: 900 for w in (b"the", b"of", b"to", b"and", b"any", b"this", b"is", b"a", b"in")}
    index, filler = licenses.Index(common, 1000), "plain words saying nothing about those things "
    found = lambda text: {x[1]: x for x in index.scan(licenses.words_of(text))[1]}
    words, at = passage.split(), len(licenses.words_of(filler))
    for text in (passage, passage.upper(), ", ".join(words) + ";"):
        assert found(filler + text + " and more " + filler)[label] == (at, label, 1.0)
    held = key.split()
    free = [i for i in range(len(words)) if not any(words[j : j + len(held)] == held and j <= i < j + len(held) for j in range(len(words)))]
    if free:
        changed = " ".join("altered" if i == free[0] else w for i, w in enumerate(words))
        got = found(filler + changed)
        assert (label in got) == ((len(words) - 1) / len(words) >= licenses.LEAST_COVERAGE and len(words) > 2)
    if len(held) / len(words) < licenses.LEAST_COVERAGE:
        assert label not in found(filler + key + " " + filler)
    if len(set(words)) > 3:
        assert label not in found(" far apart from one another indeed ".join(words))
    assert found(filler) == {} and index.scan([]) == ([], [])


def test_a_picture_s_feature():
    r = random.Random(8)
    for size in (1, 3, 40):
        payload = bytes(r.randrange(256) for _ in range(576 * size))
        n, mean = len(payload), sum(payload) / (576 * size)
        cuts = [i * n // 64 for i in range(65)]
        bits = "".join(str(int(sum(payload[a:b]) / (b - a) > mean)) for a, b in zip(cuts, cuts[1:]))
        spread = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
        assert media.feature(payload) == f"{mean:.4f}:{spread:.4f}:{int(bits, 2):016x}" and media.from_png(media.to_png(payload)) == payload


def test_media_round_trip(spark):
    texts = ["", None, "é" * 287, "x" * 576, "y" * 577, "<p>&amp; \xa0 z", "x" * 576]
    got = {r["doc_id"]: r for r in media.document_media(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["caption"] == f"{len(t or '')} characters" and r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
        # a page has the text's paragraphs in order, and the picture between them
        assert (r["n_parts"], r["pos"]) == ((2, 1) if data else (1, 0)) and r["text_sha256"] == hashlib.sha256(data).hexdigest()
    assert got[3]["feature"] == got[6]["feature"]


def test_references_stay_beside_their_texts(spark):
    """Several paragraphs: the position, what stands before and after the reference, and all texts in order."""
    r = random.Random(2)
    texts = ["".join(r.choice(["word ", "<b>&amp;", "\n", "é\r\n", "  \n\n", "x" * 50]) for _ in range(r.randrange(900))) for _ in range(40)] + ["\n" * 9_000, "long" * 5_000]
    got = {x["doc_id"]: x for x in media.document_media(documents(spark, texts)).collect()}
    several = 0
    for i, t in enumerate(texts):
        parts, x = media.paragraphs(t), got[i]
        assert "".join(parts) == t
        if t.strip():
            assert all(p.strip() for p in parts) and max(map(len, parts)) <= 3 * 2_000
            middle = (len(parts) + 1) // 2
            assert (x["pos"], x["n_parts"], x["text_sha256"]) == (middle, len(parts) + 1, hashlib.sha256(t.encode()).hexdigest())
            assert x["before"] == parts[middle - 1][-40:] and x["after"] == (parts[middle][:40] if middle < len(parts) else "")
            several += len(parts) > 2
    assert several > 10
    refs = media.shown_in(media.parse_page('<p>one</p><img src="media:a" alt="A">two<img src="media:b"><img src="media:c">'))
    assert [x[:5] for x in refs] == [(1, "a", "A", "one", "two"), (3, "b", None, "two", ""), (4, "c", None, "", "")]


def test_interleaved_pages(spark):
    page = '<h1>T</h1><p>one &lt;b&gt;</p><figure><img src="media:d1" alt="old"><figcaption>cap</figcaption></figure><p>two</p><img src="media:d2" alt="alt"><script>no</script>tail'
    parts = media.parse_page(page)
    assert [(p["pos"], p["kind"], p["text"], p["digest"], p["caption"]) for p in parts] == [
        (0, "text", "T", None, None), (1, "text", "one <b>", None, None), (2, "media", None, "d1", "cap"), (3, "text", "two", None, None), (4, "media", None, "d2", "alt"), (5, "text", "tail", None, None),
    ]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<img src=media:zz")], "id long, html string")
    store = spark.createDataFrame([("d1", b"1"), ("d2", b"2")], "digest string, media binary")
    got = [tuple(r) for r in media.resolve(media.references(media.sequences(pages)), store).orderBy("id", "pos").select("id", "pos", "digest", "media", "caption").collect()]
    assert [(g[0], g[1], g[2], g[4]) for g in got if g[0] == 1] == [(1, 2, "d1", "cap"), (1, 4, "d2", "alt")] and [bytes(g[3]) for g in got if g[0] == 1] == [b"1", b"2"]


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "a <|end|> b\x1b<|text|>"), (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a <|end|> b\x1b<|text|>"), (2, None, None, None), (2, 3, "assistant", ""), (2, 4, "assistant", "z\n\x1b\x1b"), (None, 0, "tool<|turn|>", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.assemble(table, CHAT, public_tokenizers.PATTERN), CHAT, public_tokenizers.PATTERN).collect()}
    order = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -9, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        order.setdefault(c, []).append((role or "", text or ""))
    for c, turns in order.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(chat.TURN + chat.escape(r) + chat.TEXT + chat.escape(t) + chat.END) for r, t in turns)
        assert all(x not in chat.escape(y) for _, y in turns for x in (chat.TURN, chat.TEXT, chat.END, "[INST]", "</s>"))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[7].tolist()) for i in range(60)] + [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [1.0] * 3), (None, x[0].tolist()), (7, x[7].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ids, m = np.array([i for i, v in rows[:1560]]), np.array([v for _, v in rows[:1560]], float)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {int(i) for i in ids if i % 20 == 0}
    hit = 0
    for q, found in by.items():
        s = m @ m[np.flatnonzero(ids == q)[0]]
        best = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        assert len(found) == 20 and [-f[1] for f in found] == sorted(-f[1] for f in found)
        hit += len(set(best) & {f[0] for f in found})
        if q in (2000, 2020):
            assert [f[0] for f in found] == best  # a tie of equal vectors goes by id
    assert hit / (20 * len(by)) >= 0.9


def test_pruned_search_finds_most():
    """50,000 even directions in 64 dimensions, the hardest case: a query looks into a share of the leaves and sees two thirds of the
    vectors, and still finds nine in ten of its twenty nearest."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = ann.grow(x[:32_768], len(x), 1.0)
    leaves, asked = forest.leaves(x), np.arange(0, 50_000, 500)
    probes = max(ann.LEAST_PROBES, int(np.ceil(ann.SHARE * ann.TREES * 2**forest.height)))
    assert probes < ann.TREES * 2**forest.height / 4
    found, seen = [], []
    for i, own in zip(asked, forest.probe(x[asked], probes)):
        looked = np.zeros((ann.TREES, 2**forest.height), bool)
        looked[tuple(np.array(own).T)] = True
        met = looked[np.arange(ann.TREES), leaves].any(1)
        scores = x @ x[i]
        scores[i] = -2
        found.append(met[np.argsort(-scores)[:20]].mean())
        seen.append(met.mean())
    assert np.mean(found) >= 0.9 and np.mean(seen) < 0.7


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 3)]
    assert ann.search(few.limit(0)).collect() == []


@pytest.mark.parametrize(("name", "label"), [("op2_quality", "quality"), ("op6_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in got]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % (5 if label == "quality" else 4) == (0 if label == "quality" else 2) for r in got)


def test_segments_are_maximal():
    """Against the definition: a segment's the best stretch, the shortest of equally good ones, then those beside it."""
    r = random.Random(11)
    for _ in range(200):
        scores = [r.choice([1.13, 2.37, 4.71]) if r.random() < 0.25 else r.choice([-0.25, -0.25, -1.9]) for _ in range(40)]

        def split(a, b):
            best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, a, a), key=lambda x: (round(x[0], 9), x[1] - x[2]))
            return [] if best[0] <= 0 else [*split(a, best[1]), (best[1], best[2] - 1, best[0]), *split(best[2], b)]

        found = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in split(0, 40)]
        assert all(s == pytest.approx(sum(scores[a : b + 1])) for a, b, s in found)


def test_chain_marginals_are_brute_forces():
    rng = np.random.default_rng(2)
    rows, counts = rng.standard_normal((9, 3)), np.array([1, 5, 3])
    chain = quality.Chain(rng.standard_normal(4), rng.standard_normal((2, 2)))
    got, pairs = chain.marginals(rows, counts)
    at, want, moves = 0, [], np.zeros((2, 2))
    for n in counts:
        part = rows[at : at + n] @ chain.emit[:-1] + chain.emit[-1]
        weigh = {y: np.exp(sum(part[i] * (y >> i & 1) for i in range(n)) + sum(chain.move[y >> i & 1, y >> (i + 1) & 1] for i in range(n - 1))) for y in range(2**n)}
        z = sum(weigh.values())
        want += [sum(w for y, w in weigh.items() if y >> i & 1) / z for i in range(n)]
        for y, w in weigh.items():
            for i in range(n - 1):
                moves[y >> i & 1, y >> (i + 1) & 1] += w / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, moves)


OVER_DOCUMENTS = {
    "tokens": lambda d: token_counts.count_tokens(d, PIECES),
    "bpe": lambda d: bpe.encode_decode(d, BYTES, public_tokenizers.PATTERN),
    "simhash": simhash.near_duplicates,
    "mixing": mixing.plan,
    "licences": licenses.scan,
    "media": media.document_media,
    "quality": lambda d: quality.score_texts(d, quality.fit(d, labels_of(d))),
    "toxicity": lambda d: toxicity.score_texts(d, toxicity.fit(d, labels_of(d))),
}


def labels_of(d):
    return d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))


@pytest.mark.parametrize("name", list(OVER_DOCUMENTS))
def test_awkward_tables(spark, name):
    """A row for each row, repeated and null ones too; none of an empty table."""
    docs = awkward(spark)
    got = OVER_DOCUMENTS[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    assert OVER_DOCUMENTS[name](docs.limit(0)).collect() == []


def test_awkward_vectors(spark):
    """Nothing but nulls; columns that clash with those of the search."""
    kind = "vec_id long, embedding array<float>, id string, h1 string, leaf string, score string, vector string"
    none = spark.createDataFrame([(None, None, *"abcde"), (20, None, *"abcde")], kind)
    assert ann.search(none).collect() == []
    some = spark.createDataFrame([(i, [1.0, float(i)], *"abcde") for i in range(30)] + [(0, [1.0, 0.0], *"abcde")], kind)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(some).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(0, i, i) for i in range(1, 21)]  # the same product with all: ties go by id
    large = spark.createDataFrame([(i, [1e6 * x for x in (1.0, float(i % 7), float(i % 11))]) for i in range(60)], "vec_id long, embedding array<double>")
    rows = [(r["vec_id"], np.array(r["embedding"])) for r in large.collect()]
    for q in (0, 20, 40):
        want = sorted(((-float((rows[q][1] * v).sum()), i) for i, v in rows if i != q))[:20]
        assert [(r["vec_id"], r["score"]) for r in ann.search(large).where(f"query_id = {q}").orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_awkward_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, ids string, place string, start string"
    back = lambda rows: chat.read_back(chat.assemble(spark.createDataFrame(rows, kind), CHAT, public_tokenizers.PATTERN), CHAT, public_tokenizers.PATTERN).collect()
    assert back([]) == []
    (only,) = back([(None, None, None, None, "a", "b", "c")] * 2)
    assert (only["conv_id"], only["n_turns"], only["loss_chars"]) == (None, 2, 0) and only["turns_sha256"] == hashlib.sha256(b"\n\n" * 2).hexdigest()
    long = "word <|end|> \x1b" * 60_000 + "z" * 30_000
    (one,) = back([(1, i, "assistant" if i % 2 else "user", long, "a", "b", "c") for i in range(4)])
    assert one["loss_sha256"] == hashlib.sha256((long * 2).encode()).hexdigest() and one["loss_chars"] == 2 * len(long)


def test_long_and_repeated_media(spark):
    texts = ["é" * 900_000 + "z"] * 3 + ["a"] * 40 + [None, ""]
    got = media.document_media(documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["n_bytes"], r["payload_sha256"]) == (len(data), hashlib.sha256(media.payload_of(texts[r["doc_id"]] or "")).hexdigest())


def test_texts_are_pictured_once(spark):
    docs = documents(spark, ["same"] * 50 + [None, "", "other", "same "])
    assert sorted(r["text"] for r in media.distinct_texts(docs).collect()) == ["", "other", "same", "same "]


def test_queries_run(spark):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
