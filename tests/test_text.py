import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions import udfs


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression.alias("v")).first()["v"]


def test_terms_of_words_and_ideographs(spark):
    assert value(spark, tx.search_terms(F.col("t")), t="Straße a_b 微分方程") == sorted(["strasse", "a_b", "微分方程", "微分", "分方", "方程", "微分方", "分方程"])
    assert value(spark, tx.analyzed_terms(F.col("t")), t="v1.2-x Été 字 微分") == sorted(["v1.2-x", "t", "字", "微分"])
    assert value(spark, tx.search_terms(F.col("t")), t="") == []


def test_tokens_fold_accents_but_not_sharp_s(spark):
    assert value(spark, tx.fts_tokens(F.col("t")), t="Ouè straße a_b") == ["oue", "straße", "a", "b"]


def test_heading_and_excerpt(spark):
    assert value(spark, tx.heading(F.col("t")), t="\n   \n  First line \nsecond") == "First line"
    assert value(spark, tx.heading(F.col("t")), t="") == ""
    long = "x " * 200 + "needle here " + "y " * 200
    got = value(spark, tx.excerpt(F.col("t"), F.col("q")), t=long, q="needle")
    assert "needle here" in got and got.startswith("…") and got.endswith("…")
    assert value(spark, tx.excerpt(F.col("t"), F.col("q")), t="short text", q="zzz") == "short text"


def test_paths(spark):
    assert value(spark, F.struct(tx.file_name(F.col("p")), tx.stem(F.col("p")), tx.extension(F.col("p")), tx.parent(F.col("p"))), p="a/b/c.tar.GZ") == ("c.tar.GZ", "c.tar", ".gz", "a/b")
    assert value(spark, tx.ancestors(F.col("p")), p="a/b/c.txt") == [".", "a", "a/b"]
    assert value(spark, tx.ancestors(F.col("p")), p="c.txt") == ["."]


def test_grounding_markers(spark):
    assert value(spark, tx.without_unknown_markers(F.col("t"), F.array(F.lit("S1"))), t="a [S1] b [S2][X9] c") == "a [S1] b  c"


def test_redaction(spark):
    got = value(spark, tx.redacted(F.col("t")), t="token=abc123 in /home/me/file.txt")
    assert "abc123" not in got and "/home" not in got


def test_chunks():
    assert udfs.chunks("") == [] and udfs.chunks("  a ") == ["a"]
    assert udfs.chunks("x" * 1600) == ["x" * 1600]
    plain = udfs.chunks("y" * 4000)
    assert [len(c) for c in plain] == [1600, 1600, 1160]
    for mark in udfs.MARKS:
        text = "a" * 1000 + mark + "b" * 2000
        assert udfs.chunks(text)[0] == text[: 1000 + 1].strip()
    assert all(len(c) <= 1600 for c in udfs.chunks("word. " * 3000))


@pytest.mark.parametrize(("text", "label"), [("Plain readable sentences about ordinary things, long enough to be judged fairly by their letters and spaces, and then some more.", "readable"), ("", "low"), ("�" * 30, "low"), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "low"), ("\x01\x02\x03" * 20, "low")])
def test_readability(text, label):
    score = udfs.readability(text)
    assert 0 <= score <= 1
    assert ("readable" if score >= 0.72 else "partial" if score >= 0.45 else "low") == label


def letters(start, n=30):
    return "".join(map(chr, range(ord(start), ord(start) + n)))


@pytest.mark.parametrize(
    ("text", "score"),
    [
        (letters("A", 26) + "abcd" + letters("一") + letters("あ") + letters("ア"), 0.64),  # four scripts, none of them dominant: 1 - 0.14 - 0.22
        (letters("A", 26) + "abcd" + "".join(chr(c) for c in range(0xE0, 0x100) if c not in (0xF7, 0xFF)) + letters("α", 25) + letters("а"), 0.6317),  # accented Latin is another script; 115 characters
        (letters("ა") + letters("ก") + letters("א", 27) + letters("а", 33), 0.64),
        (letters("A", 26) + "abcd" + letters("一") + letters("あ", 60), 1.0),  # three scripts
        (letters("一", 100) + "A" + letters("а", 2) + letters("א", 2) + letters("あ", 2) + letters("α", 13), 0.72),  # five scripts with two letters or more: 2 * 0.14
    ],
)
def test_readability_of_mixed_scripts(text, score):
    assert udfs.readability(text) == pytest.approx(score, abs=0.0001)


def test_decoded_says_what_is_missing(spark):
    rows = [(1, b"abc"), (2, b"x" * (udfs.MOST_CHARS + 5)), (3, "é".encode("utf-16")), (4, None)]
    d = spark.createDataFrame(rows, "id int, data binary").select("id", udfs.decoded("data").alias("x")).select("id", F.length("x.text").alias("n"), "x.truncated")
    assert {tuple(r) for r in d.collect()} == {(1, 3, False), (2, udfs.MOST_CHARS, True), (3, 1, False), (4, 0, False)}


def test_sniffing_and_names():
    assert udfs.sniffed("é".encode("utf-16")) == "é" and udfs.sniffed(b"\xef\xbb\xbfa") == "a"
    assert udfs.sniffed("中文".encode("gb18030")) == "中文" and udfs.sniffed(None) == ""
    assert udfs.recovered_name("中文.txt".encode("cp936").decode("cp437")) == "中文.txt" and udfs.recovered_name("plain.txt") == "plain.txt"
    assert udfs.normalize_unicode("Ｆｕｌｌ Straße!") == "full strasse"


def test_chunks_by_rule():
    """Each passage against the rule itself, looked up mark by mark."""
    r = random.Random(7)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc", ". ", "; ", "\n", "\n\n", "。", "；", " ", ".", "word "]) for _ in range(r.randrange(300)))
        target, overlap = r.choice([(20, 5), (37, 11), (100, 18)])
        whole, at, want = text.strip(), 0, []
        while at + target < len(whole):
            cuts = [p for p in range(at + target // 2, at + target) if any(whole.startswith(m, p) and p + len(m) <= at + target for m in udfs.MARKS)]
            stop = cuts[-1] + 1 if cuts else at + target
            want.append(whole[at:stop].strip())
            at = max(at + 1, stop - overlap)
        want.append(whole[at:].strip())
        assert udfs.chunks(text, target, overlap) == [w for w in want if w]
    assert udfs.chunks("  ") == [] and udfs.chunks("one\ntwo") == ["one\ntwo"]
    assert [len(c) for c in udfs.chunks("x" * 4000)] == [1600, 1600, 1160]


def test_exact_normalisation_goes_to_python_only_where_needed(spark):
    """Equal to normalize_unicode() on every character of the blocks and on mixtures; plain texts don't leave the JVM."""
    r = random.Random(3)
    chars = [chr(i) for a, b in udfs.BLOCKS for i in range(a, b + 1)] + list("ﬁ①½ΣςİſŉĲµªº²℡㎏\u0301\u3099\u1100\u1161ǅẞＡｂ０")
    texts = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)] + ["".join(r.choice(chars) for _ in range(30)) for _ in range(2000)] + ["ΟΔΟΣ οδος ΣΑΣ", "Straße STRASSE", "", None]
    plain = ["".join(r.choice([c for c in chars[:1000] if udfs.plain(c)]) for _ in range(20)) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts + plain], "t string").select("t", udfs.normalized_text(F.col("t")).alias("n"), tx.normalized(F.col("t")).alias("jvm"), F.col("t").rlike(udfs.PLAIN_TEXT).alias("plain")).collect()
    for x in rows:
        assert x["n"] == udfs.normalize_unicode(x["t"]), x["t"]
        assert not x["plain"] or x["jvm"] == x["n"]
    assert all(x["plain"] for x in rows[len(texts) :]) and sum(bool(x["plain"]) for x in rows[: len(chars) // 40]) > 500
    assert [bool(x["plain"]) for x in rows if x["t"] in ("ΟΔΟΣ οδος ΣΑΣ", "Straße STRASSE")] == [False, True]
