"""The pipeline against a version that goes through its stages text by text."""

import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from folioscope.llm import bpe, mixing, quality, toxicity
from folioscope.llm.queries import tokenizer_file
from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    frame = lambda rs: spark.createDataFrame(rs, docs.schema)

    model = toxicity.fit(docs, labels)
    rows = [r for r in rows if model.score(*model.passages(r["text"] or "", {})) < 0.3]
    judge = quality.fit(frame(rows), labels)
    rows = [r for r in rows if judge.scores([r["text"] or ""])[0][0] >= 0.3]
    rows.sort(key=lambda r: r["doc_id"])
    kept = set(brute_kept([(r["doc_id"], r["text"]) for r in rows]))
    rows = [r for r in rows if r["doc_id"] in kept]
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(frame(rows)).collect()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in rows:
        ids = own.encode_ordinary(r["text"])
        want += [(r["doc_id"], r["source"], tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] * copies[r["doc_id"]]

    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(want) == sorted((r["doc_id"], r["source"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in got)
    assert 0 < len(rows) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(60), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_awkward_rows(spark):
    """Nulls, repeats, ties and clashing columns: a stage gives back whole rows of its own, in its own columns."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, node string, _hash string, size string"
    good = " ".join(f"word{i} of a quiet day" for i in range(60))
    rows = [(None, None), (None, good), (1, ""), (2, good), (2, good), (2, good), (3, good + " more"), (4, "x" * 5_000), (5, "long text " * 40_000), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", None if (i or 0) % 2 else "s", 0, "a", "b", "c", "d", "e") for i, t in rows], kind)
    own = {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == docs.columns
            assert {(r["doc_id"], r["text"]) for r in out.collect()} <= own
        else:
            assert out.count() == len(rows) and "score" in out.columns
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "4", "5"]  # empty ones with 1, which has the least id; good ones with 2
    again = docs.where("false")
    assert all(stage(spark, again, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_give_back_whole_rows(spark):
    """Columns named like the stages' own helpers come back with their values and types."""
    names = "_hash _at _key _k _copies _copy _maybe _own_key _own_id _own_size _c _bit _word _bits _own _text_hash _kept _rows _number row key hash print root x".split()
    good = " ".join(f"word{i} of a quiet day" for i in range(60))
    texts = [(1, good, "a"), (2, good, "b"), (2, good, "b"), (3, good + " and more", "a"), (4, "another text " + " ".join(f"t{i}" for i in range(80)), "b"), (5, None, "c"), (None, "short one", None)]
    kind = "doc_id long, text string, source string, " + ", ".join(f"`{n}` {'string' if i % 3 else 'array<int>'}" for i, n in enumerate(names))
    docs = spark.createDataFrame([(*t, *(f"{n}{j}" if i % 3 else [j, i] for i, n in enumerate(names))) for j, t in enumerate(texts)], kind)
    own = {str(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.columns == docs.columns, name
        rows = [str(r) for r in out.collect()]
        assert rows and set(rows) <= own, name
    encoded = corpus_pipeline.encoding(spark, docs, SF)
    kept = [c for c in encoded.columns if c in names]
    assert sorted(map(str, encoded.select(*kept).collect())) == sorted(map(str, docs.select(*kept).collect())) and len(kept) == len(names)


def test_one_of_each_fingerprint(spark):
    """Operator 9's own choice of rows: one of each component, the least id's."""
    from folioscope.llm import simhash

    docs = spark.createDataFrame([(None, "a b c d", "n"), (3, "A b C d", "x"), (3, "A b C d", "y"), (2, "a b c d", "z"), (7, "other words stand here", "w"), (8, None, "v"), (1, "", "u")], "doc_id long, text string, more string")
    got = simhash.one_of_each(docs).collect()
    assert sorted((r["doc_id"], r["more"]) for r in got) == [(1, "u"), (2, "z"), (7, "w")]
