"""Queries without SQL against plain versions over the whole table."""

import difflib
import hashlib
import re

from folioscope.functions import udfs
from folioscope.operators.search_index import TieredIndex
from folioscope.plans import catalog
from folioscope.sources import corpus

SF = "/root/testdata/sf0.001"


def norm(text):
    return " ".join(re.findall(r"\w+", text.casefold()))


def test_fuzzy_filenames(spark):
    ids = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    want = []
    for q in (i for i in ids if i % 20 == 0):
        for d in ids:
            query, stem, name = norm(f"dok-{q}"), norm(f"doc-{d}"), norm(f"doc-{d}.txt")
            r = difflib.SequenceMatcher(None, query, stem).ratio()
            if query not in name and r >= 0.72:
                want.append((q, d, round(2 + 1 - r, 6)))
    got = [(r["query_id"], r["document_id"], r["score"]) for r in catalog.QUERIES["fuzzy_filenames"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_passage_chunks(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want += [(f"{r['doc_id']}:{i}", r["doc_id"], i, len(c), hashlib.sha256(c.encode()).hexdigest()) for i, c in enumerate(udfs.chunks(r["text"] or ""))]
    assert sorted(map(tuple, catalog.QUERIES["passage_chunks"](spark, SF).collect())) == sorted(want) and len(want) > 200


def test_passages_of_the_tiered_search(spark, tmp_path):
    """Over chunks, with similar names: the texts' search and the index's, which share no step, agree; excerpts hold the query's words."""
    docs, asked = corpus.documents(spark, SF), corpus.queries(spark, SF, 2)
    index = TieredIndex(spark, str(tmp_path / "index"), buckets=8)
    index.refresh(docs, corpus.passages(docs))
    columns = ["query_id", "rank", "document_id", "name", "tier", "score", "reason", "n_evidence"]
    got = catalog.QUERIES["search_passages_fuzzy"](spark, SF)
    rows = got.select(*columns, "excerpt").join(asked, "query_id").collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(map(tuple, index.search(asked, fuzzy=True).select(*columns).collect())) and rows
    for r in rows:
        assert any(w in r["excerpt"].lower() for w in r["query"].lower().split()) or r["tier"] < 2
