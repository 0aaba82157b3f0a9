"""Explainable search: BM25 over postings, tiers of name, title, heading and body matches, and the older weighted ranker.

Queries are a relation: any number of them run in one job. Only postings of the queries' terms are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.udfs import normalized_text
from folioscope.operators import grams as gr
from folioscope.sources.corpus import durable

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Queries, and their bytes, that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_QUERIES, BROADCAST_BYTES = 10_000, 16 << 20
PASSAGE_LIMIT = 250
#: Least ratio of a similar name.
SIMILAR = 0.72


def few(queries: DataFrame) -> bool:
    """Whether the queries are few and small enough to send them to all executors."""
    some = queries.limit(BROADCAST_QUERIES + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("size"))
    n, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= BROADCAST_QUERIES and size <= BROADCAST_BYTES


def asked(queries: DataFrame) -> DataFrame:
    """The queries, marked for broadcast if they're few."""
    return F.broadcast(queries) if few(queries) else queries


def query_terms(queries: DataFrame, terms: Column | None = None) -> DataFrame:
    """(query_id, term, n_terms), each term once."""
    terms = F.array_distinct(tx.fts_tokens(F.col("query"))) if terms is None else terms
    return queries.select("query_id", terms.alias("t")).select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


def tokenized(rows: DataFrame, key: str, fields: dict[str, float], tokens=tx.fts_tokens) -> DataFrame:
    """(key, fields, dl): each row's tokens by field, and their number; a null field has none."""
    split = rows.select(key, *(tokens(F.coalesce(f, F.lit(""))).alias(f) for f in fields))
    return split.withColumn("dl", sum((F.size(f) for f in fields), F.lit(0)))


def frequencies(split: DataFrame, key: str, fields: dict[str, float], terms: DataFrame | None = None, small=lambda d: d) -> DataFrame:
    """(key, dl, term, f) of tokenized(), of the given terms only: how often a term stands, weighted by field."""
    with_weight = lambda f, w: F.transform(f, lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))
    each = F.flatten(F.array(*(with_weight(f, w) for f, w in fields.items())))
    said = split.select(key, "dl", F.explode(each).alias("x")).select(key, "dl", F.col("x.term").alias("term"), F.col("x.w").alias("w"))
    said = said if terms is None else said.join(small(terms.select("term").distinct()), "term", "left_semi")
    return said.groupBy(key, "dl", "term").agg(F.sum("w").alias("f"))


def bm25_of(tf: DataFrame, key: str, stats: DataFrame, terms: DataFrame, small=lambda d: d) -> DataFrame:
    """(query_id, key, n_terms, n_matched, bm25) of frequencies() of the queries' terms and stats(n_rows, avgdl). Gains are added up
    as decimals, so that the order in which they come changes no score: rows alike in their terms tie exactly."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    idf = F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    gain = F.when(idf > 0, idf).otherwise(LEAST_IDF) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighed = tf.join(small(df), "term").crossJoin(F.broadcast(stats)).select(key, "term", gain.alias("gain"))
    return weighed.join(small(terms), "term").groupBy("query_id", key).agg(F.first("n_terms").alias("n_terms"), F.count(F.lit(1)).alias("n_matched"), F.sum(F.col("gain").cast("decimal(28,18)")).cast("double").alias("bm25"))


def bm25(rows: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, tokens=tx.fts_tokens) -> DataFrame:
    """(query_id, key, n_terms, n_matched, bm25) of all rows that hold a term of a query in any field. A term's frequency is
    weighted by field, a row's length isn't; statistics are those of all rows."""
    split = tokenized(rows, key, fields, tokens)
    stats = split.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dl").alias("avgdl"))
    terms, small = query_terms(queries), F.broadcast if few(queries) else lambda d: d  # a query has a few terms
    return bm25_of(frequencies(split, key, fields, terms, small), key, stats, terms, small)


def ranked(rows: DataFrame, order: list[Column], k: int, by: str = "query_id", name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def all_else_any(hits: DataFrame) -> DataFrame:
    """Rows that match all terms of their query; of queries without such rows, those that match any."""
    full = hits.groupBy("query_id").agg(F.max(F.col("n_matched") == F.col("n_terms")).alias("full"))  # aggregated before any shuffle
    return hits.join(full, "query_id").where("not full or n_matched = n_terms").drop("full")


def normalized_queries(queries: DataFrame) -> DataFrame:
    """(query_id, q) of the queries that have a word."""
    return durable(queries.select("query_id", normalized_text(F.col("query")).alias("q")).where("q <> ''"))


def name_rows(docs: DataFrame) -> DataFrame:
    """(document_id, name, stem, title, path), normalised."""
    return docs.select("document_id", *(normalized_text(F.col(c)).alias(c) for c in ("name", "stem", "title", "path")))


def name_strings(names: DataFrame) -> DataFrame:
    """(document_id, field, text, stem): what a query may be a part of."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("name", "title", "path")))
    return names.select("document_id", "stem", F.inline(each))


#: Of the reasons for which a document is found by its names the first counts; with their tiers.
REASONS = {"exact name": 0, "name starts with query": 1, "name contains query": 1, "name is similar": 1, "title contains query": 2, "path contains query": 2}


def metadata_hits(docs: DataFrame, queries: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(query_id, document_id, tier, score, reason) by name, title and path, by looking up grams."""
    q = normalized_queries(queries)
    names, small = durable(name_rows(docs)), F.broadcast if few(q) else lambda d: d
    return metadata_found(names, gr.contained(name_strings(names), "text", q, small), q, small, fuzzy)


def metadata_found(names: DataFrame, parts: DataFrame, q: DataFrame, small: Callable[[DataFrame], DataFrame], fuzzy: bool) -> DataFrame:
    """metadata_hits from name_rows(), and the rows (query_id, q, document_id, field, text, stem) whose text contains q."""
    hit = lambda rows, reason, score: rows.select("query_id", "document_id", reason.alias("reason"), score.cast("double").alias("score"))
    exact = [names.join(small(q), F.col(c) == F.col("q")) for c in ("name", "stem")]
    target = F.when(F.contains("stem", F.col("q")), F.col("stem")).otherwise(F.col("text"))
    at, rest = F.instr(target, F.col("q")), (F.length(target) - F.length("q")) / 1e4
    by_name = F.struct(F.when(at == 1, "name starts with query").otherwise("name contains query").alias("reason"), (F.when(at == 1, 0.0).otherwise(1 + (at - 1) / 1e3) + rest).alias("score"))
    other = F.struct(F.concat("field", F.lit(" contains query")).alias("reason"), F.when(F.col("field") == "path", 0.2).otherwise(0.0).alias("score"))
    met = parts.withColumn("x", F.when(F.col("field") == "name", by_name).otherwise(other))
    hits = [*(hit(e, F.lit("exact name"), F.lit(0.0)) for e in exact), hit(met, F.col("x.reason"), F.col("x.score"))]
    order = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason"))
    tier = F.element_at(F.array(*map(F.lit, REASONS.values())), order.cast("int"))
    every = functools.reduce(DataFrame.unionByName, hits).select("query_id", "document_id", F.struct(order.alias("order"), "score", "reason", tier.alias("tier")).alias("x"))
    best = every.groupBy("query_id", "document_id").agg(F.min("x").alias("x"))
    found = best.select("query_id", "document_id", "x.tier", "x.score", "x.reason")
    if not fuzzy:
        return found
    # similar names may be many: which of them are found for a better reason, and what is found for a worse one although the name is
    # similar, is told from the strings themselves, so that similar pairs aren't shuffled to be compared with the others
    better = F.contains("name", F.col("q")) | (F.col("stem") == F.col("q"))
    near = gr.similar(names.select("document_id", "name", "stem"), ["document_id"], "stem", q, SIMILAR, small, better)
    hit_near = near.select("query_id", "document_id", F.lit(REASONS["name is similar"]).alias("tier"), (2 + (1 - F.col("near"))).cast("double").alias("score"), F.lit("name is similar").alias("reason"))
    worse = F.col("reason").isin("title contains query", "path contains query")
    other = found.where(worse).join(names.select("document_id", "stem"), "document_id").join(small(q), "query_id")
    other = other.where(~gr.is_similar(SIMILAR)("q", "stem")).select(*found.columns)
    return found.where(~worse).unionByName(other).unionByName(hit_near)


def by_tier(heading: Column, body: Column) -> Column:
    """struct(tier, reason) of a passage whose heading, or body, holds all parts of the query."""
    of = lambda tier, reason: F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))
    return F.when(heading, of(2, "heading holds all parts")).when(body, of(3, "text holds all parts"))


def passage_hits(passages: DataFrame, names: DataFrame, queries: DataFrame, limit: int = PASSAGE_LIMIT) -> DataFrame:
    """(query_id, document_id, passage_id, tier, score, reason) of passages whose heading or body holds all parts of the query,
    among the best `limit` passages of each query by BM25."""
    rows = passages.join(names.select("document_id", "name", "path"), "document_id")
    hits = all_else_any(bm25(rows, "passage_id", {"name": 1.0, "path": 1.0, "heading": 1.0, "body": 1.0}, queries))
    top = ranked(hits, [F.desc("bm25"), F.asc("passage_id")], limit, name="place").select("query_id", "passage_id", "bm25")
    parts = normalized_queries(queries).select("query_id", F.split("q", " ").alias("parts"))
    texts = rows.join(top.select("passage_id").distinct(), "passage_id", "left_semi").select("passage_id", "document_id", *(normalized_text(F.col(c)).alias(c) for c in ("heading", "body")))
    met = texts.join(top, "passage_id").join(asked(parts), "query_id")
    holds = lambda c: F.forall("parts", lambda p: F.contains(c, p))
    return met.withColumn("x", by_tier(holds("heading"), holds("body"))).where("x is not null").select("query_id", "document_id", "passage_id", "x.tier", (-F.col("bm25")).alias("score"), "x.reason")


def merged(hits: DataFrame) -> DataFrame:
    """Per query and document the best tier and the least score in it."""
    best = hits.groupBy("query_id", "document_id").agg(F.min(F.struct("tier", "score", "reason")).alias("x"), F.count(F.lit(1)).alias("n_evidence"))
    return best.select("query_id", "document_id", "x.tier", "x.score", "x.reason", "n_evidence")


def tiered(named: DataFrame, found: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The best k documents of metadata_hits() and passage_hits(); names is (document_id, name)."""
    best = merged(named.unionByName(found.drop("passage_id"))).join(names, "document_id")
    top = ranked(best, [F.asc("tier"), F.asc(F.round("score", 9)), F.asc(F.lower("name")), F.asc("document_id")], k)
    return top.select("query_id", "rank", "document_id", "name", "tier", F.round("score", 6).alias("score"), "reason", "n_evidence")


def search_tiered(docs: DataFrame, passages: DataFrame, queries: DataFrame, k: int = 10, fuzzy: bool = False) -> DataFrame:
    """(query_id, rank, document_id, name, tier, score, reason, n_evidence): the flagship search."""
    return tiered(metadata_hits(docs, queries, fuzzy), passage_hits(passages, docs, queries), docs.select("document_id", "name"), k)


def with_excerpts(results: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    return results.join(docs.select("document_id", "body"), "document_id").join(asked(queries), "query_id").withColumn("excerpt", tx.excerpt(F.col("body"), F.col("query"))).drop("body", "query")


# The older ranker. BM25 weights of its fields, field coverage weights, phrase gains, status penalties.
FIELDS = {"name": 12.0, "path": 8.0, "summary": 6.0, "keyword": 4.0, "evidence": 3.0, "body": 1.0}
COVERAGE = {"name": 5.0, "path": 3.5, "summary": 3.0, "keyword": 2.5, "evidence": 2.0, "body": 1.0}
PHRASES = {"name": 12.0, "path": 9.0, "summary": 5.0}
PENALTY = {"stale": 2.0, "pending_stable": 3.0, "pending_edit": 3.0, "failed": 4.0, "retry_wait": 4.0}


def search_documents(docs: DataFrame) -> DataFrame:
    """Rows for the older ranker: the fields as texts, and what its scores look at."""
    return docs.select(
        "document_id", "node_type", "status", "quality_flags", "modified_at", "source", "name", "path",
        F.col("title").alias("summary"), F.concat_ws(" ", "lang", "source").alias("keyword"), F.left("body", F.lit(240)).alias("evidence"), "body",
        (F.length("body") > 20_000).alias("truncated"),
    )


def candidates(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, document_id, bm25) of the rows that the weighted ranker looks at."""
    return ranked(hits, [F.desc("bm25"), F.asc("document_id")], min(500, max(5 * k, 50)), name="place").select("query_id", "document_id", "bm25")


def rescored(met: DataFrame, coverage: Column, by_field: dict[str, Column], k: int) -> DataFrame:
    """(query_id, rank, document_id, name, score, coverage) of candidates with the columns of search_documents(), bm25 and the query
    q in lower case; coverage is the share of the query's terms that a candidate has, in all and by field."""
    met = met.withColumn("coverage", coverage)
    score = F.col("bm25") + 4 * F.col("coverage") + F.when(F.col("coverage") == 1, 1.0).otherwise(0.0)
    for f, w in PHRASES.items():
        score = score + F.when(F.contains(F.lower(F.coalesce(f, F.lit(""))), F.col("q")), w).otherwise(0.0)
    for f, w in COVERAGE.items():
        score = score + w * by_field[f]
    score = score + F.when(F.col("node_type").isin("text", "leaf"), 5.0).otherwise(0.0)
    loss = F
    for s, p in PENALTY.items():
        loss = loss.when(F.col("status") == s, p)
    score = score - loss.otherwise(0.0) - F.least(F.lit(2.0), 0.5 * F.size("quality_flags")) - F.when(F.col("truncated"), 1.5).otherwise(0.0)
    final = ranked(met.withColumn("score", score), [F.desc(F.round("score", 9)), F.asc(F.lower("name")), F.asc("document_id")], k)
    return final.select("query_id", "rank", "document_id", "name", F.round("score", 6).alias("score"), F.round("coverage", 6).alias("coverage"))


def search_weighted(rows: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """(query_id, rank, document_id, name, score, coverage): candidates by weighted BM25 over the fields' term sets, a limit,
    then filters, then rescoring."""
    rows = rows.withColumns({f: F.coalesce(f, F.lit("")) for f in FIELDS})
    sets = rows.select("document_id", *(F.array_join(tx.analyzed_terms(F.col(f)), " ").alias(f) for f in FIELDS))
    q = queries.withColumn("terms", tx.analyzed_terms(F.col("query"))).where(F.size("terms") > 0)
    hits = bm25(sets, "document_id", FIELDS, q.withColumn("query", F.array_join("terms", " ")))
    met = rows.join(candidates(hits, k), "document_id").join(asked(q.select("query_id", F.lower("query").alias("q"), "terms")), "query_id")
    met = met.where(where) if where is not None else met
    met = met.select("*", *(tx.analyzed_terms(F.col(f)).alias(f"{f}_terms") for f in FIELDS))  # of the candidates alone
    union = F.array_distinct(F.flatten(F.array(*(f"{f}_terms" for f in FIELDS))))
    share = lambda terms: F.size(F.array_intersect("terms", terms)) / F.size("terms")
    return rescored(met, share(union), {f: share(f"{f}_terms") for f in FIELDS}, k)


def expanded(results: DataFrame, children: DataFrame) -> DataFrame:
    """Direct children of matched folders that aren't results themselves: (query_id, folder_id, document_id); children is
    (folder_id, document_id)."""
    found = results.select("query_id", F.col("document_id").alias("folder_id")).join(children, "folder_id")
    return found.join(results.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti")


def reranked(results: DataFrame, order: DataFrame) -> DataFrame:
    """Results in a requested order(query_id, position, document_id): exact name hits stay first, then requested ids that are
    results (first mention counts), then the rest as before."""
    first = order.groupBy("query_id", "document_id").agg(F.min("position").alias("position"))
    met = results.join(first, ["query_id", "document_id"], "left")
    by = Window.partitionBy("query_id").orderBy((F.col("tier") != 0).cast("int"), F.when(F.col("tier") == 0, F.col("rank")), F.col("position").asc_nulls_last(), "rank")
    return met.withColumn("new_rank", F.row_number().over(by)).drop("position")


def research(queries: DataFrame, search, k: int = 5) -> DataFrame:
    """(query_id, place, document_id, part, label) of a question's parts, each searched by itself: documents in the order in
    which they were first seen, labelled R1, R2, ... for citation. search takes (query_id, query) and gives (query_id, rank,
    document_id)."""
    parts = queries.select("query_id", F.posexplode(tx.sub_queries(F.col("query"))).alias("part", "query"))
    found = search(parts.select(F.concat_ws("#", "query_id", "part").alias("query_id"), "query"))
    seen = found.select(F.substring_index("query_id", "#", 1).cast("long").alias("query_id"), F.substring_index("query_id", "#", -1).cast("int").alias("part"), "rank", "document_id").where(F.col("rank") <= k)
    first = seen.groupBy("query_id", "document_id").agg(F.min(F.struct("part", "rank")).alias("x")).select("query_id", "document_id", "x.part", "x.rank")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "document_id")))
    return placed.select("query_id", "place", "document_id", "part", F.concat(F.lit("R"), "place").alias("label"))
