"""The registered queries of the search engine: each a Spark plan with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import digests as dg
from folioscope.operators import evidence as ev
from folioscope.operators import relations as rel
from folioscope.operators import search as se
from folioscope.operators.numbering import accumulated
from folioscope.sources import corpus
from folioscope.sources.corpus import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# SQL pieces that several oracles share.


def _norm(c: str) -> str:
    return rf"array_to_string(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+'), ' ')"


def _fts(c: str) -> str:
    return rf"regexp_extract_all(translate(lower({c}), '{tx.ACCENTED}', '{tx.PLAIN}'), '[\p{{L}}\p{{N}}]+')"


HEADING = "coalesce(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 200), '')"
DOCS = f"""docs as (
select doc_id as document_id, source || '/' || lang || '/doc-' || doc_id || '.txt' as path, 'doc-' || doc_id || '.txt' as name,
    'doc-' || doc_id as stem, '.txt' as extension, source || '/' || lang as parent, {HEADING} as title, text as body,
    sha256(text) as content_hash, n_chars as size_bytes, strftime(date '2024-01-01' + (doc_id % 365)::int, '%Y-%m-%d') as modified_at, lang, source,
    case when doc_id % 20 = 0 then 'metadata_only' when doc_id % 33 = 0 then 'failed' when doc_id % 47 = 0 then 'queued' else 'indexed' end as indexing_state,
    case when doc_id % 10 = 9 then 'low' when doc_id % 5 = 2 then 'partial' else 'readable' end as readability,
    case when doc_id % 25 = 1 then 'archive_member' else 'physical' end as source_kind,
    case when doc_id % 7 = 0 then ['low_text', 'scanned'] when doc_id % 11 = 0 then ['truncated'] else [] end as quality_flags,
    case when doc_id % 13 = 0 then 'stale' when doc_id % 17 = 0 then 'pending_stable' when doc_id % 19 = 0 then 'failed' else 'current' end as status,
    case when doc_id % 6 = 0 then 'foldernode' when doc_id % 6 = 1 then 'leaf' else 'text' end as node_type
from documents)"""


def asked_sql(words: int = 3) -> str:
    return f"""asked as (
select item_id as query_id, array_to_string(list_filter(w, lambda x: length(x) >= 5)[:{words}], ' ') as query
from (select item_id, list_aggregate_distinct as w from (select item_id, (select list(x order by p) from (select x, min(p) as p from (select unnest(s) as x, generate_subscripts(s, 1) as p) group by x)) as list_aggregate_distinct
    from (select item_id, string_split({_norm('text')}, ' ') as s from benchmark))) where query <> '')"""


SNAPSHOTS = """old_s as (
select document_id, path, source_kind, size_bytes as size, content_hash, document_id * 1000 as mtime from docs where document_id % 29 <> 3),
new_s as (
select case when document_id % 23 = 5 then 'moved/' || path else path end as path, source_kind,
    case when document_id % 19 = 6 then size_bytes + 1 else size_bytes end as size,
    case when document_id % 19 = 6 then sha256(content_hash || 'x') else content_hash end as content_hash,
    case when document_id % 37 = 7 then document_id * 1000 + 1 else document_id * 1000 end as mtime
from docs where document_id % 31 <> 4)"""
DIFF = """gone as (select o.*, row_number() over (partition by source_kind, content_hash order by path) as n from old_s o where path not in (select path from new_s)),
come as (select s.*, row_number() over (partition by source_kind, content_hash order by path) as n from new_s s where path not in (select path from old_s)),
changes as (
select case when g.path is null then 'added' when c.path is null then 'deleted' else 'moved' end as kind, g.document_id, coalesce(c.path, g.path) as path,
    case when c.path is not null then g.path end as previous_path
from gone g full join come c on g.source_kind = c.source_kind and g.content_hash = c.content_hash and g.n = c.n
union all
select 'modified', o.document_id, s.path, null from old_s o join new_s s using (path)
where o.size <> s.size or o.mtime <> s.mtime or o.content_hash <> s.content_hash)"""
ITEMS = """items as (
select 'task-' || (document_id % 12) as task_id, 'item-' || document_id as item_id, document_id, path,
    case when document_id % 27 = 0 then null else content_hash end as content_hash, 'slot-' || (document_id % 3) as slot_id,
    case when document_id % 2 = 0 then 'accepted' else 'pending' end as review_state
from old_s where document_id % 9 = 0)"""
NEW_DOCS = """now_docs as (select row_number() over (order by path) + 1000000 as document_id, path, content_hash from new_s)"""


def bm25_sql(rows: str, key: str, fields: dict[str, float], terms: str = "terms", out: str = "scored") -> str:
    """CTEs that end in `out`(query_id, key, n_terms, n_matched, bm25), from `rows` and terms(query_id, n_terms, term)."""
    tok = "\nunion all ".join(f"select {key}, unnest({_fts(f)}) as term, {w}::double as w from {rows}" for f, w in fields.items())
    return f"""tok as ({tok}),
dl as (select {key}, count(t.term)::double as dl from {rows} left join tok t using ({key}) group by {key}),
st as (select count(*)::double as n_rows, avg(dl) as avgdl from dl),
tf as (select {key}, term, sum(w) as f from tok where term in (select term from {terms}) group by all),
df as (select term, count(*)::double as n from tf group by term),
gain as (select {key}, term, (case when ln((n_rows - n + 0.5) / (n + 0.5)) > 0 then ln((n_rows - n + 0.5) / (n + 0.5)) else 1e-6 end)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) as g from tf join df using (term) join dl using ({key}), st),
{out} as (select query_id, {key}, any_value(n_terms) as n_terms, count(*) as n_matched, sum(g) as bm25 from gain join {terms} using (term) group by all)"""


def terms_sql(of: str = "asked", text: str = "query") -> str:
    return f"terms as (select query_id, len(t) as n_terms, unnest(t) as term from (select query_id, list_distinct({_fts(text)}) as t from {of}))"


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# Search

_PASSAGES = "pas as (select document_id as passage_id, document_id, name, path, title as heading, body from docs)"
_TIERED = f"""with {DOCS}, {asked_sql(2)}, {terms_sql()}, {_PASSAGES},
{bm25_sql('pas', 'passage_id', {'name': 1, 'path': 1, 'heading': 1, 'body': 1})},
best as (select *, max((n_matched = n_terms)::int) over (partition by query_id) as full_ from scored),
top as (select *, row_number() over (partition by query_id order by bm25 desc, passage_id) as place from best where full_ = 0 or n_matched = n_terms qualify place <= 250),
parts as (select query_id, string_split({_norm('query')}, ' ') as parts, {_norm('query')} as q from asked),
pas_n as (select passage_id, {_norm('heading')} as h, {_norm('body')} as b from pas where passage_id in (select passage_id from top)),
hits_p as (select query_id, passage_id as document_id, case when list_bool_and(list_transform(parts, lambda p: contains(h, p))) then 2 else 3 end as tier, -bm25 as score,
    case when list_bool_and(list_transform(parts, lambda p: contains(h, p))) then 'heading holds all parts' else 'text holds all parts' end as reason
    from top join parts using (query_id) join pas_n using (passage_id)
    where list_bool_and(list_transform(parts, lambda p: contains(h, p))) or list_bool_and(list_transform(parts, lambda p: contains(b, p)))),
names as (select document_id, {_norm('name')} as name, {_norm('stem')} as stem, {_norm('title')} as title, {_norm('path')} as path from docs),
hits_m as (select query_id, document_id,
    case when q = name or q = stem then 0 when instr(name, q) > 0 then 1 else 2 end as tier,
    case when q = name or q = stem then 0.0 when instr(target, q) = 1 then (length(target) - length(q)) / 1e4
        when instr(target, q) > 1 then 1 + (instr(target, q) - 1) / 1e3 + (length(target) - length(q)) / 1e4 when instr(title, q) > 0 then 0.0 else 0.2 end as score,
    case when q = name or q = stem then 'exact name' when instr(target, q) = 1 then 'name starts with query' when instr(target, q) > 1 then 'name contains query'
        when instr(title, q) > 0 then 'title contains query' else 'path contains query' end as reason
    from (select *, case when contains(stem, q) then stem else name end as target from names, parts) where q <> '' and (q = stem or instr(name, q) > 0 or instr(title, q) > 0 or instr(path, q) > 0)),
every as (select * from hits_p union all select * from hits_m),
one as (select query_id, document_id, min(struct_pack(tier := tier, score := score, reason := reason)) as x, count(*) as n_evidence from every group by all),
ranked as (select query_id, row_number() over (partition by query_id order by x.tier, round(x.score, 9), lower(name), document_id) as rank, document_id, name, x.tier as tier,
    round(x.score, 6) as score, x.reason as reason, n_evidence from one join docs using (document_id))
select query_id, rank::int as rank, document_id, name, tier, score, reason, n_evidence from ranked where rank <= 10"""


def _tiered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's queries of two words."""
    return corpus.queries(spark, sf_dir, 2)


@query(_TIERED.replace("list_bool_and(", "list_aggregate(").replace(", p)))", ", p)), 'bool_and')"))
def search_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return se.search_tiered(docs, corpus.passages(docs, whole=True), _tiered_queries(spark, sf_dir), k=10)


@query(f"""with {DOCS}, asked as (select document_id as query_id, case document_id % 80 when 0 then name when 20 then stem when 40 then left(stem, length(stem) - 1) else 'oc-' || document_id end as query from docs where document_id % 20 = 0),
parts as (select query_id, {_norm('query')} as q from asked), names as (select document_id, {_norm('name')} as name, {_norm('stem')} as stem from docs)
select query_id, document_id, case when q = name or q = stem then 0 else 1 end as tier,
    round(case when q = name or q = stem then 0.0 when instr(target, q) = 1 then (length(target) - length(q)) / 1e4 else 1 + (instr(target, q) - 1) / 1e3 + (length(target) - length(q)) / 1e4 end, 6) as score
from (select *, case when contains(stem, q) then stem else name end as target from names, parts) where q = stem or instr(name, q) > 0""")
def search_exact_prefix_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    i, s = F.col("document_id"), F.col("stem")
    text = F.when(i % 80 == 0, F.col("name")).when(i % 80 == 20, s).when(i % 80 == 40, F.left(s, F.length(s) - 1)).otherwise(F.concat(F.lit("oc-"), i))
    asked = docs.where(i % 20 == 0).select(i.alias("query_id"), text.alias("query"))
    return se.metadata_hits(docs, asked).where("tier < 2").select("query_id", "document_id", "tier", F.round("score", 6).alias("score"))


@query(f"""with {DOCS}, {asked_sql(3)}, {terms_sql()}, {bm25_sql('docs', 'document_id', {'title': 1, 'body': 1})},
r as (select query_id, row_number() over (partition by query_id order by bm25 desc, document_id) as rank, document_id, round(bm25, 6) as score from scored)
select query_id, rank::int as rank, document_id, score from r where rank <= 10""")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    hits = se.bm25(docs, "document_id", {"title": 1.0, "body": 1.0}, corpus.queries(spark, sf_dir))
    return se.ranked(hits, [F.desc("bm25"), F.asc("document_id")], 10).select("query_id", "rank", "document_id", F.round("bm25", 6).alias("score"))


#: Every ninth document is gone, the others have one more word.
_LATER = DOCS.replace("docs as (", "docs0 as (") + ", docs as (select * replace (body || ' lighthouse' as body) from docs0 where document_id % 9 <> 4)"


def _refreshed(index, docs: DataFrame) -> None:
    """All documents, of which every ninth is then removed and every other one edited; what a refresh takes is made of them."""
    i = F.col("document_id")
    index(docs, None)
    index(docs.where(i % 9 != 4).withColumn("body", F.concat("body", F.lit(" lighthouse"))), docs.where(i % 9 == 4))


_EDITED = "docs2 as (select document_id, title, body || ' lighthouse' as body from docs where document_id % 9 <> 4)"


@query(f"""with {DOCS}, {_EDITED}, {asked_sql(3)}, {terms_sql()}, {bm25_sql('docs2', 'document_id', {'title': 1, 'body': 1})},
r as (select query_id, row_number() over (partition by query_id order by bm25 desc, document_id) as rank, document_id, round(bm25, 6) as score from scored)
select query_id, rank::int as rank, document_id, score from r where rank <= 10""")
def search_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, of which every ninth is then removed and every other one edited; searched as it is."""
    import uuid

    from folioscope.operators.search_index import SearchIndex

    index = SearchIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "document_id", {"title": 1.0, "body": 1.0})
    _refreshed(index.refresh, corpus.documents(spark, sf_dir).select("document_id", "title", "body"))
    return se.ranked(index.search(corpus.queries(spark, sf_dir)), [F.desc("bm25"), F.asc("document_id")], 10).select("query_id", "rank", "document_id", F.round("bm25", 6).alias("score"))


@query(_TIERED.replace("list_bool_and(", "list_aggregate(").replace(", p)))", ", p)), 'bool_and')").replace(DOCS, _LATER))
def search_tiered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiered search in a stored index, after an edit and a removal."""
    import uuid

    from folioscope.operators.search_index import TieredIndex

    index = TieredIndex(spark, f"{shared_dir(spark)}/tiers-{uuid.uuid4().hex}")
    _refreshed(lambda docs, removed: index.refresh(docs, corpus.passages(docs, whole=True), removed), corpus.documents(spark, sf_dir))
    return index.search(_tiered_queries(spark, sf_dir), k=10)


@query(f"""with {DOCS}, asked as (select 1 as query_id, 'nation ounded the' as query), {terms_sql()}, {bm25_sql('docs', 'document_id', {'body': 1})}
select document_id, round(bm25, 6) as score, n_matched from scored order by bm25 desc, document_id limit 20""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    asked = spark.createDataFrame([(1, "nation ounded the")], "query_id long, query string")
    return se.bm25(docs, "document_id", {"body": 1.0}, asked).orderBy(F.desc("bm25"), "document_id").limit(20).select("document_id", F.round("bm25", 6).alias("score"), "n_matched")


@query(f"""with {DOCS}, {asked_sql(3)}, {terms_sql()}, {bm25_sql('docs', 'document_id', {'name': 12, 'path': 8, 'title': 6, 'body': 1})},
r as (select query_id, row_number() over (partition by query_id order by bm25 desc, document_id) as rank, document_id, round(bm25, 6) as score from scored)
select query_id, rank::int as rank, document_id, score from r where rank <= 5""")
def bm25_weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    hits = se.bm25(docs, "document_id", {"name": 12.0, "path": 8.0, "title": 6.0, "body": 1.0}, corpus.queries(spark, sf_dir))
    return se.ranked(hits, [F.desc("bm25"), F.asc("document_id")], 5).select("query_id", "rank", "document_id", F.round("bm25", 6).alias("score"))


@query(f"""with {DOCS}, {asked_sql(3)}, {terms_sql()}, {bm25_sql('docs', 'document_id', {'body': 1})},
f as (select *, max((n_matched = n_terms)::int) over (partition by query_id) as full_ from scored)
select query_id, document_id, n_matched, (full_ = 1) as all_terms from f where full_ = 0 or n_matched = n_terms""")
def search_and_then_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = se.bm25(corpus.documents(spark, sf_dir), "document_id", {"body": 1.0}, corpus.queries(spark, sf_dir))
    return se.all_else_any(hits).select("query_id", "document_id", "n_matched", (F.col("n_matched") == F.col("n_terms")).alias("all_terms"))


_AN = r"list_distinct(list_transform(regexp_extract_all({c}, '[A-Za-z0-9][A-Za-z0-9_.\-]*'), lambda x: lower(x)))"


def _weighted_sql(where: str = "true", k: int = 10) -> str:
    fields = {"name": "name", "path": "path", "summary": "title", "keyword": "concat_ws(' ', lang, source)", "evidence": "left(body, 240)", "body": "body"}
    sets = ", ".join(f"{_AN.format(c=c)} as {f}_t" for f, c in fields.items())
    texts = ", ".join(f"array_to_string({f}_t, ' ') as {f}" for f in fields)
    cover = " + ".join(f"{w} * len(list_intersect(terms, {f}_t)) / len(terms)" for f, w in se.COVERAGE.items())
    phrase = " + ".join(f"case when contains(lower({c}), q) then {w} else 0 end" for c, w in (("d.name", 12), ("d.path", 9), ("d.title", 5)))
    return f"""with {DOCS}, {asked_sql(3)}, sets as (select *, {sets} from docs), flat as (select document_id, {texts} from sets),
qs as (select query_id, lower(query) as q, {_AN.format(c='query')} as terms from asked), asked2 as (select query_id, array_to_string(terms, ' ') as query from qs where len(terms) > 0),
{terms_sql('asked2')}, {bm25_sql('flat', 'document_id', se.FIELDS)},
top as (select *, row_number() over (partition by query_id order by bm25 desc, document_id) as place from scored qualify place <= 50),
met as (select t.query_id, d.document_id, d.name, bm25, len(list_intersect(terms, list_concat(name_t, path_t, summary_t, keyword_t, evidence_t, body_t))) / len(terms) as coverage,
    {cover} + {phrase} + case when node_type in ('text', 'leaf') then 5 else 0 end
    - case status when 'stale' then 2 when 'pending_stable' then 3 when 'failed' then 4 else 0 end - least(2, 0.5 * len(quality_flags)) - case when length(body) > 20000 then 1.5 else 0 end as extra
    from top t join sets d using (document_id) join qs using (query_id) where {where}),
s as (select *, bm25 + extra + 4 * coverage + case when coverage = 1 then 1 else 0 end as score from met),
r as (select query_id, row_number() over (partition by query_id order by round(score, 9) desc, lower(name), document_id) as rank, document_id, name, round(score, 6) as score, round(coverage, 6) as coverage from s)
select query_id, rank::int as rank, document_id, name, score, coverage from r where rank <= {k}"""


@query(_weighted_sql())
def search_coverage_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_weighted(se.search_documents(corpus.documents(spark, sf_dir)), corpus.queries(spark, sf_dir))


@query(_weighted_sql("node_type in ('text', 'leaf') and (path = 'src1' or starts_with(path, 'src1/') or status in ('current', 'stale')) and modified_at >= '2024-02-01'"))
def search_v1_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = rel.post_filter(types=["text", "leaf"], after="2024-02-01") & (tx.is_below(F.col("path"), "src1") | F.col("status").isin("current", "stale"))
    return se.search_weighted(se.search_documents(corpus.documents(spark, sf_dir)), corpus.queries(spark, sf_dir), where=where)


@query(_weighted_sql("node_type in ('text', 'leaf') and modified_at >= '2024-02-01'").replace(DOCS, _LATER))
def search_weighted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older ranker in a stored index, after an edit and a removal, with filters."""
    import uuid

    from folioscope.operators.search_index import search_weighted, weighted_index

    index = weighted_index(spark, f"{shared_dir(spark)}/weights-{uuid.uuid4().hex}")
    _refreshed(lambda docs, removed: index.refresh(se.search_documents(docs), removed), corpus.documents(spark, sf_dir))
    return search_weighted(index, corpus.queries(spark, sf_dir), where=rel.post_filter(types=["text", "leaf"], after="2024-02-01"))


@query(f"""with {DOCS} select document_id, path from docs where (lower(path) = 'src1' or starts_with(lower(path), 'src1/')) and extension in ('.txt', '.md')
and readability in ('readable', 'partial') and indexing_state in ('indexed') and source_kind in ('physical') and modified_at >= '2024-01-15' and modified_at <= '2024-12-01'""")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.filtered(corpus.documents(spark, sf_dir), "SRC1/", [".txt", ".md"], ["readable", "partial"], ["indexed"], ["physical"], "2024-01-15", "2024-12-01")
    return docs.select("document_id", "path")


@query(f"""with {DOCS}, {SNAPSHOTS}, {ITEMS} select document_id, name from docs where document_id in (select document_id from items where task_id = 'task-3') and readability <> 'low'""")
def search_task_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = corpus.task_items(spark, sf_dir).where("task_id = 'task-3'")
    return rel.filtered(corpus.documents(spark, sf_dir), readability=["readable", "partial"], scope=scope).select("document_id", "name")


@query(f"""with {DOCS} select document_id, path from docs where (contains(lower(name), 'doc') or contains(lower(title), 'doc') or contains(lower(path), 'doc'))
and (contains(lower(name), 'src1') or contains(lower(title), 'src1') or contains(lower(path), 'src1')) order by path limit 2000""")
def metadata_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.prefiltered(corpus.documents(spark, sf_dir), "doc src1").select("document_id", "path")


@query(f"""with {DOCS}, r as (select document_id, row_number() over (order by size_bytes desc, document_id) as rank from docs qualify rank <= 30), kids as (select (document_id // 10) * 10 as folder_id, document_id from docs)
select distinct 1::bigint as query_id, k.folder_id, k.document_id from r join kids k on r.document_id = k.folder_id where k.document_id not in (select document_id from r)""")
def folder_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    top = docs.orderBy(F.desc("size_bytes"), "document_id").limit(30).select(F.lit(1).cast("long").alias("query_id"), "document_id")
    kids = docs.select((F.floor(F.col("document_id") / 10) * 10).alias("folder_id"), "document_id")
    return se.expanded(top, kids)


# Text functions


@query(f"""select doc_id, len(list_distinct(t)) as n_distinct, len(t) as n_terms, md5(array_to_string(list_sort(list_distinct(t)), ' ')) as digest
from (select doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+') as t from documents)""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(tx.folded(F.col("text")), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return d.select("doc_id", F.size(tx.search_terms(F.col("text"))).alias("n_distinct"), F.size(words).alias("n_terms"), F.md5(F.array_join(tx.search_terms(F.col("text")), " ").cast("binary")).alias("digest"))


@query(f"select term, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest({_fts('text')}) as term from documents) group by term order by n desc, term limit 100")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = corpus.table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.fts_tokens(F.col("text"))).alias("term"))
    per_doc = said.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n"), "term").limit(100)


@query("""select gram, count(*) as n from (select unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))) as gram from
(select unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) as w from benchmark) where length(w) >= 3) group by gram""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("w")).where("length(w) >= 3")
    return words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id, {HEADING} as heading from documents")
def heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.heading(F.col("text")).alias("heading"))


@query(r"""with d as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as flat, replace(lower(text), 'ß', 'ss') as norm from documents),
q as (select doc_id, flat, list_filter(list_transform(['nation', 'the', 'und'], lambda t: instr(lower(flat), t)), lambda p: p > 0) as hits from d),
s as (select doc_id, flat, greatest(1, least(coalesce(list_min(hits), 1) - 80, length(flat) - 239)) as start from q)
select doc_id, substring(flat, start, 240) as excerpt from s""")
def excerpt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("nation", "the", "und")))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.evidence_excerpt(F.col("text"), terms).alias("excerpt"))


@query(r"""with p as (select item_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[,;:.!?，；：。！？、\n]+|以及|并且|同时'), lambda x: trim(x)), lambda x: length(x) >= 2)) as part,
generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '[,;:.!?，；：。！？、\n]+|以及|并且|同时'), lambda x: trim(x)), lambda x: length(x) >= 2), 1) as pos_ from benchmark),
f as (select item_id, part, min(pos_) as pos_ from p group by all), r as (select item_id, part, row_number() over (partition by item_id order by pos_) as place from f)
select item_id, place::int as place, part from r where place <= 4""")
def sub_query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.sub_queries(F.col("text"))).alias("at", "part"))
    return parts.select("item_id", (F.col("at") + 1).alias("place"), "part")


@query(r"""with t as (select doc_id, 'As [S1] and [S' || (doc_id % 4) || '] say, [' || 'X' || doc_id || '] too.' as answer from documents)
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '\[([A-Za-z]+\d+)\]', 1))), ',') as markers,
case when doc_id % 4 in (1, 2) then replace(answer, '[X' || doc_id || ']', '') else replace(replace(answer, '[X' || doc_id || ']', ''), '[S' || (doc_id % 4) || ']', '') end as grounded from t""")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    answer = F.concat(F.lit("As [S1] and [S"), i % 4, F.lit("] say, [X"), i, F.lit("] too."))
    rows = corpus.table(spark, sf_dir, "documents").select("doc_id", answer.alias("answer"))
    known = F.array(F.lit("S1"), F.lit("S2"))
    return rows.select("doc_id", F.array_join(F.array_sort(tx.citation_markers(F.col("answer"))), ",").alias("markers"), tx.without_unknown_markers(F.col("answer"), known).alias("grounded"))


# Health, folders, counts


@query(f"""with {DOCS} select count(*) as total, count(*) filter (indexing_state = 'indexed' and readability = 'readable') as readable,
count(*) filter (indexing_state = 'indexed' and readability = 'partial') as partial, count(*) filter (indexing_state = 'indexed' and readability = 'low') as low,
count(*) filter (indexing_state = 'metadata_only') as metadata_only, count(*) filter (indexing_state = 'failed') as failed, count(*) filter (indexing_state = 'queued') as queued, max(modified_at) as last_modified from docs""")
def workspace_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.health(corpus.documents(spark, sf_dir))


@query(f"with {DOCS} select readability, count(*) as n from docs where indexing_state = 'indexed' group by readability")
def readability_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.histogram(corpus.documents(spark, sf_dir).where("indexing_state = 'indexed'"), "readability")


@query(f"with {DOCS} select node_type, status, count(*) as n from docs group by all")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.histogram(corpus.documents(spark, sf_dir), "node_type", "status")


@query("""select conv_id as document_id, round(avg(case when length(text) > 200 then 0.9 else 0.5 end), 4) as score,
case when avg((length(text) > 200)::int) >= 0.7 then trim(regexp_replace(min_by(text, turn), '\\s+', ' ', 'g')) end as overview from conversations group by conv_id""")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_id"), F.when(F.length("text") > 200, 0.9).otherwise(0.5).alias("quality_score"), "text")
    return rel.document_scores(pages)


@query(f"""with {DOCS}, f as (select parent as folder, quality_flags, size_bytes, status from docs),
g as (select folder, array_to_string(list_sort(list_distinct(flatten(list(quality_flags)))), ',') as flags from f group by folder)
select folder, count(*) as files, sum(size_bytes)::bigint as bytes, count(*) filter (status = 'failed') as failed, count(*) filter (starts_with(status, 'pending')) as pending, any_value(g.flags) as flags from f join g using (folder) group by folder""")
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.folder_rollup(corpus.documents(spark, sf_dir))


def _set_digest(line: str, n: str = "count(*)") -> str:
    """The digest of a set of lines: the sums of nine numbers of 28 bits of each line's own digest."""
    parts = ", ".join(f"sum(('0x' || substr(sha256({line}), {1 + 7 * i}, 7))::bigint)" for i in range(9))
    return f"sha256(concat_ws(',', count(*), {parts}))"


@query(f"with {DOCS} select parent as folder, {_set_digest("path || '|' || content_hash || '|' || case when status = 'current' then 'available' else 'other' end")} as digest from docs group by parent")
def folder_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.folder_digest(corpus.documents(spark, sf_dir))


_LINES = "a as (select unnest(['.', source, source || '/' || lang]) as folder, path, document_id || '|' || content_hash || '|' || path as line from docs)"


@query(f"with {DOCS}, {_LINES} select folder, count(*) as files, {_set_digest('line')} as fingerprint from a group by folder")
def folder_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.folder_fingerprint(corpus.documents(spark, sf_dir))


@query(f"""with {DOCS.replace("docs as (", "docs0 as (")}, docs as (select * replace (case when document_id % 5 = 1 then sha256(content_hash) else content_hash end as content_hash) from docs0 where document_id % 7 <> 2),
{_LINES} select folder, count(*) as files, {_set_digest('line')} as fingerprint from a group by folder""")
def folder_fingerprint_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sums of all folders, updated by the files that are gone or changed alone."""
    docs, i = corpus.documents(spark, sf_dir), F.col("document_id")
    held = corpus.durable(dg.sums(rel.fingerprint_lines(docs), "folder"))
    edited = docs.where((i % 5 == 1) & (i % 7 != 2)).withColumn("content_hash", F.sha2("content_hash", 256))
    gone = rel.fingerprint_lines(docs.where((i % 7 == 2) | (i % 5 == 1)))
    now = dg.updated(held, "folder", gone, rel.fingerprint_lines(edited))
    return dg.digests(now).select("folder", F.col("n").alias("files"), F.col("digest").alias("fingerprint"))


@query(f"""with {DOCS}, one as (select parent as folder, source, {_set_digest("path || '|' || content_hash")} as digest from docs group by parent, source),
two as (select source as folder, {_set_digest("folder || '|' || digest")} as digest from one group by source)
select folder, digest from one union all select folder, digest from two union all select '.', {_set_digest("folder || '|' || digest")} from two""")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.tree_digest(corpus.documents(spark, sf_dir))


@query(f"with {DOCS} select distinct folder, case when folder = '.' then 0 else len(string_split(folder, '/')) end as depth from (select unnest(['.', source, source || '/' || lang]) as folder from docs)")
def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.folder_paths(corpus.documents(spark, sf_dir))


@query(f"""with {DOCS}, p as (select distinct unnest([source, source || '/' || lang, path]) as path from docs)
select path, repeat('  ', len(string_split(path, '/')) - 1) || '- ' || regexp_extract(path, '[^/]*$') as line from p""")
def tree_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.tree_lines(corpus.documents(spark, sf_dir))


@query("""with d as (select case doc_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.txt' else '.xyz' end as extension, n_chars from documents), g as (select extension, count(*) as files, sum(n_chars)::bigint as bytes from d group by extension)
select extension, files, bytes, extension in ('.pdf', '.docx', '.txt') as supported, round(files * case extension when '.pdf' then 0.8 when '.docx' then 0.3 when '.txt' then 0.02 else 0.05 end::double, 6) as p50_s,
round(files * case extension when '.pdf' then 4.0 when '.docx' then 0.9 when '.txt' then 0.06 else 0.2 end::double, 6) as p95_s, ceil(bytes * 0.35::double)::bigint as required_bytes from g""")
def repository_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    docs = corpus.table(spark, sf_dir, "documents").select(F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".docx").when(i % 4 == 2, ".txt").otherwise(".xyz").alias("extension"), F.col("n_chars").alias("size_bytes"))
    return rel.estimate(docs, {".pdf": (0.8, 4.0), ".docx": (0.3, 0.9), ".txt": (0.02, 0.06)})


STOP = ("the", "and", "les", "der", "die", "que", "des", "und", "con")


@query(f"""with w as (select doc_id, unnest(t) as word, generate_subscripts(t, 1) as pos_ from (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as t from documents)),
c as (select doc_id, word, count(*) as n, min(pos_) as first_at from w where length(word) >= 3 and word not in {STOP} group by all),
r as (select doc_id, word, n, row_number() over (partition by doc_id order by n desc, first_at) as rank from c) select doc_id, rank::int as rank, word, n from r where rank <= 8""")
def keyword_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_keywords(corpus.table(spark, sf_dir, "documents"), "doc_id", "text", STOP)


@query("""with m as (select 'by_type' as counter, event_type as key, 1 as v from events union all select 'by_user', 'u' || (user_id % 7), (event_id % 3)::int from events)
select counter, key, sum(v)::bigint as total from m group by all""")
def usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    rows = e.select(F.create_map("event_type", F.lit(1)).alias("by_type"), F.create_map(F.concat(F.lit("u"), F.col("user_id") % 7), (F.col("event_id") % 3).cast("int")).alias("by_user"))
    return rel.merged_counters(rows, "by_type", "by_user")


# Snapshots and tasks


@query(f"with {DOCS}, {SNAPSHOTS}, {DIFF} select kind, document_id, path, previous_path from changes")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.diff(*corpus.snapshots(spark, sf_dir))


@query(f"with {DOCS}, {SNAPSHOTS}, {DIFF} select kind, count(*) as n from changes group by kind")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.histogram(rel.diff(*corpus.snapshots(spark, sf_dir)), "kind")


@query(f"with {DOCS}, {SNAPSHOTS}, {DIFF} select previous_path, path from changes where kind = 'moved'")
def moved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.diff(*corpus.snapshots(spark, sf_dir)).where("kind = 'moved'").select("previous_path", "path")


@query(f"""with {DOCS}, {SNAPSHOTS}, g as (select path, size, content_hash, count(*) over (partition by size, content_hash) as n from old_s where path not in (select path from new_s)),
c as (select path, size, content_hash, count(*) over (partition by size, content_hash) as n from new_s where path not in (select path from old_s))
select g.path as old_path, c.path from g join c using (size, content_hash) where g.n = 1 and c.n = 1""")
def moved_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.unique_moves(*corpus.snapshots(spark, sf_dir))


@query(f"with {DOCS}, {SNAPSHOTS} select path from old_s except select path from new_s")
def removed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = corpus.snapshots(spark, sf_dir)
    return old.join(new, "path", "left_anti").select("path")


@query("""select event_id, event_type, user_id from events where ts > timestamp '2024-01-20 00:00:00' and event_id % 5 <> 0 order by ts desc, event_id desc limit 1000""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events after a time without those acknowledged (every fifth)."""
    from folioscope.streaming.changes import events_since

    e = corpus.table(spark, sf_dir, "events")
    return events_since(e, "2024-01-20 00:00:00", e.where("event_id % 5 = 0")).select("event_id", "event_type", "user_id")


@query(f"""with {DOCS}, {SNAPSHOTS}, {DIFF}, {ITEMS}, m as (select distinct kind, c.path, task_id from changes c join items i on c.document_id = i.document_id or lower(i.path) = lower(c.path) or lower(i.path) = lower(c.previous_path))
select kind, path, string_agg(task_id, ',' order by task_id) as tasks from m group by kind, path""")
def affected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.affected_tasks(rel.diff(*corpus.snapshots(spark, sf_dir)), corpus.task_items(spark, sf_dir))


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the second snapshot that have new ids, except every third of the old ones."""
    _, new = corpus.snapshots(spark, sf_dir)
    old = F.regexp_extract("path", r"doc-(\d+)", 1).cast("long")
    return new.select(F.when(old % 3 == 0, old).otherwise(F.xxhash64("path")).alias("document_id"), "path", "content_hash")


_MATCH = f"""{DOCS}, {SNAPSHOTS}, {ITEMS}, up as (select path, content_hash, case when regexp_extract(path, 'doc-(\\d+)', 1)::bigint % 3 = 0 then regexp_extract(path, 'doc-(\\d+)', 1)::bigint end as kept_id, count(*) over (partition by path) as np, count(*) over (partition by content_hash) as nh from new_s),
m as (select i.*, a.path as a_path, a.content_hash as a_hash, b.path as b_path, b.content_hash as b_hash, c.path as c_path, c.content_hash as c_hash from items i left join up a on a.kept_id = i.document_id left join (select * from up where np = 1) b on i.path = b.path left join (select * from up where nh = 1) c on i.content_hash = c.content_hash),
f as (select task_id, item_id, review_state, content_hash, case when a_path is not null then 'id' when b_path is not null then 'path' when c_path is not null then 'hash' else 'none' end as found_by, coalesce(a_hash, b_hash, c_hash) as h from m),
g as (select *, case when found_by = 'none' then 'missing' when content_hash is null then 'unverified' when h = content_hash then 'current' else 'changed' end as freshness from f)"""


@query(f"""with {_MATCH} select task_id, item_id, found_by, freshness, case when freshness in ('missing', 'changed') then 'pending' else review_state end as review_state,
case when freshness in ('missing', 'changed') then 'source_unconfirmed' else 'resolved' end as source_status from g""")
def task_reconfirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.reconfirmed(corpus.task_items(spark, sf_dir), _now(spark, sf_dir)).drop("found_id")


@query(f"""with {_MATCH} select task_id, count(*) as items, count(*) filter (freshness in ('missing', 'changed') or review_state = 'pending') as pending,
count(*) filter (freshness in ('missing', 'changed')) as unresolved, count(*) filter (freshness <> 'current') as stale from g group by task_id""")
def task_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.task_summary(rel.reconfirmed(corpus.task_items(spark, sf_dir), _now(spark, sf_dir)))


@query(f"""with {DOCS}, {SNAPSHOTS}, {ITEMS}, both_ as (select * from items union all select task_id, item_id, document_id, path, content_hash, 'slot-9', review_state from items where document_id % 4 = 0)
select task_id, 'duplicate_item' as code, item_id as key from both_ group by all having count(*) > 1 union all select task_id, 'unknown_slot', item_id from both_ where slot_id = 'slot-9'""")
def task_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus.task_items(spark, sf_dir)
    both = items.unionByName(items.where("document_id % 4 = 0").withColumn("slot_id", F.lit("slot-9")))
    slots = items.select("task_id").distinct().crossJoin(spark.createDataFrame([("slot-0",), ("slot-1",), ("slot-2",)], "slot_id string"))
    return rel.task_faults(both, slots)


@query("""with c as (select doc_id as candidate_id, n_chars as rank, 'slot-' || (doc_id % 5) as slot_id from documents union all select doc_id, n_chars + 1, 'slot-' || (doc_id % 2) from documents),
r as (select *, row_number() over (partition by candidate_id order by rank, slot_id) as n from c where slot_id in ('slot-0', 'slot-1', 'slot-2')) select slot_id, candidate_id, rank from r where n = 1""")
def proposal_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = corpus.table(spark, sf_dir, "documents"), F.col("doc_id")
    cands = d.select(i.alias("candidate_id"), F.col("n_chars").alias("rank"), F.concat(F.lit("slot-"), i % 5).alias("slot_id")).union(d.select(i, F.col("n_chars") + 1, F.concat(F.lit("slot-"), i % 2)))
    return rel.proposals(cands, spark.createDataFrame([("slot-0",), ("slot-1",), ("slot-2",)], "slot_id string"))


@query("""with s as (select user_id::varchar as path, row_number() over (partition by user_id order by ts, event_id) as generation, epoch(ts)::bigint as seen, epoch(ts)::bigint - 300 as mtime, (event_id % 4 = 0)::int::varchar as content_hash, event_id % 23 = 0 as locked from events),
c as (select *, case when lag(content_hash) over w = content_hash then 0 else 1 end as ch from s window w as (partition by path order by generation)),
r as (select *, sum(ch) over (partition by path order by generation) as run from c),
f as (select *, count(*) over (partition by path, run) - 1 as unchanged, min(case when locked then seen end) over (partition by path) as locked_since, row_number() over (partition by path order by generation desc) as last_ from r)
select path, unchanged, case when locked then case when seen - locked_since >= 86400 then 'stale' else 'pending_edit' end when unchanged >= 2 and seen - mtime >= 120 then 'queued' else 'pending_stable' end as state from f where last_ = 1""")
def stability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    scans = e.select(F.col("user_id").cast("string").alias("path"), n.alias("generation"), at.alias("at"), (at - 300).alias("mtime"), (F.col("event_id") % 4 == 0).cast("int").cast("string").alias("content_hash"), (F.col("event_id") % 23 == 0).alias("locked"))
    return rel.stability(scans)


# Evaluation


@query(f"""with {DOCS}, {asked_sql(3)}, {terms_sql()}, {bm25_sql('docs', 'document_id', {'title': 1, 'body': 1})},
r as (select query_id, row_number() over (partition by query_id order by bm25 desc, document_id) as rank, document_id from scored qualify rank <= 10),
j as (select query_id, min(rank) as rank from r join docs using (document_id) join benchmark b on b.item_id = query_id where contains(body, b.text) group by query_id),
s as (select rank from benchmark left join j on item_id = query_id)
select count(*) as n, round(avg(coalesce(rank <= 1, false)::int), 6) as hit_at_1, round(avg(coalesce(rank <= 5, false)::int), 6) as hit_at_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr from s""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks by its first long words; a document that holds the whole item is right."""
    docs = corpus.documents(spark, sf_dir)
    items = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    hits = se.bm25(docs, "document_id", {"title": 1.0, "body": 1.0}, corpus.queries(spark, sf_dir))
    top = se.ranked(hits, [F.desc("bm25"), F.asc("document_id")], 10).select("query_id", "document_id", "rank")
    judged = top.join(items, "query_id").join(docs.select("document_id", "body"), "document_id").where(F.contains("body", F.col("item")))
    found = judged.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return rel.retrieval_metrics(items.join(found, "query_id", "left").select("query_id", "rank"))


@query(f"""with {DOCS}, q as (select document_id as query_id, case when document_id % 40 = 0 then name else 'doc ' || document_id || ' txt' end as query from docs where document_id % 20 = 0),
m as (select query_id, document_id, path, len(list_intersect(list_distinct(string_split({_norm('name')}, ' ')), list_distinct(string_split({_norm('query')}, ' ')))) + case when contains(lower(name), lower(query)) then 100 else 0 end as score from docs, q),
r as (select query_id, document_id, score, row_number() over (partition by query_id order by score desc, path) as rank from m) select query_id, document_id, score::int as score, rank::int as rank from r where rank <= 20""")
def filename_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = corpus.documents(spark, sf_dir), F.col("document_id")
    asked = docs.where(i % 20 == 0).select(i.alias("query_id"), F.when(i % 40 == 0, F.col("name")).otherwise(F.concat(F.lit("doc "), i, F.lit(" txt"))).alias("query"))
    return rel.filename_best(docs, asked, 20)


_JUDGED = f"""{DOCS}, {asked_sql(3)}, {terms_sql()}, {bm25_sql('docs', 'document_id', {'title': 1, 'body': 1})},
r as (select query_id, row_number() over (partition by query_id order by bm25 desc, document_id) as rank, document_id from scored qualify rank <= 10),
right_ as (select query_id, document_id from scored join docs using (document_id) join benchmark b on b.item_id = query_id where n_matched = n_terms and contains(body, b.text)),
nm as (select query_id, document_id, len(list_intersect(list_distinct(string_split({_norm('name')}, ' ')), list_distinct(string_split({_norm('query')}, ' ')))) + case when contains(lower(name), lower(query)) then 100 else 0 end as score, path from docs, asked),
no_ as (select query_id, document_id, row_number() over (partition by query_id order by score desc, path) as place from nm),
tasks as (select query_id as task_id, min(rank) as search_rank, min(place) as baseline_rank, bool_or(rank is not null and (status <> 'stale' or document_id % 13 = 0)) as explained
    from right_ join no_ using (query_id, document_id) left join r using (query_id, document_id) join docs using (document_id) group by query_id),
ev as (select *, coalesce(search_rank <= 5, false) as top5_hit, coalesce(1.0::double / search_rank, 0) as reciprocal_rank, coalesce(search_rank, (select count(*) from docs) + 1) as search_steps from tasks)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks by its first long words; documents that hold these and the whole item are right. A result is explained
    if it has a path, an excerpt, and, where its index entry is stale, the flag that says so."""
    docs = corpus.documents(spark, sf_dir)
    items = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    asked = corpus.queries(spark, sf_dir)
    hits = corpus.durable(se.bm25(docs, "document_id", {"title": 1.0, "body": 1.0}, asked))
    full = hits.where("n_matched = n_terms").select("query_id", "document_id").join(items, "query_id")
    right = corpus.durable(full.join(docs.select("document_id", "body", "path", "status"), "document_id").where(F.contains("body", F.col("item"))).withColumn(
        "whole", (F.col("path") != "") & (tx.excerpt(F.col("body"), F.col("item")) != "") & ((F.col("status") != "stale") | (F.col("document_id") % 13 == 0))).select("query_id", "document_id", "whole"))
    top = se.ranked(hits, [F.desc("bm25"), F.asc("document_id")], 10).select("query_id", "document_id", F.col("rank").alias("search_rank"))
    places = rel.filename_ranks(docs, asked, right)
    met = right.join(places, ["query_id", "document_id"]).join(top, ["query_id", "document_id"], "left")
    tasks = met.groupBy(F.col("query_id").alias("task_id")).agg(F.min("search_rank").alias("search_rank"), F.min("rank").alias("baseline_rank"), F.max(F.col("search_rank").isNotNull() & F.col("whole")).alias("explained"))
    return rel.evaluated(tasks.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n_documents")))))


@query(f"""with {_JUDGED} select task_id, search_rank::int as search_rank, baseline_rank, explained, top5_hit, round(reciprocal_rank, 6) as reciprocal_rank, search_steps, baseline_rank - search_steps as steps_saved,
case when not top5_hit then 'relevant_document_not_in_top5' when not explained then 'explanation_contract_failed' end as failure from ev""")
def search_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(f"""with {_JUDGED}, g as (select count(*) as tasks, avg(top5_hit::int) as top5, avg(reciprocal_rank) as mrr, count(*) filter (not top5_hit) as failures, 1 - sum(search_steps)::double / greatest(1, sum(baseline_rank)) as reduction, count(*) filter (not explained) as unexplained from ev)
select tasks, round(top5, 6) as top5, round(mrr, 6) as mrr, failures, round(reduction, 6) as reduction, unexplained, top5 >= 0.8 and mrr >= 0.65 and reduction >= 0.3 and unexplained = 0 as meets from g""")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.search_gate(_evaluated(spark, sf_dir))


@query("select sum(doc_id % 5 + 1)::bigint as search_steps, sum(doc_id % 40 + 1)::bigint as baseline_steps, round(1 - sum(doc_id % 5 + 1)::double / sum(doc_id % 40 + 1), 6) as reduction from documents")
def step_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return rel.step_reduction(corpus.table(spark, sf_dir, "documents").select((i % 5 + 1).alias("search_steps"), (i % 40 + 1).alias("baseline_steps")))


_STUDY = "s as (select event_type as condition, value as duration_ms, event_id % 6 <> 0 as success from events)"


@query(f"""with {_STUDY}, o as (select condition, duration_ms, row_number() over (partition by condition order by duration_ms) as rn, count(*) over (partition by condition) as n from s where success),
p as (select condition, min(duration_ms) as p95 from o where rn = round_even((n - 1) * 0.95::double, 0) + 1 group by condition)
select s.condition, count(*) as attempts, count(*) filter (success) as successes, round(avg(success::int), 6) as rate, round(median(duration_ms) filter (success), 6) as p50, round(any_value(p95), 6) as p95 from s join p using (condition) group by s.condition""")
def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.study_summary(corpus.table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("value").alias("duration_ms"), (F.col("event_id") % 6 != 0).alias("success")))


@query("""with o as (select user_id % 10 as g, value, row_number() over (partition by user_id % 10 order by value) as rn, count(*) over (partition by user_id % 10) as n from events)
select g, round(min(value) filter (rn = round_even((n - 1) * 0.95::double, 0) + 1), 6) as nearest, round(min(value) filter (rn = greatest(1, ceil(n * 0.95::double))), 6) as ceiling from o group by g""")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), "value")
    at = rel.values_at(rows, "g", "value", {"nearest": lambda n: rel.nearest_rank(n, 0.95), "ceiling": lambda n: rel.ceiling_rank(n, 0.95)})
    return at.select("g", F.round("nearest", 6).alias("nearest"), F.round("ceiling", 6).alias("ceiling"))


@query("""with m as (select c_custkey as participant_id, item_id as task_id, sha256(c_custkey || ':' || item_id) as h from customer, benchmark),
r as (select *, row_number() over (partition by participant_id order by h, task_id) as place from m)
select participant_id, task_id, place::int as place, case when (place + ('0x' || left(sha256(participant_id::varchar), 2))::int) % 2 = 0 then 'search' else 'baseline' end as condition from r""")
def study_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("participant_id"))
    tasks = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"))
    return rel.study_assignment(people, tasks)


@query("""with b as (select event_type as metric, avg(value) as was from events where event_id % 2 = 0 group by 1), c as (select event_type as metric, avg(value) as now from events where event_id % 2 = 1 group by 1)
select metric, round((now - was) / was, 6) as regression, now <= 1000 and (round((now - was) / was, 6) <= 0.01 or metric = 'click') as passed from b join c using (metric)""")
def perf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.table(spark, sf_dir, "events")
    side = lambda r: e.where(F.col("event_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    limits = e.select(F.col("event_type").alias("metric")).distinct().select("metric", F.lit(1000.0).alias("most_value"), (F.col("metric") == "click").alias("approved"))
    return rel.perf_gate(side(0), side(1), limits, most=0.01)


# Evidence, citations, checks


@query(f"with {DOCS} select content_hash, count(*) as n, min(document_id) as first_id from docs group by content_hash having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("first_id")).where("n > 1")


@query("""with o as (select conv_id, turn, left(text, 12) as excerpt, role, row_number() over (partition by conv_id, role, text order by turn) as n from conversations),
p as (select conv_id, role, excerpt, turn, row_number() over (partition by conv_id order by turn) as place from o where n = 1) select conv_id, role, excerpt, turn, place::int as place from p where place <= 3""")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    return rel.first_evidence(rows, "conv_id", "role", "text", order="turn").select("conv_id", "role", F.left("text", F.lit(12)).alias("excerpt"), "turn", "place")


_CITES = """cites as (select doc_id as position, case when doc_id % 3 = 0 then 'c' || (doc_id % 30) end as citation_id, case when doc_id % 3 = 1 then '10.1/' || (case when doc_id % 2 = 0 then 'AB' else 'ab' end) || (doc_id % 40) end as doi,
'Title ' || (doc_id % 50) as title, 1990 + doc_id % 30 as year, case doc_id % 5 when 0 then [] when 1 then ['Ada Lovelace'] when 2 then ['Alan M Turing', 'Grace Hopper'] else ['Ada Lovelace', 'Alan M Turing', 'Grace Hopper', 'Plato'] end as authors,
case when doc_id % 2 = 0 then 'Journal ' || (doc_id % 4) end as publication, (doc_id % 9)::varchar as volume, case when doc_id % 4 = 0 then (doc_id % 3)::varchar end as issue, case when doc_id % 7 <> 0 then '1-' || (doc_id % 20) end as pages from documents),
keyed as (select *, coalesce('id:' || citation_id, 'doi:' || lower(doi), 'rec:' || title || '|' || year) as k from cites), first_c as (select *, row_number() over (partition by k order by position) as n from keyed qualify n = 1)"""


def _cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    names = lambda *a: F.array(*map(F.lit, a)) if a else F.array().cast("array<string>")
    return corpus.table(spark, sf_dir, "documents").select(
        i.alias("position"),
        F.when(i % 3 == 0, F.concat(F.lit("c"), i % 30)).alias("citation_id"),
        F.when(i % 3 == 1, F.concat(F.lit("10.1/"), F.when(i % 2 == 0, "AB").otherwise("ab"), i % 40)).alias("doi"),
        F.concat(F.lit("Title "), i % 50).alias("title"),
        (F.lit(1990) + i % 30).alias("year"),
        F.when(i % 5 == 0, names()).when(i % 5 == 1, names("Ada Lovelace")).when(i % 5 == 2, names("Alan M Turing", "Grace Hopper")).otherwise(names("Ada Lovelace", "Alan M Turing", "Grace Hopper", "Plato")).alias("authors"),
        F.when(i % 2 == 0, F.concat(F.lit("Journal "), i % 4)).alias("publication"),
        (i % 9).cast("string").alias("volume"),
        F.when(i % 4 == 0, (i % 3).cast("string")).alias("issue"),
        F.when(i % 7 != 0, F.concat(F.lit("1-"), i % 20)).alias("pages"),
        F.lit(None).cast("string").alias("type_mark"),
    )


@query(f"with {_CITES} select position, k as key from first_c")
def citation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.distinct_citations(_cites(spark, sf_dir)).select("position", "key")


@query(f"""with {_CITES}, nm as (select position, case position % 5 when 0 then '' when 1 then 'Lovelace, A.' when 2 then 'Turing, A. M., & Hopper, G.' else 'Lovelace, A., Turing, A. M., Hopper, G., & Plato' end as au from first_c)
select position, au || case when au = '' then '' else ' ' end || '(' || year || '). ' || title || '. ' || concat_ws(', ', publication, volume || case when issue is not null then '(' || issue || ')' else '' end, pages) || '.' as entry from first_c join nm using (position)""")
def citation_apa(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = rel.distinct_citations(_cites(spark, sf_dir))
    return once.select("position", rel.apa(once).alias("entry"))


@query(f"""with {_CITES} select position, array_to_string(authors[:3], ', ') || case when len(authors) > 3 then ', et al' else '' end || case when len(authors) > 0 then '. ' else '' end || title || '[Z]. '
|| concat_ws(', ', publication, year::varchar, volume || case when issue is not null then '(' || issue || ')' else '' end) || case when pages is not null then ': ' || pages else '' end || '.' as entry from first_c""")
def citation_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = rel.distinct_citations(_cites(spark, sf_dir))
    return once.select("position", rel.gb_t_7714(once).alias("entry"))


@query(f"""with {_CITES}, b as (select position, case when len(authors) = 0 then 'anon' when authors[1] = 'Ada Lovelace' then 'lovelace' else 'turing' end || year as base from cites),
n as (select position, base, row_number() over (partition by base order by position) as n from b) select position, base || case when n > 1 then n::varchar else '' end as key from n""")
def bibtex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.bibtex(_cites(spark, sf_dir)).select("position", "key")


@query(f"with {DOCS} select document_id, modified_at, name, source, row_number() over (partition by source order by modified_at, name)::int as place from docs")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.documents(spark, sf_dir).select("document_id", "modified_at", "name", "source")
    return accumulated(rows, ["modified_at", "name"], "place", within=["source"]).withColumn("place", F.col("place").cast("int"))


@query(f"""with {DOCS}, kids as (select parent as folder, path from docs where document_id % 50 <> 7 union all select 'x', 'x/' || document_id from docs where document_id % 100 = 0),
cached as (select document_id, case when document_id % 41 = 0 then 'old' else content_hash end as content_hash from docs where document_id % 43 <> 1 union all select document_id + 1000000, content_hash from docs where document_id % 200 = 0)
select 'missing_child' as code, 'error' as severity, count(*) as n from kids where path not in (select path from docs) union all select 'orphan', 'warning', count(*) from docs where path not in (select path from kids)
union all select 'duplicate_id', 'error', count(*) from (select document_id from docs group by 1 having count(*) > 1) union all select 'cache_missing', 'warning', count(*) from docs where document_id not in (select document_id from cached)
union all select 'cache_orphan', 'warning', count(*) from cached where document_id not in (select document_id from docs) union all select 'cache_outdated', 'error', count(*) from cached c join docs d using (document_id) where c.content_hash <> d.content_hash
union all select 'cache_invalid', 'error', count(*) from cached where content_hash is null or document_id is null
union all select 'failed', 'warning', count(*) from docs where status = 'failed'""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = corpus.documents(spark, sf_dir), F.col("document_id")
    kids = docs.where(i % 50 != 7).select(F.col("parent").alias("folder"), "path").union(docs.where(i % 100 == 0).select(F.lit("x"), F.concat(F.lit("x/"), i)))
    cached = docs.where(i % 43 != 1).select("document_id", F.when(i % 41 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash")).union(docs.where(i % 200 == 0).select(i + 1_000_000, "content_hash"))
    return rel.integrity(docs, kids, cached)


# Without SQL: sequential or fuzzy functions, archives, streams (tests hold them against plain Python)


@query()
def passage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.passages(corpus.documents(spark, sf_dir)).select("passage_id", "document_id", "ordinal", F.length("body").alias("n_chars"), tx.text_digest(F.col("body")).alias("digest"))


@query()
def readability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.functions.udfs import readability_score

    scored = corpus.table(spark, sf_dir, "documents").select("doc_id", readability_score("text").alias("score"))
    return scored.select("doc_id", "score", tx.readability_label(F.col("score")).alias("label"))


@query()
def fuzzy_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = corpus.documents(spark, sf_dir), F.col("document_id")
    asked = docs.where(i % 20 == 0).select(i.alias("query_id"), F.concat(F.lit("dok-"), i).alias("query"))
    return se.metadata_hits(docs, asked, fuzzy=True).where("reason = 'name is similar'").select("query_id", "document_id", F.round("score", 6).alias("score"))


@query()
def search_passages_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    asked = _tiered_queries(spark, sf_dir)
    return se.with_excerpts(se.search_tiered(docs, corpus.passages(docs), asked, fuzzy=True), docs, asked)


@query()
def research_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    asked = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def one(parts: DataFrame) -> DataFrame:
        return se.ranked(se.bm25(docs, "document_id", {"title": 1.0, "body": 1.0}, parts), [F.desc("bm25"), F.asc("document_id")], 5)

    return se.research(asked, one)


@query(f"""with {DOCS} select 'box-' || (document_id // 40) || '.zip' as container_path, 'box-' || (document_id // 40) || '.zip!/' || name as path, 1 as archive_depth,
octet_length(encode(body)) as size, sha256(body) as content_hash, null::varchar as error_code from docs""")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed forty to an archive on the executors, and the archives' members."""
    import io
    import zipfile

    import pandas as pd

    from folioscope.sources.files import ArchivePolicy, explode_archives

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in zip(pdf["name"], pdf["body"]):
                z.writestr(name, text or "")
        return pd.DataFrame({"path": [f"box-{pdf['box'].iloc[0]}.zip"], "content": [out.getvalue()]})

    docs = corpus.documents(spark, sf_dir).select("name", "body", F.floor(F.col("document_id") / 40).alias("box"))
    boxes = docs.groupBy("box").applyInPandas(pack, "path string, content binary")
    own = ArchivePolicy(ratio=1_000_000)  # the texts are known; some repeat one line and compress well
    return explode_archives(boxes, own).select("container_path", "path", "archive_depth", "size", F.sha2("content", 256).alias("content_hash"), "error_code")


@query()
def stream_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots as a stream: the change events that it appends."""
    import uuid

    from folioscope.sources.sinks import VersionedTables
    from folioscope.streaming.changes import announce, announced_stream, change_feed

    root = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    old, new = corpus.snapshots(spark, sf_dir)
    new = new.withColumn("document_id", F.xxhash64("path"))
    for generation, rows in enumerate((old, new), 1):
        announce(rows.select(F.col("document_id").cast("long"), "path", "source_kind", F.col("size").cast("long"), F.col("mtime").cast("long"), "content_hash"), root, generation)
        change_feed(announced_stream(spark, root), f"{root}/tables", f"{root}/offsets").awaitTermination()
    return VersionedTables(spark, f"{root}/tables").history("events").select("kind", "path", "previous_path", "generation")


@query("""with b as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new_ from events),
s as (select user_id, ts, sum(new_) over (partition by user_id order by ts rows unbounded preceding) as n from b)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as events from s group by user_id, n""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.streaming.changes import session_counts

    return session_counts(corpus.table(spark, sf_dir, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query(r"""select page_id, case when instr(url, '//') > 0 then regexp_replace(url, '^[a-z]+://', '') else url end as path, length(html) as size_bytes, sha256(html) as content_hash from pages""")
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as documents: a path from the address, the markup as text."""
    p = corpus.table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"), F.length("html").alias("size_bytes"), tx.text_digest(F.col("html")).alias("content_hash"))


@query("""with d as (select doc_id as query_id, 'See [S1], [S' || (doc_id % 5) || '].' as answer from documents), g as (select query_id, answer, case when doc_ok then replace(answer, '[S' || (query_id % 5) || ']', '') else answer end as clean
from (select *, (query_id % 5) not in (1, 2) as doc_ok from d)) select query_id, clean as answer, case when query_id % 5 = 2 then 'S1,S2' else 'S1' end as cited, false as degraded from g""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.plugins import grounded

    i = F.col("doc_id")
    d = corpus.table(spark, sf_dir, "documents")
    answers = d.select(i.alias("query_id"), F.concat(F.lit("See [S1], [S"), i % 5, F.lit("].")).alias("answer"))
    cites = d.select(i.alias("query_id"), F.explode(F.array(F.lit("S1"), F.lit("S2"))).alias("label"))
    return grounded(answers, cites).withColumn("cited", F.array_join("cited", ","))


@query(f"""with {DOCS} select '# ' || 'Folder ' || parent || chr(10) || chr(10) || '' || chr(10) || chr(10) || '## files' || chr(10) || chr(10) || string_agg('- [' || case when document_id % 2 = 0 then 'x' else ' ' end || '] ' || name || ': ' || trim(left(title, 20)), chr(10) order by document_id) || chr(10) as markdown, parent as task_id from docs group by parent""")
def task_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.sources.sinks import task_markdown as render

    docs = corpus.documents(spark, sf_dir)
    tasks = docs.select(F.col("parent").alias("task_id"), F.concat(F.lit("Folder "), "parent").alias("title"), F.lit("").alias("goal")).distinct()
    items = docs.select(F.col("parent").alias("task_id"), F.lit("files").alias("slot_id"), F.col("document_id").alias("position"), "name", F.lit(None).cast("int").alias("page_number"), F.left("title", F.lit(20)).alias("excerpt"), F.when(F.col("document_id") % 2 == 0, "accepted").otherwise("pending").alias("review_state"))
    return render(tasks, items)


# Evidence, cards, plans, stored JSON


@query("""with p as (select conv_id as document_id, case when turn % 3 = 0 then null else turn end as page_number, turn as page_id, text from conversations)
select document_id, left(string_agg(trim(text), chr(10) || chr(10) order by page_id), 20000) as text from p where page_number = 1 or page_number is null group by document_id""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("page_number"), F.col("turn").alias("page_id"), "text")
    return ev.page_text(pages, 1)


@query("""with r as (select conv_id as document_id, turn as ordinal, left(text, 2500) as body, row_number() over (partition by conv_id order by turn) as place from conversations)
select document_id, ordinal, body, place::int as place from r where place <= 18""")
def first_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), F.col("text").alias("body"))
    return ev.first_passages(c)


_CITED = """ev as (select doc_id % 40 as query_id, doc_id as document_id, k as position, text || k as excerpt from documents, (select unnest([0, 1, 2, 3]) as k) where n_chars >= 200),
res as (select doc_id % 40 as query_id, doc_id as document_id, n_chars >= 200 as long_, row_number() over (partition by doc_id % 40 order by n_chars, doc_id) as rank from documents),
top as (select query_id, document_id, row_number() over (partition by query_id order by rank) as n from res where long_ qualify n <= 5),
cited as (select e.query_id, 'S' || n as label, e.document_id, position + 1 as place, excerpt from ev e join top using (query_id, document_id) where position < 3)"""


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = corpus.table(spark, sf_dir, "documents"), (F.col("doc_id") % 40).alias("query_id")
    results = d.select(q, F.col("doc_id").alias("document_id"), F.row_number().over(Window.partitionBy(F.col("doc_id") % 40).orderBy("n_chars", "doc_id")).alias("rank"))
    pieces = d.where("n_chars >= 200").select(q, F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("position"), F.col("text").alias("t"))
    return ev.cited_results(results, pieces.select("query_id", "document_id", "position", F.concat("t", "position").alias("excerpt")))


@query(f"with {_CITED} select query_id, label, document_id, place::int as place, excerpt from cited")
def cited_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir)


@query(f"with {_CITED} select query_id, document_id, left(sha256(document_id || '||' || place || '|' || excerpt), 20) as candidate_id, excerpt from cited")
def evidence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.candidates(_cited(spark, sf_dir))


@query(f"with {_CITED} select left(sha256(document_id || '||' || place || '|' || excerpt), 20) as candidate_id from cited where document_id % 4 = 0")
def tampered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = ev.candidates(_cited(spark, sf_dir))
    theirs = mine.withColumn("excerpt", F.when(F.col("document_id") % 4 == 0, F.concat("excerpt", F.lit("!"))).otherwise(F.col("excerpt")))
    return ev.tampered(theirs, mine, "document_id", "excerpt")


_CARDS = """cards as (select document_id, case when document_id % 5 = 0 then 'old' else content_hash end as content_hash, case when document_id % 7 = 0 then 'failed' else 'done' end as state, 'Card ' || document_id as summary from docs where document_id % 3 <> 0)"""


def _cards(docs: DataFrame) -> DataFrame:
    i = F.col("document_id")
    return docs.where(i % 3 != 0).select("document_id", F.when(i % 5 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(i % 7 == 0, "failed").otherwise("done").alias("state"), F.concat(F.lit("Card "), i).alias("summary"))


@query(f"with {DOCS}, {_CARDS} select d.document_id, d.path, c.summary, c.content_hash is not distinct from d.content_hash as fresh from docs d left join cards c using (document_id) where d.parent = 'src1/en'")
def folder_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return ev.children_with_cards(docs, _cards(docs), "src1/en")


@query(f"""with {DOCS}, {_CARDS}, m as (select coalesce(c.content_hash = d.content_hash, false) as same, c.state from docs d left join cards c using (document_id)),
n as (select count(*) filter (same and state = 'done') as indexed, count(*) filter (same and state = 'failed') as failed, count(*) as total from m) select indexed, failed, total - indexed - failed as pending, total - indexed as estimated_calls from n""")
def card_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return ev.card_status(docs, _cards(docs))


@query(f"with {DOCS}, {_CARDS} select d.document_id as id, d.content_hash from docs d left join cards c using (document_id) where not coalesce(c.content_hash = d.content_hash and c.state in ('done', 'failed'), false)")
def cards_to_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.streaming.changes import to_refresh

    docs = corpus.documents(spark, sf_dir)
    return to_refresh(_cards(docs).withColumnRenamed("document_id", "id"), docs.select(F.col("document_id").alias("id"), "content_hash"))


@query(f"with {DOCS} select count(*) as total, count(*) filter (node_type = 'text') as text, count(*) filter (node_type <> 'text') as non_text from docs")
def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.cache_counts(corpus.documents(spark, sf_dir))


@query(f"""with {DOCS}, {SNAPSHOTS}, {DIFF}, parts as (select string_split(path, '/') as s from changes), f as (select distinct array_to_string(s[:k], '/') as folder from parts, (select unnest(range(1, 6)) as k) where k < len(s) union select '.')
select 'read' as action, count(*) as n from changes where kind in ('added', 'modified', 'moved') union all select 'roll_up', count(*) from f union all select 'drop', count(*) from changes where kind = 'deleted'""")
def update_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.update_plan(corpus.documents(spark, sf_dir), rel.diff(*corpus.snapshots(spark, sf_dir)))


_PLAN_LISTS = f"""{DOCS}, {SNAPSHOTS}, {DIFF}, c2 as (select kind, case when document_id % 4 = 1 then replace(path, '.txt', '.pdf') else path end as path from (select kind, path, regexp_extract(path, 'doc-(\\d+)', 1)::bigint as document_id from changes)),
parts as (select string_split(path, '/') as s from c2), f as (select distinct array_to_string(s[:k], '/') as folder from parts, (select unnest(range(1, 6)) as k) where k < len(s) union select '.'),
lists as (select distinct case when ends_with(path, '.txt') then 'read_text' else 'describe' end as action, path from c2 where kind in ('added', 'modified', 'moved') union all select 'roll_up', folder from f
union all select 'drop', path from c2 where kind = 'deleted' and path in (select case when document_id % 4 = 1 then replace(path, '.txt', '.pdf') else path end from docs))"""


def _plan_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes between the two snapshots, a fourth of the files being PDF files."""
    kind = lambda d: d.withColumn("path", F.when(F.regexp_extract("path", r"doc-(\d+)", 1).cast("long") % 4 == 1, F.replace("path", F.lit(".txt"), F.lit(".pdf"))).otherwise(F.col("path")))
    return ev.update_lists(kind(corpus.documents(spark, sf_dir).select("path")), kind(rel.diff(*corpus.snapshots(spark, sf_dir)).select("kind", "path")))


@query(f"with {_PLAN_LISTS} select action, path from lists")
def update_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan_lists(spark, sf_dir)


@query(f"with {_PLAN_LISTS} select action, count(*) as paths, case when action in ('describe', 'roll_up') then count(*) else 0 end as calls from lists group by action")
def estimated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.estimated_calls(_plan_lists(spark, sf_dir))


@query("""with s as (select case when event_id % 3 = 0 then 'abandoned' else 'completed' end as outcome, case when event_id % 3 = 0 then 'e' || (event_id % 4) end as error_code, value * 10000 as duration_ms from events)
select 'sessions' as metric, count(*)::double as value from s union all select 'completion_rate', round(avg((outcome = 'completed')::int), 6) from s union all select 'within_limit_rate', round(avg((outcome = 'completed' and duration_ms <= 600000)::int), 6) from s
union all select 'outcome:' || outcome, count(*)::double from s group by outcome union all select 'error_code:' || error_code, count(*)::double from s where error_code is not null group by error_code""")
def activation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = corpus.table(spark, sf_dir, "events").select(F.when(i % 3 == 0, "abandoned").otherwise("completed").alias("outcome"), F.when(i % 3 == 0, F.concat(F.lit("e"), i % 4)).alias("error_code"), (F.col("value") * 10000).alias("duration_ms"))
    return ev.activation_summary(s)


@query("""select event_id, case when event_id % 9 = 0 then null else (event_id % 100000)::bigint end as ms, (event_id * 3600) % 86400 >= 43200 as expired from events""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, at = F.col("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    iso = lambda ms: F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + ms), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    end = F.when(i % 9 == 0, "not a time").otherwise(iso(i % 100_000))
    now = F.timestamp_seconds(F.lit(1_704_067_200) + (i * 3600) % 86_400)
    return corpus.table(spark, sf_dir, "events").select("event_id", ev.duration_ms(iso(F.lit(0)), end).alias("ms"), ev.expired(at, now, 12).alias("expired"))


@query("""select event_id, case when event_id % 10 = 0 then 0 when event_id % 10 = 1 then 0 else 2 end as n_list, case when event_id % 10 = 0 then '' when event_id % 10 = 1 then '' else 'a' || event_id || ',b' end as joined from events""")
def stored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(i % 10 == 0, "{broken").when(i % 10 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit('["a'), i, F.lit('","b"]')))
    return corpus.table(spark, sf_dir, "events").select("event_id", ev.json_list(raw).alias("x")).select("event_id", F.size("x").alias("n_list"), F.array_join("x", ",").alias("joined"))


@query(f"""with {DOCS}, {SNAPSHOTS}, {ITEMS}, once as (select content_hash, min(document_id) as by_hash from docs group by content_hash having count(*) = 1)
select task_id, item_id, coalesce(by_hash, case when i.content_hash is null or i.content_hash = d.content_hash then d.document_id end) as document_id from items i left join once o on i.content_hash = o.content_hash left join docs d on i.path = d.path""")
def migrated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.migrated_items(corpus.task_items(spark, sf_dir), corpus.documents(spark, sf_dir))


@query("""with o as (select doc_id % 9 as parent_id, sha256(text) as content_hash, 'm' || (doc_id % 50) as c, 'a/' || doc_id as path from documents where doc_id % 4 <> 1), n as (select doc_id % 9 as parent_id, sha256(text) as content_hash, 'm' || (doc_id % 50) as c, case when doc_id % 3 = 0 then 'b/' else 'a/' end || doc_id as path from documents),
g as (select parent_id, content_hash, c, min(path) as old_path from o where path not in (select path from n) group by all having count(*) = 1), k as (select parent_id, content_hash, c, min(path) as path from n where path not in (select path from o) group by all having count(*) = 1)
select old_path, path from g join k using (parent_id, content_hash, c)""")
def member_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = corpus.table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = lambda d, path: d.select((i % 9).alias("parent_id"), tx.text_digest(F.col("text")).alias("content_hash"), F.array(F.concat(F.lit("m"), i % 50)).alias("member_chain"), F.array(i % 2 * 0).alias("member_indexes"), path.alias("path"))
    return ev.member_moves(rows(d.where(i % 4 != 1), F.concat(F.lit("a/"), i)), rows(d, F.concat(F.when(i % 3 == 0, "b/").otherwise("a/"), i)))


@query("select coalesce(a.doc_id, b.doc_id) as task_id, a.doc_id is not null as has_task from (select doc_id from documents where doc_id % 5 <> 0) a full join (select doc_id from labels) b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null")
def unjudged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = corpus.table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("task_id"))
    return ev.mismatched(tasks, corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id")))


@query(f"""with {DOCS}, t as (select document_id as task_id, case when document_id % 8 = 0 then [] when document_id % 6 = 0 then ['gone/' || document_id] else [path] end as paths from docs)
select 'unknown_path' as code, count(*) as n from (select unnest(paths) as p from t) where p not in (select path from docs) union all select 'duplicate_task', 0 union all select 'no_target', count(*) from t where len(paths) = 0 union all select 'missing_category', 1""")
def dataset_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = corpus.documents(spark, sf_dir), F.col("document_id")
    tasks = docs.select(i.alias("task_id"), F.when(i % 8 == 0, F.array().cast("array<string>")).when(i % 6 == 0, F.array(F.concat(F.lit("gone/"), i))).otherwise(F.array("path")).alias("relevant_paths"), F.array("lang").alias("categories"))
    return ev.dataset_faults(tasks, docs, ["en", "fr", "zh"])


@query("""with u as (select doc_id, case when doc_id % 3 = 0 then doc_id % 5 when doc_id % 3 = 1 then 99 end as e from documents) select doc_id as task_id, (doc_id % 5 + case when doc_id % 3 = 0 then 1 else 0 end) as revision,
case when doc_id % 3 = 0 then 'new ' else 'old ' end || doc_id as title, doc_id % 3 = 0 as applied, doc_id % 3 = 1 as conflict from u""")
def task_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = corpus.table(spark, sf_dir, "documents"), F.col("doc_id")
    tasks = d.select(i.alias("task_id"), (i % 5).alias("revision"), F.concat(F.lit("old "), i).alias("title"))
    updates = d.where(i % 3 != 2).select(i.alias("task_id"), F.when(i % 3 == 0, i % 5).otherwise(99).alias("expected_revision"), F.concat(F.lit("new "), i).alias("title"))
    return ev.with_revision(tasks, updates)


@query(f"""with {DOCS}, {SNAPSHOTS}, {ITEMS} select task_id, item_id, case when f.path is null then 'missing' when f.h = i.content_hash then 'current' else 'changed' end as freshness
from items i left join (select path, sha256(case when document_id % 18 = 0 then body || '!' else body end) as h from docs where document_id % 5 <> 0) f using (path)""")
def task_revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("document_id")
    files = corpus.documents(spark, sf_dir).where(i % 5 != 0).select("path", F.when(i % 18 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")).cast("binary").alias("content"))
    return ev.revalidated(corpus.task_items(spark, sf_dir), files)


@query("""with p as (select conv_id as document_id, turn as page_number, length(text) % 100 / 100.0::double as q from conversations), t as (select *, row_number() over (partition by document_id order by page_number) as n from p where q < 0.72 and not (page_number % 4 = 0))
select document_id, page_number, q as quality_score from t where n <= 25""")
def ocr_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), (F.length("text") % 100 / F.lit(100.0)).alias("quality_score"))
    return ev.ocr_budget(pages, pages.where("page_number % 4 = 0").select("document_id", "page_number"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
select doc_id::varchar as path, count(*) as rows, max(len(string_split(line, ',')))::int as columns from l where n <= 50 group by doc_id""")
def csv_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return ev.csv_shape(lines.select("path", (F.col("at") + 1).alias("number"), "line"))


@query("""select doc_id, case when doc_id % 2 = 0 then 'mine ' || doc_id end as kept, 'body ' || doc_id as body from documents""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    block = F.when(i % 2 == 0, F.concat(F.lit("<!-- user:notes -->\nmine "), i, F.lit("\n<!-- /user:notes -->\n"))).otherwise("")
    page = F.concat(F.lit("# T\n"), block, F.lit("## Summary\nbody "), i, F.lit("\n## Next\nother"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", ev.protected_blocks(page, "notes").alias("kept"), ev.section(page, "Summary").alias("body"))


@query("""with d as (select doc_id, case when doc_id % 3 = 0 then 'Report: <' || doc_id || '>.md ' else '..' || lang || '/' || doc_id || '?' end as raw from documents)
select doc_id, case when doc_id % 3 = 0 then 'Report_ _' || doc_id || '_.md' else lang_ || '_' || doc_id end as safe, case when doc_id % 3 = 0 then 'report-' || doc_id || '-md' else lang_ || '-' || doc_id end as slug from d join (select doc_id, lang as lang_ from documents) using (doc_id)""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("Report: <"), i, F.lit(">.md "))).otherwise(F.concat(F.lit(".."), "lang", F.lit("/"), i, F.lit("?")))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", tx.safe_name(raw).alias("safe"), tx.safe_slug(raw).alias("slug"))


@query(f"""with {DOCS} select document_id, left(array_to_string(list_filter(regexp_split_to_array(replace(replace(replace(trim(regexp_replace(body, '\\s+', ' ', 'g')), '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1)), lambda s: s <> '')[:3], ' '), 400) as summary from docs""")
def heuristic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.plugins import heuristic_summary

    return heuristic_summary(corpus.documents(spark, sf_dir))


@query("select doc_id as document_id, ceil(length(text) / 4.0::double)::bigint as tokens, round(ceil(length(text) / 4.0::double) * 0.5::double / 1e6, 8) as cost from documents")
def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.plugins import model_cost

    return model_cost(corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")), 0.5)


def _rehearsed(system: str, payload: str, most_output: int, key: str) -> tuple[str, int, int]:
    """A stand-in for a service: the first call of some prompts fails, the answer to others needs a repair."""
    import json

    from folioscope.operators.calls import REPAIR

    if system == REPAIR:
        return json.loads(payload)["invalid_json"] + "}", 10, 10
    if key[0] in "01" and key.endswith("-0"):
        raise ConnectionError("connection reset")
    return '{"chars": %d' % len(payload) + ("" if key[0] in "ef" else "}"), len(payload) // 4, 10


@query(r"""with p as (select doc_id, length(text) as n, left(sha256('rehearsal' || chr(31) || '1' || chr(31) || 'Say how long the text is.' || chr(31) || text), 1) as h from documents)
select doc_id as ask_id, 'ok' as status, '{"chars": ' || n || '}' as content, case when h in ('0', '1', 'e', 'f') then 2 else 1 end::bigint as calls, case when h in ('e', 'f') then 1 else 0 end as repairs from p""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every document, called again after a failure, repaired where it isn't JSON, by a stand-in for the service."""
    import uuid

    from folioscope.operators.calls import Calls, Policy

    asks = corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ask_id"), F.lit("summary").alias("purpose"), F.lit("Say how long the text is.").alias("system"), F.col("text").alias("payload"))
    policy = Policy(model="rehearsal", most_calls=1 << 40, per_round=1 << 40, per_task=2_000)
    return Calls(spark, f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}", _rehearsed, policy, lambda s: None).complete(asks)


@query(f"""with {DOCS}, n as (select document_id as node_id, path, node_type, case document_id % 90 when 0 then document_id + 1000000 when 7 then document_id + 1 when 8 then document_id - 1 end as needs from docs),
x as (select path, document_id + case when document_id % 44 = 1 then 1 else 0 end as node_id, document_id % 38 <> 0 as header_ok from docs where node_type <> 'text' and document_id % 30 <> 0 union all select 'lost/' || document_id, document_id, true from docs where document_id % 99 = 0),
r as (select path, document_id % 77 = 0 as generated from docs where document_id % 61 <> 0), leaf as (select * from n where node_type in ('leaf', 'foldernode')), m as (select leaf.path, leaf.node_id, x.node_id as w, header_ok from leaf join x using (path))
select 'index_missing' as code, 'error' as severity, path as key from leaf where path not in (select path from x) union all select 'index_invalid', 'error', path from m where not header_ok
union all select 'id_mismatch', 'error', path from m where header_ok and w <> node_id union all select 'index_untracked', 'warning', path from x where path not in (select path from leaf)
union all select 'dependency_unknown', 'error', path from n where needs not in (select node_id from n) union all select 'dependency_cycle', 'error', a.path from n a join n b on a.needs = b.node_id and b.needs = a.node_id
union all select 'raw_missing', 'warning', path from n where node_type <> 'foldernode' and path not in (select path from r)
union all select 'generated_in_raw', 'error', path from r where generated union all select 'roots_overlap', 'error', 'src1/en'
union all select 'invalid_shortcut', 'warning', path || '.url' from docs where document_id % 7 <> 0 and document_id % 2 = 0""")
def node_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = corpus.documents(spark, sf_dir), F.col("document_id")
    nodes = docs.select(i.alias("node_id"), "path", "node_type", F.array_compact(F.array(F.when(i % 90 == 0, i + 1_000_000).when(i % 90 == 7, i + 1).when(i % 90 == 8, i - 1))).alias("depends_on"))
    written = docs.where((F.col("node_type") != "text") & (i % 30 != 0)).select("path", (i + F.when(i % 44 == 1, 1).otherwise(0)).alias("node_id"), (i % 38 != 0).alias("header_ok"))
    lost = docs.where(i % 99 == 0).select(F.concat(F.lit("lost/"), i).alias("path"), i.alias("node_id"), F.lit(True).alias("header_ok"))
    raw = docs.where(i % 61 != 0).select("path", (i % 77 == 0).alias("generated"))
    roots = spark.createDataFrame([("src1",), ("src1/en",), ("src10",)], "root string")
    link = F.when(i % 7 == 0, F.lit("[InternetShortcut]\nURL=file:///x")).otherwise("URL=file:///x")
    shortcuts = docs.where(i % 2 == 0).select(F.concat("path", F.lit(".url")).alias("path"), link.alias("text"))
    return rel.node_faults(nodes, written.unionByName(lost), raw, roots, shortcuts)
