"""Plug-ins: named transforms DataFrame -> DataFrame with declared inputs; and the rules that ground what a model writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx

API = (1, 0)
PERMISSIONS = frozenset({"read_results", "read_documents", "read_tasks", "write_artifacts"})


@dataclass(frozen=True)
class Plugin:
    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    inputs: dict[str, tuple[str, ...]]  # table: the columns that it may see
    permissions: frozenset[str] = frozenset({"read_results"})
    least_api: tuple[int, int] = (1, 0)


class Plugins:
    def __init__(self) -> None:
        self.known: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        if unknown := plugin.permissions - PERMISSIONS:
            raise ValueError(f"unknown permissions: {sorted(unknown)}")
        if plugin.least_api[0] != API[0] or plugin.least_api > API:
            raise ValueError("a plug-in for another interface")
        self.known[plugin.name] = plugin

    def run(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        """The plug-in sees only the columns that it declares."""
        plugin = self.known[name]
        return plugin.run({t: tables[t].select(*columns) for t, columns in plugin.inputs.items()})


def sanitized(results: DataFrame) -> DataFrame:
    """What plug-ins get of results: no private columns, five pieces of evidence at most."""
    hidden = {"source_uri", "raw_path", "evidence_json"}
    out = results.select(*(c for c in results.columns if c not in hidden))
    return out.withColumn("evidence", F.slice("evidence", 1, 5)) if "evidence" in out.columns else out


TIMELINE = Plugin("timeline", lambda t: t["documents"].orderBy("modified_at", "name"), {"documents": ("document_id", "name", "modified_at")}, frozenset({"read_documents"}))
PACKAGE = Plugin("package", lambda t: t["documents"].select("document_id", tx.export_name(F.col("name"), F.col("content_hash")).alias("export_name"), "size_bytes"), {"documents": ("document_id", "name", "content_hash", "size_bytes")}, frozenset({"read_documents"}))


def grounded(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, answer, cited, degraded): markers without a citation(query_id, label) go; an answer that cites nothing
    afterwards is degraded to none."""
    known = citations.groupBy("query_id").agg(F.collect_set("label").alias("known"))
    met = answers.join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    met = met.withColumn("clean", tx.without_unknown_markers(F.col("answer"), F.col("known")))
    cited = F.array_sort(tx.citation_markers(F.col("clean")))
    return met.select("query_id", F.when(F.size(cited) > 0, F.col("clean")).alias("answer"), cited.alias("cited"), (F.size(cited) == 0).alias("degraded"))


def heuristic_summary(docs: DataFrame, sentences: int = 3, most: int = 400) -> DataFrame:
    """The summary without a model: the first sentences."""
    parts = F.filter(F.split(tx.one_line(F.col("body")), r"(?<=[.!?。！？])\s+"), lambda s: s != "")
    return docs.select("document_id", F.left(F.array_join(F.slice(parts, 1, sentences), " "), F.lit(most)).alias("summary"))


def model_cost(rows: DataFrame, per_million: float) -> DataFrame:
    """Estimated tokens and cost of texts(document_id, body): a token for four characters."""
    tokens = F.ceil(F.length("body") / 4)
    return rows.select("document_id", tokens.alias("tokens"), F.round(tokens * per_million / 1e6, 8).alias("cost"))


def error_code(message: Column) -> Column:
    """The class of a provider's error message."""
    m, classes = F.lower(message), {
        "auth": r"\b(401|403)\b|unauthori[sz]ed|forbidden", "quota": r"\b402\b|insufficient|quota", "rate_limited": r"\b429\b|rate limit",
        "timeout": "timed? ?out", "provider_unavailable": r"\b5\d\d\b|unavailable|connection",
    }
    out = F
    for name, pattern in classes.items():
        out = out.when(m.rlike(pattern), name)
    return out.otherwise("unknown")
