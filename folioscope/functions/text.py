"""Text functions as column expressions: normalising, terms, excerpts, headings, labels, paths, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what the full-text tokenizer folds them to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
CJK = "\\u4e00-\\u9fff"


def once(value: Column, f) -> Column:
    """f(value), where value is computed once although f uses it within a lambda."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def folded(c: Column) -> Column:
    """Lower case with sharp s spelt out, which is full case folding for Western European text."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalized(c: Column) -> Column:
    """Words of letters, digits and underscores, case-folded, joined by single spaces."""
    return F.array_join(F.regexp_extract_all(folded(c), F.lit(r"([\p{L}\p{N}_]+)"), 1), " ")


def fts_tokens(c: Column) -> Column:
    """The full-text tokenizer: runs of letters and digits, lower case, accents folded (sharp s stays)."""
    return F.regexp_extract_all(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cjk_terms(c: Column, pattern: str = f"([{CJK}]+)") -> Column:
    """Two- and three-character grams of each run of ideographs."""
    runs = F.regexp_extract_all(c, F.lit(pattern), 1)
    return F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 2), _grams(r, 3))))


def search_terms(c: Column) -> Column:
    """Sorted distinct words of the normalised text with the grams of its ideographs."""
    norm = folded(c)
    words = F.regexp_extract_all(norm, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_sort(F.array_distinct(F.concat(words, cjk_terms(norm))))


def analyzed_set(c: Column) -> Column:
    """The older analyzer: ASCII words with inner dots and dashes, single ideographs, grams; distinct."""
    words = F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9][A-Za-z0-9_.\-]*)"), 1), F.lower)
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}]+)"), 1)
    return F.array_distinct(F.concat(words, F.filter(runs, lambda r: F.length(r) == 1), cjk_terms(c)))


def analyzed_terms(c: Column) -> Column:
    """analyzed_set(), sorted."""
    return F.array_sort(analyzed_set(c))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def excerpt(text: Column, query: Column, limit: int = 240, lead: int = 70) -> Column:
    """A window of the text around the query, or else around the first of its sorted terms that occurs, or the start."""

    def found(low: Column) -> Column:
        spot = F.instr(low, F.lower(query))
        hits = F.filter(F.transform(search_terms(query), lambda t: F.instr(low, t)), lambda p: p > 0)
        return F.when(spot > 0, spot).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(1)))

    def window(flat: Column) -> Column:
        start = F.greatest(F.lit(1), once(F.lower(flat), found) - lead)
        return once(start, lambda s: F.concat(F.when(s > 1, "…").otherwise(""), F.trim(F.substring(flat, s, F.lit(limit))), F.when(s + limit <= F.length(flat), "…").otherwise("")))

    return once(one_line(text), window)


def evidence_excerpt(text: Column, terms: Column, limit: int = 240, lead: int = 80) -> Column:
    """A window that starts before the earliest term and stays within the text's end."""

    def window(flat: Column) -> Column:
        first = once(F.lower(flat), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)))
        start = F.greatest(F.lit(1), F.least(F.coalesce(first, F.lit(1)) - lead, F.length(flat) - (limit - 1)))
        return F.substring(flat, start, F.lit(limit))

    return once(one_line(text), window)


def heading(text: Column, limit: int = 200) -> Column:
    """The first line that isn't blank; what follows it isn't looked at."""
    return F.left(F.trim(F.coalesce(F.regexp_extract(text, r"\A[ \n]*([^\n]*)", 1), F.lit(""))), F.lit(limit))


def readability_label(score: Column) -> Column:
    return F.when(score >= 0.72, "readable").when(score >= 0.45, "partial").otherwise("low")


def sub_queries(query: Column, most: int = 4) -> Column:
    """Parts of a question between punctuation and conjunctions, of two characters at least, distinct, the first few."""
    parts = F.transform(F.split(query, r"[,;:.!?，；：。！？、\n]+|以及|并且|同时"), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2)), 1, most)


def citation_markers(text: Column) -> Column:
    """Labels of markers like [S1], in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Za-z]+\d+)\]"), 1))


def without_unknown_markers(text: Column, known: Column) -> Column:
    """The text without those markers whose label isn't known."""
    unknown = F.array_except(citation_markers(text), known)
    return F.aggregate(unknown, text, lambda t, m: F.replace(t, F.concat(F.lit("["), m, F.lit("]")), F.lit("")))


def safe_name(c: Column, limit: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]+', "_"), r"^[\s._]+|[\s._]+$", ""), F.lit(limit))


def safe_slug(c: Column, limit: int = 64) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(limit))


def safe_code(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).rlike(r"^[a-z][a-z0-9_]{0,63}$"), F.lower(F.trim(c))).otherwise("unknown")


def truncated(c: Column, limit: int = 80_000, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(marker))).otherwise(c)


def redacted(c: Column, limit: int = 4_000) -> Column:
    """The end of a log without paths and secrets."""
    c = F.regexp_replace(c, r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[:=]\s*)\S+", "$1$2[redacted]")
    c = F.regexp_replace(c, r"(?:[A-Za-z]:\\|/)(?:[\w.\-]+[\\/])+[\w.\-]+", "[path]")
    return F.right(c, F.lit(limit))


def locator_label(x: Column) -> Column:
    """A position in words: struct(kind, page_number, paragraph_index, table_index, sheet_name, cell_range, slide_number, line_start, line_end)."""
    return (
        F.when(x["kind"] == "page", F.concat(F.lit("page "), x["page_number"]))
        .when(x["kind"] == "paragraph", F.concat(F.lit("paragraph "), x["paragraph_index"]))
        .when(x["kind"] == "table", F.concat(F.lit("table "), x["table_index"]))
        .when(x["kind"] == "sheet", F.concat_ws(" ", x["sheet_name"], x["cell_range"]))
        .when(x["kind"] == "slide", F.concat(F.lit("slide "), x["slide_number"]))
        .when(x["kind"] == "text_line", F.concat(F.lit("lines "), x["line_start"], F.lit("-"), x["line_end"]))
        .when(x["kind"] == "image", "image")
        .otherwise("document")
    )


# Paths


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """All folders that hold a path, from '.' down."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>")))


def is_below(path: Column, prefix: str) -> Column:
    """Whether a path is a folder or lies in it, whatever the case."""
    prefix = prefix.strip("/").casefold()
    return F.lit(True) if prefix in ("", ".") else (F.lower(path) == prefix) | F.startswith(F.lower(path), F.lit(prefix + "/"))


# Digests


def text_digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def candidate_id(document: Column, page: Column, locator: Column, excerpt_: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", document, F.coalesce(page.cast("string"), F.lit("")), F.coalesce(locator, F.lit("")), excerpt_), 256), F.lit(20))


def export_name(name: Column, digest: Column) -> Column:
    return F.concat(F.left(digest, F.lit(12)), F.lit("-"), safe_name(name))
