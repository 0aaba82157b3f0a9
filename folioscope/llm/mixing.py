"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions alone.

Every source gets a target: its weight's share of all words, at most CAP times its own words; what that leaves over goes
to the other sources by weight. A document of the source is to be taken target / source size times: a whole number of
copies and a fractional one. Fractions are rounded in pairs: of two documents with fractions p and q and sizes a and b,
words move from one to the other until one fraction is 0 or 1; which of the two ways is random with the odds that keep
each document's expectation, and the fractional words a p + b q stay the same. The document that is still fractional goes on
to the next pair. Within a chunk of documents this is one fold; the residuals of chunks are the documents of the next
level, a tree whose height is the logarithm of the largest source. On its last level a source's residuals and a chunk of
its documents (or a few chunks, set aside by hash) are settled from the largest on, each against all smaller ones at once, which
keeps expectations and words in the same way; so what is rounded alone in the end is a small document, and a source's words
are off its target by less than one document's size.

Randomness is a hash of the row and the seed: reruns agree. Null texts count 0 words; a null source is a source (ordered
last). Rows alike in doc_id, source and size are told apart by a running number, which is why repeated rows can differ in
their copies. Documents of size 0 take nothing either way. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import durable

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3.0, 42
#: Mean number of documents of a chunk: one task folds it in memory.
CHUNK = 64
#: Chunks of documents of a source, at most, that are set aside for the last level.
RESERVE = 8.0
EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size, ...), a row for each source, with each one's target.

    In the order of most / weight, let level k be what all sources before k leave when they get their most, divided by the
    weights from k on. The first source whose share at its level isn't above its most ends the capped ones."""
    # The number of sources, not of documents, bounds what these windows sort.
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    kinds = F.array(*map(F.lit, weights))
    listed = sizes.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    listed = listed.withColumn("most", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = listed.withColumn("k", F.row_number().over(by_ratio)).withColumn("level", left / open_)
    fits = F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct("k", "level"))
    ranked = ranked.withColumn("first", F.min(fits).over(everything))
    share = F.when(F.col("k") >= F.col("first.k"), F.col("weight") * F.col("first.level")).otherwise(F.col("most"))
    return ranked.withColumn("target", F.least(share, F.col("most")).cast("double")).drop("weight", "most", "k", "level", "first")


ITEM = "struct<size: bigint, id: bigint, n: bigint, whole: bigint, p: double, r: double>"


def _fold(items: Column) -> Column:
    """struct(done, rest) of an array of items with fractions p: the settled ones, and the one that may stay fractional.
    r is an item's random number for its meeting with the residual."""
    none = F.lit(None).cast(ITEM)
    bind = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  evaluates value once
    whole = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)

    def put(x: Column, p: Column) -> Column:
        return x.withField("p", F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p))

    def moved(rest: Column, x: Column) -> Column:
        up = F.least((1 - rest["p"]) * rest["size"], x["p"] * x["size"])  # words that can move to the residual
        down = F.least(rest["p"] * rest["size"], (1 - x["p"]) * x["size"])  # words that can move to x
        words = F.when(x["r"] * (up + down) < down, up).otherwise(-down)
        return bind(words, lambda w: F.struct(put(rest, rest["p"] + w / rest["size"]).alias("a"), put(x, x["p"] - w / x["size"]).alias("b")))

    def meet(acc: Column, x: Column) -> Column:
        after = lambda t: F.struct(
            F.concat(acc["done"], F.filter(F.array(t["a"], t["b"]), whole)).alias("done"),
            F.when(~whole(t["a"]), t["a"]).when(~whole(t["b"]), t["b"]).otherwise(none).alias("rest"),
        )
        return F.when(acc["rest"].isNull(), F.struct(acc["done"].alias("done"), x.alias("rest"))).otherwise(bind(moved(acc["rest"], x), after))

    return F.aggregate(items, F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), none.alias("rest")), meet)


def _settle(items: Column, seed: int) -> Column:
    """An array of items, all fractions settled: each time the largest open item, the head, meets all others at once.

    With the head's fraction p and size a, the others' fractions q and sizes b: where the head moves by x, each other moves by
    -x c, with c = a q' / sum(b q') and q' = min(q / (1 - p), (1 - q) / p), so that the words stay the same. x is the farthest
    that all fractions allow, up or down, with the odds that keep expectations. It settles the head, unless the others have
    too few words, and always one item. A last item alone goes up with odds p."""
    bind = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  evaluates value once
    is_open = lambda x: (x["p"] > 0.0) & (x["p"] < 1.0)

    def put(x: Column, p: Column) -> Column:
        return x.withField("p", F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p))

    def meet(acc: Column, step: Column) -> Column:
        def with_head(head: Column) -> Column:
            others = F.slice(acc["open"], 2, F.size(acc["open"]))
            room = lambda x: F.least(x["p"] / (1 - head["p"]), (1 - x["p"]) / head["p"])
            scale = F.try_divide(head["size"].cast("double"), F.aggregate(others, F.lit(0.0), lambda n, x: n + x["size"] * room(x)))  # null without others
            random = F.pmod(F.xxhash64(F.lit(f"{seed} settle"), step, head["id"], head["size"], head["n"]), F.lit(1 << 53)) / float(1 << 53)

            def moved(m: Column) -> Column:
                up = F.aggregate(m, 1 - head["p"], lambda n, y: F.least(n, y["x"]["p"] / y["c"]))
                down = F.aggregate(m, head["p"], lambda n, y: F.least(n, (1 - y["x"]["p"]) / y["c"]))
                way = bind(F.struct(up.alias("up"), down.alias("down")), lambda w: F.when(random * (w["up"] + w["down"]) < w["down"], w["up"]).otherwise(-w["down"]))
                return bind(way, lambda w: F.concat(F.array(put(head, head["p"] + w)), F.transform(m, lambda y: put(y["x"], y["x"]["p"] - w * y["c"]))))

            parts = bind(scale, lambda k: F.transform(others, lambda x: F.struct(x.alias("x"), (room(x) * k).alias("c"))))
            return bind(bind(parts, moved), lambda xs: F.struct(F.concat(acc["done"], F.filter(xs, lambda x: ~is_open(x))).alias("done"), F.filter(xs, is_open).alias("open")))

        return F.when(F.size(acc["open"]) == 0, acc).otherwise(bind(acc["open"][0], with_head))

    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), F.sort_array(items, asc=False).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.size(items)), start, meet)["done"]


def copies(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, n, copies, source_size, target) of each row of sized(doc_id, source, size); n tells rows apart
    that are alike in those three."""
    sources = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, cap))
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("alike"))
    listed = alike.select(F.col("doc_id").alias("id"), "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "alike")).alias("n"))
    goal = sources.select(F.col("source").alias("of"), "rows", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("f"))
    same = F.col("source").eqNullSafe(F.col("of"))
    whole = F.floor(F.col("f") + EPS).cast("long")
    part = F.when((F.col("size") == 0) | (F.col("f") - whole < EPS), 0.0).otherwise(F.col("f") - whole)
    planned = durable(listed.join(goal, same).select("id", "source", "size", "n", "rows", whole.alias("whole"), part.alias("p")))
    most = sources.agg(F.max("rows")).first()[0] or 0
    fields = ("size", "id", "n", "whole", "p")
    settled = planned.where("p = 0").select("source", *fields)
    # the smaller the fractions of a source are, or what's missing to whole ones, the fewer words a document can give or take
    wanted = chunk * F.least(F.lit(RESERVE), F.try_divide(F.lit(0.5), F.least("p", 1 - F.col("p"))))
    kept = F.pmod(F.xxhash64(F.lit(f"{seed} keep"), "id", "size", "n"), F.col("rows")) < wanted
    reserve = planned.where((F.col("p") > 0) & kept).select("source", "rows", *fields)  # for the last level
    loose, level, reach = planned.where((F.col("p") > 0) & ~kept).select("source", "rows", *fields), 0, 1.0
    while True:
        last = reach * chunk >= most
        loose = loose.union(reserve) if last else loose
        parts = F.lit(1).cast("long") if last else F.ceil(F.col("rows") / (reach * chunk)).cast("long")
        place = F.pmod(F.xxhash64(F.lit(f"{seed} place {level}"), "id", "size", "n"), parts)
        random = F.pmod(F.xxhash64(F.lit(f"{seed} move {level}"), "id", "size", "n"), F.lit(1 << 53)) / float(1 << 53)
        items = F.sort_array(F.collect_list(F.struct(*fields, random.alias("r"))), asc=False)
        chunks = loose.groupBy("source", "rows", place.alias("place")).agg(items.alias("items"))
        if last:
            folded = durable(chunks.select("source", _settle(F.col("items"), seed).alias("done")))
        else:
            folded = durable(chunks.select("source", "rows", _fold(F.col("items")).alias("x"))).select("source", "rows", "x.done", "x.rest")
        settled = settled.union(folded.select("source", F.explode("done").alias("x")).select("source", *(f"x.{c}" for c in fields)))
        if last:
            break
        loose = folded.where("rest is not null").select("source", "rows", *(f"rest.{c}" for c in fields))
        level, reach = level + 1, reach * chunk
    by_source = sources.select(F.col("source").alias("of"), "source_size", "target")
    taken = settled.select(F.col("id").alias("doc_id"), "source", "size", "n", (F.col("whole") + F.col("p").cast("long")).alias("copies"))
    return taken.join(by_source, same).drop("of")


def sized_documents(docs: DataFrame) -> DataFrame:
    return durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) of each row of docs(doc_id, source, text)."""
    got = copies(sized_documents(docs), weights, cap, seed)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as it's taken, all columns kept. Texts are shuffled once."""
    got = copies(sized_documents(docs), weights, cap, seed)
    keys = ("doc_id", "source", "size")
    named = [*(F.col(x).alias(f"_{x}") for x in keys), F.xxhash64(*keys).alias("_key")]
    taken = durable(got.groupBy(*keys).agg(F.sum("copies").alias("_k"), F.count(F.lit(1)).alias("_c")).where("_k > 0").select(*named, "_k", "_c"))
    own = {"_own_id": F.col("row.doc_id").cast("long"), "_own_source": F.col("row.source").cast("string"), "_own_size": n_words(F.col("row.text"))}
    # the caller's columns stay in one, so that none can clash with those here
    rows = docs.select(F.struct("*").alias("row")).withColumns(own).withColumn("_own_key", F.xxhash64(*own))
    same = F.col("_own_key") == F.col("_key")
    for x, y in zip(own, keys):
        same = same & F.col(x).eqNullSafe(F.col(f"_{y}"))
    met = lambda plan_: rows.join(plan_.hint("shuffle_hash"), same)  # noqa: E731  the plan is narrow, the texts needn't be sorted
    each = met(taken.where("_c = 1")).withColumn("_copies", F.col("_k"))
    repeated = taken.where("_c > 1")
    if not repeated.isEmpty():
        # rows alike in the three keys share the copies out as evenly as can be
        number = F.row_number().over(Window.partitionBy("_own_key", *(f"_{x}" for x in keys)).orderBy(F.xxhash64("row.text")))
        shared = F.floor(F.col("_k") / F.col("_c")) + F.when(number <= F.col("_k") % F.col("_c"), 1).otherwise(0)
        each = each.union(met(repeated).withColumn("_copies", shared).where("_copies > 0"))
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
