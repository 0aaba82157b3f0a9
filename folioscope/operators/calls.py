"""Calls of a language model over a table of questions, within a budget, answered once and for all.

Every call is a row of a durable log, keyed by the digest of its prompt; an answered prompt is never paid for again, by whichever
run. A run goes in rounds. Which prompts a round calls is settled before it, by running sums of what they can cost at most, so
that the budget holds however many tasks call at once. Within a round a prompt is called once; what failed for a passing reason
comes again in a later round, after a pause that grows with the attempts. A refused key or an empty account ends the run. An
answer that isn't a JSON object is sent back for repair, which is a prompt of its own.

A task that dies within a round loses the answers it had not yet handed over: `per_round` bounds them, and every call carries a
key (digest and attempt) by which a service can tell a repetition.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.numbering import accumulated
from folioscope.operators.sieves import sieve, sifted
from folioscope.plugins import error_code
from folioscope.sources.corpus import durable
from folioscope.sources.sinks import VersionedTables

#: provider(system, payload, most_output, key) gives (content, input tokens, output tokens) or raises.
Provider = Callable[[str, str, int, str], tuple[str, int, int]]
#: Classes of errors that end a run, and those after which a prompt is called again.
FATAL, PASSING = ("auth", "quota"), ("rate_limited", "timeout", "provider_unavailable")
REPAIR = "The user's message holds text that should be one JSON object. Return that object, corrected, and nothing else."
LOG = "digest string, run string, attempt int, purpose string, message string, content string, is_object boolean, input_tokens long, output_tokens long, duration_ms long"


@dataclass(frozen=True)
class Policy:
    model: str = "model"
    prompt_version: str = "1"
    most_calls: int = 10_000  # of a run, repeated ones too
    most_input_tokens: int | None = None
    most_cost: float | None = None
    input_price: float = 0.0  # for a million tokens
    output_price: float = 0.0
    most_output: int = 1_024  # tokens of an answer
    retries: int = 3
    repairs: int = 1
    per_round: int = 1_000
    per_task: int = 50
    longest_pause: float = 8.0


def caller(provider: Provider, policy: Policy, run: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with its prompts(digest, purpose, system, payload, attempts)."""

    def answer(row) -> tuple:
        start, message, content, tokens = time.monotonic(), None, None, (0, 0)
        try:
            content, *tokens = provider(row.system, row.payload, policy.most_output, f"{row.digest}-{row.attempts}")
        except Exception as e:  # whatever a client raises is a row of the log
            message = f"{type(e).__name__} {getattr(e, 'status_code', '')} {e}"[:500]
        try:
            is_object = isinstance(json.loads(content or ""), dict)
        except ValueError:
            is_object = False
        return row.digest, run, int(row.attempts) + 1, row.purpose, message, content, is_object, *map(int, tokens), int(1000 * (time.monotonic() - start))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([answer(row) for row in batch.itertuples()], columns=[c.split()[0] for c in LOG.split(", ")])

    return work


class Calls:
    def __init__(self, spark: SparkSession, root: str, provider: Provider, policy: Policy = Policy(), sleeper: Callable[[float], None] = time.sleep):
        self.spark, self.provider, self.policy, self.sleeper = spark, provider, policy, sleeper
        self.tables, self.run = VersionedTables(spark, root), uuid.uuid4().hex
        self.stopped: str | None = None  # why this run makes no more calls

    def log(self) -> DataFrame:
        """Every call that was ever made, with the class of its error."""
        rows = self.tables.history("calls") if self.tables.version() else self.spark.createDataFrame([], LOG)
        return rows.withColumn("error", F.when(F.col("message").isNotNull(), error_code(F.col("message"))))

    def usage(self) -> DataFrame:
        """(purpose, calls, failed, input_tokens, output_tokens, cost) of this run."""
        p, cost = self.policy, F.sum("input_tokens") * self.policy.input_price + F.sum("output_tokens") * self.policy.output_price
        own = self.log().where(F.col("run") == self.run).groupBy("purpose")
        return own.agg(F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (cost / 1e6).alias("cost")).withColumn("model", F.lit(p.model))

    def digest(self, system: Column, payload: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", F.lit(self.policy.model), F.lit(self.policy.prompt_version), system, payload), 256)

    def _open(self, prompts: DataFrame) -> DataFrame:
        """The prompts that need a call, with the number of calls so far and those of this run."""
        log, own = self.log(), F.col("run") == self.run
        state = log.groupBy("digest").agg(
            F.max(F.col("error").isNull()).alias("answered"), F.count(F.lit(1)).cast("int").alias("attempts"),
            F.count_if(own).alias("tried"), F.max_by("error", F.when(own, F.col("attempt"))).alias("last"),
        )
        met = prompts.join(state, "digest", "left").fillna({"attempts": 0, "tried": 0, "answered": False})
        again = F.col("last").isin(*PASSING) & (F.col("tried") <= self.policy.retries)
        return met.where(~F.col("answered") & ((F.col("tried") == 0) | again)).drop("answered", "last")

    def _round(self, prompts: DataFrame) -> bool:
        """Calls what the budget allows of the prompts that need it; whether there may be more to do."""
        p = self.policy
        own = self.log().where(F.col("run") == self.run)
        calls, tokens, written = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))).first()
        # what is counted, ordered and admitted are rows without texts, which join only what is called
        sizes = prompts.select("digest", "purpose", F.greatest(F.lit(1), F.ceil((F.length("system") + F.length("payload")) / 4)).alias("tokens"))
        todo = durable(self._open(sizes))
        if todo.isEmpty():
            return False
        order = ["tried", "digest"]
        placed = accumulated(accumulated(todo, order, "place"), order, "upto", value=F.col("tokens"))
        allowed = F.col("place") <= min(p.per_round, p.most_calls - calls)
        if p.most_input_tokens is not None:
            allowed &= F.col("upto") + tokens <= p.most_input_tokens
        if p.most_cost is not None:
            worst = (F.col("upto") + tokens) * p.input_price + (F.col("place") * p.most_output + written) * p.output_price
            allowed &= worst / 1e6 <= p.most_cost
        admitted = durable(placed.where(allowed))
        n, tried = admitted.agg(F.count(F.lit(1)), F.min("tried")).first()
        if not n:
            self.stopped = "budget"
            return False
        if tried:
            self.sleeper(min(2.0 ** (tried - 1), p.longest_pause))
        parts = -(-n // p.per_task)
        texts = sifted(prompts.select("digest", "system", "payload"), "digest", sieve(admitted, "digest")).where("_maybe").drop("_maybe").repartition(parts, "digest")
        called = admitted.select("digest", "purpose", "attempts").repartition(parts, "digest").hint("shuffle_hash")
        dealt = texts.join(called, "digest").select("digest", "purpose", "system", "payload", "attempts")
        version = self.tables.commit({"calls": dealt.mapInPandas(caller(self.provider, p, self.run), LOG)})
        made = self.tables.read("calls", version).where("message is not null").select(error_code(F.col("message")).alias("error"))
        fatal = made.where(F.col("error").isin(*FATAL)).limit(1).collect()
        self.stopped = fatal[0]["error"] if fatal else None
        return not fatal

    def complete(self, asks: DataFrame) -> DataFrame:
        """(ask_id, status, content, calls, repairs) of asks(ask_id, purpose, system, payload): status ok, with a JSON object as
        content; invalid_output; the class of the last error; or not_asked, where the run was stopped before. calls are those
        that the prompts of an ask took in all runs. Equal prompts are called once; nulls count as empty texts."""
        text = lambda c: F.coalesce(c, F.lit(""))
        open_ = asks.select("ask_id", "purpose", text("system").alias("system"), text("payload").alias("payload"), F.lit(0).alias("before"))
        out = None
        for level in range(self.policy.repairs + 1):
            open_ = durable(open_.withColumn("digest", self.digest(F.col("system"), F.col("payload"))))
            prompts = durable(open_.select("digest", "purpose", "system", "payload").dropDuplicates(["digest"]))
            while self.stopped is None and self._round(prompts):
                pass
            good = F.col("error").isNull()
            state = self.log().groupBy("digest").agg(
                F.max_by(F.struct("content", "is_object"), F.when(good, F.col("attempt"))).alias("x"), F.max_by("error", "attempt").alias("error"), F.count(F.lit(1)).alias("calls"),
            )
            met = durable(open_.select("ask_id", "digest", "before").join(state, "digest", "left").withColumn("calls", F.col("before") + F.coalesce("calls", F.lit(0))))
            broken = F.col("x.content").isNotNull() & ~F.col("x.is_object")
            more = level < self.policy.repairs
            status = F.when(F.col("x.is_object"), "ok").when(broken, "invalid_output").otherwise(F.coalesce("error", F.lit("not_asked")))
            done = (met.where(~F.coalesce(broken, F.lit(False))) if more else met).select("ask_id", status.alias("status"), F.when(F.col("x.is_object"), F.col("x.content")).alias("content"), "calls", F.lit(level).alias("repairs"))
            out = done if out is None else out.unionByName(done)
            open_ = met.where(broken).select("ask_id", F.lit("json_repair").alias("purpose"), F.lit(REPAIR).alias("system"), F.to_json(F.struct(F.col("x.content").alias("invalid_json"))).alias("payload"), F.col("calls").alias("before"))
            if not more or open_.isEmpty():
                return out
        return out
