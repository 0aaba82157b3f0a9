"""Calls of a model against a service that fails at times."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators.calls import REPAIR, Calls, Policy

ASK = "ask_id long, purpose string, system string, payload string"


def service(folder, fails=None, broken=(), dead=()):
    """Answers {"n": length}; the first `fails[payload]` calls of a payload fail by rate; each call leaves a file, so that they can
    be counted over all workers."""

    class Failure(Exception):
        def __init__(self, status_code, text):
            super().__init__(text)
            self.status_code = status_code

    def provider(system, payload, most_output, key):
        with open(os.path.join(folder, key.replace("/", "_") + os.urandom(4).hex()), "w") as f:
            f.write(payload)
        seen = sum(open(os.path.join(folder, x)).read() == payload for x in os.listdir(folder))
        if payload in dead:
            raise Failure(401, "no such key")
        if seen <= (fails or {}).get(payload, 0):
            raise Failure(429, "rate limit")
        if system == REPAIR:
            return json.loads(payload)["invalid_json"] + "}", 5, 2
        answer = '{"n": %d}' % len(payload)
        return (answer[:-1] if payload in broken else answer), len(payload) // 4 + 1, 10

    return provider


def asks(spark, *payloads):
    return spark.createDataFrame([(i, "summary", "Summarise.", p) for i, p in enumerate(payloads)], ASK)


def answers(df):
    return {r["ask_id"]: (r["status"], r["content"], r["calls"], r["repairs"]) for r in df.collect()}


def made(folder):
    return len(os.listdir(folder))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls")


def test_failures_pass_and_nothing_is_paid_twice(spark, tmp_path, folder):
    pauses = []
    work = Calls(spark, str(tmp_path / "log"), service(folder, {"bb": 2, "ccc": 9}, broken={"dddd"}), Policy(retries=3, per_task=2), pauses.append)
    table = asks(spark, "a", "bb", "ccc", "dddd", "a", None)
    got = answers(work.complete(table))
    assert got == {0: ("ok", '{"n": 1}', 1, 0), 1: ("ok", '{"n": 2}', 3, 0), 2: ("rate_limited", None, 4, 0), 3: ("ok", '{"n": 4}', 2, 1), 4: ("ok", '{"n": 1}', 1, 0), 5: ("ok", '{"n": 0}', 1, 0)}
    assert pauses == [1.0, 2.0, 4.0] and made(folder) == 11
    usage = {r["purpose"]: (r["calls"], r["failed"]) for r in work.usage().collect()}
    assert usage == {"summary": (10, 6), "json_repair": (1, 0)}
    # another run calls only what wasn't answered
    later = Calls(spark, str(tmp_path / "log"), service(folder), Policy(retries=0), pauses.append)
    again = answers(later.complete(table))
    assert again[2] == ("ok", '{"n": 3}', 5, 0) and {k: v for k, v in again.items() if k != 2} == {k: v for k, v in got.items() if k != 2}
    assert made(folder) == 12


def test_the_budget_holds_over_tasks(spark, tmp_path, folder):
    table = asks(spark, *(f"text {i:03d}" for i in range(40)))
    work = Calls(spark, str(tmp_path / "a"), service(folder), Policy(most_calls=17, per_round=10, per_task=1), lambda s: None)
    got = answers(work.complete(table))
    assert made(folder) == 17 == sum(v[0] == "ok" for v in got.values()) and work.stopped == "budget"
    assert {v[0] for v in got.values()} == {"ok", "not_asked"}
    # what a call can cost at most: (5 + 10) tokens at these prices
    price = Policy(most_cost=60 * 15 / 1e6, input_price=15.0, output_price=15.0, most_output=10, per_task=1)
    work = Calls(spark, str(tmp_path / "b"), service(folder), price, lambda s: None)
    n = sum(v[0] == "ok" for v in answers(work.complete(table)).values())
    assert 0 < n < 40 and work.usage().first()["cost"] <= price.most_cost
    tokens = Calls(spark, str(tmp_path / "c"), service(folder), Policy(most_input_tokens=20, per_task=1), lambda s: None)
    assert 0 < sum(v[0] == "ok" for v in answers(tokens.complete(table)).values()) <= 6


def test_a_refused_key_ends_the_run(spark, tmp_path, folder):
    work = Calls(spark, str(tmp_path / "log"), service(folder, dead={"x", "y", "z"}), Policy(per_round=1), lambda s: None)
    got = answers(work.complete(asks(spark, "x", "y", "z")))
    assert made(folder) == 1 and work.stopped == "auth" and sorted(v[0] for v in got.values()) == ["auth", "not_asked", "not_asked"]
    assert answers(Calls(spark, str(tmp_path / "log"), service(folder), Policy()).complete(asks(spark, "x")))[0][0] == "ok"


def test_output_that_cant_be_repaired(spark, tmp_path):
    work = Calls(spark, str(tmp_path / "log"), lambda system, payload, most, key: ("[1]", 1, 1), Policy(repairs=2))
    assert answers(work.complete(asks(spark, "x")))[0][0] == "invalid_output"
    assert work.log().count() == 2  # the second repair would ask the same again
    assert work.complete(asks(spark, "x").where(F.lit(False))).count() == 0
