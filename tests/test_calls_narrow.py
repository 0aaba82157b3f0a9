"""What a round counts and orders has no texts."""

from folioscope.operators import calls


def test_texts_are_not_numbered(spark, tmp_path, monkeypatch):
    seen, real = [], calls.accumulated
    monkeypatch.setattr(calls, "accumulated", lambda rows, *a, **k: (seen.append(rows.columns), real(rows, *a, **k))[1])
    asks = spark.createDataFrame([(i, "p", "s", f"text {i % 7}") for i in range(12)], "ask_id long, purpose string, system string, payload string")
    out = calls.Calls(spark, str(tmp_path / "log"), lambda s, p, n, k: ('{"of": "%s"}' % p, 1, 1), calls.Policy(per_task=3)).complete(asks)
    assert sorted((r.ask_id, r.status, r.content, r.calls) for r in out.collect()) == [(i, "ok", '{"of": "text %d"}' % (i % 7), 1) for i in range(12)]
    assert seen and not any({"system", "payload"} & set(c) for c in seen)
