"""Packs by commands: what each rule allows, and two writers."""

from datetime import datetime

import pytest

from folioscope.operators import packs as pk
from folioscope.sources.sinks import OutdatedWriter

AT = datetime(2024, 1, 1)


def command(i, kind, pack, revision=None, repository="r", title="T", slots=None, items=None):
    return (i, kind, pack, repository, revision, title, " g ", slots, items, AT)


def item(i, node, slot="a", state="pending"):
    return (i, node, slot, state)


def test_every_rule(spark, tmp_path):
    store = pk.Packs(spark, str(tmp_path))
    run = lambda *rows: {r["command_id"]: r["outcome"] for r in store.apply(spark.createDataFrame(list(rows), pk.COMMAND)).collect()}
    assert run(command(1, "create", "p", title="  "), command(2, "create", "p"), command(3, "create", "q", repository="s"), command(4, "save", "none", 1)) == {1: "done", 2: "exists", 3: "done", 4: "not_found"}
    first = {r["pack_id"]: r for r in store.read().collect()}
    assert (first["p"]["revision"], first["p"]["lifecycle"], first["p"]["title"], first["p"]["goal"], first["p"]["slots"]) == (1, "draft", "Untitled", "g", list(pk.DEFAULT_SLOTS))
    good = [item("i1", "n1"), item("i2", "n2", "b", "accepted")]
    assert run(
        command(1, "save", "p", 2, slots=["a", "b"], items=good), command(2, "save", "q", 1, slots=["a"], items=[]), command(3, "create", "p"),
        command(4, "archive", None, 1), command(5, "save", "q", 1, repository="s", slots=["a", "a"], items=[]),
    ) == {1: "conflict", 2: "other_repository", 3: "exists", 4: "not_found", 5: "conflict"}
    for slots, items, want in (
        (["a", "a"], [], "duplicate_slots"), ([], [], "no_slots"), (None, None, "no_slots"), (["a"], [item("i", "n"), item("i", "m")], "duplicate_items"),
        (["a"], [item("i", "n"), item("j", "n")], "duplicate_nodes"), (["a"], [item("i", "n", "z")], "unknown_slot"), (["a"], [item("i", "n", None)], "unknown_slot"),
    ):
        assert run(command(1, "save", "p", 1, slots=slots, items=items)) == {1: want}
    assert run(command(1, "save", "p", 1, slots=["a", "b"], items=good, title=" New "), command(2, "save", "p", 2, slots=["a"], items=[])) == {1: "done", 2: "conflict"}
    row = pk.listed(store.read(), "r").first()
    assert (row["revision"], row["lifecycle"], row["title"], row["n_items"], row["n_pending"], row["writable"]) == (2, "saved", "New", 2, 1, True)
    assert run(command(1, "archive", "p", 2, title="ignored")) == {1: "done"}
    assert pk.listed(store.read(), "r").count() == 0 and pk.listed(store.read(), "r", archived=True).first()["title"] == "New"
    assert store.read().where("pack_id = 'p'").first()["created_at"] == AT and store.read().count() == 2


def test_newer_packs_are_left_alone(spark):
    packs = spark.createDataFrame([("p", "r", 2, 1, "draft", "t", "", ["a"], [], AT, AT)], pk.PACK)
    got = pk.outcomes(packs, spark.createDataFrame([command(1, "archive", "p", 1)], pk.COMMAND)).first()
    assert got["outcome"] == "newer_schema" and pk.listed(packs, "r").first()["writable"] is False


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = pk.Packs(spark, str(tmp_path)), pk.Packs(spark, str(tmp_path))
    table = lambda *rows: spark.createDataFrame(list(rows), pk.COMMAND)
    one.apply(table(command(1, "create", "p")))
    changed = pk.changed

    def meanwhile(*a):
        monkeypatch.setattr(pk, "changed", changed)
        two.apply(table(command(1, "archive", "p", 1)))
        return changed(*a)

    monkeypatch.setattr(pk, "changed", meanwhile)
    with pytest.raises(OutdatedWriter):
        one.apply(table(command(1, "save", "p", 1, slots=["a"], items=[])))
    assert one.read().first()["lifecycle"] == "archived"
