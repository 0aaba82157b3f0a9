"""Task packs kept as a table and changed by a relation of commands, any number in one job.

A pack is a row with its slots and items; it's small, so its rules are expressions on its own row. Commands name the revision that
they were made from. Of several commands for a pack in one batch the first counts; the others were made from a revision that is
gone. The new table is committed against the version that it was computed from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources.corpus import durable
from folioscope.sources.sinks import VersionedTables

#: Fixed value: the version of the packs that are written; newer ones are read but not changed.
SCHEMA = 1
ITEM = "struct<item_id:string,node_id:string,slot_id:string,review_state:string>"
PACK = f"pack_id string, repository_id string, schema_version int, revision int, lifecycle string, title string, goal string, slots array<string>, items array<{ITEM}>, created_at timestamp, updated_at timestamp"
#: kind is create, save or archive; only a save needs items and slots. at is when the command was given.
COMMAND = f"command_id long, kind string, pack_id string, repository_id string, expected_revision int, title string, goal string, slots array<string>, items array<{ITEM}>, at timestamp"
DEFAULT_SLOTS = ("background", "evidence", "conclusion")


def fault(slots: Column, items: Column) -> Column:
    """What is wrong with a pack, null if nothing is."""
    twice = lambda values: F.size(values) != F.size(F.array_distinct(values))
    of = lambda name: F.transform(items, lambda x: x[name])
    return (
        F.when(twice(slots), "duplicate_slots").when(F.size(slots) == 0, "no_slots").when(twice(of("item_id")), "duplicate_items")
        .when(twice(of("node_id")), "duplicate_nodes").when(F.exists(items, lambda x: ~F.coalesce(F.array_contains(slots, x["slot_id"]), F.lit(False))), "unknown_slot")
    )


def outcomes(packs: DataFrame, commands: DataFrame, default_slots: tuple[str, ...] = DEFAULT_SLOTS) -> DataFrame:
    """(command_id, pack_id, outcome, pack): done with the pack as it is then, or why not, without one."""
    none = F.array().cast(f"array<{ITEM}>")
    first = F.row_number().over(Window.partitionBy("pack_id").orderBy("command_id"))
    c = commands.withColumn("turn", first).join(packs.select("pack_id", F.struct(*packs.columns).alias("old")), "pack_id", "left")
    is_new, archive = F.col("kind") == "create", F.col("kind") == "archive"
    named = F.when(F.trim("title") != "", F.trim("title")).otherwise("Untitled")
    pick = lambda new, old: F.when(archive, F.col(f"old.{old}")).otherwise(new)
    slots = F.when(is_new, F.array(*map(F.lit, default_slots))).otherwise(pick(F.coalesce("slots", F.array().cast("array<string>")), "slots"))
    items = F.when(is_new, none).otherwise(pick(F.coalesce("items", none), "items"))
    c = c.withColumns({"new_slots": slots, "new_items": items})
    outcome = (
        F.when(F.col("pack_id").isNull(), "not_found")
        .when(is_new & (F.col("old").isNotNull() | (F.col("turn") > 1)), "exists")
        .when(~is_new & F.col("old").isNull(), "not_found")
        .when(~is_new & ~F.col("repository_id").eqNullSafe(F.col("old.repository_id")), "other_repository")
        .when(~is_new & (F.col("old.schema_version") > SCHEMA), "newer_schema")
        .when(~is_new & ((F.col("turn") > 1) | ~F.col("expected_revision").eqNullSafe(F.col("old.revision"))), "conflict")
        .otherwise(F.coalesce(fault(F.col("new_slots"), F.col("new_items")), F.lit("done")))
    )
    made = F.struct(
        "pack_id", "repository_id", F.lit(SCHEMA).alias("schema_version"), F.when(is_new, 1).otherwise(F.col("old.revision") + 1).alias("revision"),
        F.when(is_new, "draft").when(archive, "archived").otherwise("saved").alias("lifecycle"), pick(named, "title").alias("title"),
        pick(F.trim(F.coalesce("goal", F.lit(""))), "goal").alias("goal"), F.col("new_slots").alias("slots"), F.col("new_items").alias("items"),
        F.when(is_new, F.col("at")).otherwise(F.col("old.created_at")).alias("created_at"), F.col("at").alias("updated_at"),
    )
    return c.withColumn("outcome", outcome).select("command_id", "pack_id", "outcome", F.when(F.col("outcome") == "done", made).alias("pack"))


def changed(packs: DataFrame, results: DataFrame) -> DataFrame:
    """The packs after outcomes()."""
    new = results.where("outcome = 'done'").select("pack.*")
    return packs.join(new.select("pack_id"), "pack_id", "left_anti").unionByName(new)


def listed(packs: DataFrame, repository_id: str, archived: bool = False) -> DataFrame:
    """(pack_id, revision, lifecycle, title, goal, n_items, n_pending, updated_at, writable) of a repository's packs."""
    own = packs.where(F.col("repository_id") == repository_id)
    own = own if archived else own.where("lifecycle <> 'archived'")
    pending = F.size(F.filter("items", lambda x: x["review_state"] == "pending"))
    return own.select("pack_id", "revision", "lifecycle", "title", "goal", F.size("items").alias("n_items"), pending.alias("n_pending"), "updated_at", (F.col("schema_version") <= SCHEMA).alias("writable"))


class Packs:
    """The packs as a versioned table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, VersionedTables(spark, root)

    def read(self, version: int | None = None) -> DataFrame:
        return self.tables.read("packs", version) if self.tables.version() else self.spark.createDataFrame([], PACK)

    def apply(self, commands: DataFrame) -> DataFrame:
        """Carries out commands(COMMAND); gives their outcomes, once the new table is published."""
        base = self.tables.version()
        packs = self.read(base or None)
        results = durable(outcomes(packs, commands))
        self.tables.commit({"packs": changed(packs, results), "outcomes": results.drop("pack")}, base=base)
        return results.select("command_id", "pack_id", "outcome")
