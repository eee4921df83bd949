"""Event sets: numbering, copies, re-imports, edit logs and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.events import numbered


def number_events(new: DataFrame, existing: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """Given numbers stay; missing ones go on after the highest number of the key (deleted ones count)."""
    highest = existing.select(*keys, number).unionByName(new.select(*keys, number)).groupBy(*keys).agg(F.max(number).alias("_top"))
    missing = new.where(F.col(number).isNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    filled = missing.join(highest, keys, "left").withColumn(number, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast(new.schema[number].dataType))
    return new.where(F.col(number).isNotNull()).unionByName(filled.drop("_n", "_top"))


def list_events(events: DataFrame, set_id=None, recording_id=None, include_deleted: bool = False) -> DataFrame:
    """Events of a set, optionally one recording, by recording, number (missing last) and id."""
    picked = events if set_id is None else events.where(F.col("set_id") == set_id)
    picked = picked if recording_id is None else picked.where(F.col("recording_id") == recording_id)
    picked = picked if include_deleted else picked.where("not deleted")
    return picked.orderBy("recording_id", F.col("number").asc_nulls_last(), "id")


def copy_set(events: DataFrame, set_id: int, new_id: int, next_event_id: int, id_order: list[str]) -> DataFrame:
    """Live events of a set under a new set id; ids go on from next_event_id, numbers stay."""
    live = events.where((F.col("set_id") == set_id) & ~F.col("deleted"))
    placed = numbered(live, id_order, "_n")
    return placed.withColumn("id", (F.lit(next_event_id - 1) + F.col("_n")).cast("long")).drop("_n").withColumn("set_id", F.lit(new_id).cast(events.schema["set_id"].dataType))


def insert_log(events: DataFrame, action: str, user: str, at: float, fields: list[str]) -> DataFrame:
    """The log rows of inserted events (id, set_id and fields): one each, with the fields as JSON after the insert."""
    return events.select(F.col("id").alias("event"), "set_id", F.lit(action).alias("action"), F.lit(user).alias("username"), F.lit(at).alias("at"), F.to_json(F.struct(*fields)).alias("after_json"))


def latest_edit(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last log row of each key, as one aggregate per key."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def fold_history(history: DataFrame) -> DataFrame:
    """Current state from an edit log: (event, at, action, changes map<string,string>).

    Per event and field the last written value counts, written nulls included. The first delete is
    final: later rows of the event are refused, they change nothing and count for no version.
    """
    gone = history.where("action = 'delete'").groupBy("event").agg(F.min("at").alias("_gone"))
    valid = history.join(gone, "event", "left").where(F.col("_gone").isNull() | (F.col("at") <= F.col("_gone")))
    # A row for each field, and one without for the counts.
    entries = F.coalesce(F.map_entries("changes"), F.array().cast("array<struct<key:string,value:string>>"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = valid.select("event", "at", "_gone", F.explode(F.concat(none, entries)).alias("e"))
    fields = rows.groupBy("event", F.col("e.key").alias("field")).agg(F.max_by(F.struct("e.value"), F.col("at")).alias("v"), F.count(F.lit(1)).alias("n"), F.max(F.col("_gone").isNotNull()).alias("deleted"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "v.value"))))  # a field each
    whole = fields.groupBy("event").agg(F.max(F.when(F.col("field").isNull(), F.col("n"))).alias("version"), F.max("deleted").alias("deleted"), pairs.alias("p"))
    return whole.select("event", "version", "deleted", F.when(F.size("p") > 0, F.map_from_entries("p")).alias("state"))


def set_revisions(history: DataFrame) -> DataFrame:
    """Bumps per set: one per insert call (set, action, at) and one per update or delete."""
    bulk = F.col("action").isin("create", "import", "copy")
    return history.groupBy("set_id").agg((F.count_distinct(F.when(bulk, F.struct("action", "at"))) + F.count_if(~bulk)).alias("revision"))


def exclude_clusters(df: DataFrame, clusters: list[int], excluded: DataFrame, keys: list[str]) -> DataFrame:
    """The exclusion set with the members of the clusters added."""
    members = df.where(F.col("cluster").isin(clusters)).select(*keys)
    return excluded.select(*keys).union(members).distinct()


def exclusion_log(df: DataFrame, clusters: list[int], excluded: DataFrame, keys: list[str]) -> DataFrame:
    """One row: clusters, the members they have, how many of these are new to the exclusion set, and its size then."""
    members = df.where(F.col("cluster").isin(clusters)).select(*keys).distinct().withColumn("_member", F.lit(True))
    before = excluded.select(*keys).distinct().withColumn("_before", F.lit(True))
    both = members.join(before, keys, "full")
    is_member, was = F.col("_member").isNotNull(), F.col("_before").isNotNull()
    names = F.array(*[F.lit(c) for c in sorted(clusters)]).cast("array<int>")
    return both.agg(F.count_if(is_member).alias("members"), F.count_if(is_member & ~was).alias("n_new"), F.count(F.lit(1)).alias("total")).select(names.alias("clusters"), "members", "n_new", "total")


def reimport_events(existing: DataFrame, incoming: DataFrame, key: str, replace: bool) -> DataFrame:
    """Events after a re-import: per recording the existing ones stay; where counts differ and
    replace is asked, they are marked deleted and the incoming ones added; new recordings are added."""
    old = existing.where("not deleted").groupBy(key).agg(F.count(F.lit(1)).alias("_old"))
    new = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
    plan = old.join(new, key, "full").select(key, (F.col("_old").isNull() | (F.lit(replace) & (F.coalesce("_new", F.lit(0)) > 0) & (F.col("_old") != F.col("_new")))).alias("_take"))
    kept = existing.join(plan, key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("_take", F.lit(False))).drop("_take")
    added = incoming.join(plan.where("_take").select(key), key, "left_semi")
    return kept.unionByName(added)


def upsert_names(current: DataFrame, edits: DataFrame, keys: list[str], most: int = 60) -> DataFrame:
    """Names after edits (keys, name, at): the latest wins, a blank one deletes."""
    tidy = F.substring(F.trim(F.regexp_replace("name", r"\s+", " ")), 1, most)
    both = current.withColumn("at", F.lit(-1).cast("long")).unionByName(edits).withColumn("name", tidy)
    return both.groupBy(*keys).agg(F.max_by("name", "at").alias("name")).where("name <> ''")


#: The row by which a run without any label replaces its earlier labels.
NO_LABEL = None


def replace_run_labels(labels: DataFrame, runs: DataFrame, path: str) -> None:
    """Write the labels (run, event, recording, cluster) of these runs into the table at path, instead of
    what it has of them; other runs' files stay as they are, and a repeated write changes nothing.

    runs: (run) all runs that are written; one without labels loses its earlier ones. Of repeated
    (run, event) the last recording and cluster counts. The table is partitioned by run.
    """
    one = labels.groupBy("run", "event").agg(F.max(F.struct("recording", "cluster")).alias("l")).select("run", "event", "l.*")
    empty = runs.select("run").distinct().join(one.select("run").distinct(), "run", "left_anti")
    marks = empty.select("run", *[F.lit(NO_LABEL).cast(one.schema[c].dataType).alias(c) for c in ("event", "recording", "cluster")])
    out = one.join(runs.select("run").distinct(), "run", "left_semi").unionByName(marks)
    out.repartition("run", F.pmod(F.xxhash64("event"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def run_labels(spark: SparkSession, path: str) -> DataFrame:
    """(run, event, recording, cluster) of the table that replace_run_labels writes."""
    return spark.read.parquet(path).where("event is not null").select("run", "event", "recording", "cluster")
