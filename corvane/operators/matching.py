"""Matching of rows, files and recordings by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.events import numbered
from corvane.storage import cut


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in order (a single-row aggregate, no window over the group)."""
    named = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*named), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


#: Recordings that are broadcast to the rows at most; beyond, they are joined by shuffle.
MAX_BROADCAST_KEYS = 200_000


def match_recordings(rows: DataFrame, recordings: DataFrame, key: str, id_col: str, default_id: int | None = None) -> DataFrame:
    """Add the id of the recording with the row's key; null or the default where there is none.

    Blank keys match nothing. Where the recordings are too many to be broadcast, rows with blank keys
    go round the join, so that they do not gather in one task.
    """
    ids = cut(first_per(recordings.select(key, id_col).where(F.col(key) != ""), [key], [id_col]))
    if ids.count() <= MAX_BROADCAST_KEYS:
        out = rows.join(F.broadcast(ids), key, "left")
    else:
        named = rows.where(F.col(key) != "").join(ids, key, "left")
        blank = rows.where(F.coalesce(F.col(key) == "", F.lit(True))).withColumn(id_col, F.lit(None).cast(ids.schema[id_col].dataType))
        out = named.unionByName(blank)
    return out.withColumn(id_col, F.coalesce(id_col, F.lit(default_id))) if default_id is not None else out


def unmatched_refs(rows: DataFrame, recordings: DataFrame, key: str, name: str) -> DataFrame:
    """Names that rows mention but no recording has, with their number of rows."""
    return rows.join(recordings.select(key).distinct(), key, "left_anti").groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))


def orphans(recordings: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Recordings that no row mentions."""
    return recordings.join(rows.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def pair_by_name(recordings: DataFrame, tables: DataFrame) -> DataFrame:
    """Best table of each recording with the same folder and key: name with 'event', then CSV, then name."""
    low = F.lower("table_name")
    order = [(~low.contains("event")).alias("o1"), (~low.endswith(".csv")).alias("o2"), F.col("table_name").alias("o3")]
    found = recordings.join(tables, ["folder", "key"])
    return first_per(found.select("rec_id", "table_name"), ["rec_id"], order)


def pair_by_content(recordings: DataFrame, named: DataFrame) -> DataFrame:
    """Tables that name exactly one recording's key; each recording takes the first such table.

    recordings: rec_id, key (those still without a table); named: table_name, key (unused tables).
    """
    single = named.groupBy("table_name").agg(F.min("key").alias("key"), F.max("key").alias("_last")).where("key = _last").select("table_name", "key")
    found = recordings.join(single, "key").select("rec_id", "table_name")
    return first_per(first_per(found, ["table_name"], ["rec_id"]), ["rec_id"], ["table_name"])


def unused_reasons(tables: DataFrame, used: DataFrame) -> DataFrame:
    """Why a table was not taken: tables has readable, has_column, n_named and in_folder."""
    reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(~F.col("has_column"), "no file column")
        .when(F.col("n_named") > 1, "several files")
        .when(~F.col("in_folder"), "not in folder")
        .otherwise("duplicate")
    )
    return tables.join(used, "table_name", "left_anti").select("table_name", reason.alias("reason"))


def import_plan(files: DataFrame, experiments: DataFrame, recordings: DataFrame, events: DataFrame) -> DataFrame:
    """Each file with what is there already: exists, differs (event counts) and selected.

    files: name, key, experiment, n_events; experiments: experiment, exp_id; recordings: exp_id,
    key, rec_id; events: rec_id.
    """
    counts = events.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_have"))
    plan = files.join(experiments, "experiment", "left").join(recordings, ["exp_id", "key"], "left").join(counts, "rec_id", "left")
    exists = F.col("rec_id").isNotNull()
    differs = exists & (F.coalesce("n_have", F.lit(0)) != F.col("n_events"))
    return plan.select("name", "experiment", exists.alias("exists"), differs.alias("differs"), (~exists & (F.col("n_events") > 0)).alias("selected"))


def plan_by_experiment(plan: DataFrame) -> DataFrame:
    """(experiment, n_files, n_selected, n_exists, n_differs, conditions): the plan (with condition) grouped.

    conditions: map from each condition (blank and null: other) to its files.
    """
    condition = F.coalesce(F.nullif(F.trim("condition"), F.lit("")), F.lit("other"))
    counts = plan.groupBy("experiment", condition.alias("condition")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in ("selected", "exists", "differs")])
    pairs = F.array_sort(F.collect_list(F.struct("condition", "n")))  # an experiment's few conditions
    return counts.groupBy("experiment").agg(F.sum("n").alias("n_files"), *[F.sum(c).alias(f"n_{c}") for c in ("selected", "exists", "differs")], F.map_from_entries(pairs).alias("conditions"))


def route_rows(rows: DataFrame, recordings: DataFrame, key: str) -> DataFrame:
    """Each row with the experiment of the first recording that has its key (null: unmatched)."""
    first = first_per(recordings.select(key, "exp_id", "rec_id"), [key], ["rec_id"])
    return rows.join(first.select(key, "exp_id"), key, "left")


def register_recordings(new: DataFrame, known: DataFrame, replace: bool = False) -> DataFrame:
    """What happens to each new (exp_id, stem): insert, update, or reject with a reason.

    Only the first of repeated new names counts, the others are rejected as repeats; a known
    recording is updated if it is a placeholder (status missing) or replace is set.
    """
    n = F.row_number().over(Window.partitionBy("exp_id", "stem").orderBy("file_name"))
    joined = new.withColumn("_n", n).join(known.select("exp_id", "stem", "status"), ["exp_id", "stem"], "left")
    action = (
        F.when(F.col("_n") > 1, "reject: repeated in batch")
        .when(F.col("status").isNull(), "insert")
        .when((F.col("status") == "missing") | F.lit(replace), "update")
        .otherwise("reject: already there")
    )
    return joined.select("exp_id", "stem", "file_name", action.alias("action"))


def registered(new: DataFrame, known: DataFrame, next_id: int, replace: bool = False) -> DataFrame:
    """The recordings (rec_id, exp_id, stem, file_name, status, error, condition) after new ones are registered.

    new: exp_id, stem, file_name, condition. Inserted ones are pending and numbered from next_id in order of
    experiment and stem; updated ones keep their id and become pending, with the new name and condition and
    no error; all others stay. Registering the same again changes nothing (unless replace is set).
    """
    acts = register_recordings(new.select("exp_id", "stem", "file_name"), known, replace)
    conditions = first_per(new.select("exp_id", "stem", "file_name", "condition"), ["exp_id", "stem", "file_name"], ["condition"])
    named = acts.join(conditions, ["exp_id", "stem", "file_name"], "left")
    pending = lambda df: df.withColumn("status", F.lit("pending")).withColumn("error", F.lit(None).cast("string"))
    inserted = pending(numbered(named.where("action = 'insert'"), ["exp_id", "stem"], "rec_id").withColumn("rec_id", (F.col("rec_id") + next_id - 1).cast("long")))
    changes = named.where("action = 'update'").select("exp_id", "stem", F.col("file_name").alias("_file"), F.col("condition").alias("_condition"), F.lit(True).alias("_new"))
    kept = known.join(changes, ["exp_id", "stem"], "left")
    is_new = F.coalesce("_new", F.lit(False))
    swap = {"file_name": F.col("_file"), "condition": F.col("_condition"), "status": F.lit("pending"), "error": F.lit(None).cast("string")}
    kept = kept.withColumns({c: F.when(is_new, v).otherwise(F.col(c)) for c, v in swap.items()})
    names = ["rec_id", "exp_id", "stem", "file_name", "status", "error", "condition"]
    return kept.select(*names).unionByName(inserted.select(*names))
