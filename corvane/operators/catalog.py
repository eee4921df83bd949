"""Experiments, sets, runs and files: exports, memberships and what there is of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.events import numbered
from corvane.operators.filters import feature_usability


def exclude_points(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not excluded; a null in a key is excluded by nothing."""
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti").select(df.columns)


def display_name(cluster: Column, name: Column) -> Column:
    """C and the number, with the custom name in brackets where there is one (blank: none)."""
    plain = F.concat(F.lit("C"), cluster.cast("string"))
    return F.coalesce(F.concat(plain, F.lit(" ("), F.nullif(F.trim(name), F.lit("")), F.lit(")")), plain)


def cluster_names(rows: DataFrame, names: DataFrame, keys: list[str], cluster: str = "cluster") -> DataFrame:
    """Add label, the display name of each row's cluster; names (keys, name) has one row a key at most."""
    return rows.join(names.select(*keys, "name"), keys, "left").withColumn("label", display_name(F.col(cluster), F.col("name"))).drop("name")


def labels_export(labels: DataFrame, events: DataFrame, sets: DataFrame, recordings: DataFrame, names: DataFrame) -> DataFrame:
    """set_name, file_name, number and label of each labelled event, in that order.

    labels: run, event, cluster; events: event, set_id, rec_id, number; sets: set_id, set_name;
    recordings: rec_id, file_name; names: run, cluster, name. Events without set or recording keep nulls.
    """
    named = cluster_names(labels.join(events, "event"), names, ["run", "cluster"])
    rows = named.join(sets, "set_id", "left").join(recordings.select("rec_id", "file_name"), "rec_id", "left")
    return rows.select("run", "set_name", "file_name", "number", "label").orderBy("set_name", "file_name", F.col("number").asc_nulls_last(), "label", "run")


def edit_history(log: DataFrame, events: DataFrame, recordings: DataFrame) -> DataFrame:
    """The log with each event's number and file name, which are null for events that are gone."""
    known = events.select("event", "number", "rec_id").join(recordings.select("rec_id", "file_name"), "rec_id", "left").drop("rec_id")
    return log.join(known, "event", "left")


def visible_experiments(experiments: DataFrame, access: DataFrame, user, is_admin: bool = False) -> DataFrame:
    """What a user may see: all for an admin, else unrestricted ones and those listed for the user.

    experiments: exp_id, restricted; access: exp_id, user. Null restricted is unrestricted.
    """
    if is_admin:
        return experiments
    mine = access.where(F.col("user") == user).select("exp_id").distinct().withColumn("_mine", F.lit(True))
    seen = ~F.coalesce("restricted", F.lit(False)) | F.coalesce("_mine", F.lit(False))
    return experiments.join(mine, "exp_id", "left").where(seen).select(experiments.columns)


def runs_with_set_names(runs: DataFrame, sets: DataFrame, set_id) -> DataFrame:
    """run, names of its sets in their order, and uses: whether set_id is among them.

    runs: run, set_ids (a JSON list); sets: set_id, set_name. Unknown sets have no name; a run without
    a known set is left out.
    """
    listed = runs.select("run", F.posexplode(F.from_json("set_ids", "array<long>")).alias("p", "set_id"))
    found = listed.join(sets.select("set_id", "set_name"), "set_id")
    ordered = F.array_sort(F.collect_list(F.struct("p", "set_name")))["set_name"]
    return found.groupBy("run").agg(F.array_join(ordered, ", ").alias("names"), F.bool_or(F.col("set_id") == set_id).alias("uses"))


def files_used_in(files: DataFrame, experiments: DataFrame) -> DataFrame:
    """stem, the names of the experiments that have it, and its number of files (files: stem, exp_id)."""
    rows = files.join(experiments.select("exp_id", "exp_name"), "exp_id")
    return rows.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_set("exp_name")), ", ").alias("experiments"), F.count(F.lit(1)).alias("n"))


def best_bic(models: DataFrame) -> DataFrame:
    """k and bic of the model with the least BIC, the least k of equal ones (k, bic)."""
    return models.agg(F.min_by("k", F.struct("bic", "k")).alias("k"), F.min("bic").alias("bic"))


def recent_runs(runs: DataFrame, latest: int, status: str = "done") -> DataFrame:
    """The latest finished runs, newest first and by run where times are equal (run, at, status)."""
    return runs.where(F.col("status") == status).orderBy(F.desc("at"), "run").limit(latest).select("run", "at")


def pool_files(tables: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All tables as one: source_file, source_row (from 0 in the given order) and every column, null where absent."""
    files = [numbered(df, order, "_row").select(F.lit(name).alias("source_file"), (F.col("_row") - 1).alias("source_row"), *df.columns) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files)


def common_features(a: DataFrame, b: DataFrame, group: str, features: list[str], least: int = 3) -> list[str]:
    """Features usable in both groups, in the given order; ValueError if they are fewer than least."""

    def usable(df):
        return {r["feature"] for r in feature_usability(df, group, features).where("reason = 'usable'").select("feature").distinct().collect()}

    both = usable(a) & usable(b)
    if len(both) < least:
        raise ValueError(f"{least} common features are needed, there are {len(both)}")
    return [f for f in features if f in both]


def side_by_side(a: DataFrame, b: DataFrame, label: str = "grp") -> DataFrame:
    """Both groups' rows under the label A or B, nothing matched between them."""
    return a.withColumn(label, F.lit("A")).unionByName(b.withColumn(label, F.lit("B")), allowMissingColumns=True)


def pending_work(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet, by key."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti").select(todo.columns)


def experiment_stats(experiments: DataFrame, recordings: DataFrame, sets: DataFrame, reports: DataFrame) -> DataFrame:
    """Per experiment its recordings, bytes, ready recordings, sets and reports, 0 where there are none.

    recordings: exp_id, size, status; sets and reports: exp_id.
    """
    r = recordings.groupBy("exp_id").agg(F.count(F.lit(1)).alias("recordings"), F.sum("size").alias("bytes"), F.count_if(F.col("status") == "ready").alias("ready"))
    s = sets.groupBy("exp_id").agg(F.count(F.lit(1)).alias("sets"))
    p = reports.groupBy("exp_id").agg(F.count(F.lit(1)).alias("reports"))
    return experiments.select("exp_id").join(r, "exp_id", "left").join(s, "exp_id", "left").join(p, "exp_id", "left").na.fill(0)


def set_stats(events: DataFrame, by: list[str]) -> DataFrame:
    """Live events, time of the last edit and number of authors per set, or per set and recording.

    events: deleted, updated_at, author and the keys; deleted events count as edits, null authors do not.
    """
    return events.groupBy(*by).agg(F.count_if(~F.col("deleted")).alias("live"), F.max("updated_at").alias("last_edit"), F.count_distinct("author").alias("authors"))


def inventory(files: DataFrame) -> DataFrame:
    """Per experiment what deleting or exporting it covers: files, owned ones and their bytes (exp_id, owned, size)."""
    return files.groupBy("exp_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("owned").alias("owned"), F.coalesce(F.sum(F.when(F.col("owned"), F.col("size"))), F.lit(0)).alias("bytes"))


def condition_counts(recordings: DataFrame) -> DataFrame:
    """Recordings per experiment and condition; blank and missing ones are other."""
    condition = F.coalesce(F.nullif(F.trim("condition"), F.lit("")), F.lit("other"))
    return recordings.groupBy("exp_id", condition.alias("condition")).agg(F.count(F.lit(1)).alias("n"))


def named_files(rows: DataFrame, table: str, name: str) -> DataFrame:
    """Per table the number of distinct names that it mentions, and the first of them; nulls are no names."""
    return rows.select(table, name).distinct().groupBy(table).agg(F.count(name).alias("n_named"), F.min(name).alias("first_named"))


def channel_roles(channels: Column, fixed: Column | None = None) -> Column:
    """A struct with the channel numbers of the electrical, optical and reference role.

    channels: array of (index, name, units). A role comes from fixed (a struct of the same fields) where
    that has it. Else, with units in any case: electrical is the first channel in amperes (units with pa,
    or that end in a), or channel 0; with channels in volts, the reference is the first of them with ref in
    its name, else the second, else the only one, and the optical one the first that is not the reference
    (or the only one); without volts, optical and reference are the first two other channels, or as many
    as there are. None is beyond the last channel.
    """
    last = F.size(channels) - 1
    units = lambda c: F.lower(F.coalesce(c["units"], F.lit("")))
    nth = lambda found, n: F.get(found, F.lit(n))["index"]
    electrical = F.coalesce(nth(F.filter(channels, lambda c: units(c).contains("pa") | units(c).endswith("a")), 0), F.lit(0))
    volts = F.filter(channels, lambda c: units(c) == "v")
    named = F.filter(volts, lambda c: F.lower(F.coalesce(c["name"], F.lit(""))).contains("ref"))
    reference = F.coalesce(nth(named, 0), nth(volts, 1), nth(volts, 0))
    optical = F.when(nth(volts, 0) != reference, nth(volts, 0)).otherwise(F.coalesce(nth(volts, 1), nth(volts, 0)))
    others = F.filter(channels, lambda c: c["index"] != electrical)
    plain = F.coalesce(nth(others, 0), electrical)
    found = {
        "electrical": electrical,
        "optical": F.when(F.size(volts) > 0, optical).otherwise(plain),
        "reference": F.when(F.size(volts) > 0, reference).otherwise(F.coalesce(nth(others, 1), plain)),
    }
    given = lambda role: [fixed[role]] if fixed is not None else []
    return F.struct(*[F.least(F.coalesce(*given(role), c), last).alias(role) for role, c in found.items()])


def json_columns(df: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """Add out, the parsed JSON text (null where it does not parse), and out_json, its text again."""
    parsed = df.withColumn(out, F.from_json(column, schema))
    return parsed.withColumn(f"{out}_json", F.to_json(out))
