"""Reading and writing: event tables, messy CSV, file lists, recordings, bundles."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.names import unique_names
from corvane.operators.events import numbered

ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def read_event_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with a header each, all columns as text, with source_file; other extensions are an error.

    Files are read together per distinct header and the groups joined by column name.
    """
    bad = [p for p in paths if not p.lower().rstrip("/").endswith(".csv")]
    if bad:
        raise ValueError(f"unsupported files: {', '.join(bad)}")
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        groups.setdefault(tuple(spark.read.option("header", True).csv(p).columns), []).append(p)
    out = None
    for files in groups.values():
        df = spark.read.option("header", True).csv(files).select("*", F.col("_metadata.file_name").alias("source_file"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def decode_table(data: bytes, encodings=ENCODINGS) -> tuple[list[dict[str, str]], str | None]:
    """Rows of one CSV file of unknown encoding and delimiter, or an error text."""
    for encoding in encodings:
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        return [], "unknown encoding"
    lines = text.splitlines()
    if not lines or not lines[0].strip():
        return [], "no header"
    # The delimiter that the header has and that most of the first lines have as often; then the more frequent one.
    some = [x for x in lines[:20] if x.strip()]
    delimiter = max(",;\t|", key=lambda d: (lines[0].count(d) > 0, sum(x.count(d) == lines[0].count(d) for x in some), lines[0].count(d)))
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    header = [h.strip() for h in rows[0]]
    return [dict(zip(header, r, strict=False)) for r in rows[1:] if any(x.strip() for x in r)], None


def read_messy_csv(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(file, row_no, values map, error): a bad file gives one row with its error, never a failed job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, error = decode_table(bytes(content))
                if error:
                    yield pd.DataFrame({"file": [path], "row_no": [None], "values": [None], "error": [error]})
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    yield pd.DataFrame({"file": path, "row_no": range(at + 2, at + 2 + len(some)), "values": some, "error": None})

    return files.select("path", "content").mapInPandas(parse, "file string, row_no long, values map<string,string>, error string")


def list_files(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """path, name and size of files with these extensions (also double ones), without hidden names, sorted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    wanted = reduce(lambda a, b: a | b, [F.lower(name).endswith(x.lower()) for x in extensions])
    return files.where(wanted & ~name.startswith(".") & ~F.col("path").rlike("/[.][^/]+/")).select("path", name.alias("name"), F.col("length").alias("size")).orderBy("path")


def write_results(tables: dict[str, DataFrame], root: str, form: str = "parquet") -> None:
    """Each table under its name, with a header where the form has one."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(form).save(f"{root}/{name}")


def write_partitioned(df: DataFrame, root: str, by: str, form: str = "parquet") -> None:
    """One folder per value of a column; rows of a value are spread over tasks, not gathered."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).format(form).save(root)


def export_bundle(events: DataFrame, recordings: DataFrame, root: str, experiment: str = "experiment") -> None:
    """Events as JSON lines with their recording's file name, and the recordings and the experiment's name as manifest."""
    named = events.join(recordings.select("rec_id", "file_name"), "rec_id").drop("rec_id")
    named.write.mode("overwrite").json(f"{root}/events")
    recordings.select("file_name", "duration", F.lit(experiment).alias("experiment")).write.mode("overwrite").json(f"{root}/manifest")


def bundle_experiment(spark: SparkSession, root: str, experiments: DataFrame) -> str:
    """A name for the bundle's experiment that none of experiments (experiment) has."""
    base = spark.read.schema("experiment string").json(f"{root}/manifest").first()["experiment"]
    new = spark.createDataFrame([(base, 1)], "name string, n int")
    return unique_names(new, "name", ["n"], taken=experiments.select(F.col("experiment").alias("name"))).first()["unique_name"]


def import_bundle(spark: SparkSession, root: str, recordings: DataFrame, next_id: int) -> DataFrame:
    """The bundle's events under the ids of recordings here with the same file name; others are skipped.

    Events are numbered from next_id by recording, then by their old id and set.
    """
    events = spark.read.json(f"{root}/events")
    found = events.join(recordings.select("rec_id", "file_name"), "file_name").drop("file_name")
    return numbered(found, ["rec_id", "id", "set_id"], "_n").withColumn("id", (F.lit(next_id - 1) + F.col("_n")).cast("long")).drop("_n")
