"""Names of recordings: keys, parts, slugs and unique names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: Extensions that are cut off, the run number after the date, and the closing condition word.
EXTENSIONS = [".fakeabf.npz", ".abf", ".csv", ".xlsx", ".xls"]
RUN_PATTERN = r"^(\d{4}_\d{2}_\d{2})_(\d{3,5})(?=[\s_-]|$)"
CONDITION_PATTERN = r"(?i)[\s_-]+(DC|AC[\s_-]*AOM|AC|AOM|baseline)$"
UNNAMED = "Unnamed experiment"


def base_name(path: Column) -> Column:
    """The last part of a path, whichever slash divides it."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def without_extension(name: Column) -> Column:
    """The name without a known extension; anything else after a dot stays."""
    return F.regexp_replace(name, "(?i)(" + "|".join(e.replace(".", "[.]") for e in EXTENSIONS) + ")$", "")


def stem(path: Column) -> Column:
    """Base name without a known extension, lower case."""
    return F.lower(without_extension(base_name(path)))


def strict_key(path: Column) -> Column:
    """Base name in lower case without its last extension, whatever that is; blank for null."""
    name = F.element_at(F.split(F.trim(path), "/"), -1)
    return F.coalesce(F.lower(F.regexp_replace(name, r"(?<=[^.])[.][^.]*$", "")), F.lit(""))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility folding, for which Spark has no function."""
    return text.str.normalize("NFKC")


def name_key(path: Column) -> Column:
    """Forgiving key: NFKC, no known extension, runs of blanks and underscores as one blank, lower case.

    Blank for null. Folding runs in Arrow batches: apply this to distinct names, not to each row.
    """
    tidy = F.regexp_replace(without_extension(nfkc(base_name(F.trim(path)))), r"(?U)[\s_]+", " ")
    return F.coalesce(F.lower(F.trim(tidy)), F.lit(""))


def _key_of(base: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.regexp_replace(without_extension(base), r"(?U)[\s_]+", " "))), F.lit(""))


def with_name_key(df: DataFrame, name: str, out: str) -> DataFrame:
    """Add the forgiving key of a name column (see name_key). Null or blank: blank.

    Names of ASCII letters need no folding and stay in the JVM; the others take their key from the table
    of their distinct names.
    """
    plain = F.coalesce(F.col(name), F.lit("")).rlike(r"^[\x00-\x7F]*$")
    here = df.where(plain).withColumn(out, _key_of(base_name(F.trim(name))))
    other = df.where(~plain)
    keys = other.select(name).distinct().withColumn(out, name_key(F.col(name)))
    return here.unionByName(other.join(keys, name).select(*df.columns, out))


def normalize_condition(word: Column) -> Column:
    """baseline in lower case, AC-AOM with a dash however it is written, anything else in upper case; blank for null."""
    tidy = F.upper(F.regexp_replace(F.coalesce(word, F.lit("")), r"(?U)[\s_-]+", ""))
    return F.when(tidy == "BASELINE", "baseline").when(tidy == "ACAOM", "AC-AOM").otherwise(tidy)


def parse_file_name(df: DataFrame, column: str, run_pattern: str = RUN_PATTERN, strip_pattern: str = CONDITION_PATTERN, prefix: str = "") -> DataFrame:
    """Add experiment, condition and run (null: none) as a file name tells them.

    The name is folded by NFKC and white space, loses a known extension, the run number that
    follows the date (group 1 of run_pattern stays) and the closing condition word (group 1 of
    strip_pattern). Nothing left: the whole stem, and for a blank or null name a fixed one.
    """
    whole = F.trim(F.regexp_replace(nfkc(without_extension(base_name(F.coalesce(F.col(column), F.lit(""))))), r"(?U)\s+", " "))
    named = df.withColumn("_stem", whole)
    left = F.regexp_replace("_stem", run_pattern, "$1")
    word = F.regexp_extract(left, strip_pattern, 1)
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(left, strip_pattern, ""), r"\s{2,}", " "), r"^[ _-]+|[ _-]+$", "")
    name = F.trim(F.concat(F.lit(prefix), F.coalesce(F.nullif(tidy, F.lit("")), F.col("_stem"))))
    return named.withColumns(
        {
            "experiment": F.coalesce(F.nullif(name, F.lit("")), F.lit(UNNAMED)),
            "condition": normalize_condition(word),
            "run": F.nullif(F.regexp_extract("_stem", RUN_PATTERN, 2), F.lit("")),
        }
    ).drop("_stem")


def slugify(text: Column, fallback: str, most: int = 60) -> Column:
    """Letters, digits, dot, dash and underscore; other runs become one underscore; bounded length."""
    clean = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(clean, r"^_+|_+$", ""), 1, most), F.lit("")), F.lit(fallback))


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name", taken: DataFrame | None = None) -> DataFrame:
    """Add a name that no other row and none of taken (a column of the same name) has.

    The first row keeps a free name; repeats, and all where the name is taken, get the next free ' (2)',
    ' (3)' and so on. A form that another row has as its own name is not free. Null names stay null.
    """
    own = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_rows"))
    there = own.select(name, F.lit(False).alias("_old"))
    if taken is not None:
        there = there.unionByName(taken.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_old", F.lit(True)))
    # Each form "base (n)" that is there, by base; and the bases that are old themselves.
    form = r"^(?s)(.*) [(]([0-9]{1,9})[)]$"
    used = there.select(F.regexp_extract(name, form, 1).alias(name), F.regexp_extract(name, form, 2).try_cast("int").alias("_i")).where("_i >= 2")
    used = used.unionByName(there.where("_old").select(name, F.lit(1).alias("_i"))).distinct()
    n_used = used.groupBy(name).agg(F.count(F.lit(1)).alias("_used"))
    most = F.col("_rows") + F.coalesce("_used", F.lit(0))
    numbers = own.join(n_used, name, "left").select(name, F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("_i"))
    free = numbers.join(used, [name, "_i"], "left_anti")
    free = free.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy("_i")))
    placed = df.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    joined = placed.join(free, [name, "_n"], "left")
    made = F.when(F.col("_i") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_i").cast("string"), F.lit(")")))
    return joined.withColumn(out, made).select(*df.columns, out)


def format_time(epoch: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC from epoch seconds; blank if missing."""
    seconds = F.floor(epoch).cast("long")
    moment = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
