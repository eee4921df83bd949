"""Header aliases, lenient coercion and the event schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Canonical feature names and the headers they go by, first match wins.
FEATURE_ALIASES = {
    "duration": ["duration", "duration_val", "dur", "dwell", "dwell_time"],
    "OSC": ["osc", "osc_pct", "step_osc", "optical_scatter"],
    "RefOSC": ["refosc", "ref_osc", "refosc_pct", "reference_osc"],
    "entry_peak": ["entry Peak (pA)", "entry_peak", "entry peak", "entry peak (pA)", "entry_peak_pa"],
    "exit_peak": ["exit Peak (pA)", "exit_peak", "exit peak", "exit peak (pA)", "exit_peak_pa"],
    "entry_spike": ["entry_spike", "entry spike", "entryspike", "entry_current", "ispike_entry"],
    "exit_spike": ["exit_spike", "exit spike", "exitspike", "exit_current", "ispike_exit"],
}
#: The same for the raw values that spike amplitudes are made of.
RAW_ALIASES = {
    "entry_base": ["entry Base (pA)", "entry_base", "entry base", "entry baseline", "entry_baseline", "entry baseline (pA)", "entry_base_pa"],
    "entry_peak": ["entry Peak (pA)", "entry_peak", "entry peak", "entry peak (pA)", "entry_peak_pa"],
    "exit_peak": ["exit Peak (pA)", "exit_peak", "exit peak", "exit peak (pA)", "exit_peak_pa"],
    "exit_base": ["exit Base (pA)", "exit_base", "exit base", "exit baseline", "exit_baseline", "exit baseline (pA)", "exit_base_pa"],
}
#: Columns of the internal event schema by kind, and headers other than their names.
TIMES = ["event_start", "event_end", "event_plateau", "entry_base_t", "entry_peak_t", "exit_peak_t", "exit_base_t", "window_start", "window_end"]
AMPLITUDES = ["optical_base", "optical_rise", "optical_end", "opticalre_base", "opticalre_rise", "opticalre_end", "entry_base", "entry_peak", "exit_peak", "exit_base"]
TEXTS = ["file_name", "sensor", "analytes", "solution", "notes"]
INTERNAL = ["event_id", *TEXTS, *TIMES, *AMPLITUDES]
EVENT_ALIASES = {
    "file_name": ["file_name", "file name"],
    "event_start": ["event_start (s)", "event_start_s", "event_start"],
    "event_end": ["event_end (s)", "event_end_s", "event_end"],
    "optical_base": ["Base (V)", "optical_base"],
    "optical_rise": ["Step (V)", "optical_rise"],
    "opticalre_base": ["RefBase (V)", "opticalre_base"],
    "opticalre_rise": ["RefStep (V)", "opticalre_rise"],
    "entry_base": ["entry Base (pA)", "entry_base"],
    "entry_peak": ["entry Peak (pA)", "entry_peak"],
    "exit_peak": ["exit Peak (pA)", "exit_peak"],
    "exit_base": ["exit Base (pA)", "exit_base"],
}
#: Derived columns of event files, and the layouts of the two export forms.
DERIVED = ["duration", "OSC", "RefOSC", "entry spike", "exit spike"]
LEGACY = [
    "event_id", "file_name", "sensor", "analytes", "solution", "event_start (s)", "event_end (s)", "notes",
    "Base (V)", "Step (V)", "RefBase (V)", "RefStep (V)", "entry Base (pA)", "entry Peak (pA)", "exit Peak (pA)", "exit Base (pA)",
    "duration", "OSC", "RefOSC", "entry spike", "exit spike", "event_plateau",
    "entry_base_t", "entry_peak_t", "exit_peak_t", "exit_base_t", "window_start", "window_end",
]
PREDICTED = [
    "event_id", "file_name", "sensor", "analytes", "solution", "event_start (s)", "event_end (s)", "notes",
    "Base (V)", "Step (V)", "RefBase (V)", "RefStep (V)", "entry Base (pA)", "entry Peak (pA)", "exit Peak (pA)", "exit Base (pA)",
    "duration", "OSC", "RefOSC", "entry spike", "exit spike", "event_plateau", "event_plateau_t",
    "entry_base_t", "entry_peak_t", "exit_peak_t", "exit_base_t",
]


def feature_header(name: str) -> str:
    """Trimmed, lower case, each blank to an underscore."""
    return name.strip().lower().replace(" ", "_")


def event_header(name: str) -> str:
    """Trimmed, lower case, without blanks, tabs, brackets and commas."""
    return re.sub(r"[ \t()\[\],]", "", name.strip().lower())


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]], normalise=feature_header) -> DataFrame:
    """Canonical columns by header alias; the first alias in the list that is there wins.

    Of headers that are alike after normalising the last counts. A canonical name without any
    header becomes a null string column.
    """
    have = {normalise(c): c for c in df.columns}
    picked = []
    for name, names in aliases.items():
        actual = next((have[normalise(a)] for a in names if normalise(a) in have), None)
        picked.append(F.col(f"`{actual}`").alias(name) if actual is not None else F.lit(None).cast("string").alias(name))
    return df.select(*picked)


def numeric(c: Column) -> Column:
    """A finite double, or null for anything else."""
    text = F.trim(c.cast("string"))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    value = F.when(plain, text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def clean_text(c: Column) -> Column:
    """Null for blank text and for the word nan."""
    trimmed = F.trim(c)
    return F.when((trimmed != "") & (F.lower(trimmed) != "nan"), trimmed)


def integral_id(c: Column) -> Column:
    """A long if the value is a whole number, else null."""
    value = numeric(c)
    return F.when(value == F.floor(value), value.cast("long"))


def to_internal(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Any event file to the internal schema: 25 columns of fixed names and types, missing ones null.

    derived comes after them: a map of the derived columns that have a number in the row, or null.
    """
    names = EVENT_ALIASES if aliases is None else aliases
    found = resolve_columns(df, {c: names.get(c, [c]) for c in INTERNAL} | {c: [c] for c in DERIVED}, event_header)
    kinds = {c: clean_text for c in TEXTS} | {c: numeric for c in TIMES + AMPLITUDES} | {"event_id": integral_id}
    stored = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, DERIVED)), F.array(*[numeric(F.col(f"`{c}`")) for c in DERIVED])), lambda k, v: v.isNotNull())
    return found.select(*[kinds[c](F.col(c)).alias(c) for c in INTERNAL], F.when(F.size(stored) > 0, stored).alias("derived"))


def drop_empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without those of the columns that have no value in any row (one aggregate row decides)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] == 0])


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """ValueError naming the columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_settings(alpha: float, max_k: int, duration_min: float = 0.0, duration_max: float = 0.0, n_boot: int = 1) -> None:
    """ValueError for settings outside their ranges."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if max_k < 2:
        raise ValueError("max_k must be 2 or more")
    if duration_min < 0 or duration_max < 0 or (duration_max and duration_max <= duration_min):
        raise ValueError("durations must not be negative, and the largest above the least")
    if n_boot < 1:
        raise ValueError("n_boot must be 1 or more")
