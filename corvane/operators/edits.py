"""Edits of events in order: which are accepted, and the events after them, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.columns import AMPLITUDES, TEXTS, TIMES

#: Landmark fields, whose change clears the derived values; all fields that an edit may change.
LANDMARKS = frozenset(c for c in [*TIMES, *AMPLITUDES] if not c.startswith("window"))
EDITABLE = frozenset(["event_no", *TEXTS, *TIMES, *AMPLITUDES]) - {"file_name"}
#: Actions that make an event.
CREATES = frozenset(["create", "import", "copy", "nn"])
EDIT_COLUMNS = ["event", "edit", "action", "expected", "fields", "derived"]
EDIT_TYPES = "event long, edit long, action string, expected long, fields map<string,string>, derived map<string,double>"
#: Per edit: the decision and the event after it.
DECIDED = "event long, edit long, accepted boolean, reason string, version long, deleted boolean, fields map<string,string>, derived map<string,double>"
_DECIDED_NAMES = [c.split()[0] for c in DECIDED.split(", ")]


class Event:
    """One event's state; version 0 is one that is not there."""

    def __init__(self, version=0, deleted=False, fields=None, derived=None):
        self.version, self.deleted, self.fields, self.derived = version, deleted, dict(fields or {}), derived

    def take(self, action: str, expected, fields, derived) -> tuple[bool, str | None]:
        """Apply one edit: (accepted, reason)."""
        changed = {k: v for k, v in dict(fields or {}).items() if k in EDITABLE}
        if action in CREATES:
            if self.version:
                return False, "exists"
            self.version, self.fields, self.derived = 1, changed, dict(derived) if derived else None
            return True, None
        if action != "delete" and not changed:
            return True, "nothing to change"
        if not self.version or self.deleted:
            return False, "deleted"
        if action == "delete":
            self.deleted = True
        else:
            if expected is not None and not pd.isna(expected) and int(expected) != self.version:
                return False, "stale"
            self.fields.update(changed)
            if LANDMARKS & changed.keys():
                self.derived = None
        self.version += 1
        return True, None

    def row(self, event, edit, accepted, reason) -> tuple:
        return event, edit, accepted, reason, self.version, self.deleted, dict(self.fields), self.derived


def _as_map(value):
    return None if value is None else dict(value)


def _rows(batch: pd.DataFrame) -> Iterator[tuple]:
    for event, edit, action, expected, fields, derived in batch[EDIT_COLUMNS].itertuples(index=False):
        yield event, edit, action, expected, _as_map(fields), _as_map(derived)


def _framed(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_DECIDED_NAMES)
    return out.astype({"event": "int64", "edit": "int64", "version": "int64"}) if rows else out


def apply_edits(edits: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """DECIDED of each edit (event, edit, action, expected, fields, derived), in order of edit.

    events: (event, version, deleted, fields, derived) that are there already. An edit of an event that is
    not there or deleted is refused (deleted); an update with a version other than the event's is
    refused (stale), one without a version is not checked; a delete is never stale. Accepted ones raise
    the version; a changed landmark clears the derived values; a written null is a value. Fields that no
    edit may change are left out, and an update without any other changes nothing and is accepted. An
    action of CREATES makes the event, once.

    Edits are dealt by event and sorted, and pass through with one event's state at a time in memory.
    """
    log = edits.select(*[F.col(c) for c in EDIT_COLUMNS], F.lit(None).cast("long").alias("at_version"), F.lit(None).cast("boolean").alias("at_deleted"))
    if events is not None:
        known = events.select("event", F.lit(None).cast("long").alias("edit"), F.lit("state").alias("action"), F.lit(None).cast("long").alias("expected"), "fields", "derived", F.col("version").alias("at_version"), F.col("deleted").alias("at_deleted"))
        log = log.unionByName(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Event()
        for batch in batches:
            out = []
            for (event, edit, action, expected, fields, derived), version, deleted in zip(_rows(batch), batch["at_version"], batch["at_deleted"], strict=True):
                if event != current:
                    current, state = event, Event()
                if action == "state":
                    state = Event(int(version), bool(deleted), fields, derived)
                    continue
                accepted, reason = state.take(action, expected, fields, derived)
                out.append(state.row(event, edit, accepted, reason))
            yield _framed(out)

    dealt = log.repartition("event").sortWithinPartitions("event", F.col("edit").asc_nulls_first())
    return dealt.mapInPandas(run, DECIDED)


def edited_events(events: DataFrame, decided: DataFrame) -> DataFrame:
    """(event, version, deleted, fields, derived) after the edits; events without edits stay, made ones are added."""
    last = decided.groupBy("event").agg(F.max_by(F.struct("version", "deleted", "fields", "derived"), "edit").alias("s")).select("event", "s.*").where("version > 0")
    rest = events.join(last.select("event"), "event", "left_anti").select("event", "version", "deleted", "fields", "derived")
    return last.unionByName(rest)


STATE = "version long, deleted boolean, fields map<string,string>, derived map<string,double>"


def stream_edits(edits: DataFrame) -> DataFrame:
    """DECIDED of each edit as edits arrive (an event's in order over batches), by the same rules.

    Events begin with an edit of CREATES. State per event: its version, whether it is deleted, its fields and derived values.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        event = Event(*state.get) if state.exists else Event()
        rows = pd.concat(list(batches)).sort_values("edit")
        out = []
        for of, edit, action, expected, fields, derived in _rows(rows):
            accepted, reason = event.take(action, expected, fields, derived)
            out.append(event.row(of, edit, accepted, reason))
        state.update((event.version, event.deleted, event.fields, event.derived))
        yield _framed(out)

    return edits.select(*EDIT_COLUMNS).groupBy("event").applyInPandasWithState(step, DECIDED, STATE, "append", "NoTimeout")
