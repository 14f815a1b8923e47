"""Keyed state in Python, for many keys at a call.

A call of a state function costs Spark and pandas some ten milliseconds, however few rows its key has. So keys are dealt to a
fixed number of groups by a hash. A group's state is that of its keys; one call goes through the rows of all of them, each key
for itself, and has a timer for the earliest of their times."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that keys are dealt to. A checkpoint holds the state of groups, so it is read with the number that it was written with.
GROUPS = 256

_WHOLE = {"owner_id": "int64", "job_id": "int64", "seq": "Int64", "stage_index": "Int64", "place": "int64", "stream_id": "int64", "frame_idx": "int64"}


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: _WHOLE[n] for n in names if n in _WHOLE})


#: Of a key, its state (what JSON holds, None at first) and its rows in this batch, none if its time is over: its new state
#: (None: to be forgotten), rows that come out, and milliseconds until its time is over, if it has one.
Step = Callable[[tuple, object, list[tuple]], tuple[object, list[tuple], int | None]]


def _grouped(step: Step, keys: int, names: list[str], schema: str, timed: bool):
    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(key): (value, over) for key, value, over in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if timed else 0
        come: dict[tuple, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch[n].tolist() for n in names), strict=True):
                come.setdefault(row[:keys], []).append(row[keys:])
        for key, (_, over) in held.items():
            if over is not None and over < now:
                come.setdefault(key, [])
        out: list[tuple] = []
        for key, rows in come.items():
            value, some, wait = step(key, held[key][0] if key in held else None, rows)
            out += some
            if value is None:
                held.pop(key, None)
            else:
                held[key] = value, None if wait is None else now + wait
        if held:
            state.update((json.dumps([(key, value, over) for key, (value, over) in held.items()]),))
            if times := [over for _, over in held.values() if over is not None]:
                state.setTimeoutDuration(max(1, min(times) - now))
        elif state.exists:
            state.remove()
        yield frame(out, schema)

    return run


def stateful(rows: DataFrame, by: list[str], step: Step, schema: str, mode: str, timed: bool = False) -> DataFrame:
    """A stream of what `step` gives for each key that has rows in a batch or, if `timed`, whose time is over. Keys are whole
    numbers and not null. Rows of a key come without it, as tuples in the order of the other columns and in no order of their own."""
    names = by + [c for c in rows.columns if c not in by]
    group = F.pmod(F.xxhash64(*by), F.lit(GROUPS)).alias("dealt_to")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    run = _grouped(step, len(by), names, schema, timed)
    return rows.select(group, *names).groupBy("dealt_to").applyInPandasWithState(run, schema, "held string", mode, timeout)
