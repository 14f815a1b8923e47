"""What subscribers get from job events: keyed state that puts late events in their place, loses none and tells idle times.

Events may arrive late, repeatedly, and over restarts. A job's events carry seq, counted from 0, so the state knows what is
missing: it holds what comes after a gap until the gap is filled, or until nothing came for a while, and then lets it go in
order; what was missing comes out whenever it arrives. State is bounded by what is held and missing, not by what was seen."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.streaming.events import FRAMES, known
from parlance.streaming.keyed import frame, stateful

#: Fixed value: milliseconds without an event after which a subscriber gets a `ping`.
IDLE_MS = 15_000
PING = "ping"

OWNED = "owner_id long, place long, job_id long, seq long, event string, live boolean"
PASSED = "owner_id long, job_id long, seq long, event string, closes boolean, was string"
RAW = "stream_id long, frame_idx long, raw string"


def _rows(batches: Iterator[pd.DataFrame]) -> list[dict]:
    return [row for batch in batches for row in batch.to_dict("records")]


class Places:
    """What has come of a numbered sequence: all below `next` but `missing`; `held` waits for a gap to be filled."""

    def __init__(self, saved: list | None = None):
        self.next, missing, held = saved or (0, [], [])
        self.missing, self.held = set(missing), {k: v for k, v in held}

    def saved(self) -> list:
        return [self.next, sorted(self.missing), sorted(self.held.items())]

    def has(self, k: int) -> bool:
        return k in self.held or k < self.next and k not in self.missing

    def come(self, k: int, value) -> list:
        """(place, value) of all that may go on now that k came; nothing if it came before."""
        if self.has(k):
            return []
        if k in self.missing:
            self.missing.discard(k)
            return [(k, value)]
        self.held[k] = value
        return self._go()

    def _go(self) -> list:
        out = []
        while self.next in self.held:
            out.append((self.next, self.held.pop(self.next)))
            self.next += 1
        return out

    def release(self) -> list:
        """All that is held, in order; the gaps count as missing from now on."""
        out = []
        while self.held:
            least = min(self.held)
            self.missing.update(range(self.next, least))
            self.next = least
            out += self._go()
        return out


# one job


def _tail(idle: int | None):
    def step(key: tuple, saved: list | None, rows: list[tuple]) -> tuple[tuple, list[tuple], int | None]:
        state, closed = saved or (None, False)
        if closed:  # of a job that has ended only that is remembered
            return (None, True), [], None
        places, out, ready = Places(state), [], []
        if not rows:  # nothing came in time
            ready = places.release()
            if not ready:
                out.append((*key, None, PING, None, False))
        for seq, event, stage in sorted(rows, key=lambda r: r[0]):
            ready += places.come(int(seq), [event, int(stage) if stage == stage else None])  # null is not equal to itself
        for seq, (event, stage) in ready:
            closed = not event.startswith("stage_")
            out.append((*key, seq, event, stage, closed))
            if closed:
                return (None, True), out, None
        return (places.saved(), False), out, idle

    return step


def tail(events: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """A stream of each job's events as its subscriber gets them, each once, up to the one that ends the job.

    The order is that of seq, whatever batch brings an event. After `idle_ms` without one, events that wait for a gap come
    out, and with nothing waiting a `ping` does; an event that was missing then comes when it arrives. Nothing comes after the
    event that ends the job, whose state is one flag. With `idle_ms` None nothing is timed, so that a run over what is there
    (availableNow) ends; with timers a stream goes on until it is stopped."""
    e = known(events).select("owner_id", "job_id", "seq", "event", "stage_index")
    return stateful(e, ["owner_id", "job_id"], _tail(idle_ms), FRAMES, "append", idle_ms is not None)


# all jobs of an owner

CONNECTED = "connected"


def _owner(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    connected, place, waiting, seen = tuple(state.get) if state.exists else (False, 0, "[]", "{}")
    waiting, seen = json.loads(waiting), {k: Places(v) for k, v in json.loads(seen).items()}
    out: list[tuple] = []
    rows = _rows(batches)
    now = []
    for row in rows:
        if row["event"] == CONNECTED:
            continue
        places = seen.setdefault(str(int(row["job_id"])), Places())
        if not places.has(int(row["seq"])):
            places.come(int(row["seq"]), 0)
            places.release()  # an owner gets events as they arrive; what is missing may come later
            now.append([row["ts"].value, int(row["job_id"]), int(row["seq"]), row["event"]])
    connects = any(row["event"] == CONNECTED for row in rows)
    if not connected and not connects:
        waiting += now
    else:
        if not connected:
            old = waiting + now
            created: dict[int, int] = {}
            for ts, job, _, _ in old:
                created[job] = min(ts, created.get(job, ts))
            going = [(*r[1:], False) for r in sorted(old, key=lambda r: (created[r[1]], r[1], r[2]))]
        else:
            going = [(*r[1:], True) for r in sorted(now)]
        for job, seq, event, live in going:
            place += 1
            out.append((*key, place, job, seq, event, live))
        connected, waiting = True, []
    state.update((connected, place, json.dumps(waiting), json.dumps({k: v.saved() for k, v in seen.items()})))
    yield frame(out, OWNED)


def owner_tail(events: DataFrame, connections: DataFrame) -> DataFrame:
    """A stream for each owner over all their jobs: (owner_id, place, job_id, seq, event, live).

    Before an owner's row in connections (owner_id, ts) arrives, events wait in the state. Then they come out, the oldest job
    first, each job in order of seq, together with the rest of that batch; later ones follow as they arrive, within a batch by
    time. Replay and live part have one source and one checkpoint, so nothing falls between them; each event comes once, and
    jobs that end do not end the stream. An owner's events are numbered in one task, as one connection gets them."""
    e = known(events).select("owner_id", "job_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "event")
    c = connections.select("owner_id", F.lit(None).cast("long").alias("job_id"), F.lit(None).cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit(CONNECTED).alias("event"))
    return e.unionByName(c).groupBy("owner_id").applyInPandasWithState(_owner, OWNED, "connected boolean, place long, waiting string, seen string", "append", GroupStateTimeout.NoTimeout)


# deletion

DELETED = "deleted"


def _passing(after: int | None):
    def step(key: tuple, saved: list | None, rows: list[tuple]) -> tuple[tuple | None, list[tuple], int | None]:
        if not rows:  # a deleted job whose work is over
            return None, [], None
        status, deleted = saved or ("queued", False)
        out: list[tuple] = []
        gone = any(event == DELETED for _, event in rows)
        for seq, event in sorted((r for r in rows if r[1] != DELETED), key=lambda r: r[0]):
            ends = not event.startswith("stage_")
            if not deleted and not gone:
                out.append((*key, int(seq), event, ends, None))
            if status != "ended":
                status = "ended" if ends else "running"
        if gone and not deleted:
            deleted = True
            out.append((*key, None, DELETED, True, status))
        # a deleted job is remembered as long as its work may still send events
        return (status, deleted), out, after if deleted and status != "running" else None

    return step


def undeleted(events: DataFrame, tombstones: DataFrame, forget_ms: int | None = 3_600_000) -> DataFrame:
    """A stream of events (owner_id, job_id, seq, event, closes, was) of jobs until they are deleted.

    A tombstone (owner_id, job_id) gives one row `deleted`, which closes the job's subscribers; `was` tells whether the job was
    queued (and is never run), running (its work goes on unseen) or ended. No event of a job comes after its tombstone, nor
    from the batch that brings it. The state is released `forget_ms` after the work is over, or after the tombstone of a job
    that is not running; with None it stays, and a run over what is there ends. A tombstone without the job's owner deletes nothing."""
    e = known(events).select("owner_id", "job_id", "seq", "event")
    t = tombstones.where(F.col("owner_id").isNotNull() & F.col("job_id").isNotNull()).select("owner_id", "job_id", F.lit(-1).cast("long").alias("seq"), F.lit(DELETED).alias("event"))
    return stateful(e.unionByName(t), ["owner_id", "job_id"], _passing(forget_ms), PASSED, "append", forget_ms is not None)


# frames


def _cutting(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    saved, rest, number = tuple(state.get) if state.exists else (None, "", 0)
    places, out = Places(json.loads(saved) if saved else None), []
    parts = [rest]
    for row in sorted(_rows(batches), key=lambda r: r["seq"]):
        parts += [chunk for _, chunk in places.come(int(row["seq"]), row["chunk"] or "")]
    *whole, rest = "".join(parts).split("\n\n")
    for raw in whole:
        out.append((*key, number, raw))
        number += 1
    state.update((json.dumps(places.saved()), rest, number))
    yield frame(out, RAW)


def frames(chunks: DataFrame) -> DataFrame:
    """A stream of whole frames (stream_id, frame_idx, raw) from chunks (stream_id, seq, chunk) that are cut anywhere.

    The state carries the unfinished rest of one frame, and chunks that came before their turn (seq counts from 0); so the
    frames are the same however bytes are cut and over however many batches they come. A rest without its end stays."""
    return chunks.groupBy("stream_id").applyInPandasWithState(_cutting, RAW, "places string, rest string, number long", "append", GroupStateTimeout.NoTimeout)
