"""Stateful operators for streams of frames, hits and checks, on ``applyInPandasWithState`` and watermarks.

Each takes and returns a DataFrame (streaming or not tied to a sink); state is per key and bounded by
what is waiting or inside a window.  ``reorder`` (without a deadline) and ``drain`` hold the state of many keys together, in
``BUCKETS`` groups by the key's hash, as a call of Python for each key and batch takes longer than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RULES

BUCKETS = 2_048


def _bucketed(rows: DataFrame, key: str):
    """Grouped by the key's hash; null keys are a group of their own, so that columns of numbers stay whole numbers."""
    return rows.withColumn("_bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS))).cast("int")).groupBy("_bucket")


def reorder(frames: DataFrame, key: str, seq: str, body: str, deadline_ms: int = 0) -> DataFrame:
    """``key, seq, body, gap_expired``: frames in order of number from 0, each once.

    A frame that comes early waits for those before it; one that was released already is dropped.  With
    ``deadline_ms`` a gap that lasts that long (processing time) is given up: what waits is released and
    marked, up to the next gap; each key has a timer then, and so a state of its own.
    """
    fields = dict(frames.dtypes)
    if not deadline_ms:
        return _reorder_many(frames.select(key, seq, body), key, seq, body)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expect, seqs, bodies = state.get if state.exists else (0, [], [])
        waiting = dict(zip(list(seqs), list(bodies), strict=True))
        out = []
        expired = state.hasTimedOut and bool(waiting)
        if expired:
            expect = min(waiting)
        for b in batches:
            for s, x in zip(b[seq], b[body], strict=True):
                if s >= expect:
                    waiting.setdefault(int(s), x)
        while expect in waiting:
            out.append((k[0], expect, waiting.pop(expect), expired))
            expect += 1
        order = sorted(waiting)
        state.update((expect, order, [waiting[s] for s in order]))
        if deadline_ms and waiting:
            state.setTimeoutDuration(deadline_ms)
        if out:
            yield pd.DataFrame(out, columns=[key, seq, body, "gap_expired"])

    rows = f"{key} {fields[key]}, {seq} long, {body} {fields[body]}, gap_expired boolean"
    kept = f"expect long, seqs array<long>, bodies array<{fields[body]}>"
    return frames.select(key, seq, body).groupBy(key).applyInPandasWithState(step, rows, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _reorder_many(frames: DataFrame, key: str, seq: str, body: str) -> DataFrame:
    """``reorder`` for the keys of a bucket at once: of sorted numbers from the expected one on, those in place by their rank go."""
    fields = dict(frames.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, expects, *held = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        new = pd.concat([b[[key, seq, body]] for b in batches])
        new = new[new[seq].notna()]
        names = keys + held[0] + new[key].tolist()
        codes, _ = pd.factorize(pd.Series(names, dtype=object), use_na_sentinel=False)
        n = int(codes.max(initial=-1)) + 1
        expect = np.zeros(n, np.int64)
        expect[codes[: len(keys)]] = expects
        first = np.full(n, -1)
        first[codes[::-1]] = np.arange(len(codes))[::-1]  # a place where the key's name stands
        rows = pd.DataFrame({"c": codes[len(keys) :], "s": np.array(held[1] + new[seq].tolist(), np.int64)})
        bodies = np.empty(len(rows), object)
        bodies[:] = held[2] + new[body].tolist()
        rows = rows[rows["s"].to_numpy() >= expect[rows["c"]]].drop_duplicates().sort_values(["c", "s"])  # what waits comes first, and stays
        c, s = rows["c"].to_numpy(), rows["s"].to_numpy()
        goes = s - rows.groupby("c").cumcount().to_numpy() == expect[c]
        expect += np.bincount(c[goes], minlength=n)
        name = lambda at: [names[first[x]] for x in at]
        mine, stays = bodies[rows.index], ~goes
        state.update((name(range(n)), expect.tolist(), name(c[stays]), s[stays].tolist(), mine[stays].tolist()))
        if goes.any():
            yield pd.DataFrame({key: name(c[goes]), seq: s[goes], body: mine[goes], "gap_expired": False})

    rows = f"{key} {fields[key]}, {seq} long, {body} {fields[body]}, gap_expired boolean"
    kept = f"keys array<{fields[key]}>, expects array<long>, wait_keys array<{fields[key]}>, seqs array<long>, bodies array<{fields[body]}>"
    return _bucketed(frames, key).applyInPandasWithState(step, rows, kept, "append", GroupStateTimeout.NoTimeout)


def finalize(segments: DataFrame, key: str, start: str, end: str, total: str) -> DataFrame:
    """``key, start, end``: each segment once, when sound beyond its end has come, so that it no longer grows.

    Rows are what was found in the buffer so far: segments with the buffer's length at that time.
    """
    fields = dict(segments.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (done,) = state.get if state.exists else (0,)
        out = []
        for b in batches:
            for s, e, t in sorted(zip(b[start], b[end], b[total], strict=True), key=lambda r: (r[2], r[0])):
                if e < t and e > done:
                    out.append((k[0], max(s, done), e))
                    done = e
        state.update((int(done),))
        if out:
            yield pd.DataFrame(out, columns=[key, start, end])

    rows = f"{key} {fields[key]}, {start} long, {end} long"
    return segments.select(key, start, end, total).groupBy(key).applyInPandasWithState(step, rows, "done long", "append", GroupStateTimeout.NoTimeout)


def escalate(hits: DataFrame, key: str, at: str, order: str, phrase: str, window_s: float = RULES.window_s) -> DataFrame:
    """``key, at, order, phrase, n_same, n_distinct`` as each hit arrives, over the window that ends with it.

    The state is the hits inside the window.  A hit that comes late counts with those still held.
    """
    fields = dict(hits.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, ps = (list(x) for x in state.get) if state.exists else ([], [])
        recent = list(zip(ts, ps, strict=True))
        new = [r for b in batches for r in zip(b[at], b[order], b[phrase], strict=True)]
        out = []
        for t, o, p in sorted(new):
            recent = [(u, q) for u, q in recent if u >= t - window_s] + [(t, p)]
            out.append((k[0], t, o, p, sum(q == p for _, q in recent), len({q for _, q in recent})))
        state.update(([t for t, _ in recent], [p for _, p in recent]))
        if out:
            yield pd.DataFrame(out, columns=[key, at, order, phrase, "n_same", "n_distinct"])

    rows = f"{key} {fields[key]}, {at} double, {order} {fields[order]}, {phrase} {fields[phrase]}, n_same long, n_distinct long"
    kept = f"ts array<double>, ps array<{fields[phrase]}>"
    return hits.select(key, at, order, phrase).groupBy(key).applyInPandasWithState(step, rows, kept, "append", GroupStateTimeout.NoTimeout)


def drain(rows: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """``key, row_id, delivered_by, attempts``: alerts when they are delivered, at once or by a later heartbeat.

    ``rows`` have ``alert, sent, beat, up`` (booleans).  The state is the waiting alerts of a bucket's keys with their attempts.
    """
    fields = dict(rows.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beats: dict = {}  # heartbeats of each key, from those of this batch
        waiting: dict = {}  # by key: an alert with its attempts, less the heartbeats when it began to wait
        for owner, a, n in zip(*state.get, strict=True) if state.exists else ():
            waiting.setdefault(owner, {})[a] = n
        out = []
        every = pd.concat(list(batches)).sort_values(order)
        for owner, me, alert, sent, beat, up in zip(*(every[c].tolist() for c in (key, row_id, "alert", "sent", "beat", "up")), strict=True):
            owner = None if owner != owner else owner  # a null key of a numeric kind
            if beat and waiting.get(owner):
                beats[owner] = beats.get(owner, 0) + 1
                if up:
                    out += [(owner, a, int(me), n + beats[owner]) for a, n in waiting.pop(owner).items()]
            if alert and sent:
                out.append((owner, int(me), int(me), 1))
            elif alert:
                waiting.setdefault(owner, {})[int(me)] = 1 - beats.get(owner, 0)
        left = [(owner, a, n + beats.get(owner, 0)) for owner, own in waiting.items() for a, n in own.items()]
        state.update(tuple(map(list, zip(*left))) if left else ([], [], []))
        if out:
            yield pd.DataFrame(out, columns=[key, row_id, "delivered_by", "attempts"])

    columns = [key, *[c for c in order if c != row_id], row_id, "alert", "sent", "beat", "up"]
    kind = f"{key} {fields[key]}, {row_id} long, delivered_by long, attempts long"
    return _bucketed(rows.select(*columns), key).applyInPandasWithState(step, kind, f"owners array<{fields[key]}>, ids array<long>, tries array<long>", "append", GroupStateTimeout.NoTimeout)


def recent_context(rows: DataFrame, key: str, at: str, order: str, text: str, span: float) -> DataFrame:
    """``key, order, context`` as each transcript arrives: those before it, no more than ``span`` earlier, in order.

    The state is pruned to the span.
    """
    fields = dict(rows.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*(list(x) for x in state.get), strict=True)) if state.exists else []
        out = []
        for t, o, x in sorted((r for b in batches for r in zip(b[at], b[order], b[text], strict=True)), key=lambda r: r[:2]):
            held = [(u, y) for u, y in held if u >= t - span]
            out.append((k[0], o, " ".join(y for _, y in held if y is not None)))
            held.append((t, x))
        state.update(([t for t, _ in held], [x for _, x in held]))
        if out:
            yield pd.DataFrame(out, columns=[key, order, "context"])

    kind = f"{key} {fields[key]}, {order} {fields[order]}, context string"
    return rows.select(*dict.fromkeys([key, at, order, text])).groupBy(key).applyInPandasWithState(step, kind, "ts array<double>, xs array<string>", "append", GroupStateTimeout.NoTimeout)


def timeouts(beats: DataFrame, key: str, at: str, triggered: str, lateness: str = "0 seconds") -> DataFrame:
    """``key, status, last_ms``: journeys silent for longer than their grace, by event time and watermark."""
    fields = dict(beats.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, had = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], "TIMED_OUT_AFTER_TRIGGER" if had else "TIMED_OUT", last)], columns=[key, "status", "last_ms"])
            return
        for b in batches:
            last = max(last, int(b["_ms"].max()))
            had = bool(had or b[triggered].any())
        state.update((last, had))
        grace = RULES.heartbeat_after_trigger_s if had else RULES.heartbeat_s
        state.setTimeoutTimestamp(max(last + int(grace * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    rows = f"{key} {fields[key]}, status string, last_ms long"
    marked = beats.withColumn("_ms", F.unix_millis(at)).withWatermark(at, lateness)
    return marked.select(key, at, triggered, "_ms").groupBy(key).applyInPandasWithState(step, rows, "last long, had boolean", "append", GroupStateTimeout.EventTimeTimeout)


def language_streak(checks: DataFrame, key: str, order: str, value: str, times: int = 3, first: str = "en") -> DataFrame:
    """``key, order, language``: the language after each check; it changes when another was heard ``times`` times running."""
    fields = dict(checks.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, candidate, n = state.get if state.exists else (first, "", 0)
        out = []
        for o, v in sorted(r for b in batches for r in zip(b[order], b[value], strict=True)):
            if v == now:
                candidate, n = "", 0
            else:
                candidate, n = v, n + 1 if v == candidate else 1
                if n == times:
                    now, candidate, n = v, "", 0
            out.append((k[0], o, now))
        state.update((now, candidate, n))
        if out:
            yield pd.DataFrame(out, columns=[key, order, "language"])

    rows = f"{key} {fields[key]}, {order} {fields[order]}, language string"
    return checks.select(key, order, value).groupBy(key).applyInPandasWithState(step, rows, "now string, candidate string, n int", "append", GroupStateTimeout.NoTimeout)


def dedup(events: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """Each event id once within the lateness; state older than that is let go."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def counts_with_late(events: DataFrame, at: str, width: str, lateness: str, by: str) -> DataFrame:
    """Events per window and kind; rows later than ``lateness`` behind the newest are left out."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
