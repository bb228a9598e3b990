"""Keyed state over ordered events: limiters, breakers, watchers, throttled alerts, hash chains.

Each function takes rows and gives each row its decision. The state machines are small Python classes; the same class runs on a
batch (one key's rows in order, streamed through a task after a sort, so no key is held in memory) and on a stream
(`stateful`, with the state kept by Structured Streaming).
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class SlidingWindow:
    """Accepts an event if fewer than `most` accepted ones lie within `seconds` before it, the edge included. Rejected ones don't count."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds
        self.times: list[float] = []

    def step(self, row: dict) -> dict:
        now = row["t"]
        self.times = [t for t in self.times if t >= now - self.seconds]
        allowed = len(self.times) < self.most
        if allowed:
            self.times.append(now)
        return {"allowed": allowed, "remaining": max(0, self.most - len(self.times)), "reset_at": (self.times[0] + self.seconds) if self.times else now}

    def save(self) -> str:
        return json.dumps(self.times)

    def load(self, data: str) -> None:
        self.times = json.loads(data)


class Breaker:
    """closed; `failures` in a row open it; after `cooldown` seconds the next request is let through half open; `successes` close it, a failure opens it again."""

    def __init__(self, failures: int = 3, cooldown: float = 60.0, successes: int = 2):
        self.failures, self.cooldown, self.successes = failures, cooldown, successes
        self.state, self.bad, self.good, self.opened = "closed", 0, 0, 0.0

    def step(self, row: dict) -> dict:
        now = row["t"]
        if self.state == "open" and now - self.opened >= self.cooldown:
            self.state, self.good = "half_open", 0
        allowed = self.state != "open"
        if allowed and row["ok"]:
            self.bad = 0
            if self.state == "half_open":
                self.good += 1
                if self.good >= self.successes:
                    self.state = "closed"
        elif allowed:
            self.bad += 1
            if self.state == "half_open" or self.bad >= self.failures:
                self.state, self.bad, self.opened = "open", 0, now
        return {"allowed": allowed, "state": self.state}

    def save(self) -> str:
        return json.dumps([self.state, self.bad, self.good, self.opened])

    def load(self, data: str) -> None:
        self.state, self.bad, self.good, self.opened = json.loads(data)


class Throttle:
    """Sends an alert if `seconds` have passed since the last that was sent."""

    def __init__(self, seconds: float = 60.0):
        self.seconds, self.last = seconds, None

    def step(self, row: dict) -> dict:
        sent = self.last is None or row["t"] - self.last >= self.seconds
        if sent:
            self.last = row["t"]
        return {"sent": sent}

    def save(self) -> str:
        return json.dumps(self.last)

    def load(self, data: str) -> None:
        self.last = json.loads(data)


class InFlight:
    """One request of a key at a time: granted unless one is open, until its completion or for `seconds`; a refused one doesn't count.

    `outcome` is granted or refused for a request, closed or idle for a completion (`done`) with or without an open request.
    """

    def __init__(self, seconds: float = 600.0):
        self.seconds, self.since = seconds, None

    def step(self, row: dict) -> dict:
        now = row["t"]
        if self.since is not None and now - self.since > self.seconds:
            self.since = None
        before = self.since
        if row["done"]:
            self.since = None
            return {"outcome": "idle" if before is None else "closed"}
        if before is None:
            self.since = now
        return {"outcome": "granted" if before is None else "refused"}

    def save(self) -> str:
        return json.dumps(self.since)

    def load(self, data: str) -> None:
        self.since = json.loads(data)


class HashChain:
    """Each row's digest is keyed over its content and the digest before it."""

    def __init__(self, key: str):
        self.key, self.last = key, ""

    def step(self, row: dict) -> dict:
        before = self.last
        content = json.dumps({"content": row["content"], "prev": before}, sort_keys=True, ensure_ascii=False)
        self.last = hmac.new(self.key.encode(), content.encode(), hashlib.sha256).hexdigest()
        return {"prev_hash": before, "hash": self.last}

    def save(self) -> str:
        return self.last

    def load(self, data: str) -> None:
        self.last = data


def decided(rows: DataFrame, key: str, order: list[str], machine: Callable[[], object], out: str) -> DataFrame:
    """`rows` with the machine's columns (schema `out`), key by key in order. Keys stream through tasks; a key needs only its state."""
    names = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for pdf in batches:
            made: list[dict] = []
            for row in pdf.to_dict("records"):
                if state is None or row[key] != last:
                    last, state = row[key], machine()
                made.append(state.step(row))
            yield pdf.assign(**{n: [m[n] for m in made] for n in names})

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", " + out
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def stateful(stream: DataFrame, key: str, machine: Callable[[], object], out: str, idle_seconds: int | None = 3600) -> DataFrame:
    """The same decisions on a stream (columns: key, t in seconds, and what the machine reads), in the order of arrival; a key's state goes after `idle_seconds` without rows (None: never, for keys that are few)."""
    names = [f.split()[0] for f in out.split(", ")]
    columns = stream.columns

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        m = machine()
        if state.exists:
            m.load(state.get[0])
        for pdf in batches:
            pdf = pdf.sort_values("t", kind="stable")
            made = [m.step(r) for r in pdf.to_dict("records")]
            yield pdf.assign(**{n: [x[n] for x in made] for n in names})[[*columns, *names]]
        state.update((m.save(),))
        if idle_seconds:
            state.setTimeoutDuration(1000 * idle_seconds)

    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes) + ", " + out
    return stream.groupBy(key).applyInPandasWithState(run, schema, "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_seconds else GroupStateTimeout.NoTimeout)


def ready_files(scans: DataFrame) -> DataFrame:
    """(scan, path): files whose size and time are the same in two scans one after the other, at the first such scan of a version."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("scan")
    same = (F.col("scan") - F.lag("scan").over(w) == 1) & (F.col("size") == F.lag("size").over(w)) & (F.col("mtime") == F.lag("mtime").over(w))
    marked = scans.withColumn("stable", F.coalesce(same, F.lit(False)))
    return marked.withColumn("before", F.coalesce(F.lag("stable").over(w), F.lit(False))).filter("stable and not before").select("scan", "path")


def event_windows(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows, for batches and streams with a watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
