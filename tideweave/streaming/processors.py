"""Stateful processors: causal delivery, delta buffers with acknowledgements, bounded seen sets, presence expiry.

They run with transformWithStateInPandas and need the RocksDB state store.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DELIVERED = "from_replica string, to_replica string, from_seq long, to_seq long, payload string, acked long"
GROUPED = "replica string, peer string, from_seq long, to_seq long, payloads array<string>"
FIRST_SEEN = "replica string, id string, arrival long"
EXPIRED = "user_id string, last_ms long"


class CausalDelivery(StatefulProcessor):
    """Per (from, to): applies intervals without gaps, buffers those that come early, drops what is known.

    State is the acknowledged number and the buffer; both survive a restart from the checkpoint.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.acked = handle.getValueState("acked", "seq long")
        self.early = handle.getMapState("early", "from_seq long, to_seq long", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        acked = self.acked.get()[0] if self.acked.exists() else 0
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.to_seq > acked:
                    self.early.updateValue((int(r.from_seq), int(r.to_seq)), (r.payload,))
        out = []
        for span, (payload,) in sorted((tuple(k), tuple(v)) for k, v in self.early.iterator()):
            if span[1] <= acked:
                self.early.removeKey(span)
            elif span[0] <= acked:
                acked = span[1]
                out.append((key[0], key[1], span[0], span[1], payload, acked))
                self.early.removeKey(span)
            else:
                break
        self.acked.update((acked,))
        yield pd.DataFrame(out, columns=["from_replica", "to_replica", "from_seq", "to_seq", "payload", "acked"])

    def close(self) -> None:
        pass


class DeltaBuffer(StatefulProcessor):
    """Per replica: buffers deltas (kind "delta", seq, payload), takes acknowledgements (kind "ack", peer, seq) and
    gives each registered peer (kind "peer") what it lacks; what all peers have is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.deltas = handle.getMapState("deltas", "seq long", "payload string")
        self.peers = handle.getMapState("peers", "peer string", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [r for frame in rows for r in frame.itertuples(index=False)]  # of one replica and batch
        if arrived:
            for r in sorted(arrived, key=lambda r: r.arrival):
                if r.kind == "delta":
                    self.deltas.updateValue((int(r.seq),), (r.payload,))
                elif r.kind == "peer" and not self.peers.containsKey((r.peer,)):
                    self.peers.updateValue((r.peer,), (0,))
                elif r.kind == "ack" and self.peers.containsKey((r.peer,)):
                    self.peers.updateValue((r.peer,), (max(int(r.seq), self.peers.getValue((r.peer,))[0]),))
        acks = {tuple(k)[0]: tuple(v)[0] for k, v in self.peers.iterator()}
        held = sorted((tuple(k)[0], tuple(v)[0]) for k, v in self.deltas.iterator())
        if acks:
            least = min(acks.values())
            for seq, _ in held:
                if seq <= least:
                    self.deltas.removeKey((seq,))
        out = []
        for peer, acked in sorted(acks.items()):
            group = [(s, p) for s, p in held if s > acked]
            if group:
                out.append((key[0], peer, acked, group[-1][0], [p for _, p in group]))
        yield pd.DataFrame(out, columns=["replica", "peer", "from_seq", "to_seq", "payloads"])

    def close(self) -> None:
        pass


class SeenSet(StatefulProcessor):
    """Per replica: lets each message id through once and remembers the newest ``size`` of them."""

    def __init__(self, size: int = 1000):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "arrival long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[str, int] = {}  # of the ids that are new in this batch, whichever frame they come in
        for frame in rows:
            for name, arrival in frame.groupby("id")["arrival"].min().items():
                if name in first or not self.seen.containsKey((name,)):
                    first[name] = min(int(arrival), first.get(name, int(arrival)))
        out = sorted(((key[0], name, arrival) for name, arrival in first.items()), key=lambda x: (x[2], x[1]))
        for _, name, arrival in out:
            self.seen.updateValue((name,), (arrival,))
        count = (self.count.get()[0] if self.count.exists() else 0) + len(out)
        if count > self.size:  # the oldest go, found in one pass over what is held
            held = heapq.nsmallest(count - self.size, ((tuple(v)[0], tuple(k)[0]) for k, v in self.seen.iterator()))
            for _, name in held:
                self.seen.removeKey((name,))
            count = self.size
        self.count.update((count,))
        yield pd.DataFrame(out, columns=["replica", "id", "arrival"])

    def close(self) -> None:
        pass


class PresenceExpiry(StatefulProcessor):
    """Per user: emits a removal when event time has passed its last event by the timeout; the watermark drives the timers."""

    def __init__(self, timeout_ms: int = 30_000):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(frame["ts_ms"].max()) for frame in rows)
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.timeout_ms)
        yield pd.DataFrame({"user_id": pd.Series([], dtype=str), "last_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"user_id": [key[0]], "last_ms": [self.last.get()[0]]})
        self.last.clear()

    def close(self) -> None:
        pass


def causal_delivery(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("from_replica", "to_replica").transformWithStateInPandas(CausalDelivery(), DELIVERED, "append", "none")


def delta_buffers(messages: DataFrame) -> DataFrame:
    """messages: replica, kind, seq, peer, payload, arrival."""
    return messages.groupBy("replica").transformWithStateInPandas(DeltaBuffer(), GROUPED, "update", "none")


def first_seen(messages: DataFrame, size: int = 1000) -> DataFrame:
    return messages.groupBy("replica").transformWithStateInPandas(SeenSet(size), FIRST_SEEN, "append", "none")


def presence_expiry(events: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    """events: user_id, ts_ms, ts with a watermark."""
    return events.groupBy("user_id").transformWithStateInPandas(PresenceExpiry(timeout_ms), EXPIRED, "append", "eventTime")
