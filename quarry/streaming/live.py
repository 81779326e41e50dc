"""The live view: what a journal makes of each id, kept in the state store and restarted from its checkpoint.

State of an id: its links, each with what the last record that settles it says and the parity of toggles since, and the
last refreshed metadata. Neighbouring ids share a bucket, whose ids are one value of the store: a call into Python, a read
and a write go for each bucket that a trigger touches, and a record costs its bucket's state and nothing else. Two kinds of
rows come out, told apart by `kind`: `state` after each trigger that changed the id, and `quiet` when no record of the id
has come for the gap (the trailing edge of a debounce), by a timer at the earliest such time of a bucket; event time
decides, so a restart doesn't fire timers early or twice.

Records of an id are applied in the order of usn within a trigger; a record at or below the last one applied is one that a
restarted source has sent again and is passed over. Records without an id or usn are left out, and those without a parent
or a name touch metadata alone. A trigger's records of a bucket are sorted in memory; files per trigger bound them. Records
that come later than `late` behind the newest are dropped, as event time has passed them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarry.operators.maintenance import LINK, apply_states, overlay_latest
from quarry.operators.storage import cut_lineage

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINKS = "array<struct<parent_id: bigint, name: string, settled: boolean, last: string, flips: boolean, size: bigint, made: bigint>>"
OUT = f"id long, kind string, usn long, n long, links {LINKS}, refreshed long, size long"
#: A column of arrays for each field of a link; a list of structs would be taken apart value by value in Python.
_FIELDS = {"parent_id": "long", "name": "string", "settled": "boolean", "last": "string", "flips": "boolean", "link_size": "long", "made": "long"}
_FLAT = "id long, kind string, usn long, n long, refreshed long, size long, " + ", ".join(f"{f} array<{t}>" for f, t in _FIELDS.items())
_RECORD = ["id", "usn", "at_ms", "parent_id", "name", "action", "refresh", "size"]
#: Bits of an id that tell it apart in its bucket.
BUCKET_BITS = 7


class LinkState(StatefulProcessor):
    """bucket: JSON of id -> [last usn, records since the last quiet, usn and size of the last refresh, time of the next quiet,
    links], links: [parent_id, name, settled, last, flips, size and usn of the last add or toggle]; timer: the one that is set."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "ids string, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, timer = self._read()
        records = pd.concat(list(rows)).sort_values("usn", kind="stable")
        changed: dict[int, tuple] = {}  # state before the trigger's first record, links by place, time of the last record
        for i, usn, at_ms, parent, name, action, refresh, size in zip(*(records[c].tolist() for c in _RECORD)):
            met = changed.get(i)
            if met is None:
                state = ids.get(i) or [-1, 0, -1, None, None, []]
                met = changed[i] = (state[0], state, {(k[0], k[1]): k for k in state[5]}, [at_ms])
            sent, state, links, last_ms = met
            if usn <= sent:
                continue
            size = None if size is None else int(size)
            state[0], state[1], last_ms[0] = usn, state[1] + 1, max(last_ms[0], at_ms)
            if refresh:
                state[2], state[3] = usn, size
            if name is not None and action in ("add", "remove", "hide", "toggle"):
                link = links.get((parent, name))
                if link is None:
                    link = links[parent, name] = [parent, name, None, None, False, None, -1]
                    state[5].append(link)
                if action in ("add", "toggle"):
                    link[5], link[6] = size, usn
                if action == "toggle":
                    link[4] = not link[4]
                else:
                    link[2], link[3], link[4] = action == "add", action, False
        new = {i: state for i, (sent, state, _, _) in changed.items() if state[0] > sent}
        if not new:
            return
        for i, state in new.items():
            ids[i], state[4] = state, changed[i][3][0] + self.gap_ms
        yield self._rows("state", new.items())
        yield from self._quiet(ids, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, _ = self._read()
        yield from self._quiet(ids, -1, timerValues.getCurrentWatermarkInMs())

    def _quiet(self, ids: dict[int, list], timer: int, watermark: int) -> Iterator[pd.DataFrame]:
        """Tells the ids whose time has passed, sets the timer to the earliest of the others and writes the bucket."""
        due = {i: state for i, state in ids.items() if state[4] is not None and state[4] < watermark}
        if due:
            yield self._rows("quiet", due.items())
        for state in due.values():
            state[1], state[4] = 0, None
        earliest = min((state[4] for state in ids.values() if state[4] is not None), default=-1)
        if earliest != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if earliest >= 0:
                self.handle.registerTimer(earliest)
        self.bucket.update((json.dumps(ids, separators=(",", ":")), earliest))

    def _read(self) -> tuple[dict[int, list], int]:
        kept = self.bucket.get()
        return ({int(i): state for i, state in json.loads(kept[0]).items()}, kept[1]) if kept else ({}, -1)

    def _rows(self, kind: str, states: Iterable[tuple[int, list]]) -> pd.DataFrame:
        met = list(states)
        told = {"id": [i for i, _ in met], "kind": kind, **{c: [s[f] for _, s in met] for f, c in enumerate(("usn", "n", "refreshed"))}, "size": pd.array([s[3] for _, s in met], "Int64")}
        return pd.DataFrame(told | {c: [[k[f] for k in s[5]] for _, s in met] for f, c in enumerate(_FIELDS)})

    def close(self) -> None:
        pass


def live_states(changes: DataFrame, gap_ms: int, late: str = "1 hour") -> DataFrame:
    """Rows as in OUT from a stream of changes (id, usn, ts, parent_id, name, action, refresh, size)."""
    conf = changes.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a trigger sends its changes, not its partitions' whole files
    timed = changes.where("id is not null and usn is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    # numbers without nulls stay whole numbers in pandas
    whole = F.col("parent_id").isNotNull() & F.col("name").isNotNull()
    records = timed.select(F.shiftright("id", BUCKET_BITS).alias("bucket"), "ts", "id", "usn", F.unix_millis("ts").alias("at_ms"), F.coalesce("parent_id", F.lit(0)).alias("parent_id"), F.when(whole, F.col("name")).alias("name"), "action", F.coalesce("refresh", F.lit(False)).alias("refresh"), F.col("size").cast("string").alias("size"))
    flat = records.groupBy("bucket").transformWithStateInPandas(statefulProcessor=LinkState(gap_ms), outputStructType=_FLAT, outputMode="Append", timeMode="EventTime")
    return flat.select("id", "kind", "usn", "n", F.arrays_zip(*_FIELDS).cast(LINKS).alias("links"), "refreshed", "size")


def keep_states(states: DataFrame, folder: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Appends what comes out to a table; a batch that is run again rewrites its own folder. State lies in the partitions that
    the first start of a checkpoint has, those of the session or `partitions`: each costs a task and a store every trigger."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    conf = states.sparkSession.conf
    own = conf.get("spark.sql.shuffle.partitions")
    try:  # a query keeps the settings that it starts with
        conf.set("spark.sql.shuffle.partitions", str(partitions or own))
        return states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set("spark.sql.shuffle.partitions", own)


def view(base: DataFrame, spark: SparkSession, folder: str, key: tuple[str, ...] = LINK) -> DataFrame:
    """Base as of the last state of each id."""
    states = spark.read.schema(f"{OUT}, batch long").parquet(folder).where("kind = 'state'")
    last = cut_lineage(states.groupBy("id").agg(F.max_by(F.struct("links", "refreshed", "size"), "usn").alias("s")))  # read four times
    each = last.select("id", F.explode("s.links").alias("l")).select("id", "l.*")
    makers = each.where("made >= 0").select(*key, "size", F.col("made").alias("usn"))
    rows = apply_states(base, each.select(*key, "settled", "last", "flips"), makers, key)
    return overlay_latest(rows, makers, last.where("s.refreshed >= 0").select("id", F.col("s.refreshed").alias("usn"), F.col("s.size").alias("size")), key, ("size",))
