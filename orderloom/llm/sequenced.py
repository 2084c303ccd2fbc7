"""Sequenced change applier: changes that carry a running number per client are applied in order, late ones held back.

``Applier.feed`` takes a batch of changes (client, number n, day, ...) to a stateful Structured Streaming query, started anew for each
batch on one checkpoint. Its keys are slots. A client whose changes lie in one range partition of (client, number) belongs to a slot by
its hash; the state has the slot's held changes and each client's pointer (its next number). A client over several ranges has a slot
for each of them, and the state the held changes of that range only.

* At a batch's end the pointer is the first number that isn't held from it on.
* At the next batch's start, a held change whose day + ``grace`` isn't after the largest day so far pulls the pointer over the gaps
  before it. That repeats as long as there is one, so the pointer ends behind the run that holds the largest number of them.
* Both follow from a slot's rows, where it has all of a client. Of a client over several ranges, each range reports where its first gap
  is, the largest number that is due and the gap behind that; the driver goes along these (a row a range, and two ranges a partition
  at most) and sends the pointer with the next batch. So a start is one write, one shuffle to the state, and no join of what is held.
* Each slot gets a control row with each batch, so that it hands out what is applied even if it has no change there.

Of equal numbers, the first by batch, day and change id is held, unless the pointer has passed it; the others are rejected. So the
changes of one number in one batch are settled before the state is asked, and rows of a batch need no order.

``dense_ranks`` and ``effects`` scan rows in order of (client, number) in range partitions; what a partition needs of those before it
is a row a partition. Nothing that grows with the input goes through one task, to the driver or into a broadcast; of more rows,
ranges and slots become more, not larger (``RANGE``, ``SLOT``).

Defined results: repeated rows are one; a null client_id is a client of its own (shared with -2^63); a null seq ranks first; rows without
change_id or valid_at vanish; an op other than I and D, or null, is U; a day before the first batch's belongs to it; NaN and infinite
balances give null cents, and I and U set them; ties in change_id go by the other columns' hash; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from . import _store

#: Rows of a range partition, and changes of a slot, that are aimed at where there are many; SLOTS are there a task at least.
RANGE = 500_000
SLOT = 200_000
SLOTS = 3
#: Held changes of a state entry.
PIECE = 50_000
GRACE = 3
NO_ID = -(2**63)
ALL = 2**62
_STATE = "spark.sql.streaming.stateStore"
#: A start runs one batch, so its stores are put away at once; they log changes, and take no disk before they need it.
STATE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}.rocksdb.allowFAllocate": "false", f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false", f"{_STATE}.unloadOnCommit": "true",
}

HELD = "cid long, m long, day int, change_id long, op string, city string, balance double"
#: kind 0 is a change, 1 a slot's control row (p: the pointer of all its clients is there at least), 2 the pointers of a client over several
#: ranges, at the end of the last batch (q) and now (p), with the range's first number (m). due is the largest day that is due next.
INPUT = f"slot long, kind int, first boolean, {HELD}, q long, p long, due int, run int"
OUTPUT = f"{HELD}, batch int, slot long, lead long, last_due long, gap long, kind string, run int"
_HELD = [f.split(" ")[0] for f in HELD.split(", ")]
_OUT = [f.split(" ")[0] for f in OUTPUT.split(", ")]
_WHOLE = {c: "int64" for c in ("cid", "m", "change_id", "slot", "lead", "last_due", "gap")} | {c: "int32" for c in ("day", "batch", "run")}
_SCHEMA = pa.schema(list(zip(_HELD, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.float64()))))


def _blob(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows[_HELD], _SCHEMA, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows(blobs: list[bytes]) -> pd.DataFrame:
    """All rows of the blobs."""
    tables = [pa.ipc.open_stream(b).read_all() for b in blobs]
    return _objects((pa.concat_tables(tables) if tables else _SCHEMA.empty_table()).to_pandas())


def _objects(rows: pd.DataFrame) -> pd.DataFrame:
    """Strings as Python objects, null as None, whatever pandas takes for them."""
    return rows.assign(**{c: np.array([None if x is None or x != x else x for x in rows[c]], object) for c in ("op", "city")})


class Held(StatefulProcessor):
    """Held changes of a slot, in pieces, and the pointers (q, p) of its clients, if it has all of them."""

    def init(self, handle) -> None:
        self.pointers = handle.getValueState("pointers", "blob binary, pieces int")
        self.pieces = handle.getMapState("pieces", "piece int", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [x for x in rows if len(x)]
        if chunks:
            yield self._step(int(key[0]), pd.concat(chunks) if len(chunks) > 1 else chunks[0])

    def close(self) -> None:
        pass

    def _step(self, slot: int, given: pd.DataFrame) -> pd.DataFrame:
        kind = given["kind"].to_numpy()
        run, due, least = (int(given[c].to_numpy()[kind == 1][0]) for c in ("run", "due", "p"))
        shared = kind == 2
        state = self.pointers.get() if self.pointers.exists() else (b"", 0)
        held = _rows([bytes(self.pieces.getValue((i,))[0]) for i in range(state[1])])
        if shared.any():
            known = given[["cid", "q", "p", "m"]].to_numpy()[shared]
            cid, q, p, lo = known[np.argsort(known[:, 0])].T
        else:
            cid, q, p = np.frombuffer(state[0], np.int64).reshape(3, -1)
            p, lo = np.maximum(p, least), np.zeros(len(cid), np.int64)

        before_q, before_p = (_looked_up(cid, x, held["cid"].to_numpy()) for x in (q, p))
        m = held["m"].to_numpy()
        gone = m < before_p
        applied = held[gone].assign(batch=np.where(m < before_q, run - 1, run)[gone], kind="applied")
        held = held[~gone]

        fresh = _objects(given[kind == 0])
        take = fresh["first"].to_numpy(bool) & (fresh["m"].to_numpy() >= _looked_up(cid, p, fresh["cid"].to_numpy()))
        if len(held) and len(fresh):
            take &= ~pd.MultiIndex.from_frame(fresh[["cid", "m"]]).isin(pd.MultiIndex.from_frame(held[["cid", "m"]]))
        rejected = fresh[~take].assign(batch=run, kind="rejected")
        parts = [x[_HELD] for x in (held, fresh[take]) if len(x)]
        held = (pd.concat(parts) if parts else held[_HELD]).sort_values(["cid", "m"], kind="stable")

        c = held["cid"].to_numpy()
        who, lead, last_due, gap = _facts(c, held["m"].to_numpy(), held["day"].to_numpy(), np.maximum(_looked_up(cid, p, c), _looked_up(cid, lo, c)), due)
        frames = [applied, rejected]
        if shared.any():
            pointers = b""
            frames.append(pd.DataFrame({"cid": who, "lead": lead, "last_due": last_due, "gap": gap}).assign(kind="end", batch=run))
        else:
            idle = ~np.isin(cid, who)
            moved = np.stack([np.concatenate((who, cid[idle])), np.concatenate((lead, p[idle])), np.concatenate((np.where(last_due >= lead, gap, lead), p[idle]))])
            pointers = moved[:, np.argsort(moved[0])].astype(np.int64).tobytes()
        if len(applied) or take.any() or pointers != bytes(state[0]):
            self._write(held, pointers, state[1])
        # whole numbers stay so: each frame gets all columns before they are put together
        frames = [_shaped(x.assign(run=run, slot=slot)) for x in frames if len(x)]
        return _objects(pd.concat(frames) if frames else _shaped(applied))

    def _write(self, held: pd.DataFrame, pointers: bytes, before: int) -> None:
        count = -(-len(held) // PIECE)
        for i in range(count):
            self.pieces.updateValue((i,), (_blob(held.iloc[i * PIECE : (i + 1) * PIECE]),))
        for i in range(count, before):
            self.pieces.removeKey((i,))
        self.pointers.update((pointers, count))


def _shaped(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.reindex(columns=_OUT).fillna(dict.fromkeys(_WHOLE, 0)).astype(_WHOLE)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where there is none; keys are sorted."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def _facts(cid: np.ndarray, m: np.ndarray, day: np.ndarray, floor: np.ndarray, due: int) -> tuple[np.ndarray, ...]:
    """Of each client: the first number that isn't held from ``floor`` on, the largest held one that is due (or -1) and the first
    behind it that isn't held (or -1). Rows are sorted by (cid, m)."""
    start = np.flatnonzero(np.append(True, cid[1:] != cid[:-1])[: len(cid)])
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(len(cid))
    run = m - at
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(cid))))
    lead = floor[start] + np.add.reduceat((run - floor == -start[of]).astype(np.int64), start)
    last = np.maximum.reduceat(np.where(day <= due, at, -1), start)
    follows = (at >= last[of]) & (run == run[last[of]])
    gap = m[last] + np.add.reduceat(follows.astype(np.int64), start)
    return cid[start], lead, np.where(last >= 0, m[last], -1), np.where(last >= 0, gap, -1)


class Applier:
    """Feeds batches in order; ``settled`` returns what was decided so far. A batch of changes has the columns client_id, n (from 1), day,
    change_id, op, city, balance, ``first``: whether it is the first of its client, number and batch, and ``part``: the range that it lies
    in, if its client has several, else null. ``spans`` has these: (part, client, smallest n - 1, largest n), in order of n."""

    def __init__(self, spark: SparkSession, changes: int, spans: Iterable[tuple] = (), grace: int = GRACE, root: str | None = None):
        self.spark, self.grace, self.root = spark, grace, root or _store.place(spark, "changes")
        self.slots = max(SLOTS * _store.tasks(spark), changes // SLOT)
        self.run, self.largest = 0, None
        self.spans: dict = {}
        for part, cid, lo, end in spans:
            self.spans.setdefault(cid, []).append((self.slots + part, lo, end))
        self.pointers = {cid: (0, 0) for cid in self.spans}

    def feed(self, rows: DataFrame, largest: int | None) -> None:
        """One batch; ``largest`` is the largest day of its rows, if there are any."""
        days = [x for x in (self.largest, largest) if x is not None]
        self.largest = max(days) if days else None
        cid = F.coalesce("client_id", F.lit(NO_ID))
        slot = F.coalesce(F.lit(self.slots) + F.col("part"), F.pmod(F.xxhash64(cid), F.lit(self.slots)))
        self._feed(rows.select(cid.alias("cid"), (F.col("n") - 1).alias("m"), "day", "change_id", "op", "city", "balance", "first", slot.alias("slot"), F.lit(0).alias("kind")), 0)

    def finish(self) -> None:
        """Everything that is still held is applied."""
        self.pointers = {cid: (q, ALL) for cid, (q, _) in self.pointers.items()}
        self._feed(None, ALL)

    def _feed(self, rows: DataFrame | None, least: int) -> None:
        self.run += 1
        due = -(2**31) if self.largest is None else self.largest - self.grace
        shared = [(slot, cid, lo, *self.pointers[cid]) for cid, ranges in self.spans.items() for slot, lo, _ in ranges]
        told = [(slot, 1, 0, 0, 0, least) for slot in (*range(self.slots), *sorted({x[0] for x in shared}))]
        told += [(slot, 2, cid, lo, q, p) for slot, cid, lo, q, p in shared]
        control = self.spark.createDataFrame(pd.DataFrame(told, columns=["slot", "kind", "cid", "m", "q", "p"]), "slot long, kind int, cid long, m long, q long, p long").coalesce(1)
        both = control if rows is None else rows.unionByName(control, allowMissingColumns=True)
        # a null among whole numbers would make them floats in pandas
        none = lambda c, t: F.lit(None).cast(t) if t in ("string", "double") else F.lit(0).cast(t)
        both = both.withColumns({"due": F.lit(due), "run": F.lit(self.run)})
        columns = [(c, t, F.col(c).cast(t)) if c in both.columns else (c, t, none(c, t)) for c, t in (f.split(" ") for f in INPUT.split(", "))]
        both = both.select(*[(x if t in ("string", "double") else F.coalesce(x, F.lit(0).cast(t))).alias(c) for c, t, x in columns])
        with _store.cleaned(self.spark):
            both.write.mode("append").parquet(f"{self.root}/in")
        self._stream()
        if self.spans and rows is not None:
            self._advance()
        self._freed()

    def _freed(self) -> None:
        """Gives back what a start leaves on the driver. Plans, broadcasts and shuffles are held from Python until its garbage is collected, and
        a driver's heap grows to its limit before it collects what has become old."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _stream(self) -> None:
        """The query over what was added, on its checkpoint; the session's settings are put back."""
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            source = self.spark.readStream.schema(INPUT).parquet(f"{self.root}/in")
            out = source.groupBy("slot").transformWithStateInPandas(Held(), OUTPUT, "append", "none")
            writer = out.writeStream.format("parquet").partitionBy("kind", "run").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/checkpoint")
            writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _out(self, kind: str) -> DataFrame:
        return self.spark.read.schema(OUTPUT).parquet(f"{self.root}/out").where(F.col("kind") == kind)

    def _advance(self) -> None:
        """Pointers of clients over several ranges, at a batch's end and at the next one's start."""
        told = self._out("end").where(F.col("run") == self.run).select("slot", "cid", "lead", "last_due", "gap").collect()  # a row a client and range
        facts = {(r["slot"], r["cid"]): (r["lead"], r["last_due"], r["gap"]) for r in told}
        self.pointers = {cid: _moved(self.pointers[cid][1], [(lo, end, *facts.get((slot, cid), (None, -1, -1))) for slot, lo, end in ranges]) for cid, ranges in self.spans.items()}

    def settled(self) -> DataFrame:
        """(cid, m, change_id, op, city, balance, batch, status) of everything that was decided."""
        rows = self._out("applied").withColumn("status", F.lit("applied")).unionByName(self._out("rejected").withColumn("status", F.lit("rejected")))
        return rows.select("cid", "m", "change_id", "op", "city", "balance", "batch", "status")


def _moved(p: int, ranges: list[tuple]) -> tuple[int, int]:
    """Where a client stands at the batch's end, and at the next one's start. ranges: (smallest number, end, lead, last_due, gap)."""

    def behind(i: int, at: int) -> int:
        """``at``, or if that is a range's end, the first number that isn't held in those that follow."""
        while i + 1 < len(ranges) and at >= ranges[i][1]:
            i, at = i + 1, max(at, ranges[i + 1][2] or 0)
        return at

    i = max((k for k, r in enumerate(ranges) if r[0] <= p), default=0)
    q = behind(i, max(p, ranges[i][2] or 0))
    due = max(range(len(ranges)), key=lambda k: ranges[k][3])
    return q, behind(due, ranges[due][4]) if ranges[due][3] >= q else q


def _scanned(rows: DataFrame, order: list[str], scan, shape: str, name: str) -> DataFrame:
    """A table of what ``scan(batches)`` returns for each range partition of (cid, order[0]), sorted by ``order``."""
    n = _store.tasks(rows.sparkSession)
    return _store.written(rows.repartitionByRange(n, "cid", order[0]).sortWithinPartitions("cid", *order).mapInArrow(scan, shape), name)


def _change(a: np.ndarray, before) -> np.ndarray:
    out = np.ones(len(a), bool)
    out[1:] = a[1:] != a[:-1]
    out[0] = before is None or a[0] != before
    return out


def _ranked(batches):
    """Dense ranks within a partition, which rows are the first of their client, number and batch, and a row (kind 1) with what the next partition needs."""
    task, cid, seq, rank, head, distinct, lead = TaskContext.get().partitionId(), None, None, 0, None, 0, None
    rows = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c, s = batch.column("cid").to_numpy(), batch.column("s").to_numpy()
        client = _change(c, cid)
        number = client | _change(s, seq)
        count = np.cumsum(number)
        start = np.maximum.accumulate(np.where(client, count - 1, -1))
        n = np.where(start >= 0, count - start, rank + count)
        head = c[0] if head is None else head
        distinct += int(client.sum())
        live = batch.column("live").to_numpy(zero_copy_only=False)
        b = batch.column("batch").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(live)
        key = np.stack([c[at], s[at], b[at].astype(np.int64)]) if len(at) else np.zeros((3, 0), np.int64)
        first = np.ones(len(at), bool)
        if len(at):
            first[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            first[0] = lead is None or tuple(key[:, 0]) != lead
            lead = tuple(key[:, -1])
        cid, seq, rank = c[-1], s[-1], int(n[-1])
        kept = batch.take(pa.array(at)).select(["cid", "change_id", "op", "city", "balance", "day", "batch"])
        more = {"n": pa.array(n[at]), "first": pa.array(first), "early": pa.array(c[at] == head), "task": pa.array(np.full(len(at), task, np.int32)), "kind": pa.array(np.zeros(len(at), np.int32))}
        rows = pa.RecordBatch.from_arrays([*kept.columns, *more.values()], [*kept.schema.names, *more])
        yield rows
    if rows is not None:
        own = {"cid": int(cid), "n": rank, "early": bool(head == cid), "task": task, "kind": 1, "batch": 0, "day": distinct, "change_id": int(head)}
        yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in rows.schema], rows.schema.names)


def dense_ranks(rows: DataFrame, size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cid, change_id, op, city, balance, day, batch, n, first) of live rows, as a table with a folder a batch; and a row a partition."""
    shape = "cid long, change_id long, op string, city string, balance double, day int, batch int, n long, first boolean, early boolean, task int, kind int"
    order = ["s", "day", "change_id", "tie"]
    n = max(_store.tasks(rows.sparkSession), -(-size // RANGE))
    path = _store.place(rows.sparkSession, "ranked")
    with _store.cleaned(rows.sparkSession):
        rows.repartitionByRange(n, "cid", "s").sortWithinPartitions("cid", *order).mapInArrow(_ranked, shape).write.partitionBy("batch").parquet(path)
    table = rows.sparkSession.read.schema(shape).parquet(path)
    return table.where("kind = 0"), table.where("kind = 1")


def _carried(parts: list) -> tuple[list[tuple], list[tuple]]:
    """(task, offset, head, tail): what the ranks of the first client of each partition lack, and its first and last client if they have
    several partitions; and (task, client, smallest n - 1, largest n or more) of these."""
    parts = sorted(parts, key=lambda r: r["task"])
    out, spans, rank, same = [], [], 0, False
    for k, p in enumerate(parts):
        head, tail, one = p["change_id"], p["cid"], p["early"]
        follows = k + 1 < len(parts) and parts[k + 1]["change_id"] == tail
        offset = rank if same else 0
        rank = p["n"] + (offset if one else 0)
        if same:
            spans.append((p["task"], head, offset, rank if one and follows else ALL))
        if follows and not (same and one):
            spans.append((p["task"], tail, 0, rank))
        out.append((p["task"], offset, head if same else None, tail if follows else None))
        same = follows
    return out, spans


def _effects(batches):
    """Numbers jumped, city and balance after each applied change; what depends on earlier partitions is marked as open. A last row (kind 1) sums up."""
    task, cid, head, m = TaskContext.get().partitionId(), None, None, 0
    value: list = [None, None]
    known = [False, False]
    ended = None
    shape = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.num_rows
        c, at = batch.column("cid").to_numpy(), batch.column("m").to_numpy()
        op = np.array([{"I": 1, "D": 2}.get(x, 0) for x in batch.column("op").to_pylist()])
        new = _change(c, cid)
        head = c[0] if head is None else head
        early = c == head
        previous = np.concatenate(([m], at[:-1]))
        missed = np.where(new, at, at - previous - 1)
        cols: dict = {"cid": pa.array(c), "m": pa.array(at), "change_id": batch.column("change_id"), "batch": batch.column("batch"), "gone": pa.array(op == 2), "missed": pa.array(missed), "start": pa.array(new & early)}
        for j, name in enumerate(("city", "balance")):
            col = batch.column(name)
            sets = (op > 0) | col.is_valid().to_numpy(zero_copy_only=False)
            source = np.where(sets, np.arange(k), -1)
            # a client's first row ends what came before
            edge = np.where(new, np.arange(k), -1)
            source, edge = np.maximum.accumulate(source), np.maximum.accumulate(edge)
            own = (source >= 0) & (source >= edge)
            within = edge >= 0
            cleared = own & (op[np.maximum(source, 0)] == 2)
            taken = col.take(pa.array(np.where(own & ~cleared, source, 0), mask=~(own & ~cleared)))
            before = ~own & ~within
            held = pa.array([value[j]] * int(before.sum()), col.type)
            full = taken.to_numpy(zero_copy_only=False).astype(object)
            full[before] = held.to_pylist()
            settled = own | np.where(within, ~early, known[j] | (not bool(head == cid)))
            if j:
                full = [None if x is None or (isinstance(x, float) and x != x and not valid) else x for x, valid in zip(full, taken.is_valid().to_numpy(zero_copy_only=False) | before)]
            cols[name] = pa.array(list(full), col.type)
            cols[f"{name}_open"] = pa.array(~settled)
            value[j], known[j] = cols[name][-1].as_py(), bool(settled[-1])
        cid, m = c[-1], int(at[-1])
        ended = bool(op[-1] == 2)
        cols |= {"task": pa.array(np.full(k, task, np.int32)), "kind": pa.array(np.zeros(k, np.int32))}
        last = np.append(c[1:] != c[:-1], True)
        cols["last"] = pa.array(last)
        out = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
        if shape is not None:
            yield _unlast(shape, c[0])
        shape = out
    if shape is not None:
        yield shape
        own = {"cid": int(cid), "m": m, "change_id": int(head), "city": value[0], "balance": value[1], "city_open": not known[0], "balance_open": not known[1], "gone": ended, "start": bool(head == cid), "task": task, "kind": 1}
        yield pa.RecordBatch.from_arrays([pa.array([own.get(f.name)], f.type) for f in shape.schema], shape.schema.names)


def _unlast(batch: pa.RecordBatch, following: int) -> pa.RecordBatch:
    """The batch's last row isn't its client's last if the next batch goes on with it."""
    if batch.column("cid")[-1].as_py() != following:
        return batch
    last = batch.column("last").to_numpy(zero_copy_only=False).copy()
    last[-1] = False
    return batch.set_column(batch.schema.get_field_index("last"), "last", pa.array(last))


def effects(applied: DataFrame) -> DataFrame:
    """(cid, change_id, batch, missed, city, balance, current) of applied changes."""
    spark = applied.sparkSession
    shape = "cid long, m long, change_id long, batch int, gone boolean, missed long, start boolean, city string, city_open boolean, balance double, balance_open boolean, task int, kind int, last boolean"
    table = _scanned(applied.select("cid", "m", "change_id", "op", "city", "balance", "batch"), ["m"], _effects, shape, "effects")
    parts = sorted(table.where("kind = 1").collect(), key=lambda r: r["task"])  # a row a partition
    carry, cid, m, value = [], None, -1, (None, None)
    for k, p in enumerate(parts):
        head, one = p["change_id"], p["start"]
        same = head == cid
        follows = k + 1 < len(parts) and parts[k + 1]["change_id"] == p["cid"]
        carry.append((p["task"], m if same else -1, *(value if same else (None, None)), p["cid"], follows))
        inherit = value if same and one else (None, None)
        value = (inherit[0] if p["city_open"] else p["city"], inherit[1] if p["balance_open"] else p["balance"])
        cid, m = p["cid"], p["m"]
    given = spark.createDataFrame(carry, "task int, _m long, _city string, _balance double, _tail long, _follows boolean")
    rows = table.where("kind = 0").join(given, "task")
    own = lambda c: F.when(F.col(f"{c}_open"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    last = F.col("last") & ~((F.col("cid") == F.col("_tail")) & F.col("_follows"))
    missed = F.when(F.col("start"), F.col("m") - F.col("_m") - 1).otherwise(F.col("missed"))
    return rows.select("cid", "change_id", "batch", missed.alias("missed"), own("city"), own("balance"), (last & ~F.col("gone")).alias("current"))


def numbered(changes: DataFrame, batches: int, first_day: int, days: int, jitter: int, drop: int) -> DataFrame:
    """Distinct changes with their day, batch and whether they take part; client and seq as plain longs."""
    rows = _store.plain(changes, "change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").distinct()
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    day = (F.unix_date(F.to_date("valid_at")) + jitter * (h % 4)).cast("int")
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / days))).cast("int")
    rows = rows.select(
        F.coalesce("client_id", F.lit(NO_ID)).alias("cid"), F.coalesce("seq", F.lit(NO_ID)).alias("s"), "change_id", "op", "city", "balance", day.alias("day"),
        F.coalesce(F.col("valid_at").isNotNull() & (h % drop != 0), F.lit(False)).alias("live"), F.xxhash64("op", "valid_at", "source", "segment", "city", "balance").alias("tie"),
    )
    return rows.withColumn("batch", F.coalesce(batch, F.lit(1)))


def apply_changes(changes: DataFrame, batches: int = 12, first_day: int = 19723, days: int = 160, jitter: int = 9, drop: int = 11, grace: int = GRACE) -> DataFrame:
    """(change_id, client_id, status, batch, missed, city, balance, current) of all changes that take part."""
    spark = changes.sparkSession
    live, parts = dense_ranks(numbered(changes, batches, first_day, days, jitter, drop), changes.count())
    parts = parts.select("cid", "n", "early", "task", "day", "change_id").collect()  # a row a partition
    carried, spans = _carried(parts)
    offsets = F.broadcast(spark.createDataFrame(carried, "task int, _offset long, _head long, _tail long"))
    told = {r["batch"]: r for r in live.groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("rows")).collect()}  # a row a batch
    applier = Applier(spark, sum(r["rows"] for r in told.values()), spans, grace)
    for k in range(1, batches + 1):
        rows = live.where(F.col("batch") == k).join(offsets, "task")
        n = F.col("n") + F.when(F.col("early"), F.col("_offset")).otherwise(0)
        part = F.when((F.col("cid") == F.col("_head")) | (F.col("cid") == F.col("_tail")), F.col("task"))
        applier.feed(rows.withColumns({"n": n, "client_id": F.col("cid"), "part": part}), told[k]["day"] if k in told else None)
    applier.finish()
    done = applier.settled()
    after = effects(done.where("status = 'applied'")).withColumn("status", F.lit("applied"))
    lost = done.where("status = 'rejected'").select("cid", "change_id", "batch", F.lit(0).cast("long").alias("missed"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("double").alias("balance"), F.lit(False).alias("current"), "status")
    out = after.unionByName(lost)
    return out.select("change_id", F.when(F.col("cid") != NO_ID, F.col("cid")).alias("client_id"), "status", "batch", "missed", "city", "balance", "current")


def op11_changes(spark, sf_dir: str) -> DataFrame:
    out = apply_changes(spark.read.parquet(f"{sf_dir}/client_changes.parquet"))
    cents = F.expr("try_cast(floor(100 * balance + 0.5) AS BIGINT)")
    return out.select("change_id", "client_id", "status", "batch", "missed", "city", cents.alias("cents"), "current")


def brute(rows: list[dict], batches: int = 12, first_day: int = 19723, days: int = 160, jitter: int = 9, drop: int = 11, grace: int = GRACE) -> list[tuple]:
    """The same change by change, for tests."""
    import datetime
    import math
    import zlib

    rank: dict = {}
    for r in rows:
        rank.setdefault(r["client_id"], set()).add(r["seq"])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(v, key=lambda x: (x is not None, x or 0)))} for c, v in rank.items()}
    fed: dict = {}
    for r in rows:
        if r["valid_at"] is None or r["change_id"] is None:
            continue
        h = zlib.crc32(str(r["change_id"]).encode())
        if h % drop:
            day = (r["valid_at"].date() - datetime.date(1970, 1, 1)).days + jitter * (h % 4)
            fed.setdefault(max(1, min(batches, 1 + (day - first_day) * batches // days)), []).append((day, r["change_id"], r))
    clients: dict = {c: {"next": 1, "held": {}, "values": [None, None], "top": 0, "last": None} for c in rank}
    out: dict = {}

    def apply(c, s, n, batch):
        day, r = s["held"].pop(n)
        if r["op"] == "D":
            s["values"] = [None, None]
        else:
            s["values"] = [new if r["op"] == "I" or new is not None else old for old, new in zip(s["values"], (r["city"], r["balance"]))]
        b = s["values"][1]
        out[r["change_id"]] = [c, "applied", batch, n - s["top"] - 1, s["values"][0], None if b is None else math.floor(100 * b + 0.5), False]
        s["top"], s["next"], s["last"] = n, n + 1, r

    largest = None
    for batch in range(1, batches + 2):
        for c, s in clients.items():
            while s["held"] and (batch > batches or largest is not None and min(d for d, _ in s["held"].values()) + grace <= largest):
                s["next"] = min(s["held"])
                while s["next"] in s["held"]:
                    apply(c, s, s["next"], batch)
        for day, i, r in sorted(fed.get(batch, []), key=lambda x: x[:2]):
            s, n = clients[r["client_id"]], rank[r["client_id"]][r["seq"]]
            if n in s["held"] or n < s["next"]:
                out[i] = [r["client_id"], "rejected", batch, 0, None, None, False]
                continue
            s["held"][n] = (day, r)
            while s["next"] in s["held"]:
                apply(r["client_id"], s, s["next"], batch)
        largest = max([d for d, _, _ in fed.get(batch, [])] + ([] if largest is None else [largest]), default=None)
    for s in clients.values():
        if s["last"] is not None and s["last"]["op"] != "D":
            out[s["last"]["change_id"]][6] = True
    return sorted((i, *v) for i, v in out.items())
