"""Best-fit packing of documents into sequences, with bound-certified repacking.

A document is its token ids and an end id. Documents longer than a sequence are cut into full pieces; the last one may be shorter.
Pieces are dealt to groups of about ``GROUP``. Each group packs its pieces by best-fit decreasing and bounds the number of
sequences it needs from below by dual feasible functions (sums of sizes under functions that no feasible sequence can push above
its capacity). Where the two are equal, the group is certified: no packing of its pieces alone needs fewer. It is settled if the bound
comes from sizes that don't fit together; if it comes from the sum of sizes, what is left over in its last sequences can still fill those of
others. Such groups, and those with a gap, keep the sequences that are full but for a 32nd and exchange the pieces of the rest: these are dealt anew into fewer groups, packed again, and so on until everything is settled, one
group is left, or a round no longer saves a sequence; then the packing before it stays.

* Pieces are dealt by task and place, so copies of one document spread over all groups; a group's size doesn't grow with the input.
* Only narrow rows (id, piece, start, length, checksum) are shuffled, unless ``ids`` asks for the tokens, too.
* A worker tokenises each distinct word once, and keeps the ids of up to ``KNOWN`` by 64-bit hash: white space never lies within
  or joins the units that the tokenizer's rules form, and case doesn't matter to them, so the ids of a text are those of its words
  in order. That holds for tokenizers that fold case, split at white space and drop it, such as the default; for others pass ``words=False``.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are documents of their own; ids may be of any
type; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store, _text

CAPACITY = 2048
END = 0
#: Pieces of a group, on average; rounds of exchanges at most.
GROUP = 50_000
ROUNDS = 6
#: A sequence of a group with a gap stays as it is if less than this part of it is free; what is emptier is exchanged.
SLACK = 32
#: Bytes of text that a task tokenises at once; units whose ids a worker keeps.
CHUNK = 8 << 20
KNOWN = 2_000_000
_loaded: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> Units:
    """The tokenizer of this worker and what it met; Spark's tasks are the threads."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Units(Tokenizer.from_file(path))
    return _loaded[path]


class Units:
    """Ids of the units that this worker met, by 64-bit hash; it starts anew beyond ``KNOWN`` units."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.lens, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units and how many each has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for u in ids for x in u), np.uint32, int(lens.sum())), lens

    def learn(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where each of the (sorted, distinct) keys stands in the tables; units not met before are tokenised."""
        if len(self.keys) + len(keys) > KNOWN:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            raw = data.tobytes()
            flat, lens = self.encode([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            place = len(self.flat) + np.cumsum(lens) - lens
            self.keys, self.at, self.lens, self.flat = np.concatenate((self.keys, keys[new])), np.concatenate((self.at, place)), np.concatenate((self.lens, lens)), np.concatenate((self.flat, flat))
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.at, self.lens = self.keys[order], self.at[order], self.lens[order]
            at = np.searchsorted(self.keys, keys)
        return at


def units_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units, and for each text the number of units before it: words, and what symbols
    follow their last ASCII letter or digit, since the tokenizer's rules always part those."""
    starts, ends, first = _text.spans(data, offs, _text.SPACE)
    if not len(starts):
        return starts, ends, first
    last = np.maximum.accumulate(np.where(_text.SYMBOL[data], -1, np.arange(len(data))))[ends - 1]
    apart = last[(last >= starts) & (last < ends - 1) & (data[last] < 128)] + 1
    starts, ends = np.sort(np.concatenate((starts, apart))), np.sort(np.concatenate((ends, apart)))
    return starts, ends, np.searchsorted(starts, offs, "left")


def encoded(text: pa.Array, known: Units, words: bool = True, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each followed by ``end``, and the offset of each text's ids."""
    if words:
        data, offs = _text.buffer(text)
        if b"<|" in data.tobytes():  # may be a special token, which is told from others by its case and symbols
            starts, ends, first = _text.spans(data, offs, _text.SPACE)
        else:
            data = _text.FOLD[data]
            starts, ends, first = units_of(data, offs)
        keys, at, which = np.unique(_text.word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        place = known.learn(keys, starts[at], ends[at], data)
        flat, unit_at, lens = known.flat, known.at[place], known.lens[place]
    else:
        flat, lens = known.encode([t or "" for t in text.to_pylist()])
        unit_at = np.cumsum(lens) - lens
        which, first = np.arange(len(text)), np.arange(len(text) + 1)
    size = lens[which]
    until = np.concatenate(([0], np.cumsum(size)))[first] + np.arange(len(first))
    out = np.full(int(until[-1]), end, np.uint32)
    inner = np.ones(len(out), bool)
    inner[until[1:] - 1] = False
    out[inner] = flat[_text.ragged(unit_at[which], size)]
    return out, until


def _cut(batches, path: str, words: bool, end: int, capacity: int, ids: bool):
    """Pieces of all documents, with the task and the place in it."""
    tokenizer, task, nth = _tokenizer(path), TaskContext.get().partitionId(), 0
    for batch in _text.pieces(batches, limit=CHUNK):
        flat, offs = encoded(batch.column(1), tokenizer, words, end)
        total = np.diff(offs)
        count = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(total[doc] - start, capacity)
        at = offs[doc] + start
        raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(at))
        cols = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, at[-1] + length[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
            names.append("ids")
        place = pa.array(np.arange(nth, nth + len(doc)))
        nth += len(doc)
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(doc), task, np.int32)), place], [*names, "_task", "_nth"])


def cut_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, words: bool = True, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], _task, _nth) of each piece, written to the shared folder."""
    path = path or vocabulary()
    kind = docs.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * ids + [("_task", T.IntegerType()), ("_nth", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    return _store.written(_store.plain(docs, "doc_id", "text").mapInArrow(lambda b: _cut(b, path, words, end, capacity, ids), schema), "pieces")


def lower_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that pieces need at least; count[s] pieces have the size s.

    The largest bound of these families of dual feasible functions: sizes as they are; for each threshold, sizes above capacity - threshold as a whole
    sequence and those below the threshold as nothing; and for k = 1..32, floor((k + 1) * s / capacity) / k unless that is even.
    """
    s = np.arange(capacity + 1)
    n, size = count.astype(np.int64), count.astype(np.int64) * s
    upto_n, upto_s = np.cumsum(n), np.cumsum(size)
    best = -(-int(size.sum()) // capacity)
    half = capacity // 2
    a = np.arange(1, half + 1)
    whole = upto_n[-1] - upto_n[capacity - a]
    big = upto_n[capacity - a] - upto_n[half]
    big_size = upto_s[capacity - a] - upto_s[half]
    small = upto_s[half] - upto_s[a - 1]
    more = np.maximum(0, -(-(small - (big * capacity - big_size)) // capacity))
    best = max(best, int((whole + big + more).max(initial=0)))
    for k in range(1, 33):
        up = (k + 1) * s
        value = np.where(up % capacity == 0, s * k, up // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (capacity * k)))
    return best


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each size in the order given, each into the fullest sequence that has room; and their number.

    Sequences with the same room are a stack; a bit for each room says which stacks aren't empty.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        above = rooms >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, used
            used += 1
        seq[i], off[i] = b, capacity - room
        left = room - s
        if left:
            stacks[left].append(b)
            rooms |= 1 << left
    return seq, off, used


def _packed(table: pa.Table, capacity: int) -> pa.Table:
    """A group's packing, its bound, and which rows are settled by it."""
    keys = [("length", "descending"), ("ids_crc32", "ascending"), ("piece", "ascending"), ("_task", "ascending"), ("_nth", "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=keys))
    size = table["length"].to_numpy()
    seq, off, used = best_fit(size, capacity)
    bound = lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
    full = np.bincount(seq, size, used)[seq] >= capacity - capacity // SLACK
    n = table.num_rows
    more = {"seq": seq, "offset": off, "used": np.full(n, used), "bound": np.full(n, bound), "settled": full | ((used == bound) & (bound > -(-int(size.sum()) // capacity)))}
    for name, value in more.items():
        table = table.append_column(name, pa.array(value))
    return table


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """The pieces of cut_documents() with ``sequence_id`` and ``offset``."""
    names = [c for c in pieces.columns if c not in ("_task", "_nth")]
    live, spent, settled = pieces, None, []
    n = pieces.count()
    groups = max(1, -(-n // group))
    for k in range(rounds):
        dealt = live.withColumn("grp", F.pmod(F.xxhash64(F.lit(k), "_task", "_nth"), F.lit(groups)))
        schema = T.StructType([*dealt.schema, *(T.StructField(c, T.LongType()) for c in ("seq", "offset", "used", "bound")), T.StructField("settled", T.BooleanType())])
        done = _store.written(dealt.groupBy("grp").applyInArrow(lambda t: _packed(t, capacity), schema), "packed")
        used = done.groupBy("grp").agg(F.max("used").alias("used")).agg(F.sum("used")).first()[0] or 0
        if spent is not None and used >= spent:
            settled.append(before.where("not settled"))  # noqa: F821  the packing before it is as good
            break
        named = done.select(*names, "offset", (F.lit(k).cast("long") * (1 << 56) + F.col("grp") * (1 << 28) + F.col("seq")).alias("sequence_id"), "settled", "_task", "_nth", "grp", "seq")
        settled.append(named.where("settled"))
        left = done.where("not settled")
        open_ = left.agg(F.count("*").alias("rows"), F.count_distinct("grp", "seq").alias("seqs")).first()
        if not open_["rows"] or groups == 1 or k == rounds - 1:
            settled.append(named.where("not settled"))
            break
        before, spent, live = named, open_["seqs"], left.select(*pieces.columns)
        groups = max(1, min(groups - 1, -(-open_["rows"] // group)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, words: bool = True, ids: bool = False, group: int = GROUP) -> DataFrame:
    """Each piece of each document with its sequence and its offset there."""
    return pack(cut_documents(docs, path, capacity, end, words, ids), capacity, group)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the tokens of each sequence and where its pieces begin; for pieces with ``ids``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))


def bound_of(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences used and the least that any packing of these pieces needs, from the counts of all sizes."""
    sizes = packed.groupBy("length").count().collect()  # at most capacity rows
    count = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        count[r["length"]] = r["count"]
    return {"used": packed.where("offset = 0").count(), "bound": lower_bound(count, capacity)}


def op13_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
