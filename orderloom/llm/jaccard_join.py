"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct ``width``-word shingles. Under each of ``orders`` global orders
(frequent shingles last, the rest by another hash each time) a linked pair must share a token among
the first ``n - ceil(threshold * n) + 1`` of both, and enough of them for the rest to reach the
overlap that the threshold asks for. A pair is a candidate only if it passes under every order; then
the whole sets are compared.

* Equal sets meet as one signature first, so copies never become pairs.
* Each entry of a bucket carries a sketch of its set: the parity of the tokens that fall on each of 128
  bits. Two sets differ in at least as many tokens as their sketches differ in bits, so a pair whose
  sketches differ in more bits than a linked pair's sets may differ in tokens isn't a candidate, whatever
  the order. That is exact, and is asked of each pair of a bucket before anything is emitted. Sets above
  ``SKETCHED`` tokens have no sketch, and pass.
* A token's bucket is cut where sizes leave a gap that no linked pair spans. A piece of up to ``BUCKET``
  sets yields the pairs that pass, packed and pre-counted. In a larger piece, a search along the pairs
  that pass yields a forest: a link for each set but the first of its tree. Copies are found by the first
  of them, so a piece of near copies is searched in one pass; one without any is compared pair by pair.
* Sets that candidates join form clusters, and a cluster is cut into blocks of up to ``BLOCK`` sets, each
  verified in one task by a product. Heads of the linked groups found there are compared in blocks, too.
  That joins most near copies of one text. Then a larger cluster is cut anew, along its components: each
  pair of blocks is verified, but for those of one component, which have nothing left to join. No row is
  emitted for a pair, and no link between components is lost.
* Links become components by star contraction. Nothing of all documents goes to the driver; what is
  broadcast is bounded: the most frequent shingles (``HEAVY``) and a bitmap of candidates (``BITS``).
* The number of parts follows from the number of shingles, so a part's size doesn't grow with the input.

Shingles are compared as 48-bit hashes and sets as 64-bit signatures.

Defined results: a null, empty or wordless text has an empty set, links with nothing and is its own
component; a text under ``width`` words has one shingle, its whole sequence; repeated rows are equal
sets and link; a null doc_id counts as smaller than all others and comes back as null; an empty table
gives an empty result; other columns are ignored. A doc_id that isn't of an integer type is refused (TypeError).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from ._text import U

WIDTH = 5
PERCENT = 80
ORDERS = 3
BUCKET = 96
#: Parts at least, so that what a part's number leaves of a token's 42 bits fits 4 bytes; prefix tokens of a part at most, on average.
PARTS = 1 << 10
PART = 4_000_000
#: Frequent shingles kept on the driver, at most; 9 bytes each. Fewer only change the orders.
HEAVY = 1_000_000
#: Sets and shingles of a block, on average at most, and members of a group whose head is compared with others.
BLOCK = 96
BLOCK_SHINGLES = 60_000
GROUP = 4
#: Sets that hold a frequent shingle, at least.
OFTEN = 32
#: Tokens of a set that has a sketch, at most; a pair may differ in 2/9 of its tokens, and chance differs in half of the bits.
SKETCHED = 256
#: Words of the candidates' bitmap, 8 bytes each.
BITS = 1 << 17
NO_ID = -(2**63)
_LOW = U((1 << 48) - 1)
_M42 = U((1 << 42) - 1)
_SALT = [U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)]


def shingle_sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text's index << 48 | shingle) of a batch, and the size of each text's set."""
    data, offs = _text.buffer(text)
    starts, ends, first = _text.spans(data, offs, _text.SPACE)
    h = _text.word_hashes(data, starts, ends, fold=True)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    keys = []
    if len(h) >= width:
        inside = np.flatnonzero(doc[: len(h) - width + 1] == doc[width - 1 :])
        keys.append((doc[inside].astype(U) << U(48)) | (_text.grams(h, width)[inside] >> U(16)))
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        keys.append((short.astype(U) << U(48)) | (_text.whole(h, first[short], first[short + 1]) >> U(16)))
    keys = _text.distinct(np.concatenate(keys)) if keys else np.zeros(0, U)
    return keys, np.bincount((keys >> U(48)).astype(np.int64), minlength=len(words))


def signatures(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), U)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(_text.mix(keys & _LOW), at[full])
    return _text.mix(out + sizes.astype(U) * U(0xD6E8FEB86659FD93)).view(np.int64)


def sketches(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of 64 parities each of the tokens of each set, none of them empty; zero for sets that are too large."""
    bit = _text.mix(token * _SALT[4])
    flag, upper = U(1) << (bit & U(63)), (bit >> U(6)) & U(1) == 1
    at = np.cumsum(sizes) - sizes
    return tuple(np.where(sizes <= SKETCHED, np.bitwise_xor.reduceat(np.where(mine, flag, U(0)), at), U(0)) for mine in (~upper, upper))


def near(xa, ya, na, xb, yb, nb, percent: int) -> np.ndarray:
    """Which pairs' sizes and sketches allow a link."""
    both = na + nb
    apart = np.bitwise_count(xa ^ xb).astype(np.int64) + np.bitwise_count(ya ^ yb)
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= percent * large) & ((apart <= both - 2 * -(-percent * both // (100 + percent))) | (large > SKETCHED))


def spanning(sig, x, y, n, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that join all sets of a piece that pairs which may link join; sizes rise."""
    queue: list = []
    out: tuple = ([], [])
    at = 0
    while at < len(sig):
        if queue:
            own = queue.pop()
        else:
            own = (sig[at], x[at], y[at], n[at])
            at += 1
        # sizes rise: what is too small or too large for a link isn't looked at
        lo = at + int(np.searchsorted(n[at:], -(-percent * own[3] // 100)))
        hi = at + int(np.searchsorted(n[at:], 100 * own[3] // percent, "right"))
        hit = near(own[1], own[2], own[3], x[lo:hi], y[lo:hi], n[lo:hi], percent)
        if hit.any():
            k = lo + np.flatnonzero(hit)
            out[0].append(sig[k])
            out[1].append(np.full(len(k), own[0], U))
            queue += zip(sig[k], x[k], y[k], n[k])
            left = np.ones(len(sig), bool)
            left[:at] = False
            left[k] = False
            sig, x, y, n, at = sig[left], x[left], y[left], n[left], 0
    none = [np.zeros(0, U)]
    return np.concatenate(out[0] or none), np.concatenate(out[1] or none)


def _batch(cols: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in cols.items()], list(cols))


def _facts(batches, width: int):
    """(_id, n, sig) of each document, and its key if there is one."""
    types = {"_id": pa.int64(), "n": pa.int64(), "sig": pa.int64()}
    for batch in _text.pieces(batches):
        keys, sizes = shingle_sets(batch.column(1), width)
        more = {"key": batch.column(2)} if batch.num_columns > 2 else {}
        yield _batch({"_id": batch.column(0), "n": sizes.astype(np.int64), "sig": signatures(keys, sizes)} | more, types | dict.fromkeys(more, pa.int64()))


def _fresh(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a batch, and which of its texts are the first with their set."""
    sig = signatures(keys, sizes)
    fresh = np.zeros(len(sig), bool)
    fresh[np.unique(sig, return_index=True)[1]] = True
    return sig, fresh & (sizes > 0)


def _dealt(part: np.ndarray):
    """(part, places) of each part that occurs."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        yield int(part[order[a]]), order[a:b]


def _tallies(batches, width: int, parts: int):
    """How many distinct sets of a chunk hold each shingle, packed by part."""
    for batch in _text.pieces(batches):
        keys, sizes = shingle_sets(batch.column(0), width)
        _, fresh = _fresh(keys, sizes)
        token = np.sort((keys & _LOW)[np.repeat(fresh, sizes)])
        if not len(token):
            continue
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count, token = np.diff(np.append(first, len(token))).astype(U), token[first]
        out: tuple = ([], [])
        for part, k in _dealt((token % U(parts)).astype(np.int64)):
            out[0].append(part)
            out[1].append(_text.planes(token[k] // U(parts), 6) + _text.planes(count[k], 2))
        yield _batch({"part": out[0], "blob": out[1]}, {"part": pa.int32(), "blob": pa.binary()})


def _frequent(batches, parts: int, least: int):
    """(shingle, sets) of the shingles of at least so many sets."""
    for part, blobs in _grouped(batches):
        cols: list = [[], []]
        for blob in blobs:
            k, at = len(blob) // 8, 0
            for c, w in zip(cols, (6, 2)):
                x, at = _text.unplanes(blob, k, w, at)
                c.append(x)
        token, count = (np.concatenate(c) for c in cols)
        order = np.argsort(token)
        token, count = token[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        total = np.add.reduceat(count, first)
        often = total >= least
        yield _batch({"token": (token[first[often]] * U(parts) + U(part)).view(np.int64), "n": total[often].view(np.int64)}, {"token": pa.int64(), "n": pa.int64()})


def _prefixes(batches, width: int, percent: int, orders: int, parts: int, heavy):
    """Prefix tokens of each distinct set in a chunk, packed by part: order * parts + token's part."""
    tokens, grade = heavy.value
    may = np.zeros(1 << 20, bool)
    may[(tokens & U((1 << 20) - 1)).astype(np.int64)] = True
    for batch in _text.pieces(batches):
        keys, sizes = shingle_sets(batch.column(0), width)
        sig, fresh = _fresh(keys, sizes)
        sig = sig.view(U)
        keys = keys[np.repeat(fresh, sizes)]
        docs = np.flatnonzero(fresh)
        n = sizes[docs]
        if not len(docs):
            continue
        token, doc = keys & _LOW, np.repeat(np.arange(len(docs)), n).astype(U) << U(48)
        x, y = sketches(token, n)
        rank = np.zeros(len(token), U)
        if len(tokens):
            hit = np.flatnonzero(may[(token & U((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(tokens, token[hit]), len(tokens) - 1)
            same = tokens[at] == token[hit]
            rank[hit[same]] = grade[at[same]].astype(U) << U(42)
        prefix = n - -(-percent * n // 100) + 1
        take = _text.ragged(np.cumsum(n) - n, prefix)
        owner = np.repeat(np.arange(len(docs)), prefix)
        for j in range(orders):
            out = ([], [])
            sorted_ = np.sort(doc | rank | (_text.mix(token * _SALT[j] + U(j)) >> U(22)))
            t = sorted_[take] & _M42
            part = (t % U(parts)).astype(np.int64)
            t = t // U(parts)
            for p, k in _dealt(part):
                d = owner[k]
                out[0].append(j * parts + p)
                out[1].append(_text.planes(t[k], 4) + _text.planes(sig[docs[d]], 6) + _text.planes(n[d], 4) + _text.planes(x[d], 8) + _text.planes(y[d], 8))
            yield _batch({"part": out[0], "blob": out[1]}, {"part": pa.int32(), "blob": pa.binary()})


def need(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that the prefixes of a linked pair share at least."""
    overlap = -(-percent * (na + nb) // (100 + percent))
    rest = np.maximum(-(-percent * na // 100) - 1, -(-percent * nb // 100) - 1)
    return np.maximum(overlap - rest, 1)


def _grouped(batches):
    """(part, blobs) of a partition that is sorted by part."""
    part, held = None, []
    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(blob)
    if held:
        yield part, held


def _pairs(batches, percent: int, parts: int, bucket: int, deal: int):
    """Packed pairs of small pieces with their counts (kind 0); the links of larger ones (kind 1)."""
    types = {"part": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    for part, blobs in _grouped(batches):
        cols = [[] for _ in range(5)]
        for blob in blobs:
            k, at = len(blob) // 30, 0
            for c, w in zip(cols, (4, 6, 4, 8, 8)):
                v, at = _text.unplanes(blob, k, w, at)
                c.append(v)
        token, sig, n, x, y = (np.concatenate(c) for c in cols)
        del cols
        order = np.argsort(token)
        t = token[order]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        live = order[same[1:] | same[:-1]]
        token, sig, n, x, y = token[live], sig[live], n[live].astype(np.int64), x[live], y[live]
        order = np.lexsort((sig, n, token))
        token, sig, n, x, y = (c[order] for c in (token, sig, n, x, y))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig, n, x, y = (c[new] for c in (token, sig, n, x, y))
        # sizes rise within a token: a gap that is too wide for a link ends a piece
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
        head = np.flatnonzero(first)
        size = np.diff(np.append(head, len(token)))
        big = size > bucket
        if big.any():
            trees = [spanning(sig[i : i + k], x[i : i + k], y[i : i + k], n[i : i + k], percent) for i, k in zip(head[big], size[big])]
            u, v = (np.concatenate(c) for c in zip(*trees))
            out = ([], [])
            for p, k in _dealt((_text.mix(u ^ _text.mix(v)) % U(deal)).astype(np.int64)):
                out[0].append(p)
                out[1].append(_text.planes(u[k], 6) + _text.planes(v[k], 6))
            yield _batch({"part": out[0], "kind": [1] * len(out[0]), "blob": out[1]}, types)
        left = np.repeat(np.where(big, 0, size), size) - (np.arange(len(token)) - np.repeat(head, size)) - 1
        lo, hi = [], []
        at, lag = np.flatnonzero(left >= 1), 1
        while len(at):
            to = at + lag
            fit = near(x[at], y[at], n[at], x[to], y[to], n[to], percent)
            lo.append(at[fit])
            hi.append(to[fit])
            lag += 1
            at = at[left[at] >= lag]
        if not lo or not sum(map(len, lo)):
            continue
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        lo, hi = np.where(sig[lo] < sig[hi], lo, hi), np.where(sig[lo] < sig[hi], hi, lo)
        a, b, na, nb = sig[lo], sig[hi], n[lo], n[hi]
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        count = np.diff(np.append(first, len(a)))
        a, b, na, nb = a[first], b[first], na[first], nb[first]
        to = (_text.mix(a) % U(deal)).astype(np.int64)
        out = ([], [])
        for p, k in _dealt(to):
            out[0].append(p)
            out[1].append(b"".join(_text.planes(v[k], w) for v, w in ((a, 6), (b, 6), (na, 4), (nb, 4), (count, 4), (np.full(len(a), part // parts), 1))))
        yield _batch({"part": out[0], "kind": [0] * len(out[0]), "blob": out[1]}, types)


def _candidates(batches, percent: int, orders: int):
    """(0, a, b): pairs that pass under every order; (1, a, b): the links of large pieces."""
    types = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64()}

    def settled(blobs):
        cols = [[] for _ in range(6)]
        for blob in blobs:
            k, at = len(blob) // 25, 0
            for c, w in zip(cols, (6, 6, 4, 4, 4, 1)):
                x, at = _text.unplanes(blob, k, w, at)
                c.append(x)
        a, b, na, nb, count, j = (np.concatenate(c) for c in cols)
        order = np.lexsort((b, a))
        a, b, na, nb, count, j = (x[order] for x in (a, b, na.astype(np.int64), nb.astype(np.int64), count.astype(np.int64), j.astype(np.int64)))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        seen = np.zeros((len(first), orders), np.int64)
        np.add.at(seen, (group, j), count)
        ok = first[(seen >= need(na[first], nb[first], percent)[:, None]).all(axis=1)]
        return _batch({"kind": np.zeros(len(ok), np.int32), "a": a[ok].view(np.int64), "b": b[ok].view(np.int64)}, types)

    def large(blobs):
        """Each link once."""
        cols = [[], []]
        for blob in blobs:
            k = len(blob) // 12
            for i in range(2):
                cols[i].append(_text.unplanes(blob, k, 6, 6 * k * i)[0])
        pairs = np.stack([np.concatenate(c) for c in cols])
        pairs = pairs[:, np.lexsort(pairs)]
        new = np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)))
        a, b = pairs[:, new].view(np.int64)
        return _batch({"kind": np.ones(len(a), np.int32), "a": a, "b": b}, types)

    part, held = None, ([], [])
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if p != part:
                if held[0]:
                    yield settled(held[0])
                if held[1]:
                    yield large(held[1])
                held = ([], [])
            part = p
            held[kind].append(blob)
    if held[0]:
        yield settled(held[0])
    if held[1]:
        yield large(held[1])


def _sets(batches, width: int, bits):
    """(_id, sig, set) of the documents that the bitmap may hold, each set once a chunk and id."""
    bitmap = bits.value
    types = {"_id": pa.int64(), "sig": pa.int64(), "n": pa.int64(), "tokens": pa.binary()}

    def wanted():
        for batch in batches:
            k = batch.column(1).to_numpy(zero_copy_only=False).view(U)
            hit = (bitmap[(k >> U(6)).astype(np.int64) % len(bitmap)] >> (k & U(63))) & U(1)
            if hit.any():
                yield batch.filter(pa.array(hit.astype(bool)))

    for batch in _text.pieces(wanted()):
        keys, sizes = shingle_sets(batch.column(2), width)
        sig = signatures(keys, sizes)
        at = np.cumsum(sizes) - sizes
        token = keys & _LOW
        blobs = [_text.planes(token[x : x + n], 6) for x, n in zip(at, sizes)]
        yield _batch({"_id": batch.column(0), "sig": sig, "n": sizes.astype(np.int64), "tokens": blobs}, types)


def _blocks(batches, percent: int):
    """Links of the sets of a pair of blocks, as a forest: each set and the smallest that it reaches here."""

    def forest(sigs, sizes, blobs):
        token = np.concatenate([_text.unplanes(x, n, 6)[0] for x, n in zip(blobs, sizes)])
        doc = np.repeat(np.arange(len(sigs)), sizes)
        order = np.argsort(token)
        token, doc = token[order], doc[order]
        col = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) - 1
        keep = np.bincount(col)[col] > 1
        doc = doc[keep]
        col = np.cumsum(np.concatenate(([True], np.diff(col[keep]) > 0))) - 1 if keep.any() else col[:0]
        shared = np.zeros((len(sigs), len(sigs)), np.float32)
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
            x, y = np.searchsorted(col, (c, c + 2048))
            m = np.zeros((len(sigs), 2048), np.float32)
            m[doc[x:y], col[x:y] - c] = 1
            shared += m @ m.T
        n = np.array(sizes, np.float64)
        link = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        sig = np.array(sigs, np.int64)
        label = sig.copy()
        while True:
            new = np.where(link, label[None, :], label[:, None]).min(axis=1)
            if (new == label).all():
                break
            label = new
        far = label != sig
        return _batch({"u": sig[far], "v": label[far]}, {"u": pa.int64(), "v": pa.int64()})

    unit, held = None, ([], [], [])
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for c, i, j, sig, n, tokens in zip(*cols):
            if (c, i, j) != unit and held[0]:
                yield forest(*held)
                held = ([], [], [])
            unit = (c, i, j)
            for x, v in zip(held, (sig, n, tokens)):
                x.append(v)
    if held[0]:
        yield forest(*held)


def link_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, orders: int = ORDERS, key: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``: the smallest doc_id that links reach.

    With ``key`` (of longs) also that of the row, and a ``group`` that no other component has, whatever its ids.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    n = _store.tasks(spark)
    own = F.coalesce(_store.long_id(docs, "doc_id"), F.lit(NO_ID)).alias("_id")
    texts = docs.select(own, "text")
    noted = texts if key is None else docs.select(own, "text", key.alias("key"))
    facts = _store.written(noted.mapInArrow(lambda b: _facts(b, width), "_id long, n long, sig long" + ("" if key is None else ", key long")), "facts")

    shingles = facts.agg(F.sum("n")).first()[0] or 0
    deal = max(2 * n, shingles // PART)
    parts = max(PARTS, deal)

    tallies = texts.select("text").mapInArrow(lambda b: _tallies(b, width, parts), "part int, blob binary")
    often = tallies.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lambda b: _frequent(b, parts, OFTEN), "token long, n long")
    with _store.cleaned(spark):
        often = often.orderBy(F.desc("n"), "token").limit(HEAVY).toPandas()
    token = often["token"].to_numpy(np.int64).view(U)
    order = np.argsort(token)
    grade = np.minimum(np.log2(np.maximum(often["n"].to_numpy(np.float64), 1)).astype(np.uint8), 63)
    token, grade = token[order], grade[order]
    heavy = sc.broadcast((token, grade))

    packed = texts.select("text").mapInArrow(lambda b: _prefixes(b, width, percent, orders, parts, heavy), "part int, blob binary")
    pairs = packed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lambda b: _pairs(b, percent, parts, BUCKET, deal), "part int, kind int, blob binary")
    found = pairs.repartition(n, "part").sortWithinPartitions("part").mapInArrow(lambda b: _candidates(b, percent, orders), "kind int, a long, b long")
    found = _store.written(found, "candidates")

    reps = _store.written(
        facts.where("n > 0").groupBy("sig").agg(F.min("_id").alias("_id"), F.max("n").alias("n"), F.count("*").alias("copies")).withColumn("low", F.col("sig").bitwiseAND((1 << 48) - 1)), "sets"
    )
    ends = found.select(F.col("a").alias("low")).union(found.select("b")).distinct()
    verts = _store.written(reps.join(ends, "low").withColumn("k", F.xxhash64("_id")), "vertices")
    with _store.cleaned(spark):
        words = verts.select((F.shiftrightunsigned("k", 6) % BITS).alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap = np.zeros(BITS, U)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(U)
    bits = sc.broadcast(bitmap)

    # candidates that links may join, directly or not, are compared together
    grouped = _store.components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    crowd = _store.written(grouped.withColumnsRenamed({"node": "low", "component": "c"}).join(verts, "low").select("_id", "sig", "n", "c"), "crowd")
    often = max(100, 2 * crowd.count() // n)
    many = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    placed = _store.met(crowd.select("_id", "sig", "c"), crowd.groupBy("c").agg(F.count("*").alias("n"), many.alias("blocks")), "c", often)
    placed = _store.written(placed.withColumn("i", F.pmod(F.xxhash64("sig"), "blocks")), "placed")
    sets = texts.select("_id", F.xxhash64("_id").alias("k"), "text").mapInArrow(lambda b: _sets(b, width, bits), "_id long, sig long, n long, tokens binary")
    held = _store.written(sets.join(placed, ["_id", "sig"]).select("c", "blocks", "i", "sig", "n", "tokens"), "held")

    def verified(units: DataFrame) -> DataFrame:
        """Links of the sets of each unit (c, i, j)."""
        rows = units.select("c", "i", "j", "sig", "n", "tokens").repartition(n, "c", "i", "j").sortWithinPartitions("c", "i", "j")
        return _store.written(rows.mapInArrow(lambda b: _blocks(b, percent), "u long, v long"), "links")

    links = [verified(held.withColumn("j", F.col("i")))]
    wide, scratch = held.where("blocks > 1"), []
    if not placed.where("blocks > 1").isEmpty():
        named = _store.written(wide.select("c", "i", "sig").join(links[0].withColumnRenamed("u", "sig"), "sig", "left").select("c", "i", "sig", F.coalesce("v", "sig").alias("label")), "labels")
        heads = named.groupBy("c", "i", "label").agg(F.count("*").alias("members")).where(F.col("members") >= GROUP)
        cuts = heads.groupBy("c").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("cuts"))
        heads = _store.written(_store.met(heads.select("c", F.col("label").alias("sig")), cuts, "c", often), "heads")
        links.append(verified(heads.join(wide.select("sig", "n", "tokens"), "sig").withColumn("i", F.pmod(F.xxhash64("sig"), "cuts")).withColumn("j", F.col("i"))))
        joint = _store.components(links[0].union(links[1]))
        named2 = _store.written(named.select("c", "sig").join(joint.withColumnsRenamed({"node": "sig"}), "sig", "left").select("c", "sig", F.coalesce("component", "sig").alias("label")), "labels")
        # components that fill blocks get some of their own; the others share blocks of the number 0
        groups = named2.groupBy("c", "label").agg(F.count("*").alias("m"))
        pure = groups.where(F.col("m") >= BLOCK // 2).select("label", F.col("m").alias("n"), F.ceil(F.col("m") / BLOCK).alias("own"))
        rest = groups.where(F.col("m") < BLOCK // 2).groupBy("c").agg(F.sum("m").alias("n"), F.ceil(F.sum("m") / BLOCK).alias("shared"))
        alone = _store.met(named2.select("c", "sig", "label"), pure, "label", often).select("c", "sig", "label", F.pmod(F.xxhash64("sig"), "own").alias("k"), F.lit(True).alias("pure"))
        mixed = _store.met(named2.join(pure.select("label"), "label", "left_anti").select("c", "sig"), rest, "c", often)
        mixed = mixed.select("c", "sig", F.lit(0).cast("long").alias("label"), F.pmod(F.xxhash64("sig"), "shared").alias("k"), F.lit(False).alias("pure"))
        block = F.struct("pure", "label", "k")
        dealt = _store.written(alone.union(mixed).select("c", "sig", block.alias("own")), "dealt")
        lists = dealt.groupBy("c").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("own")).alias("all"))
        pairs = _store.met(dealt, lists, "c", often).select("c", "sig", "own", (F.array_position("all", F.col("own")) - 1).alias("p"), F.posexplode("all").alias("q", "other"))
        pairs = pairs.where(~(F.col("own.pure") & F.col("other.pure") & (F.col("own.label") == F.col("other.label"))))
        pairs = pairs.select("sig", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
        links.append(verified(pairs.join(wide.select("c", "sig", "n", "tokens"), "sig")))
        scratch = [named, heads, joint, named2, dealt]
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.union(more)

    linked = joined = _store.components(all_links)
    lowest = joined.join(reps, joined["node"] == reps["sig"]).groupBy("component").agg(F.count("*").alias("n"), F.min("_id").alias("m"))
    joined = _store.met(joined, lowest, "component", often).select(F.col("node").alias("sig"), "m", "component")
    named = reps.join(joined, "sig", "left").where("copies > 1 or m is not null").select("sig", F.coalesce("m", "_id").alias("m"), *([] if key is None else [F.coalesce("component", "sig").alias("group")]))
    named = _store.written(named, "named")
    _store.dropped(found, reps, verts, grouped, crowd, placed, held, linked, *links, *scratch)
    rows = facts.select("_id", "n", "sig", *([] if key is None else ["key"])).join(named, "sig", "left")
    least = F.when((F.col("n") > 0) & F.col("m").isNotNull(), F.col("m")).otherwise(F.col("_id"))
    back = lambda c: F.when(c != NO_ID, c)
    more = [] if key is None else ["key", F.when(F.col("n") > 0, F.coalesce("group", "sig")).alias("group")]
    return rows.select(back(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(least).alias("component_id"), *more)


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute(rows, width: int = WIDTH, percent: int = PERCENT) -> dict:
    """The same by an inverted index, for tests: doc_id -> (n_shingles, component_id)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        shared: dict = {}
        for x in s:
            for o in holders.get(x, ()):
                shared[o] = shared.get(o, 0) + 1
            holders.setdefault(x, []).append(d)
        for o, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
