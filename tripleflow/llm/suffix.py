"""Exact removal of repeated byte strings.

``suffix_array`` is the linear grouping construction: suffixes are grouped by their
Lyndon prefixes, groups are taken in descending order, and pointers to the previous
smaller suffix split lower groups; a second pass emits the order inside the groups.
``repeated_in`` finds repeats with it and serves one shard at a time. CPython runs it
at some microseconds a byte, which is far over any budget for whole tables.

``remove_repeats`` therefore finds the same bytes without sorting suffixes. Every
string of LENGTH bytes has an anchor, the GRAM of its bytes with the least hash, so
equal strings have equal anchors at equal places, and neighbouring strings share
them. Strings that reach far to the right of their anchor, and those that reach far
to its left, have some 60 bytes in common by which they are looked up: where those
are nowhere repeated no more work is needed, where the whole context is repeated its
first place settles it, and only where contexts differ are the strings themselves
compared, by two independent 64-bit hashes. A common part and its context are 112
bits, a string 128: of 1e14 strings, two that differ would be taken for equal with a
chance of about 1e-11.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lm import _pack, _unpack
from .shared import mix, ranges, stage, utf8

LENGTH = 100
GRAM = 24
HALF = (LENGTH - GRAM) // 2
PIECE = 1 << 20
CHUNK = 12 << 20
BUCKET_ROWS = 900_000
HOME_BYTES = 40_000_000  # of text whose findings meet in one task
NO_ID = -(1 << 63)
_PLACE = np.uint64((1 << 30) - 1)
_BASE = 0x5851F42D4C957F2D
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SECOND_BASE = 0xD1342543DE82EF95
_SECOND_BYTES = mix(np.arange(301, 557, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(seq: list[int]) -> list[int]:
    """Starts of the suffixes of ``seq`` in order, a suffix before those that it begins."""
    n = len(seq)
    starts: list[list[int]] = [[] for _ in range(max(seq, default=-1) + 1)]
    for i, c in enumerate(seq):
        starts[c].append(i)
    order = [i for own in starts for i in own]
    place, group, size, before = [0] * n, [0] * n, {}, [-1] * n
    start = 0
    for r, i in enumerate(order):
        if r and seq[order[r - 1]] != seq[i]:
            start = r
        place[i], group[i] = r, start
        size[start] = size.get(start, 0) + 1
    end = n
    while end:
        g = group[order[end - 1]]
        members = order[g:end]
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            before[i] = p
        for i in members:
            # chains inside the group, each link walked once
            chain, p = [i], before[i]
            while p >= 0 and group[p] == g:
                chain.append(p)
                p = before[p]
            for j in chain:
                before[j] = p
        for i in members:
            if (p := before[i]) >= 0:
                counts[p] = counts.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in counts.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[c]:
                old = group[p]
                moved[old] = moved.get(old, 0) + 1
                to = old + size[old] - moved[old]
                other = order[to]
                order[place[p]], order[to] = other, p
                place[other], place[p] = place[p], to
            for old, k in moved.items():
                size[old] -= k
                fresh = old + size[old]
                if size[old]:
                    size[fresh] = k
                    for r in range(fresh, fresh + k):
                        group[order[r]] = fresh
                else:
                    size[old] = k
        end = g
    free, out, done = {}, [-1] * n, [False] * n
    at, k = -1, n
    while True:
        j = k - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free.setdefault(g, g)] = j
            free[g] += 1
            done[j] = True
            j = before[j]
        at += 1
        if at == n:
            return out
        k = out[at]


def repeated_in(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each text, in order, the byte runs covered by strings that start earlier as well, by a suffix array."""
    seq, where = [], []
    for k, t in enumerate(texts):
        seq += [b + len(texts) for b in t] + [k]
        where += [(k, i) for i in range(len(t))] + [(k, -1)]
    covered = [bytearray(len(t)) for t in texts]

    def settle(run: list[int]) -> None:
        first = min(run)
        for r in run:
            if r != first:
                k, i = where[r]
                covered[k][i : i + length] = b"\x01" * length

    run: list[int] = []
    for r in suffix_array(seq):
        k, i = where[r]
        if i < 0 or i + length > len(texts[k]):
            continue
        if run and seq[run[-1] : run[-1] + length] != seq[r : r + length]:
            settle(run)
            run = []
        run.append(r)
    if run:
        settle(run)
    out = []
    for c in covered:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(bytes(c), np.int8), [0]))))
        out.append([(int(a), int(b)) for a, b in edge.reshape(-1, 2)])
    return out


class Rolling:
    """Hashes of the substrings of some bytes."""

    def __init__(self, data: np.ndarray, base: int = _BASE, values: np.ndarray = _BYTES):
        n = len(data)
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * power[:n], out=self.sums[1:])
        power[1:] = np.uint64(pow(base, -1, 1 << 64))
        power[0] = 1
        self.back = np.cumprod(power, out=power)

    def all(self, length: int) -> np.ndarray:
        m = max(0, len(self.sums) - length)
        return mix((self.sums[length : length + m] - self.sums[:m]) * self.back[:m])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of common bytes, context hash, text, first start, last start) of each side of each anchor of texts laid end to end."""
    empty = np.zeros(0, np.int64)
    fit = np.maximum(0, sizes - LENGTH + 1)
    starts = np.cumsum(sizes) - sizes
    p = ranges(starts, fit)
    if not len(p):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    roll = Rolling(data)
    h = roll.all(GRAM)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: reach - width], low[width - reach :])
    text = np.repeat(np.arange(len(sizes)), fit)
    at = (low[p] & _PLACE).astype(np.int64)
    del low
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a, lo, hi, text = at[first], p[first], p[last], text[first]
    left, right = lo < a - HALF, hi >= a - HALF
    common = np.concatenate((roll.of(a[left] - HALF - 1, a[left] + GRAM), roll.of(a[right], a[right] + LENGTH - HALF) ^ np.uint64(_BASE)))
    lo, hi = np.concatenate((lo[left], np.maximum(lo, a - HALF)[right])), np.concatenate((np.minimum(hi, a - HALF - 1)[left], hi[right]))
    a, text = np.concatenate((a[left], a[right])), np.concatenate((text[left], text[right]))
    context = mix(roll.of(lo, hi + LENGTH) ^ mix(((a - lo) * 1000 + (hi - lo)).astype(np.uint64) + np.uint64(1))) >> np.uint64(16)
    return mix(common), context, text, lo - starts[text], hi - starts[text]


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    a = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield a, k
            a, total = k, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list]]:
    """(ids, crc32 of texts, texts as bytes, values of a fourth column, if any) of chunks of about CHUNK bytes."""
    ids: list[int] = []
    crcs: list[int] = []
    texts: list[np.ndarray] = []
    more: list = []
    total = 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        crcs += batch.column(1).to_pylist()
        if batch.num_columns > 3:
            more += batch.column(3).to_pylist()
            own = [np.frombuffer(zlib.decompress(z), np.uint8) for z in batch.column(2).to_pylist()]
        else:
            data, offs = utf8(batch.column(2))
            own = [data[offs[k] : offs[k + 1]] for k in range(batch.num_rows)]
        texts += own
        total += sum(map(len, own))
        if total >= CHUNK:
            yield np.array(ids, np.int64), np.array(crcs, np.int64), texts, more
            ids, crcs, texts, more, total = [], [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.array(crcs, np.int64), texts, more


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they go through an exchange."""
    for batch in batches:
        z = [zlib.compress(t, 1) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["id", "crc", "z"])


def _first_of(keys: tuple[np.ndarray, ...], ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, id and start; which begin a new key; which are at another place than the first of their key."""
    turn = np.lexsort((starts, ids, *reversed(keys)))
    new = np.ones(len(turn), bool)
    for k in keys[:1]:
        own = k[turn]
        same = own[1:] == own[:-1]
    for k in keys[1:]:
        own = k[turn]
        same &= own[1:] == own[:-1]
    if len(turn):
        new[1:] = ~same
    head = np.maximum.accumulate(np.where(new, np.arange(len(turn)), 0))
    i, s = ids[turn], starts[turn]
    return turn, new, (i != i[head]) | (s != s[head])


_ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("body", T.BinaryType())])


_BODIES = "part int, body binary"


def _found(kind: str, parts: int, ids: np.ndarray, crcs: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """(lo, hi) pairs on their way to their documents, packed by ranges of hashed ids."""
    home = (mix((ids ^ crcs).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    return _deal(home[doc], parts, ids, crcs, doc, lo.astype(np.uint32), hi.astype(np.uint32), mark=kind[:1].encode())


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and kind with its pairs."""
    held: dict[bytes, list[bytes]] = {b"s": [], b"o": []}
    for batch in batches:
        for body in batch.column(1).to_pylist():
            held[body[:1]].append(body)
    for kind, bodies in held.items():
        rows = [np.zeros((0, 4), np.int64)]
        for body in bodies:
            step, crc, doc, lo, hi = _unpack(body[1:], np.int64, np.uint32, np.uint32, np.uint32, np.uint32)
            rows.append(np.stack((np.cumsum(step)[doc], crc[doc].astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)), axis=1))
        ids, crcs, lo, hi = np.concatenate(rows).T
        turn = np.lexsort((lo, crcs, ids))
        ids, crcs, pairs = ids[turn], crcs[turn], np.stack((lo[turn], hi[turn]), axis=1).astype(np.uint32)
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1])
        cut = np.flatnonzero(new)
        ends = np.append(cut[1:], len(ids))
        for a in range(0, len(cut), 1000):
            own, stop = cut[a : a + 1000], ends[a : a + 1000]
            name = "span" if kind == b"s" else "open"
            body = [pairs[x:y].tobytes() for x, y in zip(own.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(crcs[own]), pa.array([name] * len(own), pa.string()), pa.array(body, pa.binary())], names=_ROWS.names)


def _runs(doc: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a document as (doc, first, last)."""
    turn = np.lexsort((starts, doc))
    doc, starts = doc[turn], starts[turn]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], starts[first], starts[np.append(first[1:], len(doc)) - 1] if len(first) else starts[:0]


def _deal(part_of: np.ndarray, parts: int, ids: np.ndarray, crcs: np.ndarray, doc: np.ndarray, *columns: np.ndarray, mark: bytes = b"r") -> pa.RecordBatch:
    """Rows by bucket, packed with the documents they are in."""
    turn = np.argsort(part_of, kind="stable")
    cut = np.searchsorted(part_of[turn], np.arange(parts + 1))
    numbers, bodies = [], []
    for p in range(parts):
        own = turn[cut[p] : cut[p + 1]]
        if len(own):
            there, at = np.unique(doc[own], return_inverse=True)
            numbers.append(p)
            bodies.append(mark + _pack(np.diff(ids[there], prepend=0), crcs[there].astype(np.uint32), at.astype(np.uint32), *[c[own] for c in columns]))
    return pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int32)), pa.array(bodies, pa.binary())], names=["part", "body"])


def _pass_on(batch: pa.RecordBatch, parts: int) -> pa.RecordBatch:
    """Finished rows on their way through the same exchange."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    raw = sink.getvalue().to_pybytes()
    return pa.RecordBatch.from_arrays([pa.array([zlib.crc32(raw) % parts], pa.int32()), pa.array([b"f" + raw], pa.binary())], names=["part", "body"])


def _gather(batches: Iterator[pa.RecordBatch], *kinds: type) -> Iterator[pa.RecordBatch | tuple[np.ndarray, ...]]:
    """First what is passed on, then the columns: ids and crcs of documents, document of each row, columns."""
    ids, crcs, docs, columns, at = [], [], [], [[] for _ in kinds], 0
    for batch in batches:
        for body in batch.column(1).to_pylist():
            if body[:1] == b"f":
                yield from pa.ipc.open_stream(body[1:])
                continue
            step, crc, doc, *own = _unpack(body[1:], np.int64, np.uint32, np.uint32, *kinds)
            ids.append(np.cumsum(step))
            crcs.append(crc)
            docs.append(doc.astype(np.int64) + at)
            at += len(step)
            for c, x in zip(columns, own, strict=True):
                c.append(x)
    if ids:
        yield (np.concatenate(ids), np.concatenate(crcs).astype(np.int64), np.concatenate(docs), *[np.concatenate(c) for c in columns])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False) -> DataFrame:
    """What is left of every text without the bytes covered by a LENGTH-byte string that also starts earlier.

    Earlier is a smaller id, or a smaller start under the same id; rows that share an id
    are told apart by their texts, and equal rows are the same place, so that neither is
    a copy of the other. Strings are judged on the input. A null id is smaller than all
    others; null texts are empty and lose nothing; an empty table gives an empty result;
    other columns are ignored. Returns id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, with ``clean``, kept (the remaining bytes).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    homes = max(1, -(-total // HOME_BYTES))
    parts = max(1, -(-total // (GRAM * BUCKET_ROWS)))  # a side of an anchor for every 26 bytes

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, crcs, texts, _ in _texts(batches):
            found: list[tuple[np.ndarray, ...]] = []
            sizes = np.array([len(t) for t in texts], np.int64)
            for a, b in _pieces(sizes, PIECE):
                if sizes[a:b].max() >= LENGTH:
                    g, c, t, lo, hi = anchors(np.concatenate(texts[a:b]), sizes[a:b])
                    found.append((g, c, t + a, lo, hi))
            if not found:
                continue
            g, c, t, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            turn, new, later = _first_of((g, c), ids[t], lo)
            g, c, t, lo, hi = g[turn], c[turn], t[turn], lo[turn], hi[turn]
            if later.any():
                yield _pass_on(_found("span", homes, ids, crcs, t[later], lo[later], hi[later]), parts)
            # equal rows are one place: the first of them stands for all
            g, c, t, lo, hi = g[new], c[new], t[new], lo[new], hi[new]
            yield _deal((mix(g ^ np.uint64(77)) % np.uint64(parts)).astype(np.int64), parts, ids, crcs, t, g, c, lo.astype(np.uint32), (hi - lo).astype(np.uint8))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _gather(batches, np.uint64, np.uint64, np.uint32, np.uint8):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            ids, crcs, doc, g, c, lo, width = got
            lo = lo.astype(np.int64)
            hi = lo + width
            turn, new, later = _first_of((g,), ids[doc], lo)
            group = np.cumsum(new) - 1
            c = c[turn]
            mixed = np.bincount(group, c != c[np.flatnonzero(new)][group]) > 0
            doc, lo, hi = doc[turn], lo[turn], hi[turn]
            open_ = mixed[group]
            for kind, pick in (("span", later & ~open_), ("open", open_)):
                if pick.any():
                    yield _found(kind, homes, ids, crcs, doc[pick], lo[pick], hi[pick])

    settled = stage(rows.mapInArrow(anchored, _BODIES).repartitionById(parts, "part").mapInArrow(settle, _BODIES).repartitionById(homes, "part").mapInArrow(_by_document, _ROWS), "repeat-anchors")
    open_ = settled.where("kind = 'open'").groupBy("id", "crc").agg(F.collect_list("body").alias("open"))
    wide = settled.where("kind = 'open'").agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"] // 8
    shares = max(1, -(-wide * (HALF // 2) // BUCKET_ROWS))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, crcs, texts, runs in _texts(batches):
            sizes = np.array([len(t) for t in texts], np.int64)
            found = []
            for a, b in _pieces(sizes, PIECE):
                data = np.concatenate(texts[a:b])
                begin = np.cumsum(sizes[a:b]) - sizes[a:b]
                pairs = [np.frombuffer(b"".join(r), np.uint32).reshape(-1, 2).astype(np.int64) for r in runs[a:b]]
                t = np.repeat(np.arange(b - a), [len(x) for x in pairs])
                lo, hi = np.concatenate(pairs).T
                n = hi - lo + 1
                s, t = ranges(lo, n), np.repeat(t, n)
                at = s + begin[t]
                w = mix(Rolling(data).of(at, at + LENGTH))
                found.append((w, mix(Rolling(data, _SECOND_BASE, _SECOND_BYTES).of(at, at + LENGTH)), t + a, s))
            w, v, t, s = (np.concatenate(x) for x in zip(*found, strict=True))
            turn, new, later = _first_of((w, v), ids[t], s)
            w, v, t, s = w[turn], v[turn], t[turn], s[turn]
            if later.any():
                yield _pass_on(_found("span", homes, ids, crcs, *_runs(t[later], s[later])), shares)
            w, v, t, s = w[new], v[new], t[new], s[new]
            yield _deal((mix(w ^ np.uint64(78)) % np.uint64(shares)).astype(np.int64), shares, ids, crcs, t, w, v, s.astype(np.uint32))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _gather(batches, np.uint64, np.uint64, np.uint32):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            ids, crcs, doc, w, v, s = got
            s = s.astype(np.int64)
            turn, _, later = _first_of((w, v), ids[doc], s)
            if later.any():
                yield _found("span", homes, ids, crcs, *_runs(doc[turn][later], s[turn][later]))

    squeezed = rows.mapInArrow(_squeeze, "id long, crc long, z binary")
    asked = squeezed.join(open_, ["id", "crc"]).select("id", "crc", "z", "open")
    strings = stage(asked.mapInArrow(hashed, _BODIES).repartitionById(shares, "part").mapInArrow(compare, _BODIES).repartitionById(homes, "part").mapInArrow(_by_document, _ROWS), "repeat-strings")
    spans = settled.where("kind = 'span'").unionAll(strings).groupBy("id", "crc").agg(F.collect_list("body").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for z, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = np.frombuffer(zlib.decompress(z), np.uint8)
                size = len(raw)
                gone = runs = 0
                if own:
                    lo, hi = np.frombuffer(b"".join(own), np.uint32).reshape(-1, 2).astype(np.int64).T
                    delta = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(delta, lo, 1)
                    np.add.at(delta, hi + LENGTH, -1)
                    covered = np.cumsum(delta[:-1]) > 0
                    gone, runs = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    raw = raw[~covered]
                kept = raw.tobytes()
                out.append((size, gone, runs, hashlib.sha256(kept).hexdigest(), kept if clean else None))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    done = squeezed.join(spans, ["id", "crc"], "left").select("id", "crc", "z", "spans").mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if clean else []))
