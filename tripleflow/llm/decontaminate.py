"""Benchmark decontamination with an FM-index per shard of documents.

Words are the symbols. Only benchmark words have a symbol of their own; every
other word ends a run, as nothing it is part of can match. Each shard (a bounded
number of words of one input partition) gets a suffix array by prefix doubling,
its Burrows-Wheeler transform in a wavelet matrix, and suffix positions at every
RATE-th place and at run starts. All windows are searched backward at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .shared import bounded, ranges, trim, utf8

WINDOW = 8
SHARD_WORDS = 300_000
BLOCK_WORDS = 2_000_000  # benchmark words whose windows go to the executors at once
RATE = 16

# letters and digits stay (A-Z as a-z), what is beyond ASCII stays, all else parts words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    return raw.translate(_FOLD).split()


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each 0 is a separator of its own, smaller than words and ordered by place.

    Prefix doubling that sorts again only suffixes whose rank is still shared.
    """
    n = len(seq)
    sep = seq == 0
    order = np.argsort(seq, kind="stable")
    key = seq[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (key[1:] == 0)
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.diff(np.append(starts, n))
    open_ = order[np.repeat(size > 1, size)]
    del sep, key, new
    h = 1
    while len(open_):
        far = open_ + h
        second = np.where(far < n, rank[np.minimum(far, n - 1)], -1) + 1
        first = rank[open_]
        turn = np.argsort(first * (n + 2) + second, kind="stable")
        open_, first, second = open_[turn], first[turn], second[turn]
        head = np.ones(len(open_), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.ones(len(open_), bool)
        group[1:] = first[1:] != first[:-1]
        at = np.arange(len(open_))
        base = np.maximum.accumulate(np.where(group, at, 0))
        mine = np.maximum.accumulate(np.where(head, at, 0))
        rank[open_] = first + (mine - base)
        heads = np.flatnonzero(head)
        size = np.diff(np.append(heads, len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Count and locate word patterns in ``seq`` (int array that starts and ends with 0; 0 never matches)."""

    def __init__(self, seq: np.ndarray, rate: int = RATE):
        sa = suffix_array(seq)
        n = len(seq)
        self.n = n
        top = int(seq.max(initial=0))
        self.bits = max(1, top.bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=top + 1))))
        self.bwt = seq[sa - 1]
        self.zeros: list[int] = []
        self.ranks: list[np.ndarray] = []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            rank0 = np.zeros(n + 1, np.int32)
            np.cumsum(1 - one, out=rank0[1:])
            self.ranks.append(rank0)
            self.zeros.append(int(rank0[-1]))
            level = np.concatenate((level[one == 0], level[one == 1]))
        self.base = self._walk(np.arange(top + 1), np.zeros(top + 1, np.int64))
        marked = (sa % rate == 0) | (self.bwt == 0)
        self.marked = marked
        self.nth = np.cumsum(marked) - 1
        self.samples = sa[marked]

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            r = self.ranks[k][i]
            i = np.where((c >> b) & 1, self.zeros[k] + i - r, r)
        return i

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """C[c] + rank of c before row i."""
        return self.before[c] + self._walk(c, i) - self.base[c]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each pattern (a row of word symbols)."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        top = len(self.base) - 1
        lo[(patterns > top).any(axis=1)] = self.n
        live = np.flatnonzero(lo < hi)
        for j in range(length - 1, -1, -1):
            c = patterns[live, j]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
            live = live[lo[live] < hi[live]]
        dead = np.ones(m, bool)
        dead[live] = False
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled one."""
        out, steps, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(at):
            hit = self.marked[rows]
            out[at[hit]] = self.samples[self.nth[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            rows = self.step(self.bwt[rows], rows)
            steps += 1
        return out


class Windows:
    """The distinct windows of some benchmark items, by length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, words) in enumerate(items):
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[i : i + window]), set()).add(k)
        self.by_length = []
        for length in sorted({len(w) for w in found}):
            own = sorted(w for w in found if len(w) == length)
            counts = np.array([len(found[w]) for w in own], np.int64)
            members = np.array([k for w in own for k in sorted(found[w])], np.int64)
            self.by_length.append((length, np.array(own, np.int64), np.concatenate(([0], np.cumsum(counts))), members))
        self.least = min((x[0] for x in self.by_length), default=0)

    def search(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """For a shard: number of words before each document, which words are hit, items found in each document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        total = int(first[-1])
        get = self.ids.get
        flat = np.fromiter((get(w, 0) for d in docs for w in d), np.int32, total)
        delta = np.zeros(total + 1, np.int32)
        found: list[list[int]] = [[] for _ in docs]
        # runs of benchmark words within a document, long enough for some window
        known = flat > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        begins[first[:-1][sizes > 0]] = known[first[:-1][sizes > 0]]
        run_start = np.flatnonzero(begins)
        if not self.by_length or not len(run_start):
            return first, np.zeros(total, bool), found
        run = np.cumsum(begins)[known] - 1
        run_len = np.bincount(run, minlength=len(run_start))
        keep = run_len >= self.least
        run_start, run_len = run_start[keep], run_len[keep]
        if not len(run_start):
            return first, np.zeros(total, bool), found
        source = ranges(run_start, run_len)
        places = np.arange(len(source)) + np.repeat(np.arange(len(run_len)), run_len) + 1
        seq = np.zeros(len(source) + len(run_len) + 1, np.int32)
        seq[places] = flat[source]
        where = np.zeros(len(seq), np.int64)
        where[places] = source
        index = FMIndex(seq)
        pairs = []
        for length, patterns, offsets, members in self.by_length:
            lo, hi = index.find(patterns)
            got = np.flatnonzero(hi > lo)
            if not len(got):
                continue
            rows = ranges(lo[got], hi[got] - lo[got])
            which = np.repeat(got, hi[got] - lo[got])
            at = where[index.locate(rows)]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + length, -1)
            doc = np.searchsorted(first, at, "right") - 1
            once = np.unique(doc * len(patterns) + which)
            doc, which = once // len(patterns), once % len(patterns)
            n = offsets[which + 1] - offsets[which]
            pairs.append(np.repeat(doc, n) * len(self.names) + members[ranges(offsets[which], n)])
        if pairs:
            for p in np.unique(np.concatenate(pairs)).tolist():
                found[p // len(self.names)].append(p % len(self.names))
        return first, np.cumsum(delta[:-1]) > 0, found


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Windows]:
    """The stated query set, in blocks of a bounded number of words."""
    block, words = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        own = words_of(row.text)
        block.append(("" if row.item_id is None else str(row.item_id), own))
        words += len(own)
        if words >= block_words:
            yield Windows(block)
            block, words = [], 0
    if block:
        yield Windows(block)


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("clean_text", T.StringType()),
        T.StructField("text_key", T.StringType()),
    ]
)


def _spans(hit: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def without(text: str, words: list[bytes], spans: list[list[int]]) -> str:
    """``text`` without the bytes from each span's first word to the end of its last."""
    raw = text.encode()
    low, at, bounds = raw.translate(_FOLD), 0, []
    for w in words:
        at = low.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def find_contamination(docs: DataFrame, benchmark: DataFrame, clean: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Word spans of ``docs`` that occur in ``benchmark`` windows, and the items they belong to.

    A window is 8 consecutive words of an item; an item with fewer words, but some, is
    one window. Null or wordless texts have 0 words and no spans; wordless items are
    never found; items with the same words are all found; repeated rows each give a
    row; no benchmark gives empty findings for all, no documents an empty result. Other
    columns are not carried. One row per document: doc_id, n_words, item_ids, spans
    (maximal [first word, one past last word)), clean_text (with ``clean``: the text
    without its spans, where it has any; else null).

    The benchmark must be the small side; it goes to the executors in blocks of
    BLOCK_WORDS words. With more than one block, each document gets a row per block:
    merge_blocks() unites them, with the same result as one block has.
    """
    share = docs.sparkSession.sparkContext.broadcast
    blocks = [share(windows) for windows in benchmark_blocks(benchmark)] or [share(Windows([]))]
    if len(blocks) == 1:
        return _search_block(docs, blocks[0], clean, id_col).drop("text_key")
    return merge_blocks([_search_block(docs, b, False, id_col, keyed=True) for b in blocks], docs, clean, id_col)


def _text_key() -> Column:
    """Of equal texts only; a null text is an empty one."""
    from pyspark.sql import functions as F

    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def merge_blocks(parts: list[DataFrame], docs: DataFrame, clean: bool, id_col: str) -> DataFrame:
    """Unite the findings of several blocks of the benchmark for each row of ``docs``; rows of equal id and text have equal ones."""
    from functools import reduce

    from pyspark.sql import functions as F

    found = [p.withColumn("block", F.lit(k)) for k, p in enumerate(parts)]
    # a set: equal rows have equal findings in a block
    both = reduce(DataFrame.unionAll, found).groupBy(F.col("doc_id").alias("key_id"), "text_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.struct("block", "item_ids", "spans"))).alias("found"),
    )
    both = both.select("key_id", "text_key", "n_words", F.flatten("found.item_ids").alias("item_ids"), F.flatten("found.spans").alias("raw_spans"))

    @F.pandas_udf("struct<spans: array<array<long>>, clean_text: string>")
    def unite(raw, text):  # noqa: ANN001, ANN202
        import pandas as pd

        spans, texts = [], []
        for own, t in zip(raw, text, strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((int(x[0]), int(x[1])) for x in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            spans.append(merged)
            texts.append(without(t, words_of(t), merged) if merged and t is not None else None)
        return pd.DataFrame({"spans": spans, "clean_text": texts})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key().alias("row_text_key"), F.col("text") if clean else F.lit(None).cast("string").alias("text"))
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("row_text_key") == F.col("text_key"))).withColumn("u", unite("raw_spans", "text"))
    return out.select("doc_id", "n_words", "item_ids", "u.spans", "u.clean_text")


def _search_block(docs: DataFrame, shared: Broadcast, clean: bool, id_col: str, keyed: bool = False) -> DataFrame:
    """Findings of a block; text_key is null unless ``keyed``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids: list[int] = []
        keys: list[str | None] = []
        texts: list[bytes] = []
        words: list[list[bytes]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            first, hit, found = own.search(words)
            cols: list[list] = [[], [], [], [], [], []]
            for k, name in enumerate(ids):
                a, b = int(first[k]), int(first[k + 1])
                spans = _spans(hit[a:b]) if found[k] else []
                row = (name, b - a, [own.names[i] for i in found[k]], spans, without(texts[k].decode(), words[k], spans) if clean and spans else None, keys[k])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_OUT.names)

        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw = data.tobytes()
            for k, (name, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = raw[offs[k] : offs[k + 1]]
                ids.append(name)
                keys.append(key)
                texts.append(text if clean else b"")
                words.append(text.translate(_FOLD).split())
                count += len(words[-1])
                if count >= SHARD_WORDS:
                    yield flush()
                    ids, keys, texts, words, count = [], [], [], [], 0
        if ids:
            yield flush()
        trim()

    from pyspark.sql import functions as F

    return bounded(docs).select(F.col(id_col).cast("long"), "text", (_text_key() if keyed else F.lit(None).cast("string")).alias("key")).mapInArrow(shards, _OUT)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_contamination()'s rows."""
    from pyspark.sql import functions as F

    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0]), F.lit(0)).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") >= 2).alias("contaminated"),
    )
