"""Cross-entropy difference under matched target and background bigram models.

Both models have one vocabulary, one smoothing and one size: background counts are
scaled to the target's number of words. Counts cover every word of both tables, and
the vocabulary is every word that occurs in either, so it grows with the corpus.

What a word costs parts into a share of the bigram, which takes the counts of the
bigram and of the word, and a share of the word as context of the next one. Both are
known where all occurrences of the word meet, so words are dealt into buckets by their
hash. Only the HEAVY_SHARE words at most that have 1/HEAVY_SHARE of all each are known
everywhere, with the counts of their bigrams with each other in one dense table; their
other bigrams are dealt by the hash of both words. A bucket first reads what each chunk
of texts has counted (a key has a row in a chunk, however often it occurs there), then
the occurrences, chunk by chunk, so its memory depends on its keys and not on how
common they are. Words are known by 64 bits, the contexts of a word by 48, and in a
bucket bigrams by 64.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, mix, release, stage, trim, utf8

HEAVY_SHARE = 500
PRIOR = 50.0  # words of unigram evidence that every context starts with
ADD = 0.5  # added to every unigram count
CHUNK_WORDS = 400_000
KNOWN_WORDS = 150_000  # hashes that a worker remembers
BUCKET_WORDS = 2_000_000
HOME_WORDS = 3_000_000  # of the texts whose sums meet in one task
FLUSH = 200_000
OUT_ROWS = 1_000_000  # sums that a bucket holds back, to send them in few pieces
NO_ID = -(1 << 63)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = 0x9E3779B97F4A7C15


def _fold(key: Column) -> Column:
    return F.coalesce(F.pmod(key, F.lit(2)), F.lit(0)).cast("int")


def _both(docs: DataFrame, target: DataFrame, id_col: str, target_id: str) -> DataFrame:
    """id, kind (fold, plus 2 in the target), text."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), _fold(F.col(id_col)).alias("kind"), "text")
    return own.unionAll(target.select(F.lit(NO_ID).alias("id"), (_fold(F.col(target_id)) + 2).alias("kind"), "text"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    ids: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    words: list[list[bytes]] = []
    count = 0
    for batch in batches:
        data, offs = utf8(batch.column(2))
        raw = data.tobytes().translate(_LOWER)
        a = 0
        own = [raw[offs[k] : offs[k + 1]].split() for k in range(batch.num_rows)]
        id_, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in range(batch.num_rows):
            count += len(own[k])
            if count >= CHUNK_WORDS or k + 1 == batch.num_rows:
                ids.append(id_[a : k + 1])
                kinds.append(kind[a : k + 1])
                words += own[a : k + 1]
                a = k + 1
            if count >= CHUNK_WORDS:
                yield np.concatenate(ids), np.concatenate(kinds), words
                ids, kinds, words, count = [], [], [], 0
    if words:
        yield np.concatenate(ids), np.concatenate(kinds), words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, n): kinds 0 to 3 are occurrences, 4 to 7 text ends."""
    held: dict[int, Counter] = {k: Counter() for k in range(8)}

    def flush() -> Iterator[pa.RecordBatch]:
        for k, own in held.items():
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(np.full(len(own), k, np.int32)), pa.array(np.fromiter(own.values(), np.int64, len(own)))],
                    names=["word", "kind", "n"],
                )
                own.clear()

    for _, kinds, words in _chunks(batches):
        for k in range(4):
            own = [words[i] for i in np.flatnonzero(kinds == k).tolist()]
            held[k].update(chain.from_iterable(own))
            held[k + 4].update(w[-1] for w in own if w)
        if sum(map(len, held.values())) > FLUSH:
            yield from flush()
    yield from flush()


START = 0  # number of the place before a text; heavy words are 1, 2, ...; all other words have numbers from 2 ** 16 on


class WordNumbers(dict):
    """Numbers of words; forgets all when it has many."""

    def __init__(self, heavy: list[bytes]):
        self.heavy = {w: k + 1 for k, w in enumerate(heavy)}
        super().__init__(self.heavy)

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
            self.update(self.heavy)
        value = self[word] = xxhash.xxh64_intdigest(word) | 1 << 16
        return value


class Models:
    """What every executor knows: sizes, counts of heavy words, and of their bigrams. Arrays have a row for each kind."""

    def __init__(self, heavy: list[bytes], unigram: np.ndarray, ends: np.ndarray, totals: np.ndarray, texts: np.ndarray, places: int):
        self.heavy, self.totals, self.texts, self.places = heavy, totals, texts, places
        self.unigram = np.concatenate((np.zeros((4, 1), np.int64), unigram), axis=1)
        self.context = np.concatenate((texts[:, None], unigram - ends), axis=1)
        self.width = len(heavy) + 1
        self.pairs = np.zeros((4, self.width, self.width), np.int64)

    def scale(self, fold: int) -> list[tuple[int, float]]:
        """(kind, factor of its counts) of the target and background models that score texts of ``fold``."""
        other = 1 - fold
        return [(other + 2, 1.0), (other, self.totals[other + 2] / self.totals[other] if self.totals[other] else 0.0)]

    def word_share(self, fold: int, pairs: np.ndarray, unigram: np.ndarray) -> list[np.ndarray]:
        """Bits by model: less those of the context."""
        out = []
        for kind, r in self.scale(fold):
            single = (unigram[kind] * r + ADD) / (self.totals[kind] * r + ADD * self.places)
            out.append(-np.log2(pairs[kind] * r + PRIOR * single))
        return out

    def context_share(self, fold: int, context: np.ndarray) -> list[np.ndarray]:
        return [np.log2(context[kind] * r + PRIOR) for kind, r in self.scale(fold)]


def symbols(numbers: dict[bytes, int], words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, text, whether the text ends with it) of every word; without WordNumbers all unknown words have one number."""
    get = numbers.__getitem__ if isinstance(numbers, WordNumbers) else lambda w: numbers.get(w, 1 << 16)
    sizes = np.array([len(w) for w in words], np.int64)
    cur = np.fromiter(map(get, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    prev = np.empty(len(cur), np.uint64)
    prev[1:] = cur[:-1]
    ends = np.cumsum(sizes)[sizes > 0]
    prev[ends - sizes[sizes > 0]] = START
    last = np.zeros(len(cur), bool)
    last[ends - 1] = True
    return prev, cur, np.repeat(np.arange(len(words)), sizes), last


def train(both: DataFrame) -> Models:
    """Counts over all rows; at most HEAVY_SHARE words and HEAVY_SHARE ** 2 pairs of them reach the driver."""
    parts = both.mapInArrow(_count_words, "word string, kind int, n long")
    counts = stage(parts.groupBy("word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(8)]), "lm-words")
    sums = counts.agg(F.count(F.lit(1)).alias("words"), *[F.coalesce(F.sum(f"k{k}"), F.lit(0)).alias(f"k{k}") for k in range(8)]).first()
    total = sum(sums[k + 1] for k in range(4))
    n = F.col("k0") + F.col("k1") + F.col("k2") + F.col("k3")
    rows = counts.where(n * HEAVY_SHARE >= total).withColumn("n", n).collect()
    release(counts)
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    table = np.array([[r[f"k{k}"] for k in range(8)] for r in rows], np.int64).reshape(-1, 8).T
    models = Models([r["word"].encode() for r in rows], table[:4], table[4:], np.array(sums[1:5], np.int64), np.array(sums[5:], np.int64), sums["words"] + 1)
    shared = both.sparkSession.sparkContext.broadcast(models)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, known = shared.value.width, {w: k + 1 for k, w in enumerate(shared.value.heavy)}
        seen = np.zeros(4 * h * h, np.int64)
        for _, kinds, words in _chunks(batches):
            prev, cur, text, _ = symbols(known, words)
            both_heavy = (prev < h) & (cur < h)
            key = (kinds[text[both_heavy]].astype(np.int64) * h + prev[both_heavy].astype(np.int64)) * h + cur[both_heavy].astype(np.int64)
            seen += np.bincount(key, minlength=len(seen))
        some = np.flatnonzero(seen)
        for a in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 50_000]), pa.array(seen[some[a : a + 50_000]])], names=["key", "n"])
        trim()

    flat = models.pairs.ravel()
    for r in both.mapInArrow(count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        flat[r["key"]] = r["n"]
    shared.unpersist()
    return models


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each as planes of equal bytes of its numbers, which compress."""
    out = []
    for x in arrays:
        wide = np.ascontiguousarray(x)
        out.append(np.array([wide.dtype.itemsize, len(wide)], np.int64).tobytes())
        out.append(np.ascontiguousarray(wide.view(np.uint8).reshape(len(wide), -1).T).tobytes() if len(wide) else b"")
    return b"".join(out)


def _unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    at, out = 0, []
    for kind in kinds:
        width, n = np.frombuffer(raw, np.int64, 2, at)
        at += 16
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += width * n
    return out


_KEYS = (np.uint64, np.uint32, np.uint64, np.uint8, np.uint32, np.uint32, np.uint8, np.uint32)
_48 = np.uint64((1 << 48) - 1)


def _chunk_keys(v: np.ndarray, w: np.ndarray, kind: np.ndarray, last: np.ndarray) -> bytes:
    """What a chunk has counted, of occurrences sorted by word, context and kind: words, their numbers of (context, kind), those
    with their counts, and the text ends: word, kind, count."""
    new_w = np.concatenate(([True], w[1:] != w[:-1]))
    new = new_w | np.concatenate(([True], (v[1:] != v[:-1]) | (kind[1:] != kind[:-1])))
    at, word = np.flatnonzero(new), np.cumsum(new_w) - 1
    ends, n = np.unique(word[last] * 4 + kind[last], return_counts=True)
    of_word = np.bincount(word[at], minlength=int(word[-1]) + 1)
    counted = (w[new_w], of_word.astype(np.uint32), v[at], kind[at], np.diff(np.append(at, len(w))).astype(np.uint32), (ends // 4).astype(np.uint32), (ends % 4).astype(np.uint8), n.astype(np.uint32))
    return _pack(*counted)


def _numbered(keys: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, or where they are, in order, and the number of each key."""
    turn = np.argsort(keys)
    own = keys[turn]
    new = np.concatenate(([True], own[1:] != own[:-1]))
    number = np.empty(len(keys), np.int64)
    number[turn] = np.cumsum(new) - 1
    return turn[new] if where else own[new], number


class Bucket:
    """Costs of the words that meet in a bucket, from what all chunks have counted."""

    def __init__(self, models: Models, keys: list[tuple[int, list[np.ndarray]]]):
        words, place = _numbered(np.concatenate([k[0] for _, k in keys]))
        sizes = [len(k[0]) for _, k in keys]
        places = np.split(place, np.cumsum(sizes)[:-1])
        word = np.concatenate([np.repeat(p, k[1]) for p, (_, k) in zip(places, keys, strict=True)])
        v, kind, n = (np.concatenate([k[j] for _, k in keys]) for j in (2, 3, 4))
        first, pair = _numbered(mix(words[word]) ^ mix(v), where=True)
        of_pair, pairs = word[first], len(first)
        counts = np.bincount(pair * 4 + kind, n, minlength=4 * pairs).reshape(pairs, 4).T
        unigram = np.bincount(word * 4 + kind, n, minlength=4 * len(words)).reshape(-1, 4).T
        ends = np.bincount(np.concatenate([p[k[5]] * 4 + k[6] for p, (_, k) in zip(places, keys, strict=True)]), np.concatenate([k[7] for _, k in keys]), minlength=4 * len(words)).reshape(-1, 4).T
        context = unigram - ends
        heavy = np.flatnonzero(words < models.width)
        number = words[heavy].astype(np.int64)
        unigram[:, heavy], context[:, heavy] = models.unigram[:, number], models.context[:, number]
        # cost by model, and by fold and whether the word ends a text
        self.table = np.empty((2, 4, pairs))
        for f in (0, 1):
            for m, (own, rest) in enumerate(zip(models.word_share(f, counts, unigram[:, of_pair]), models.context_share(f, context), strict=True)):
                self.table[m, 2 * f], self.table[m, 2 * f + 1] = own + rest[of_pair], own
        # of each chunk the pairs of its occurrences: those of documents only, in runs
        self.runs, at = {}, 0
        for chunk, k in keys:
            own = slice(at, at + len(k[2]))
            mine = kind[own] < 2
            self.runs[chunk] = (pair[own][mine].astype(np.int32), n[own][mine].astype(np.int32))
            at += len(k[2])

    def costs(self, chunk: int, fold: np.ndarray, doc: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        at = (2 * fold[doc].astype(np.int64) + last) * self.table.shape[2] + np.repeat(*self.runs[chunk])
        return [np.bincount(doc, table.ravel()[at], minlength=len(fold)) for table in self.table]


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", target_id: str = "conv_id") -> DataFrame:
    """Bits per word of every whole text of ``docs`` under both models, and their difference.

    Words are runs of non-space bytes, A-Z lower-cased. The target model is learned from
    all texts of ``target``, the background model from all of ``docs``, each in two
    folds by the parity of the id; texts are scored by the models of the other fold, so
    none is scored by counts that it is part of. A null id is in fold 0. A low score is
    likelier of the target. Null and wordless texts have 0 words and null losses; rows
    that share an id are one document; without target texts both models are what the
    prior says; an empty table gives an empty result; other columns are ignored.
    Returns id, n_words, target_loss, background_loss, score (target_loss less
    background_loss), rounded to 6 places.
    """
    both = _both(bounded(docs), target, id_col, target_id)
    models = train(both)
    total = int(models.totals.sum())
    top = int(np.ceil(np.log2(max(1.0, total / BUCKET_WORDS))))
    homes = max(1, -(-total // HOME_WORDS))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, numbers = shared.value, WordNumbers(shared.value.heavy)
        h, chunk = own.width, TaskContext.get().partitionId() << 32
        known = [[n + c[None, :] for n, c in zip(own.word_share(f, own.pairs, own.unigram[:, None, :]), own.context_share(f, own.context), strict=True)] for f in (0, 1)]
        ending = [own.word_share(f, own.pairs, own.unigram[:, None, :]) for f in (0, 1)]
        begin = [own.context_share(f, own.context[:, 0]) for f in (0, 1)]
        for ids, kinds, words in _chunks(batches):
            chunk += 1
            prev, cur, text, last = symbols(numbers, words)
            kinds = kinds.astype(np.int64)
            both_heavy = (prev < h) & (cur < h)
            mine = kinds < 2
            sizes = np.array([len(w) for w in words], np.int64)
            v, w, at = prev[both_heavy].astype(np.int64), cur[both_heavy].astype(np.int64), text[both_heavy]
            fold, over = kinds[at] & 1, last[both_heavy]
            sums = []
            for m in (0, 1):
                cost = np.where(fold == 0, np.where(over, ending[0][m][v, w], known[0][m][v, w]), np.where(over, ending[1][m][v, w], known[1][m][v, w]))
                first = np.where(sizes > 0, np.where((kinds & 1) == 0, begin[0][m], begin[1][m]), 0.0)
                sums.append(np.bincount(at, cost, minlength=len(ids)) + first)
            parts, phases, bodies = [chunk % (1 << top)], [2], [_pack(ids[mine], sizes[mine], sums[0][mine], sums[1][mine])]
            rest = np.flatnonzero(~both_heavy)
            v, w, doc, over = prev[rest] & _48, cur[rest], text[rest], last[rest]
            kind = kinds[doc].astype(np.uint8)
            place = mix(np.where(w < h, mix(prev[rest] ^ w * np.uint64(_ODD)), w))
            part = (place >> np.uint64(64 - top)).astype(np.int64) if top else np.zeros(len(w), np.int64)
            # by part, then as good as by word, context and kind: what a key has in two runs is just there twice
            turn = np.argsort(place & ~np.uint64((1 << 24) - 1) | (v * np.uint64(_ODD)) >> np.uint64(42) << np.uint64(2) | kind)
            v, w, doc, over, kind, part = (x[turn] for x in (v, w, doc, over, kind, part))
            cut = np.searchsorted(part, np.arange((1 << top) + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                x = slice(cut[p], cut[p + 1])
                parts.append(p)
                phases.append(0)
                bodies.append(_chunk_keys(v[x], w[x], kind[x], over[x]))
                some = np.flatnonzero(mine[doc[x]])
                if len(some):
                    there, local = np.unique(doc[x][some], return_inverse=True)
                    narrow = np.uint16 if len(there) <= 65536 else np.uint32
                    parts.append(p)
                    phases.append(1)
                    bodies.append(np.int64(narrow == np.uint32).tobytes() + _pack(np.diff(ids[there], prepend=0), (kinds[there] & 1).astype(np.uint8), local.astype(narrow), np.packbits(over[x][some])))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(parts, np.int32)), pa.array(np.array(phases, np.int32)), pa.array(np.full(len(parts), chunk)), pa.array(bodies, pa.binary())], names=["part", "phase", "chunk", "body"])
        trim()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, bucket = shared.value, [], None

        def out(i: np.ndarray, n: np.ndarray, t: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            home = (mix(i.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
            turn = np.lexsort((i, home))
            cut = np.searchsorted(home[turn], np.arange(homes + 1))
            some = np.flatnonzero(np.diff(cut))
            bodies = [_pack(np.diff(i[x], prepend=0), n[x], t[x], b[x]) for x in (turn[cut[k] : cut[k + 1]] for k in some.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bodies, pa.binary())], names=["part", "body"])

        held: list[list[np.ndarray]] = [[], [], [], []]
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held[0]:
                # a document has a row for each chunk that it is in
                ids, own_ = np.unique(np.concatenate(held[0]), return_inverse=True)
                yield out(ids, *(np.bincount(own_, np.concatenate(x)).astype(x[0].dtype) for x in held[1:]))
            for x in held:
                x.clear()

        for batch in batches:
            for phase, chunk, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = body.as_buffer()
                if phase == 0:
                    keys.append((chunk, _unpack(raw, *_KEYS)))
                    continue
                if phase == 2:
                    found = _unpack(raw, np.int64, np.int64, np.float64, np.float64)
                else:
                    if bucket is None:
                        bucket, keys = Bucket(own, keys), []
                    step, fold, local, over = _unpack(raw[8:], np.int64, np.uint8, np.uint32 if raw[:8] == b"\x01" + bytes(7) else np.uint16, np.uint8)
                    ids = np.cumsum(step)
                    found = [ids, np.zeros(len(ids), np.int64), *bucket.costs(chunk, fold, local, np.unpackbits(over, count=len(local)))]
                for x, y in zip(held, found, strict=True):
                    x.append(y)
                count += len(found[0])
                if count >= OUT_ROWS:
                    yield from flush()
                    count = 0
        yield from flush()
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(body, np.int64, np.int64, np.float64, np.float64) for batch in batches for body in batch.column(1).to_pylist()]
        if held:
            ids, own = np.unique(np.concatenate([np.cumsum(x[0]) for x in held]), return_inverse=True)
            n, t, b = (np.bincount(own, np.concatenate([x[k] for x in held])) for k in (1, 2, 3))
            for k in range(0, len(ids), 10_000):
                at = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at].astype(np.int64)), pa.array(t[at]), pa.array(b[at])], names=["id", "n", "t", "b"])

    # in a bucket, what was counted comes before what is scored by it
    dealt = both.mapInArrow(deal, "part int, phase int, chunk long, body binary").repartitionById(1 << top, "part").sortWithinPartitions("phase")
    scored = dealt.mapInArrow(score, "part int, body binary")
    sums = scored.repartitionById(homes, "part").mapInArrow(add, "id long, n long, t double, b double")
    some = F.col("n") > 0
    return sums.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        F.col("n").alias("n_words"),
        F.when(some, F.round(F.col("t") / F.col("n"), 6)).alias("target_loss"),
        F.when(some, F.round(F.col("b") / F.col("n"), 6)).alias("background_loss"),
        F.when(some, F.round((F.col("t") - F.col("b")) / F.col("n"), 6)).alias("score"),
    )


SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM (SELECT doc_id AS id, CAST(doc_id % 2 AS INT) AS kind, text FROM documents
        UNION ALL SELECT NULL, CAST(conv_id % 2 AS INT) + 2, text FROM conversations)),
flat AS (SELECT r, id, kind, unnest(words) AS w, unnest(range(len(words))) AS p, len(words) AS size FROM texts),
totals AS (SELECT kind, count(*) AS n, count(*) FILTER (p = 0) AS texts FROM flat GROUP BY kind),
places AS (SELECT count(DISTINCT w) + 1 AS v FROM flat),
chained AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY r ORDER BY p), ' ') AS v FROM flat),
uni AS (SELECT w, kind, count(*) AS n FROM flat GROUP BY ALL),
ctx AS (SELECT v, kind, count(*) AS n FROM chained GROUP BY ALL),
bi AS (SELECT v, w, kind, count(*) AS n FROM chained GROUP BY ALL),
asked AS (SELECT DISTINCT v, w, kind AS fold FROM chained WHERE kind < 2),
model AS (
  SELECT a.v, a.w, a.fold, m.kind, CASE WHEN m.kind >= 2 THEN 1.0::DOUBLE ELSE t.n::DOUBLE / m.n END AS r, m.n AS total,
    coalesce(u.n, 0) AS un, coalesce(c.n, 0) AS cn, coalesce(b.n, 0) AS bn
  FROM asked a JOIN totals m ON m.kind % 2 = 1 - a.fold JOIN totals t ON t.kind = 3 - a.fold
  LEFT JOIN uni u ON u.w = a.w AND u.kind = m.kind LEFT JOIN ctx c ON c.v = a.v AND c.kind = m.kind
  LEFT JOIN bi b ON b.v = a.v AND b.w = a.w AND b.kind = m.kind),
loss AS (
  SELECT v, w, fold, kind >= 2 AS target,
    -log2((bn * r + {PRIOR}::DOUBLE * ((un * r + {ADD}::DOUBLE) / (total * r + {ADD}::DOUBLE * (SELECT v FROM places)))) / (cn * r + {PRIOR}::DOUBLE)) AS bits
  FROM model),
sums AS (
  SELECT c.id, sum(t.bits) / count(*) AS t, sum(b.bits) / count(*) AS b, (sum(t.bits) - sum(b.bits)) / count(*) AS s, count(*) AS n
  FROM chained c JOIN loss t ON t.target AND t.v = c.v AND t.w = c.w AND t.fold = c.kind
  JOIN loss b ON NOT b.target AND b.v = c.v AND b.w = c.w AND b.fold = c.kind
  WHERE c.kind < 2 GROUP BY c.id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(t, 6) AS target_loss, round(b, 6) AS background_loss, round(s, 6) AS score
FROM documents d LEFT JOIN sums ON sums.id = d.doc_id
"""
