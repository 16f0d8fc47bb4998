"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

Documents with equal shingle sets are one class from the start. Classes whose
signatures share a band meet in a bucket; one leader of every bucket is compared with
the other members on full sets. Where a bucket then still holds several components,
its members are indexed by their rarest shingles. Of two similar sets the first shingle
that both have comes so early in either that sizes and places alone rule out most
pairs (an exact filter); in every list of the index a few leaders are compared with
the members of other components that the filter leaves, and rounds with more leaders
follow until it leaves none. Pairs of members are never listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import among, mix, ranges, release, stage, trim, utf8

SHINGLE = 5
SLOTS = 100
BANDS = 20  # of SLOTS / BANDS slots: a pair at 0.85 shares none with probability 8e-6
LOW_BANDS = 25  # below 0.85: a pair at 0.8 shares none with probability 2e-6
BATCH_WORDS = 60_000
KNOWN_WORDS = 100_000
KEY_BITS = 1 << 24  # of a filter that keeps rows without a match out of a join's shuffle
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct 5-word shingles of each text, sorted, one text after the other, and their counts."""
    words = [t.translate(_LOWER).split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[x] for w in words for x in w), np.uint64, int(sizes.sum()))
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    n = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, 0)
    at, doc = ranges(first, n), np.repeat(np.arange(len(texts)), n)
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h = (h ^ flat[at + j]) * _STEP
        h ^= h >> np.uint64(29)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        tail = []
        for d in short.tolist():
            x = np.uint64(sizes[d])
            with np.errstate(over="ignore"):
                for w in flat[first[d] : first[d] + sizes[d]]:
                    x = (x ^ w) * _STEP
                    x ^= x >> np.uint64(31)
            tail.append(x)
        h, doc = np.concatenate((h, np.array(tail, np.uint64))), np.concatenate((doc, short))
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def super_minhash(hashes: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """[sets, slots] signatures: P(equal slot) is the Jaccard similarity.

    Every element walks through a random permutation of the slots; its j-th stop gets a
    value in [j, j + 1), so values of one element are correlated and a slot keeps the
    least. All elements take a step at a time; a set stops once its slots all hold less
    than the next step could give.
    """
    sets = len(counts)
    sig = np.full((sets, slots), np.inf)
    flat = sig.ravel()
    element, owner = hashes, np.repeat(np.arange(sets), counts)
    perm: np.ndarray | None = None
    for j in range(slots):
        if not len(element):
            break
        with np.errstate(over="ignore"):
            r = mix(element + np.uint64(j + 1) * _STEP)
            k = (mix(r ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(slots - j)).astype(np.int64) + j
        value = j + (r >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        if perm is None:
            place = k
        else:
            row = np.arange(len(element))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(flat, owner * slots + place, value)
        stay = (sig.max(axis=1) >= j + 1)[owner]
        if perm is None:
            element, owner, k = element[stay], owner[stay], k[stay]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
            perm[np.arange(len(element)), k] = 0
            perm[:, 0] = k
        elif not stay.all():
            element, owner, perm = element[stay], owner[stay], perm[stay]
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """[sets, bands] 64-bit keys."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sig), 1))
    for j in range(bits.shape[2]):
        h = mix(h ^ bits[:, :, j])
    return h.view(np.int64)


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)
_SETS = "rep long, f1 long, n long, shingles binary"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        data, offs = utf8(batch.column(1))
        raw, at = data.tobytes(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + 6 * BATCH_WORDS, "right")) - 1)
            yield batch.column(0).slice(at, end - at), [raw[offs[k] : offs[k + 1]] for k in range(at, end)]
            at = end


def _fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    raw = b"".join(hashlib.blake2b(hashes[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(counts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _sign(bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for ids, texts in _batches(batches):
            hashes, counts = shingle_sets(texts, known)
            keys = band_keys(super_minhash(hashes, counts), bands)
            marks = _fingerprints(hashes, counts)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts.astype(np.int64)), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                names=_SIGNED.names,
            )
        trim()

    return sign


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for ids, texts in _batches(batches):
        hashes, counts = shingle_sets(texts, known)
        marks, ends = _fingerprints(hashes, counts), np.cumsum(counts)
        sets = [hashes[e - c : e].tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(marks[:, 0].copy()), pa.array(counts.astype(np.int64)), pa.array(sets, pa.binary())], names=["rep", "f1", "n", "shingles"])
    trim()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Contraction: every node points to its least neighbour, pointers are doubled until
    they stand, edges are renamed to the nodes pointed to, and those within a node
    vanish. So a chain in order takes one round. Only counts reach the driver.
    """
    labels: DataFrame | None = None
    edges = stage(edges.where("a <> b").distinct(), "cc-edges")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "cc-to")
        while True:
            nxt = to.select(F.col("a").alias("x"), F.col("p").alias("pp"))
            jumped = stage(to.join(nxt, F.col("p") == F.col("x")).select("a", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved")), "cc-jump")
            to = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = to.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            labels = labels.join(to, F.col("component") == F.col("a"), "left").select("node", F.coalesce("p", "component").alias("component"))
        pa_, pb = to.select(F.col("a").alias("x"), F.col("p").alias("pa")), to.select(F.col("a").alias("y"), F.col("p").alias("pb"))
        renamed = edges.join(pa_, F.col("a") == F.col("x")).join(pb, F.col("b") == F.col("y"))
        edges = stage(renamed.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        labels = stage(labels, "cc-labels")
        if edges.isEmpty():
            return labels


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): components ca and cb of those ``pairs`` (rep, f1, leader, leader_f1, ca, cb) whose full sets have 100 * intersection >= percent * union.

    Sets of which no pair is on a join's side stay out of its shuffle.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in range(4))
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    at = np.searchsorted(q, p)
                    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    good[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good))

    left = sets.where(among(pairs, "rep", KEY_BITS)(F.col("rep"))).select("rep", "f1", F.col("shingles").alias("x"))
    right = sets.where(among(pairs, "leader", KEY_BITS)(F.col("rep"))).select(F.col("rep").alias("leader"), F.col("f1").alias("leader_f1"), F.col("shingles").alias("y"))
    return pairs.join(left, ["rep", "f1"]).join(right, ["leader", "leader_f1"]).select("ca", "cb", "x", "y").mapInArrow(check, "a long, b long").distinct()


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            own = [np.frombuffer(x, np.int64) for x in part.column(4).to_pylist()]
            sizes = np.array([len(x) for x in own], np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(part.column(j).to_numpy(), sizes)) for j in range(4)), pa.array(np.concatenate(own))], names=["rep", "f1", "n", "component", "token"])


def early(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, rep, f1, component, n, place): the early shingles of the ``open_`` (rep, component) sets.

    Only shingles that more than one component has can be common to sets of different
    components. A set's places begin with all others, then these from the rarest on.
    Sets that have too few are similar to none. Of two similar sets of sizes n and m at
    least percent / (100 + percent) * (n + m) are common, so the first of them has as
    many places from it to the end, in either set, and is among the first
    n - ceil(percent / 100 * n) + 1 of n.
    """
    each = sets.join(open_, "rep").select("rep", "f1", "n", "component", "shingles").mapInArrow(_spread, "rep long, f1 long, n long, component long, token long")
    each = stage(each, "near-tokens")
    between = each.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("df")).where("low < high").select("token", "df")
    ranked = each.join(between, "token").groupBy("rep", "f1", "n", "component").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("all"))
    own = F.size("all")
    some = ranked.where(100 * own >= percent * F.col("n"))
    # places count from 0; the first of `all` is at n - size
    wanted = F.slice("all", 1, (F.lit(1) + own - F.ceil(F.col("n") * percent / 100)).cast("int"))
    listed = some.select("rep", "f1", "component", "n", (F.col("n") - own).alias("first"), F.posexplode(F.transform(wanted, lambda x: x["token"])).alias("k", "token"))
    out = stage(listed.select("token", "rep", "f1", "component", "n", (F.col("first") + F.col("k")).alias("place")), "near-early")
    release(each)
    return out


def _apart(members: DataFrame, *key: str) -> DataFrame:
    """Keys whose members are in more than one component."""
    return members.groupBy(*key).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(*key)


def _fits(percent: int, n: str, place: str, m: str, other: str) -> Column:
    """Sets of sizes n and m whose first common shingle is at these places may be similar."""
    return F.least(F.col(n) - F.col(place), F.col(m) - F.col(other)) * (100 + percent) >= percent * (F.col(n) + F.col(m))


def live(entries: DataFrame, percent: int) -> DataFrame:
    """The ``entries`` that fit another component's entry of their list: decided for each size and place that occurs, not for each member."""
    lists = entries.join(_apart(entries, "token"), "token", "left_semi")
    kinds = lists.groupBy("token", "n", "place").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    kinds = stage(kinds, "near-kinds")
    # the partner's side of a list in one row of its own, so that a kind meets the list once
    other = kinds.groupBy("token").agg(F.collect_list(F.struct("n", "place", "low", "high")).alias("others"))
    fit = F.exists(
        "others",
        lambda x: (F.least(F.col("n") - F.col("place"), x["n"] - x["place"]) * (100 + percent) >= percent * (F.col("n") + x["n"]))
        & ((F.col("low") < F.col("high")) | (x["low"] < x["high"]) | (F.col("low") != x["low"])),
    )
    alive = kinds.join(other, "token").where(fit).select("token", "n", "place")
    return lists.join(alive, ["token", "n", "place"], "left_semi")


def _relabel(df: DataFrame, moved: DataFrame) -> DataFrame:
    """``component`` as ``moved`` (node, component) has it."""
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("moved_to"))
    return df.join(to, "component", "left").withColumn("component", F.coalesce("moved_to", "component")).select(df.columns)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of non-space bytes, A-Z lower-cased; a text of fewer than 5 words,
    but some, has the one shingle of all of them; null and wordless texts have none and
    are linked with nothing. Rows that share an id are one node: all their texts'
    links are its own. A row with a null id is no node, but is in the component of
    rows with an equal set. An empty table gives an empty result; other columns are
    ignored. Returns doc_id, n_shingles, component_id (smallest id reachable), kept
    (doc_id = component_id).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bands = BANDS if percent >= 85 else LOW_BANDS
    signed = stage(texts.mapInArrow(_sign(bands), _SIGNED), "near-signed")
    some = signed.where("n > 0")
    classes = stage(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "near-classes")
    rows = classes.where(F.col("rep").isNotNull()).select("rep", "f1", "n", F.explode("bands").alias("key"))
    shared_keys = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "near-buckets")
    # most keys are one class's own
    members = stage(rows.where(among(shared_keys, "key", KEY_BITS)(F.col("key"))).join(shared_keys, "key"), "near-members")
    # ids with several texts tie their classes together
    several = some.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low < high").select("doc_id")
    ties = some.select("doc_id", "f1", "f2").join(several, "doc_id", "left_semi").join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
    ties = stage(ties.groupBy("doc_id").agg(F.min("rep").alias("least"), F.collect_set("rep").alias("reps")).select(F.explode("reps").alias("a"), F.col("least").alias("b")), "near-ties")
    # the most connected member of a bucket leads: an original rather than its copies
    weight = members.groupBy("rep", "f1").agg(F.sum("members").alias("weight"))
    lead = members.join(weight, ["rep", "f1"]).groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("rep").alias("leader"), F.col("f1").alias("leader_f1"), F.col("n").alias("leader_n"))).alias("l")).select("key", "l.*")
    lead = stage(lead, "near-leaders")
    apt = ((F.col("rep") != F.col("leader")) | (F.col("f1") != F.col("leader_f1"))) & (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n"))
    pairs = members.join(lead, "key").where(apt).select("rep", "f1", "leader", "leader_f1", F.col("rep").alias("ca"), F.col("leader").alias("cb"))
    wanted = stage(members.select("rep").distinct(), "near-wanted")
    # a set is there as often as its row; other texts of a wanted id are there too, which are tied to it anyway
    sets = stage(texts.where(among(wanted, "rep")(F.col("doc_id"))).join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "text").mapInArrow(_expand, _SETS), "near-sets")
    links = verified(stage(pairs.distinct(), "near-pairs"), sets, percent)
    labels = components(links.unionAll(ties))
    # leaders are through with their bucket
    home = members.select("key", "rep", "f1", F.col("rep").alias("component")).join(lead.select("key", F.col("leader").alias("rep"), F.col("leader_f1").alias("f1")), ["key", "rep", "f1"], "left_anti")
    home = stage(_relabel(home, labels), "near-home")
    open_ = stage(home.join(_apart(home, "key"), "key", "left_semi").select("rep", "component").distinct(), "near-open")
    entries, leaders = stage(live(early(open_, sets, percent), percent), "near-live"), 1
    while not entries.isEmpty():
        if leaders == 1:
            lead = entries.groupBy("token").agg(F.min(F.struct("place", "rep", "f1", "n", "component")).alias("l")).select("token", "l.*")
        else:
            lead = entries.withColumn("at", F.row_number().over(Window.partitionBy("token").orderBy("place", "rep", "f1"))).where(F.col("at") <= leaders).drop("at")
        lead = stage(lead.select("token", *(F.col(c).alias(f"leader_{c}") for c in ("rep", "f1", "n", "place", "component"))), "near-leaders")
        fit = (F.col("component") != F.col("leader_component")) & _fits(percent, "n", "place", "leader_n", "leader_place")
        pairs = entries.join(lead, "token").where(fit).select("rep", "f1", F.col("leader_rep").alias("leader"), "leader_f1", F.col("component").alias("ca"), F.col("leader_component").alias("cb"))
        links = stage(verified(stage(pairs.distinct(), "near-pairs"), sets, percent), "near-links")
        rest = entries.join(lead.select("token", F.col("leader_rep").alias("rep"), F.col("leader_f1").alias("f1")), ["token", "rep", "f1"], "left_anti")
        if not links.isEmpty():
            moved = components(links)
            labels = stage(_relabel(labels, moved).unionAll(moved).distinct(), "near-labels")
            rest = _relabel(rest, moved)
        entries, leaders = stage(live(stage(rest, "near-rest"), percent), "near-live"), leaders * 8
    homes = classes.join(labels, F.col("rep") == F.col("node"), "left").select("f1", "f2", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    moved = stage(homes.where("copies > 1 or component <> rep").select("f1", "f2", "component"), "near-homes")
    release(members, sets, home, classes)
    return signed.join(moved, ["f1", "f2"], "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id"))).otherwise(F.lit(True)).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every group that with the smallest id stays, null ids last.

    Rows are told apart by a hash of id and text, so null ids and ids with several
    texts take part like any other; of rows with equal id and text one stays, unless
    they have no words. All columns are kept, whatever their names; an empty table
    gives an empty result.
    """
    mark = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.select(mark.alias("doc_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = near_duplicates(rows, percent).where("n_shingles > 0").groupBy("doc_id").agg(F.first("component_id").alias("group"), F.count(F.lit(1)).alias("rows"))
    found = stage(found, "one-found")
    groups = found.groupBy("group").agg(F.sum("rows").alias("rows")).where("rows > 1").select("group")
    several = stage(found.join(groups, "group", "left_semi").join(rows.select("doc_id", "id").distinct(), "doc_id"), "one-several")
    first = several.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("least")).select(F.col("least.doc_id").alias("doc_id"), F.lit(True).alias("first"))
    fate = stage(several.join(first, "doc_id", "left").select("doc_id", F.coalesce("first", F.lit(False)).alias("first"), "rows"), "one-fate")
    # most rows are in no group and stay where they are
    inner = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).withColumn("doc_id", F.xxhash64(F.col(f"c{docs.columns.index(id_col)}").cast("long"), F.col(f"c{docs.columns.index(text_col)}")))
    rows = inner.withColumn("some", among(fate, "doc_id")(F.col("doc_id")))
    some = rows.where("some").join(fate, "doc_id", "left").where("first is null or first")
    once = some.withColumn("own", F.when(F.col("first").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", "own"])
    own = [f"c{k}" for k in range(len(docs.columns))]
    return rows.where("not some").select(own).unionAll(once.select(own)).toDF(*docs.columns)
