"""Every operator against brute force, and on awkward tables."""

import base64
import hashlib
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleflow.llm import ann, archives, decontaminate, language, lm, mixing, near_dup, sharding, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, part int, crc long, size int, kind int, rep long, bucket int"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "k", 3, 4, 5, 6, 7, 8) for r in rows], DOCS)


def sample(seed=0, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 20, 60, 200]))) for _ in range(n)]
    for i in range(0, n, 4):
        src = r.randrange(n)
        own = texts[src].split(" ")
        if i % 8 and own:
            own[r.randrange(len(own))] = "changed"
        texts[i] = " ".join(own)
    line = "the very same line of words that is found again and again in many of these texts " * 2
    rows = [(i, t if i % 5 else t + "\n" + line + "é" + str(i), r.choice(["aa", "bb", None]), r.choice(["s1", "s2", "s3", None])) for i, t in enumerate(texts)]
    rows[3] = (3, None, None, None)
    rows[4] = (4, "", "aa", "s1")
    rows[6] = (6, "long " * 30_000 + "end", "bb", "s2")
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, repeated rows, rows that share an id."""
    long = "one two three four five six seven eight nine ten " * 12
    return frame(spark, [(None, long, None, None), (7, long, "aa", "s1"), (7, long, "aa", "s1"), (7, "other " + long, "bb", None), (8, None, "aa", "s1"), (9, "  \t\n", None, "s2"), (None, None, None, None)])


# --- 3


def brute_repeats(rows, length=suffix.LENGTH):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                covered[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, k in zip(b, covered, strict=True) if not k)
        spans = sum(1 for j in range(len(covered)) if covered[j] and (j == 0 or not covered[j - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_suffix_array(seq):
    assert suffix.suffix_array(seq) == sorted(range(len(seq)), key=lambda i: seq[i:])


def test_repeats_match_brute_force(spark, docs, rows):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert found == brute_repeats([(r[0], r[1]) for r in rows])


def test_one_shard_by_suffix_array(rows):
    texts = [(r[1] or "")[:2000].encode() for r in rows[:25]]
    expected = brute_repeats([(i, t.decode(errors="ignore")) for i, t in enumerate(texts)])
    runs = suffix.repeated_in([t.decode(errors="ignore").encode() for t in texts])
    assert [sum(b - a for a, b in r) for r in runs] == [expected[i][1] for i in range(len(texts))]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=400).map(lambda b: bytes(c % 2 for c in b)), min_size=1, max_size=4))
def test_anchor_ranges_cover_all_strings(texts):
    sizes = np.array([len(t) for t in texts])
    _, _, text, lo, hi = suffix.anchors(np.frombuffer(b"".join(texts), np.uint8), sizes)
    covered = Counter((t, p) for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True) for p in range(a, b + 1))
    assert set(covered) == {(k, p) for k, t in enumerate(texts) for p in range(len(t) - suffix.LENGTH + 1)}
    assert set(covered.values()) <= {1}


def test_repeats_on_odd_rows(odd, empty):
    found = suffix.remove_repeats(odd).collect()
    assert len(found) == 7
    # equal rows are one place: they have equal results
    assert len({(r.n_removed, r.kept_sha256) for r in found if r.doc_id == 7 and r.n_bytes == min(x.n_bytes for x in found if x.doc_id == 7)}) == 1
    assert suffix.remove_repeats(empty).count() == 0


# --- 5


def brute_components(rows, percent=85):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(near_dup._LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        parent[i] = i

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def near_rows(n=90):
    r = random.Random(5)
    out = []
    for g in range(6):
        base = [f"w{r.randrange(500)}" for _ in range(100)]
        for k in range(n // 6):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                own[r.randrange(100)] = f"edit{r.randrange(10**6)}"
            out.append((len(out), " ".join(own), "aa", "s1"))
    return out


@pytest.mark.parametrize("make", [sample, near_rows])
def test_near_duplicates_match_brute_force(spark, make):
    rows = make()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert found == brute_components([(r[0], r[1]) for r in rows])


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 62, 400, dtype=np.uint64)
    b = np.concatenate((a[:300], r.integers(0, 1 << 62, 100, dtype=np.uint64)))
    sig = near_dup.super_minhash(np.concatenate((a, b)), np.array([400, 400]), 100)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.15


def family_rows(n=160, words=150, seed=3):
    """Copies of one text of which each has its own edits, so that some are linked and others are just too far apart; the original is not there."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for k in r.sample(range(words), r.choice([1, 1, 2, 2, 3, 4])):
            own[k] = f"e{r.randrange(12)}" if i % 3 else f"own{i}"
        out.append((i, " ".join(own), "aa", "s1"))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_families_without_an_original(spark, percent):
    rows = family_rows()
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows), percent).collect()}
    assert found == brute_components([(r[0], r[1]) for r in rows], percent)
    assert 1 < sum(kept for _, _, kept in found.values()) < len(rows)


def test_sets_without_pairs_are_not_shuffled(spark):
    own = [(i, 1, 4, np.array([i, 1000, 2000, 3000], np.uint64).tobytes()) for i in range(500)] + [(600, 1, 4, np.array([7, 1000, 2000, 3000], np.uint64).tobytes())]
    sets = near_dup.stage(spark.createDataFrame(own, near_dup._SETS), "test-sets")
    pairs = near_dup.stage(spark.createDataFrame([(600, 1, 7, 1, 600, 7), (8, 1, 9, 1, 8, 9)], "rep long, f1 long, leader long, leader_f1 long, ca long, cb long"), "test-pairs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = near_dup.verified(pairs, sets, 85)
        assert [tuple(x) for x in links.collect()] == [(600, 7)]
        plan, written = links._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

        def walk(node):
            metrics = node.metrics()
            if node.nodeName() == "Exchange":
                written.append(metrics.apply("shuffleRecordsWritten").value())
            for k in range(node.children().size()):
                walk(node.children().apply(k))
            if "QueryStage" in node.nodeName():
                walk(node.plan())

        walk(plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(written) >= 4 and sum(written) < 50  # all sets are 501 on either side


def test_chains_take_few_rounds(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(near_dup, "stage", lambda df, tag, own=near_dup.stage: staged.append(tag) or own(df, tag))
    chain = [(k, k + 1) for k in range(400)] + [(1000 + 7 * k % 101, 1000 + 7 * (k + 1) % 101) for k in range(100)]
    found = {r.node: r.component for r in near_dup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(401)} | {1000 + k: 1000 for k in range(101)}
    assert len(staged) <= 50


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect())
    # both texts of 7 are similar; the null id has the set of one of them
    assert found == Counter({(7, 10, 7, True): 2, (7, 11, 7, True): 1, (None, 10, 7, False): 1, (8, 0, 8, True): 1, (9, 0, 9, True): 1, (None, 0, None, True): 1})
    assert near_dup.near_duplicates(empty).count() == 0
    # ids with two texts tie them together, whoever is the smallest
    x, y = (" ".join(f"{c}{k}" for k in range(50)) for c in "xy")
    rows = [(1, x, None, None), (5, x, None, None), (5, y, None, None), (3, y, None, None), (8, y + " z", None, None)]
    found = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert found == Counter({(1, 1, True): 1, (5, 1, False): 2, (3, 1, False): 1, (8, 1, False): 1})


def test_one_of_each_group_on_odd_rows(spark, odd, empty):
    kept = near_dup.one_of_each_group(odd)
    assert kept.columns == odd.columns
    # one text of id 7, of two that are similar, and the wordless rows
    found = kept.collect()
    assert sorted(str(r.doc_id) for r in found) == ["7", "8", "9", "None"] and all(not (r.text or "").strip() for r in found if r.doc_id != 7)
    x, y = (" ".join(f"{c}{k}" for k in range(50)) for c in "xy")
    rows = [(None, x, None, None), (None, x, None, None), (4, y, None, None), (4, x + " z", None, None), (None, y + " z", None, None), (6, "short", None, None), (6, "short", None, None), (6, "other", None, None)]
    found = Counter((r.doc_id, r.text) for r in near_dup.one_of_each_group(frame(spark, rows)).collect())
    assert found == Counter([(4, y), (4, x + " z"), (6, "short"), (6, "other")])
    assert near_dup.one_of_each_group(empty).count() == 0


# --- 10


def brute_contamination(rows, items, window=8):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(near_dup._LOWER))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(name)
    out = {}
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for length in {len(x) for x in windows}:
            for a in range(len(w) - length + 1):
                if own := windows.get(tuple(w[a : a + length])):
                    hit |= set(range(a, a + length))
                    names |= own
        text = ",".join(sorted(map(str, names)))
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(text.encode()).hexdigest(), len(names) >= 2)
    return out


def test_contamination_matches_brute_force(spark, docs, rows):
    items = [(0, rows[11][1]), (1, "the very same line of words that is found again"), (2, "ab"), (3, None), (4, ""), (5, "again and again in many of these texts the very same"), (6, rows[7][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contamination([(r[0], r[1]) for r in rows], items)
    for found in (decontaminate.find_contamination(docs, benchmark), decontaminate.find_contamination(docs, benchmark, clean=True)):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest(found).collect()}
        assert got == expected
    assert decontaminate.digest(decontaminate.find_contamination(docs, benchmark.limit(0))).agg(F.sum("n_items")).first()[0] == 0


def test_contamination_in_blocks(spark, docs, rows, monkeypatch):
    items = [(k, rows[k][1]) for k in range(7, 25)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (100,))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.digest(decontaminate.find_contamination(docs, benchmark)).collect()}
    assert got == {k: v[:3] for k, v in brute_contamination([(r[0], r[1]) for r in rows], items).items()}


def test_blocks_give_odd_rows_what_one_block_gives(spark, odd, monkeypatch):
    items = [(1, "three four five"), (1, "ten one two"), (2, "other one"), (None, "seven eight"), (3, "no such words"), (4, "eight nine ten one two three four five six")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)

    def found():
        rows = decontaminate.find_contamination(odd, benchmark, clean=True).collect()
        return Counter((r.doc_id, r.n_words, tuple(r.item_ids), tuple(map(tuple, r.spans)), r.clean_text) for r in rows)

    one = found()
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", (3,))
    assert sum(one.values()) == 7 and len(list(decontaminate.benchmark_blocks(benchmark))) > 2
    assert found() == one


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(3)
    seq = np.concatenate(([0], r.integers(1, 4, 300), [0], r.integers(1, 4, 50), [0])).astype(np.int32)
    index = decontaminate.FMIndex(seq)
    patterns = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    lo, hi = index.find(patterns)
    for p, a, b in zip(patterns.tolist(), lo.tolist(), hi.tolist(), strict=True):
        there = [i for i in range(len(seq) - 2) if seq[i : i + 3].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == there


def test_contamination_on_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "three four five")], "item_id long, text string")
    assert decontaminate.find_contamination(odd, benchmark).count() == 7
    assert decontaminate.find_contamination(empty, benchmark).count() == 0


# --- 2


def brute_cross_entropy(rows, target):
    """(id, text) of both: {id: (n_words, target_loss, background_loss)}; every word is in the vocabulary."""
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(near_dup._LOWER))
    fold = lambda i: 0 if i is None else i % 2
    uni, ctx, bi = [Counter() for _ in range(4)], [Counter() for _ in range(4)], [Counter() for _ in range(4)]
    for k, table in ((0, rows), (2, target)):
        for i, t in table:
            w = words(t)
            uni[k + fold(i)].update(w)
            ctx[k + fold(i)].update([None, *w][: len(w)])
            bi[k + fold(i)].update(zip([None, *w], w, strict=False))
    total, places, out = [sum(x.values()) for x in uni], len(set().union(*uni)) + 1, {}
    for i, t in rows:
        w, other = words(t), 1 - fold(i)
        own = out.setdefault(i, [0, 0.0, 0.0])
        own[0] += len(w)
        for v, x in zip([None, *w], w, strict=False):
            for m, kind in ((1, other + 2), (2, other)):
                r = 1.0 if m == 1 else total[other + 2] / total[other] if total[other] else 0.0
                single = (uni[kind][x] * r + lm.ADD) / (total[kind] * r + lm.ADD * places)
                own[m] -= np.log2((bi[kind][v, x] * r + lm.PRIOR * single) / (ctx[kind][v] * r + lm.PRIOR))
    return {i: (n, *(pytest.approx(x / n, abs=2e-6) if n else None for x in (t, b))) for i, (n, t, b) in out.items()}


@pytest.mark.parametrize("share", [500, 20])
def test_cross_entropy(spark, docs, rows, empty, odd, monkeypatch, share):
    monkeypatch.setattr(lm, "HEAVY_SHARE", share)
    monkeypatch.setattr(lm, "BUCKET_WORDS", 4000)
    conversations = [(k, r[1]) for k, r in enumerate(rows[:20])] + [(None, "a null id"), (21, None)]
    target = spark.createDataFrame([(i, 0, t) for i, t in conversations], "conv_id long, turn int, text string")
    for own in (docs, odd):
        found = {r.doc_id: (r.n_words, r.target_loss, r.background_loss) for r in lm.cross_entropy_difference(own, target).collect()}
        assert found == brute_cross_entropy([(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()], conversations)
    assert lm.cross_entropy_difference(empty, target.limit(0)).count() == 0
    assert lm.cross_entropy_difference(odd, target.limit(0)).count() == 4  # null, 7, 8, 9


def test_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    words, seqs = 5, [(k, r.integers(1, 6, 40)) for k in range(4) for _ in range(5)]
    counts, ends, totals, texts = np.zeros((4, words), int), np.zeros((4, words), int), np.zeros(4, int), np.zeros(4, int)
    pairs = np.zeros((4, words + 1, words + 1), int)
    for k, s in seqs:
        np.add.at(pairs[k], (np.concatenate(([0], s[:-1])), s), 1)
        np.add.at(counts[k], s - 1, 1)
        totals[k] += len(s)
        texts[k] += 1
        ends[k][s[-1] - 1] += 1
    m = lm.Models([b"%d" % k for k in range(words)], counts, ends, totals, texts, words + 1)
    # the place before a text never follows; in its stead a word that never occurs has what is left
    for own, context in zip(m.word_share(0, pairs, m.unigram[:, None, :]), m.context_share(0, m.context), strict=True):
        assert np.allclose(np.exp2(-(own + context[:, None])).sum(axis=1), 1)


# --- 4


def test_disguises_are_undone():
    words = Counter({"stupid": 300, "idiot": 300, "hello": 200, "world": 200, "nothing": 100})
    model = toxicity.CharModel(words)
    for token, word in {"stup1d": "stupid", "s t u p i d": "stupid", "1d10t": "idiot", "i.d.i.o.t": "idiot", "stuuuupid": "stupid", "$tupid": "stupid", "idi0t": "idiot", "h3ll0": "hello"}.items():
        assert model.decode(token) == word
    assert toxicity.words_and_odd("You s.t.u.p.i.d, stuuupid 1d10t!")[1] >= {"s.t.u.p.i.d", "stuuupid", "1d10t"}
    assert toxicity.words_and_odd("an i   d   i   o   t or iidiioot")[1] >= {"i   d   i   o   t", "iidiioot"}


def brute_viterbi(words, token):
    """Log probability of the likeliest path: every way to write, states are all that is written of a word."""
    grams = Counter()
    for word, n in words.items():
        padded = "^" + word + "$"
        for i in range(1, len(padded)):
            for k in range(max(0, i - toxicity.ORDER + 1), i + 1):
                grams[padded[k : i + 1]] += n
    starts = Counter()
    for g, n in grams.items():
        starts[g[:-1]] += n

    def log(written, char):
        context, lost = written[1 - toxicity.ORDER :], 0.0
        while context not in starts:
            context = context[1:]
        while context + char not in grams:
            if not context:
                return lost + np.log(0.1 / starts[""])
            context, lost = context[1:], lost - toxicity.BACK
        return lost + np.log(grams[context + char] / starts[context])

    wild = dict.fromkeys(toxicity.WILD, "abcdefghijklmnopqrstuvwxyz")
    paths, last = {"^": 0.0}, None
    for c in re.sub(r"[ .\-]+", " ", token):
        after = defaultdict(lambda: -np.inf)
        for written, v in paths.items():
            if c.isalpha():
                after[written + c] = max(after[written + c], v + log(written, c))
            for x in (toxicity.LEET | wild).get(c, ""):
                after[written + x] = max(after[written + x], v + log(written, x) - (toxicity.WILD_SWAP if c in wild else toxicity.SWAP))
            if c == " " or c in wild or c in toxicity.GAPS:
                after[written] = max(after[written], v - toxicity.SKIP)
                if written != "^":
                    after["^"] = max(after["^"], v - toxicity.SKIP + log(written, "$"))
            elif c == last:
                after[written] = max(after[written], v - toxicity.COLLAPSE)
        paths, last = dict(after), last if c == " " else c
    return max(v + (log(w, "$") if w != "^" else 0.0) for w, v in paths.items())


@settings(max_examples=150, deadline=None)
@given(st.text("aabbcé10$|. *", min_size=1, max_size=8))
def test_decoding_matches_brute_force(token):
    words = Counter({"abba": 7, "cab": 4, "bac": 3, "éab": 2, "lab": 3, "sol": 1, "bobs": 2})
    if token.count("*") <= 2:
        value, _ = toxicity.CharModel(words).decode_all([token])[0]
        assert value == pytest.approx(brute_viterbi(words, token), abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aabbcdelmé10$|. *#&", min_size=1, max_size=120), min_size=1, max_size=6))
def test_cuts_of_long_tokens_change_nothing(tokens):
    words = Counter({"abba": 7, "cable": 4, "bacdel": 3, "éablem": 2, "lab": 3, "debacle": 1, "bobs": 2})
    model, long = toxicity.CharModel(words), toxicity.LONG
    cut = model.decode_all(tokens)
    try:
        toxicity.LONG = 10**9
        whole = [model.decode_all([t])[0] for t in tokens]
    finally:
        toxicity.LONG = long
    assert [v for v, _ in cut] == pytest.approx([v for v, _ in whole], abs=1e-3)


def test_decoding_takes_little_memory(monkeypatch):
    rng = random.Random(4)
    model = toxicity.CharModel(Counter({"".join(rng.choices("aeiorstlnd", k=rng.randint(3, 7))): 3 for _ in range(500)} | {"stupid": 9}))
    short = sorted({"".join(rng.choices("abst01$", k=rng.randint(4, 9))) for _ in range(4000)})

    def peak(tokens):
        tracemalloc.start()
        got = model.decode_all(tokens)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, top

    # a long token beside many short ones
    alone, top = peak(short)
    long = "ê. " * 1000 + "5tup1d"
    beside, top_beside = peak([*short, long])
    assert beside == [*alone, *model.decode_all([long])]
    assert top_beside < top + 5e6  # as many steps for all took 240 MB
    # wildcards that leave thousands of states open at each step
    tops = [peak(["*-" * n + "5tup1d"])[1] for n in (50, 150)]
    assert tops[1] < tops[0] + 2e6
    # characters are dropped early, with the same result
    monkeypatch.setattr(toxicity, "PATHS", 50)
    assert model.decode_all([*short, long]) == beside


def test_long_tokens_are_read_whole():
    words = Counter({"stupid": 300, "idiot": 300, "hello": 200, "world": 200, "nothing": 100, "you": 300})
    scorer = toxicity.Scorer({"wstupid": 5.0, "widiot": 5.0}, -3.0, toxicity.CharModel(words))
    plain = scorer.score("hello world")
    filler = "/".join(["hello", "world", "nothing"] * 12)
    spaced = "  ".join(" ".join(w) for w in ["hello", "world", "nothing"] * 6)
    for text in (
        "hello/world,nothing.stupid/hello,world",
        "hello/world,nothing.1d10t/hello,world",
        f"{filler}/stup1d/{filler}",
        "世界，" * 30 + "stupid，" + "世界，" * 30,
        "stu" + "u" * 200 + "pid",
        "y o u s t u p i d",
        "y o u  s t u p i d",
        f"{spaced}  s t u p i d  {spaced}",
    ):
        assert scorer.score(text) > plain, text
    assert scorer.score(filler) == scorer.score(spaced) == plain


def test_toxicity(spark, empty, odd):
    r = random.Random(1)
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows, labels = [], []
    for i in range(400):
        own = [r.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            own[r.randrange(30)] = r.choice(["stupid", "idiot", "moron"])
        rows.append((i, " ".join(own), "aa", "s1"))
        labels.append((i, 1, int(toxic)))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    found = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(found[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in found]) > 0.97
    hidden = frame(spark, [(0, "abcde 1d10t fghab", None, None), (1, "abcde fghab", None, None)])
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(hidden, model).collect()}
    assert got[0] >= toxicity.THRESHOLD > got[1]
    assert all(0 <= x.score <= 1 for x in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, known.limit(0))).count() == 0


def test_toxicity_learns_from_all_labels(spark):
    rows = 60_000
    learned = [i for i in range(rows) if zlib.crc32(str(i).encode()) % 4 != 2]
    rare = [a + b + "qzx" for a in "qvwxy" for b in "jkzq"]  # no two begin alike
    # each rare word is in six of the toxic texts, all others are plain
    at = {i: rare[k // 6] for k, i in enumerate(random.Random(2).sample(learned, 6 * len(rare)))}
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = [(i, f"{words[i % 5]} {at.get(i, '')} {words[i // 5 % 5]}", None, None) for i in range(rows)]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in texts], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i in at)) for i in range(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert all(model.score(f"alpha {w} beta") >= toxicity.THRESHOLD for w in rare)
    assert model.score("alpha beta gamma") < toxicity.THRESHOLD


def test_toxicity_counts_beginnings_in_all_texts(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 8))) for _ in range(150)]
    rows = [(i, " ".join(r.choice(words[:60] if i % 7 == 0 else words[20:]) for _ in range(r.randint(0, 6))), int(i % 7 == 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    counts = defaultdict(lambda: [0, 0])
    for i, t, y in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            own = toxicity.words_and_odd(t)[0]
            assert own == toxicity.plain_words(t)
            for f in {"w" + w for w in own} | {"p" + w[:n] for w in own for n in toxicity.PREFIXES if len(w) > n}:
                counts[f][y] += 1
    asked, choose = [], toxicity.choose
    monkeypatch.setattr(toxicity, "choose", lambda own, *size: asked.append((dict((f, [a, b]) for f, a, b in own), size)) or choose(own, *size))
    toxicity.fit(docs, known)
    got, size = asked[0]
    assert sum(size) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(900))
    marks = {f: n for f, n in counts.items() if n[1] >= 4 and n[1] >= n[0]}
    assert marks and marks == {f: n for f, n in got.items() if n[1] >= 4 and n[1] >= n[0]}


def test_logistic_takes_equal_rows_together(monkeypatch):
    r = np.random.default_rng(8)
    sets = [sorted(set(r.integers(0, 12, r.integers(0, 5)).tolist())) for _ in range(300)]
    y = np.array([int(2 in x or 7 in x) ^ int(r.random() < 0.05) for x in sets])
    flat = lambda xs: np.array([j for x in xs for j in x], np.int32)
    w, bias = toxicity.logistic(flat(sets), np.array([len(x) for x in sets]), 1 - y, y, 12)
    own = sorted({tuple(x) for x in sets})
    n = {(x, k): sum(tuple(s) == x and v == k for s, v in zip(sets, y, strict=True)) for x in own for k in (0, 1)}
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    w2, bias2 = toxicity.logistic(flat(own), np.array([len(x) for x in own]), *(np.array([n[x, k] for x in own]) for k in (0, 1)), 12)
    assert np.allclose(w, w2) and abs(bias - bias2) < 1e-9
    # where no weight can change without raising the loss
    p = 1 / (1 + np.exp(-np.array([sum(w[j] for j in x) + bias for x in sets])))
    slope = np.array([sum(p[i] - y[i] for i, x in enumerate(sets) if j in x) for j in range(12)]) + 1.5
    assert (slope > -0.05).all() and np.abs(slope[w > 0.05]).max() < 0.05


# --- 8


def test_language(spark, odd, empty):
    r = random.Random(2)
    syllables = {"xx": ["ba", "do", "ki", "ru"], "yy": ["éa", "ön", "schu", "tz"]}
    rows = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang, "s1") for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    rows += [(200, None, "xx", None), (201, "123 456 !!", "xx", None), (202, "", None, None)]
    docs = frame(spark, rows)
    model = language.fit(docs)
    found = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(docs, model).collect()}
    assert all(found[i][0] == ("xx", "yy")[i % 2] for i in range(200))
    assert {found[i] for i in (200, 201, 202)} == {("und", 0.0)}
    assert language.identified(docs, model).count() == 200
    assert language.identify(odd, language.fit(empty)).count() == 7


def parser_of(texts):
    return language.CrossParser(texts)


def greedy_phrases(parser, ref, text):
    """Pieces of one parse from end to end: the next piece is the longest that occurs in ``ref``."""
    known, codes = "".join(map(chr, ref)), "".join(map(chr, text))
    count = at = 0
    while at < len(codes):
        n = 0
        while at + n < len(codes) and codes[at : at + n + 1] in known:
            n += 1
        if at + n == len(codes):
            break  # the last piece is not over
        count += 1
        at += n + (codes[at + n] not in known)  # a symbol that occurs nowhere goes with the piece before it
    return count


@pytest.mark.parametrize("segment", [7, 64, 10**6])
@pytest.mark.parametrize("cells", [10, 10**7])
def test_phrases_match_a_greedy_parse(monkeypatch, segment, cells):
    monkeypatch.setattr(language, "SEGMENT", segment)
    monkeypatch.setattr(language, "DENSE_CELLS", cells)
    r = random.Random(7)
    letters = "abcdeé" + "".join(map(chr, range(0x4E00, 0x4E00 + 400)))
    text = lambda n, some: "".join(r.choice(some) for _ in range(n))
    texts = {"aa": [text(300, "abc "), text(200, "abé ")], "zh": [text(900, letters[6:]), text(60, "ab ")]}
    parser = parser_of(texts)
    assert parser.letters.width > 300
    docs = [text(n, some) for n in (0, 1, 5, 400, 1500) for some in ("abc ", letters, letters[6:200] + " ", "xyz")] + [texts["zh"][0][100:700]]
    codes = [parser.letters.encode(t) for t in docs]
    found = parser.phrases(codes)
    for lang, own in enumerate(parser.langs):
        ref = np.concatenate([np.zeros(1, np.int32), *[parser.letters.encode(t) for t in texts[own]]]).tolist()
        # a letter that no text of the language has is a piece that is passed over, as is the symbol of unknown letters
        for d, x in enumerate(codes):
            assert found[d, lang] == greedy_phrases(parser, ref, x.tolist()), (own, d)


def test_automaton_knows_all_substrings():
    codes = [int(c) for c in "0110100110010110"]
    automaton = language.SuffixAutomaton(codes)

    def has(word):
        s = 0
        for c in word:
            s = automaton.next[s].get(c, -1)
            if s < 0:
                return False
        return True

    subs = {tuple(codes[a:b]) for a in range(len(codes)) for b in range(a, len(codes) + 1)}
    for n in range(6):
        for k in range(1 << n):
            word = tuple((k >> j) & 1 for j in range(n))
            assert has(word) == (word in subs)


# --- 1


def test_search_matches_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((600, 24)).astype(np.float32)
    x[50:70] = x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows[10] = (10, None, 0)
    rows[11] = (11, [0.0] * 24, 0)
    rows[12] = (12, [float("nan")] + [1.0] * 23, 0)
    rows[13] = (13, [None] + [1.0] * 23, 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    found = defaultdict(list)
    for q in ann.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[q.query_id].append((q.vec_id, q.score))
    ok = [i for i in range(600) if i not in (10, 11, 12, 13)]
    d = x[ok].astype(np.float64)
    hits = 0
    for q in range(0, 600, 50):
        s = d @ x[q].astype(np.float64) / np.linalg.norm(d, axis=1) / np.linalg.norm(x[q].astype(np.float64))
        best = sorted(((round(-v, 12), i) for v, i in zip(s, ok, strict=True) if i != q))[:5]
        hits += len({i for _, i in best} & {i for i, _ in found[q]})
        assert len(found[q]) == 5
    assert hits >= 0.95 * 60
    assert [i for i, _ in found[50]] == [3, 51, 52, 53, 54]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_training_an_index_takes_little_memory():
    x = np.random.default_rng(6).standard_normal((8000, 8))
    tracemalloc.start()
    try:
        index = ann.train(x, [[i] for i in range(len(x))], 20_000_000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.centres) == 1000
    assert peak < 60e6  # all distances at once took more than 128 MB


def test_the_driver_fits_no_index(spark, monkeypatch):
    driver, train = os.getpid(), ann.train

    def elsewhere(*given):
        assert os.getpid() != driver
        return train(*given)

    monkeypatch.setattr(ann, "train", elsewhere)
    x = np.random.default_rng(8).standard_normal((60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.search(df, df.where("vec_id % 50 = 0")).count() == 10


def test_search_of_lists_of_several_blocks_and_rare_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "PROBED", 7)
    monkeypatch.setattr(ann, "CELLS", 50)
    r = np.random.default_rng(5)
    x = {i: r.standard_normal(3 if i % 50 == 1 or i == 100 else 8) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for q in ann.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found[q.query_id].append(q.vec_id)
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    hits = 0
    for q in range(0, 400, 50):
        best = sorted((i for i in x if i != q and len(x[i]) == len(x[q])), key=lambda i: -cosine(x[i], x[q]))[:5]
        assert len(found[q]) == 5
        hits += len(set(best) & set(found[q]))
    assert hits >= 38
    monkeypatch.setattr(ann, "SAMPLE_VALUES", 1)  # no length is in the sample
    few = ann.search(df, df.where("vec_id % 50 = 0")).groupBy("query_id").count().collect()
    assert [x["count"] for x in few] == [5] * 8


# --- 6, 7


def test_shards(docs, rows, odd, empty):
    found = sharding.shard_by_bytes(docs, 8).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in found:
        sizes[r.shard] += r["size"]
    largest = max(r["size"] for r in found)
    mean = sum(sizes.values()) / 8
    assert all(abs(v - mean) <= largest for v in sizes.values())
    for k in sizes:
        assert sorted(r.slot for r in found if r.shard == k) == list(range(sum(r.shard == k for r in found)))
    assert sharding.shard_by_bytes(odd, 3).count() == 7
    assert sharding.shard_by_bytes(empty, 3).count() == 0


def brute_shards(rows, shards=8):
    """(doc_id, text) -> (doc_id, size, crc32, shard, slot), in order."""
    sized = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1, i) for i, t in rows))
    total, at, out, slots = sum(x[3] for x in sized), 0, [], Counter()
    for _, _, crc, size, i in sized:
        at += size
        shard = min(shards - 1, int((at - size / 2) * shards / total // 1))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return Counter(out)


def test_shards_match_prefix_sums(docs, rows, odd):
    for own, n in ((docs, 8), (odd, 3)):
        plain = [(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()]
        assert Counter(map(tuple, sharding.shard_by_bytes(own, n).collect())) == brute_shards(plain, n)


def brute_mix(rows):
    """(id, text, source) -> list of (id, size, taken, passes, position), water-filling and schedules by hand."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    targets, names = brute_targets(sizes), sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    out = []
    for k, source in enumerate(names):
        weight, want = (5, 2, 1)[k % 3], int(targets[source] + 0.5)
        a = 0.8 - (weight - 1) * 0.4
        own = sorted((int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:10], 16), i if i is not None else -(1 << 70), size(t), i) for i, t, s in rows if s == source)
        full, start = (want // sizes[source] if sizes[source] else 0), 0
        for _, _, n, i in own:
            last = min(max(want - full * sizes[source] - start, 0), n)
            taken = full * n + last
            done = start / want if want else 0
            t = done if abs(a) < 1e-9 else ((((1 - a) ** 2 + 4 * a * done) ** 0.5) - (1 - a)) / (2 * a)
            out.append((i, n, taken, full + (2 * last >= n), round(t, 9) if taken else None))
            start += n
    return Counter(out)


def test_mix_matches_brute_force(docs, rows, odd):
    for own in (docs, odd):
        plain = [(r.doc_id, r.text, r.source) for r in own.select("doc_id", "text", "source").collect()]
        found = mixing.mix_curriculum(own).collect()
        assert Counter((r.doc_id, r["size"], r.taken, r.passes, None if r.position is None else round(r.position, 9)) for r in found) == brute_mix(plain)


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[k] for k in open_)
        full = {k for k in open_ if level * w[k] > 2 * sizes[k]}
        if not full:
            return out | {k: level * w[k] for k in open_}
        for k in full:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def test_mix(docs, rows, odd, empty):
    found = mixing.mix_curriculum(docs).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    targets, taken = brute_targets(sizes), defaultdict(int)
    for r in found:
        assert r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[k] - targets[k]) <= 1 for k in targets)
    assert mixing.mix_curriculum(odd).count() == 7
    assert mixing.mix_curriculum(empty).count() == 0


# --- 9


def test_archives(spark):
    html = [None, "", "short", "x" * 99, "y" * 100, "y" * 100, "x" * 99, "zé" * 300, "zé" * 300, "HTTP/1.1 fake\r\n\r\nWARC/1.1" * 10, "y" * 100]
    pages = spark.createDataFrame([(i, None if i % 3 == 0 else f"http://h/{i} a", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, n int")
    found = {r.page_id: r for r in archives.round_trip(pages).collect()}
    assert len(found) == len(html)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = min(j for j, x in enumerate(html) if (x or "").encode() == raw)
        repeat = len(raw) >= 100 and first != i
        r = found[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if repeat else "response", first if repeat else None)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_archives_on_odd_rows(spark, monkeypatch):
    """Repeated and null ids, and digests on either side of the bound for a broadcast."""
    rows = [(i % 7 if i % 11 else None, ("p%d " % (i % 5 if i % 2 else i)) * 60) for i in range(120)] + [(500, "rest " * 40), (501, "rest " * 40)]
    pages = spark.createDataFrame([(i, "http://h/", h, "x") for i, h in rows], "page_id long, url string, html string, archive string").repartition(3)
    least = {}
    for i, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    for common in (1000, 10):
        monkeypatch.setattr(archives, "COMMON", common)
        found = archives.round_trip(pages).collect()
        assert Counter((r.page_id, r.payload_digest) for r in found) == Counter((i, hashlib.sha256(h.encode()).hexdigest()) for i, h in rows)
        assert len({r.record_id for r in found}) == len(rows)
        of = {hashlib.sha256(h.encode()).hexdigest(): k for h, k in least.items()}
        responses = Counter(r.payload_digest for r in found if r.record_type == "response" and r.page_id is not None)
        assert responses == Counter(of.keys())
        assert all(r.page_id == of[r.payload_digest] for r in found if r.record_type == "response" and r.page_id is not None)
        assert all(r.refers_to == of[r.payload_digest] for r in found if r.record_type == "revisit")
        assert all(r.record_type == "response" for r in found if r.page_id is None)


def test_arc_versions_and_cut_records():
    for version in (1, 2):
        head = archives.arc_head(version, "a.arc", "20200101000000")
        line = archives.arc_line(version, "http://x/", "20210203040506", "text/html", 5, 200, "a.arc", 0)
        plain = head + line + b"hello\n" + line + b"he"
        records = list(archives.arc_records(plain))
        assert [(n, h["url"], c) for n, h, c in records] == [(0, "http://x/", b"hello"), (1, "http://x/", b"he")]
    warc = archives.to_warc("a.arc", 0, records[0][1], b"hello", None)
    (fields, block), = archives.warc_records(warc)
    assert block == b"hello" and fields["warc-type"] == "resource" and fields["warc-date"] == "2021-02-03T04:05:06Z"
    assert base64.b32decode(fields["warc-payload-digest"][7:] + "====") == hashlib.sha256(b"hello").digest()


# --- pipeline


def brute_pipeline(rows, items):
    """(doc_id, text, source) after all stages, as the manifest: plain loops, texts all in memory."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # one of each group: rows equal in id and text are one
    unique = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    roots = brute_components(list(enumerate(r[1] for r in unique)), 80)
    rows = [r for k, r in enumerate(unique) if roots[k][2]]
    found = brute_contamination(list(enumerate(r[1] for r in rows)), items)
    clean = []
    for k, (i, t, s) in enumerate(rows):
        if found[k][2] < 2:
            if found[k][2]:
                own = brute_hits(t, items)
                spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
                edges = [(spots[a][0], spots[b - 1][1]) for a, b in own]
                t = "".join(t[x:y] for x, y in zip([0, *(e[1] for e in edges)], [*(e[0] for e in edges), len(t)], strict=True))
                if not t.strip():
                    continue
            clean.append((i, t, s))
    return clean


def brute_hits(text, items, window=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit = words(text), set()
    for _, t in items:
        x = words(t)
        n = min(window, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit |= set(range(b, b + n))
    out = []
    for p in sorted(hit):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return out


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key long, items int, passes int, row_key string, pass int, some int, clean_text string, first int, rows int, own int, c0 int, position double"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    words = ["ba", "do", "ki", "ru", "labo", "teri"]
    rows = [(i, " ".join(r.choice(words) + str(r.choice("abcdefgh")) for _ in range(60)), f"s{i % 3}") for i in range(60)]
    rows += [(60, rows[0][1], "s1"), (61, None, "s1"), (62, "123", "s1"), (63, rows[1][1] + " " + rows[2][1], "s0"), (64, rows[5][1], None), (None, rows[6][1], "s1"), (None, "only here " + rows[7][1][:90], None)]
    rows += [rows[8], (8, "another text of eight", "s2"), (65, " ".join(rows[1][1].split()[3:12]), "s0"), (66, "word " * 20_000, "s0")]
    items = [("p", " ".join(rows[1][1].split()[:20])), ("q", " ".join(rows[2][1].split()[5:30]))]
    spark.createDataFrame([(*x[:2], "xx", x[2], len(x[1] or ""), 1, 2, 3, "k", 4, 5, "c", 6, 7, 8, 9, 0.5) for x in rows], CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = brute_pipeline(rows, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:3]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == [f.split()[0] for f in CLASHING.split(", ")]
    kept = docs.collect()
    assert Counter((x.doc_id, x.text, x.source) for x in kept) == Counter(clean)
    assert all(x.n_chars == len(x.text) and (x.key, x.rows, x.row_key, x.position) == (1, 7, "k", 0.5) for x in kept)
    # mix: ids are unique but for 8 and null, whose texts have row keys; passes by hand with those keys
    keyed = {(x.doc_id, x.text): x.row_key for x in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key")).collect()}
    mixed = brute_mix([(keyed[i, t], t, s) for i, t, s in clean])
    passes = {k[0]: k[3] for k in mixed}
    repeated = [(i, t) for i, t, _ in clean for _ in range(passes[keyed[i, t]])]
    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32, x.shard, x.slot) for x in done) == brute_shards(repeated)


def test_pipeline_on_no_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_takes_near_copies_from_0_8(spark):
    import corpus_pipeline

    # texts of 100 shingles; a changed last word costs one, so k changed at the end share 100 - k of 100 + k
    rows, expected = [], {}
    for k, similar in ((8, True), (10, True), (11, True), (12, False), (14, False)):
        own = [f"t{k}w{j}" for j in range(104)]
        near = own[:-k] + [f"t{k}n{j}" for j in range(k)]
        rows += [(10 * k, " ".join(own), "aa", "s1"), (10 * k + 1, " ".join(near), "aa", "s1")]
        expected |= {10 * k: True, 10 * k + 1: not similar}
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, frame(spark, rows), "").collect()}
    assert kept == {i for i, stays in expected.items() if stays}
