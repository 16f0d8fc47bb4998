"""Language identification by cross-parsing against suffix automata.

Each language's bounded training text becomes a suffix automaton. A document is
cut greedily into the longest pieces that occur in that text; related text needs
few pieces. The pieces are counted for many text segments at once, a character
a step: every segment is parsed as if a piece began with it, and then, segment after
segment, from the state in which the one before really ended until both parses are in
one state. So the count is that of one parse from end to end.

Transitions over the commonest letters are in a dense table, the others in a hash
table; every letter of the training texts has a symbol of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, by_bytes, fold, trim, uniform

TRAIN_CHARS = 24_000  # of each language: the bound on the sample that is fitted
TRAIN_DOCS = 120  # of each language: about so many whole texts the sample is taken from
SEGMENT = 1024
LANES = 4096
DENSE_CELLS = 6_000_000  # of all languages' dense tables together
BATCH_BYTES = 3_000_000


class SuffixAutomaton:
    """Transitions of the automaton of all substrings of ``codes`` (small ints)."""

    def __init__(self, codes: list[int]):
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in codes:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next = nxt

    def transitions(self) -> np.ndarray:
        """[transitions, 3]: state, symbol, state after."""
        rows = [(s, c, t) for s, row in enumerate(self.next) for c, t in sorted(row.items())]
        return np.array(rows, np.int64).reshape(-1, 3)


class Transitions:
    """state x symbol -> state or -1: a dense table for symbols below ``dense``, a hash table for the rest."""

    def __init__(self, rows: np.ndarray, states: int, width: int):
        self.dense = max(2, min(width, DENSE_CELLS // max(1, states)))
        self.flat = np.full(states * (self.dense + 1), -1, np.int32)  # the last column stands for all further symbols
        near = rows[:, 1] < self.dense
        self.flat[rows[near, 0] * (self.dense + 1) + rows[near, 1]] = rows[near, 2]
        far = rows[~near]
        self.far = width > self.dense
        self.mask = (1 << max(4, int(4 * len(far)).bit_length())) - 1
        self.keys, self.after = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        keys = far[:, 0] << 21 | far[:, 1]
        left = np.arange(len(far))
        place = self._hash(keys)
        while len(left):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[left[free]]  # of several for one place the last stays
            mine = self.keys[place] == keys[left]
            self.after[place[mine]] = far[left[mine], 2]
            left, place = left[~mine], (place[~mine] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Arrays of one shape."""
        if not self.far:
            return self.flat[state * (self.dense + 1) + symbol]
        new = self.flat[state * (self.dense + 1) + np.minimum(symbol, self.dense)]
        if (symbol >= self.dense).any():
            at = np.nonzero(np.broadcast_to(symbol >= self.dense, new.shape))
            if len(at[0]):
                keys = state[at].astype(np.int64) << 21 | np.broadcast_to(symbol, new.shape)[at]
                place, found, left = self._hash(keys), np.full(len(keys), -1, np.int32), np.arange(len(keys))
                while len(left):
                    there = self.keys[place]
                    hit = there == keys[left]
                    found[left[hit]] = self.after[place[hit]]
                    on = ~hit & (there >= 0)
                    left, place = left[on], (place[on] + 1) & self.mask
                new[at] = found
        return new


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """Code points to symbols: 0 parts words, 1 is any letter not seen in training, then the letters seen, the commonest first."""

    def __init__(self, seen: list[int]):
        self.seen = seen
        self.width = len(seen) + 2
        self._table: np.ndarray | None = None

    def table(self) -> np.ndarray:
        if self._table is None:
            t = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)
            t[np.array(self.seen, np.int64)] = np.arange(2, self.width)
            self._table = t
        return self._table

    def __getstate__(self) -> dict:
        return {"seen": self.seen, "width": self.width, "_table": None}

    def encode(self, text: str) -> np.ndarray:
        """Symbols with one 0 between words and at both ends."""
        codes = self.table()[codepoints(text)]
        codes = np.concatenate(([0], codes, [0])).astype(np.int32)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]


class CrossParser:
    """The fitted languages."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        counts: dict[int, int] = {}
        for own in texts.values():
            for t in own:
                for c, n in zip(*np.unique(codepoints(t), return_counts=True), strict=True):
                    if chr(int(c)).isalpha():
                        counts[int(c)] = counts.get(int(c), 0) + int(n)
        self.letters = Letters(sorted(counts, key=lambda c: (-counts[c], c)))
        rows, self.ref, roots, states = [], [], [], 0
        for lang in self.langs:
            codes = np.concatenate([np.zeros(1, np.int32), *[self.letters.encode(t) for t in texts[lang]]])
            automaton = SuffixAutomaton(codes.tolist())
            rows.append(automaton.transitions() + np.array([states, 0, states]))
            roots.append(states)
            states += len(automaton.next)
            self.ref.append(max(2, len(codes)))
        self.roots = np.array(roots, np.int32)
        self.step = Transitions(np.concatenate(rows) if rows else np.zeros((0, 3), np.int64), states, self.letters.width)

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """[documents, languages] number of pieces."""
        k, out = len(self.langs), np.zeros((len(docs), len(self.langs)), np.int64)
        if not k:
            return out
        flat = np.concatenate([*docs, np.zeros(1, np.int32)])
        begin = np.cumsum([0, *(len(d) for d in docs)])[:-1]
        cut = [(d, a) for d, x in enumerate(docs) for a in range(0, len(x), SEGMENT)]
        owner = np.array([c[0] for c in cut], np.int64)
        start = begin[owner] + np.array([c[1] for c in cut], np.int64) if cut else np.zeros(0, np.int64)
        sizes = np.array([min(SEGMENT, len(docs[d]) - a) for d, a in cut], np.int64)
        root = self.roots[:, None]
        symbols = np.arange(self.letters.width)
        fresh = self.step(np.repeat(root, len(symbols), axis=1), np.broadcast_to(symbols, (k, len(symbols))))
        fresh = np.where(fresh < 0, root, fresh)  # [language, symbol]: where a piece begins
        ends, left = np.zeros((k, len(cut)), np.int32), np.zeros((k, len(cut)), np.int32)  # pieces, state at the end
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), LANES):
            pick = order[at : at + LANES]
            n = sizes[pick]
            alive = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # lanes longer than the step
            state, count = np.repeat(root, len(pick), axis=1), np.zeros((k, len(pick)), np.int32)
            for step in range(int(n[0])):
                m = int(alive[step])
                c = flat[start[pick[:m]] + step]
                new = self.step(state[:, :m], c)
                stop = new < 0
                count[:, :m] += stop
                state[:, :m] = np.where(stop, fresh[:, c], new)
            ends[:, pick], left[:, pick] = count, state
        number = np.arange(len(cut)) - np.searchsorted(owner, owner)  # of the segment in its text
        for j in range(1, int(number.max(initial=0)) + 1):
            seg = np.flatnonzero(number == j)
            lang, lane = (x.ravel() for x in np.meshgrid(np.arange(k), seg, indexing="ij"))
            true, guess, step = left[lang, lane - 1], self.roots[lang], 0
            on = np.flatnonzero(true != guess)
            lang, lane, true, guess = lang[on], lane[on], true[on], guess[on]
            while len(lane):
                c = flat[start[lane] + step]
                for own, sign in ((true, 1), (guess, -1)):
                    new = self.step(own, c)
                    stop = new < 0
                    ends[lang[stop], lane[stop]] += sign  # lanes are there once
                    own[:] = np.where(stop, fresh[lang, c], new)
                step += 1
                over = (step >= sizes[lane]) & (true != guess)
                left[lang[over], lane[over]] = true[over]
                on = np.flatnonzero((true != guess) & ~over)
                lang, lane, true, guess = lang[on], lane[on], true[on], guess[on]
        for x in range(k):
            out[:, x] = np.bincount(owner, ends[x], minlength=len(docs)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.letters.encode(t or "") for t in texts]
        some = np.array([len(c) > 1 for c in codes], bool)  # a letter between two parts
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = (self.phrases(codes) + 1) * np.log2(np.array(self.ref, float))[None, :]  # bits: a piece is a pointer into the reference
        gap = cost - cost.min(axis=1, keepdims=True)
        sure = 1.0 / np.exp2(-np.minimum(gap / 8, 60)).sum(axis=1)
        best = cost.argmin(axis=1)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], [float(p) if s else 0.0 for p, s in zip(sure, some, strict=True)]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> CrossParser:
    """Fit on hash-chosen labelled documents of each language, whole texts of ``train_chars`` characters together at most.

    About ``train_docs`` texts of a language that are not longer than that reach the
    driver; a text that would exceed the bound is passed over for the next. A language
    that has only longer texts is fitted on its shortest. Rows without a language, and
    those of the held-out fold, are never used; null and empty texts teach nothing;
    repeated rows count as often as they are there; a table without labels gives a
    model that knows no language.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (fold("doc_id") != 2)).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    fits = F.length("text") <= train_chars
    rates = {r["lang"]: train_docs / max(1, r["n"]) for r in labelled.groupBy("lang").agg(F.sum(fits.cast("long")).alias("n")).collect()}  # a row per language
    if not rates:
        return CrossParser({})
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("lang"))
    chance = uniform(F.col("doc_id"), F.lit("language"))
    texts: dict[str, list[str]] = {}
    room = dict.fromkeys(rates, train_chars)
    sample = labelled.where(fits & (chance < rate)).select("lang", "text", chance.alias("chance"), "doc_id")
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["chance"], r["doc_id"] is None, r["doc_id"], r["text"])):
        if len(r["text"]) <= room[r["lang"]]:
            texts.setdefault(r["lang"], []).append(r["text"])
            room[r["lang"]] -= len(r["text"])
    # a rare language may have missed the sample by chance, or have longer texts only
    for lang in sorted(set(rates) - {k for k, v in texts.items() if any(map(str.strip, v))}):
        some = labelled.where((F.col("lang") == lang) & (F.trim("text") != "")).orderBy(F.length("text"), "text").limit(1)
        texts[lang] = [r["text"] for r in some.select("text").collect()]
    return CrossParser(texts)


def identify(docs: DataFrame, model: CrossParser, id_col: str = "doc_id") -> DataFrame:
    """Language and confidence of every whole text: doc_id, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything
    if nothing was learned; ties go to the first language by name; repeated rows each
    give a row; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in by_bytes(batches, 1, BATCH_BYTES):
            lang, score = own.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
        trim()

    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return bounded(docs).select(F.col(id_col).cast("long"), "text").mapInArrow(parse, out)


def identified(docs: DataFrame, model: CrossParser, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole and without a shuffle, whose text has a language (is not ``und``).

    Null texts and texts without a letter go, as does everything if nothing was
    learned; repeated rows stay as often as they are there; an empty table gives an
    empty result; all columns are kept, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def lang_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            whole = pa.RecordBatch.from_arrays([texts], names=["text"])
            yield pa.array([x for part in by_bytes(iter([whole]), 0, BATCH_BYTES) for x in shared.value.predict(part.column(0).to_pylist())[0]], pa.string())
        trim()

    return bounded(docs).where(lang_of(text_col) != "und")
