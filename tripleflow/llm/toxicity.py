"""Toxicity scores of texts restored through a noisy channel.

Odd tokens (leetspeak, letters spaced out or repeated) become lattices of the
letters that each character may stand for; Viterbi decoding under a character
language model with the channel's costs gives the likeliest word or words. Words as
they are and restored words are then looked up among word and word-beginning features
that labelled documents tell apart.

The channel. A letter writes itself. A character of LEET writes one of its letters at
a cost, a wildcard any of a-z at a higher one. A gap (GAPS and wildcards) is passed
over or ends the word. A character equal to the one before it, gaps apart, may fall
away. Any other character ends the word. More than WILD_RUN wildcards in a row are an
ornament and count as one gap.

Decoding is exact: a state of the lattice is the longest ending of what is written
that the model knows as a context, and all states are kept. Tokens are decoded side by
side, a character a step. After four letters of which none repeats the one before it,
all paths are in one state, so long tokens are cut there without any effect.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import among, bounded, by_bytes, fold, release, stage, trim, uniform

COMMON = 2000  # the character model knows the words that one labelled row in so many has (12 rows at least)
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3
ORDER = 5
BACK = 0.92  # nats for each context that is given up
WILD_RUN = 4
LONG = 32  # tokens from here on are cut where all paths meet
BATCH_BYTES = 1_500_000
MEMO = 40_000  # tokens that a worker remembers
PATHS = 1_000_000  # characters that decoding holds before it drops those that no path leads back to
CHUNK = 1_000_000  # entries of the table of features that a step of the fit takes at once
OTHERS = 2
KNOWN_BITS = 1 << 24  # of the filter that keeps unlabelled texts out of the join with labels

# fixed values: what characters may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
WILD = "*#?%"
GAPS = " \t.-_~'\"`,:;/\\|+=^\u00ad\u200b\u200c\u200d\u2060\ufeff"
SWAP, WILD_SWAP, SKIP, COLLAPSE = 1.5, 2.5, 0.4, 0.6  # costs in nats

_AZ = np.arange(97, 123)
_EDGES = ".,;:!?()[]{}<>\"'`«»„“”…*_-–—/\\|#"
_JOINT = re.compile(r"[\W\d_]+")
_TWICE = re.compile(r"(.)\1", re.DOTALL)
_WIDE = re.compile(r"[ \t.\-_*~]{2,}")
_SPACED = re.compile(r"(?<![^\s.,;:!?])(?:[^\W_][ \t.\-_*~]+){3,}[^\W_](?![^\s.,;:!?])")
_PLAIN_GAPS = "".join(c for c in GAPS if c not in LEET)
_GAP_RUN = re.compile(f"[{re.escape(_PLAIN_GAPS)}]+")
_ORNAMENT = re.compile(f"[{re.escape(WILD)}]{{{WILD_RUN + 1},}}")
_END = re.compile(f"(?:[^\\W\\d_]|[{re.escape(''.join(LEET) + WILD + GAPS)}])+")


_ODD = re.compile(f"[{re.escape(''.join(LEET) + WILD + GAPS)}]|([^\\W\\d_])\\1")
_SWAPS = {ord(c): (np.array([ord(x) for x in s]), SWAP) for c, s in LEET.items()} | {ord(c): (_AZ, WILD_SWAP) for c in WILD}
_LETTER, _OVER, _PASSED, _SWAPPED = 0, 1, 2, 4
_KIND = np.zeros(0x110000, np.uint8)
_KIND[0] = _OVER
for _c in (32, *map(ord, WILD + "".join(c for c in GAPS if c in LEET))):
    _KIND[_c] |= _PASSED
for _c in _SWAPS:
    _KIND[_c] |= _SWAPPED


class CharModel:
    """Character model of words: counts of up to ORDER characters, backed off by a constant.

    Contexts are numbered; ``fail`` leads to the context without its first character.
    """

    def __init__(self, words: Counter):
        grams: Counter = Counter()
        for word, n in words.items():
            padded = "^" + word + "$"
            for i in range(1, len(padded)):
                for k in range(max(0, i - ORDER + 1), i + 1):
                    grams[padded[k : i + 1]] += n
        total = max(1, sum(n for g, n in grams.items() if len(g) == 1))
        starts: Counter = Counter()
        for g, n in grams.items():
            if len(g) > 1:
                starts[g[:-1]] += n
        starts[""], starts["^"] = total, max(1, starts["^"])
        names = sorted(starts, key=lambda g: (len(g), g))
        number = {g: i for i, g in enumerate(names)}
        self.start, self.size = number["^"], len(names)
        self.fail = np.array([number[g[1:]] for g in names], np.int32)
        self.floor = math.log(0.1 / total)
        self.end = np.full(self.size, self.floor, np.float32)
        self.az_log = np.full((self.size, 26), self.floor, np.float32)
        self.az_next = np.zeros((self.size, 26), np.int32)
        own: list[list[tuple[int, int, float, int]]] = [[] for _ in range(ORDER)]
        others = []
        for g, n in grams.items():
            after = g[1 - ORDER :]
            while after not in number:
                after = after[1:]
            row = (number[g[:-1]], ord(g[-1]), math.log(n / starts[g[:-1]]), number[after])
            if g[-1] == "$" or 97 <= row[1] <= 122:
                own[len(g) - 1].append(row)
            else:
                others.append(row)
        lengths = np.array([len(g) for g in names])
        for length in range(ORDER):
            at = np.flatnonzero(lengths == length)
            if length:
                f = self.fail[at]
                self.end[at], self.az_log[at], self.az_next[at] = self.end[f] - BACK, self.az_log[f] - BACK, self.az_next[f]
            for context, char, log, after in own[length]:
                if char == 36:
                    self.end[context] = log
                else:
                    self.az_log[context, char - 97], self.az_next[context, char - 97] = log, after
        others.sort()
        self.keys = np.array([c * 0x110000 + x for c, x, _, _ in others], np.int64)
        self.key_log = np.array([x[2] for x in others], np.float32)
        self.key_next = np.array([x[3] for x in others], np.int32)
        # value and choice of what a run of wildcards at the end of a token writes: -1 nothing, -2 the end of the word
        self.tails = [np.where(np.arange(self.size) == self.start, 0.0, self.end.astype(np.float64))]
        self.choices = [np.full(self.size, -1)]
        for _ in range(WILD_RUN):
            rest = self.tails[-1]
            every = np.column_stack((rest - SKIP, self.end - SKIP + rest[self.start], self.az_log - WILD_SWAP + rest[self.az_next]))
            every[self.start, 1] = -np.inf
            self.choices.append(every.argmax(axis=1) - 2)
            self.choices[-1] = np.where(self.choices[-1] < 0, -3 - self.choices[-1], self.choices[-1])
            self.tails.append(every.max(axis=1))

    def write(self, nodes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of letters after contexts, and the contexts then."""
        az = (codes >= 97) & (codes <= 122)
        if az.all():
            return self.az_log[nodes, codes - 97], self.az_next[nodes, codes - 97]
        k = np.where(az, codes - 97, 0)
        log, after = self.az_log[nodes, k].astype(np.float64), self.az_next[nodes, k]
        left = np.flatnonzero(~az)
        log[left], after[left] = 0.0, 0
        at = nodes[left]
        for level in range(ORDER):
            if not len(left):
                break
            wanted = at.astype(np.int64) * 0x110000 + codes[left]
            place = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
            hit = self.keys[place] == wanted if len(self.keys) else np.zeros(len(left), bool)
            log[left[hit]] += self.key_log[place[hit]]
            after[left[hit]] = self.key_next[place[hit]]
            miss, root = ~hit, at == 0
            log[left[miss]] -= np.where(root[miss], -self.floor, BACK)
            left, at = left[miss & ~root], self.fail[at[miss & ~root]]
        return log, after

    def state(self, letters: str) -> int:
        node = np.zeros(1, np.int32)
        for c in letters:
            _, node = self.write(node, np.array([ord(c)]))
        return int(node[0])

    def decode(self, token: str) -> str:
        return self.decode_all([token])[0][1]

    def decode_all(self, tokens: list[str]) -> list[tuple[float, str]]:
        """The log probability of the likeliest path, and the words that it writes, for each token."""
        pieces: list[tuple[str, int, int, int, int]] = []  # characters, state before, wildcards behind, token, part
        for k, token in enumerate(tokens):
            for j, part in enumerate(_END.findall(token)):
                part = _GAP_RUN.sub(" ", _ORNAMENT.sub(" ", part))
                body = part.rstrip(WILD)
                tail, a, state = len(part) - len(body), 0, self.start
                for p in _meetings(body) if len(body) >= LONG else ():
                    pieces.append((body[a:p], state, -1, k, j))
                    a, state = p, self.state(body[p - ORDER + 1 : p])
                pieces.append((body[a:], state, tail, k, j))
        weights = [len(p[0]) * 27 ** min(3, sum(p[0].count(w) for w in WILD)) for p in pieces]
        found: list[tuple[float, str]] = [(0.0, "")] * len(pieces)
        order, a = sorted(range(len(pieces)), key=lambda i: (len(pieces[i][0]), weights[i])), 0
        while a < len(order):
            b, weight = a + 1, weights[order[a]]
            while b < len(order) and weight + weights[order[b]] <= 200_000:
                weight += weights[order[b]]
                b += 1
            for i, x in zip(order[a:b], self._side_by_side([pieces[i] for i in order[a:b]]), strict=True):
                found[i] = x
            a = b
        values, texts, last = [0.0] * len(tokens), [""] * len(tokens), [0] * len(tokens)
        for (_, _, _, k, j), (value, text) in zip(pieces, found, strict=True):
            values[k] += value
            texts[k] += (" " if j != last[k] else "") + text
            last[k] = j
        return [(v, " ".join(t.split())) for v, t in zip(values, texts, strict=True)]

    def _side_by_side(self, pieces: list[tuple[str, int, int, int, int]]) -> list[tuple[float, str]]:
        """Values and texts of ``pieces``, a character of all of them a step; a piece that has ended takes part no more."""
        sizes = np.array([len(p[0]) for p in pieces])
        starts = np.cumsum(sizes + 1) - sizes  # a zero stands before each piece
        codes = np.frombuffer(("\0" + "\0".join(p[0] for p in pieces)).encode("utf-32-le", "surrogatepass"), np.int32)
        # equal to the last character that is no gap; runs of plain gaps are one space by now
        twice = np.zeros(codes.shape, bool)
        twice[1:] = codes[1:] == codes[:-1]
        twice[2:] |= (codes[1:-1] == 32) & (codes[2:] == codes[:-2])
        twice &= (_KIND[codes] & (_OVER | _PASSED)) == 0
        tails = np.array([p[2] for p in pieces])
        tok, node, value = np.arange(len(pieces)), np.array([p[1] for p in pieces], np.int32), np.zeros(len(pieces))
        ends, totals = np.zeros(len(pieces), np.int64), np.zeros(len(pieces))
        ending, rows = {int(n) for n in sizes}, len(pieces)
        back = _Paths(len(pieces))
        for i in range(max(ending) + 1):
            live = None
            if i in ending:
                at = np.flatnonzero(sizes[tok] == i)
                total = value[at]
                for k in range(WILD_RUN + 1):
                    of = np.flatnonzero(tails[tok[at]] == k)
                    total[of] += self.tails[k][node[at[of]]]
                best = np.argsort(-total, kind="stable")
                best = best[np.argsort(tok[at[best]], kind="stable")]
                best = best[np.concatenate(([True], np.diff(tok[at[best]]) > 0))]
                won = at[best]
                ends[tok[won]], totals[tok[won]] = node[won], total[best]
                back.end(tok[won], won)
                live = np.flatnonzero(sizes[tok] > i)
                if not len(live):
                    break
                tok, node, value = tok[live], node[live], value[live]
                rows = int((sizes > i).sum())
            here = starts[tok] + i
            c = codes[here]
            kind = _KIND[c]
            parents, nodes, values, written = [], [], [], []

            def offer(at: np.ndarray, to: np.ndarray, v: np.ndarray, w: np.ndarray, out: tuple = (parents, nodes, values, written)) -> None:
                for x, y in zip(out, (at, to, v, w), strict=True):
                    x.append(y)

            at = np.flatnonzero(kind == _LETTER)
            log, to = self.write(node[at], c[at])
            offer(at, to, value[at] + log, c[at])
            if len(at) < len(tok):
                at = np.flatnonzero(kind & _PASSED)
                offer(at, node[at], value[at] - SKIP, np.zeros(len(at), np.int32))
                at = at[node[at] != self.start]
                offer(at, np.full(len(at), self.start, np.int32), value[at] - SKIP + self.end[node[at]], np.full(len(at), 32, np.int32))
                swapped = np.flatnonzero(kind & _SWAPPED)
                for char in np.unique(c[swapped]).tolist():
                    letters, cost = _SWAPS[char]
                    at = swapped[c[swapped] == char]
                    log, to = self.az_log[node[at]][:, letters - 97], self.az_next[node[at]][:, letters - 97]
                    offer(np.repeat(at, len(letters)), to.ravel(), (value[at][:, None] - cost + log).ravel(), np.tile(letters, len(at)).astype(np.int32))
            at = np.flatnonzero(twice[here])
            offer(at, node[at], value[at] - COLLAPSE, np.zeros(len(at), np.int32))
            parent, to, v, w = (np.concatenate(x) for x in (parents, nodes, values, written))
            own = tok[parent]
            best = np.arange(len(parent))
            if len(parent) > rows:
                # of the paths that meet in a state of a token the likeliest goes on
                several = (np.bincount(own) > 1)[own]
                many = np.flatnonzero(several)
                key = own[many].astype(np.int64) * self.size + to[many]
                by_key = np.argsort(key, kind="stable")
                many, key = many[by_key], key[by_key]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                most = np.repeat(np.maximum.reduceat(v[many], first), np.diff(np.append(first, len(many))))
                at = np.flatnonzero(v[many] == most)
                at = at[np.concatenate(([True], key[at][1:] != key[at][:-1]))]
                best = np.concatenate((best[~several], many[at]))
            parent = parent[best]
            tok, node, value = tok[parent], to[best], v[best]
            back.step(parent if live is None else live[parent], w[best])
        # the texts, a newline before each
        out = np.zeros(len(codes), "<i4")
        out[starts - 1] = 10
        for i, (at, chars) in enumerate(back.read(), 1):
            out[starts[at] + sizes[at] - i] = chars
        texts = out[out > 0].tobytes().decode("utf-32-le", "surrogatepass").split("\n")[1:]
        for i in np.flatnonzero(tails).tolist():
            n = int(ends[i])
            for k in range(pieces[i][2], 0, -1):
                choice = int(self.choices[k][n])
                if choice >= 0:
                    texts[i], n = texts[i] + chr(97 + choice), int(self.az_next[n, choice])
                elif choice == -2:
                    texts[i], n = texts[i] + " ", self.start
        return list(zip(totals.tolist(), texts, strict=True))


class _Paths:
    """What paths have written: each character once, and the place of the one before it.

    Characters that no path leads back to are dropped now and then. Paths soon have their
    beginnings in common, so what is held hardly grows with their number times the
    length of a token.
    """

    def __init__(self, paths: int):
        self.last, self.ended = np.full(paths, -1, np.int32), np.full(paths, -1, np.int32)  # by path, by token; -1 for nothing
        self.before: list[np.ndarray] = []
        self.chars: list[np.ndarray] = []
        self.held, self.most = 0, PATHS

    def end(self, tokens: np.ndarray, paths: np.ndarray) -> None:
        self.ended[tokens] = self.last[paths]

    def step(self, parent: np.ndarray, written: np.ndarray) -> None:
        self.last = self.last[parent]
        at = np.flatnonzero(written)
        self.before.append(self.last[at])
        self.chars.append(written[at])
        self.last[at] = np.arange(self.held, self.held + len(at))
        self.held += len(at)
        if self.held > self.most:
            self._sweep()
            self.most = max(PATHS, 2 * self.held)

    def _sweep(self) -> None:
        used = np.zeros(self.held + 1, bool)  # the last entry takes the -1
        used[self.last] = used[self.ended] = True
        a = self.held
        for before in reversed(self.before):
            b, a = a, a - len(before)
            used[before[used[a:b]]] = True
        place = np.append(np.cumsum(used[:-1], dtype=np.int32) - 1, np.int32(-1))
        kept, a = [], 0
        for before, chars in zip(self.before, self.chars, strict=True):
            own = used[a : a + len(before)]
            a += len(before)
            if own.any():
                kept.append((place[before[own]], chars[own]))
        self.before, self.chars = [x for x, _ in kept], [x for _, x in kept]
        self.last, self.ended, self.held = place[self.last], place[self.ended], int(used[:-1].sum())

    def read(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tokens and the characters that they write, from the last of each to the first."""
        tokens = np.flatnonzero(self.ended >= 0)
        if len(tokens):
            before, chars, at = np.concatenate(self.before), np.concatenate(self.chars), self.ended[tokens]
        while len(tokens):
            yield tokens, chars[at]
            at = before[at]
            tokens, at = tokens[at >= 0], at[at >= 0]


def _meetings(body: str) -> list[int]:
    """Places at least LONG / 2 apart before which stand four letters none of which repeats its forerunner; nor does what follows."""
    out, run, last = [], 0, 0
    for p in range(1, len(body)):
        run = (run + 1 if body[p - 1].isalpha() and (p < 2 or body[p - 1] != body[p - 2]) else int(body[p - 1].isalpha()))
        if run >= ORDER - 1 and body[p] != body[p - 1] and p - last >= LONG // 2:
            out.append(p)
            last = p
    return out


def _decodable(s: str) -> bool:
    letters = sum(c.isalpha() for c in s)
    return letters >= 2 or letters > 0 and len(s) >= 4


def plain_words(text: str) -> set[str]:
    """The plain words of ``words_and_odd``."""
    words = set()
    for t in set(text.lower().split()):
        if t.isalpha():
            words.add(t)
            continue
        s = t.strip(_EDGES)
        if s.isalpha():
            words.add(s)
        elif s and _decodable(s):
            words.update(p for p in _JOINT.split(s) if p)
    return words


def words_and_odd(text: str) -> tuple[set[str], set[str]]:
    """Plain words of a text, and tokens that may be disguised ones; a-z case is dropped."""
    low = text.lower()
    words, odd = set(), set()
    for t in set(low.split()):
        if t.isalpha():
            words.add(t)
            if _TWICE.search(t):
                odd.add(t)
            continue
        s = t.strip(_EDGES)
        if s.isalpha():
            words.add(s)
            if t != s and ("*" in t or "!" in t[:-1] or "#" in t):
                odd.add(t)
            elif _TWICE.search(s):
                odd.add(s)
        elif s and _decodable(s):
            if _ODD.search(s):
                odd.add(t if "*" in t or "#" in t else s)
            words.update(p for p in _JOINT.split(s) if p)
    for m in _SPACED.finditer(low):
        odd.add(m.group())
        # a wider gap may part words
        odd.update(part for part in _WIDE.split(m.group()) if part != m.group() and _decodable(part))
    return words, odd


class Scorer:
    """Weights of word and word-beginning features, and the restoring model."""

    def __init__(self, weights: dict[str, float], bias: float, model: CharModel):
        self.bias, self.model = bias, model
        self.words = {k[1:]: v for k, v in weights.items() if k[0] == "w"}
        self.starts = {n: {k[1:]: v for k, v in weights.items() if k[0] == "p" and len(k) == n + 1} for n in PREFIXES}
        self.memo: dict[str, list[str]] = {}
        self.heads = {k[1:4] for k in weights}  # no other word has a weight

    def restore(self, tokens: set[str]) -> None:
        """Decode ``tokens`` that the memo doesn't hold."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = sorted(tokens - self.memo.keys())
        for token, (_, text) in zip(new, self.model.decode_all(new), strict=True):
            self.memo[token] = text.split(" ")

    def score(self, text: str | None) -> float:
        return self.score_all([text])[0]

    def score_all(self, texts: list[str | None]) -> list[float]:
        read = [(self._known(words), odd) for words, odd in (words_and_odd(t or "") for t in texts)]
        self.restore({token for _, odd in read for token in odd})
        return [self._score(words, odd) for words, odd in read]

    def _known(self, words: Iterable[str]) -> set[str]:
        return {w for w in words if w[:3] in self.heads}

    def _score(self, words: set[str], odd: set[str]) -> float:
        words = words | self._known(w for token in odd for w in self.memo[token] if len(w) > 1)
        # sorted: the same sum on every run
        total = self.bias + sum(self.words[w] for w in sorted(self.words.keys() & words))
        for n, known in self.starts.items():
            if known:
                total += sum(known[p] for p in sorted(known.keys() & {w[:n] for w in words}))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, total))))


def choose(counts: list[tuple[str, int, int]], n0: int, n1: int) -> list[str]:
    """Features worth a weight: at least 4 labelled documents, and mostly those."""
    rate, out = max(n1 / max(1, n0 + n1), 1e-9), []
    for feature, a, b in counts:  # a documents without, b with the label
        share = b / (a + b)
        if b >= 4 and share >= 0.5 and share > rate:
            out.append((-b * math.log(share / rate), feature))
    return [f for _, f in sorted(out)]


def logistic(column: np.ndarray, sizes: np.ndarray, n0: np.ndarray, n1: np.ndarray, features: int, penalty: float = 1.5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of at least 0 and a bias: logistic regression with an L1 penalty, by accelerated proximal steps.

    A row has ``sizes`` features, one row's after the other's in ``column``, and stands
    for n0 documents without and n1 with the label.
    """
    rows, total, marked = len(sizes), float(n0.sum() + n1.sum()), float(n1.sum())
    n0, n1 = n0.astype(np.float64), n1.astype(np.float64)
    column, owner = column.astype(np.int32, copy=False), np.repeat(np.arange(rows, dtype=np.int32), sizes)
    cuts = [slice(a, a + CHUNK) for a in range(0, len(column), CHUNK)]

    def by_feature(of_row: np.ndarray) -> np.ndarray:
        out = np.zeros(features)
        for c in cuts:
            out += np.bincount(column[c], of_row[owner[c]], minlength=features)
        return out

    def by_row(of_feature: np.ndarray) -> np.ndarray:
        out = np.zeros(rows)
        for c in cuts:
            own, first = owner[c], int(owner[c.start])
            part = np.bincount(own - first, of_feature[column[c]])
            out[first : first + len(part)] += part
        return out

    w, z, bias, t = np.zeros(features), np.zeros(features), float(np.log((marked + 0.5) / (total - marked + 0.5))), 1.0
    most = int(sizes.max(initial=1)) + 1
    reach = by_feature(n0 + n1) * most / 4 + 1e-9  # a bound on the curvature, feature by feature
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(by_row(z) + bias, -40, 40)))
        off = n0 * p - n1 * (1 - p)
        new = np.maximum(0.0, z - (by_feature(off) + penalty) / reach)
        bias -= float(off.sum() / (total * most / 4 + 1e-9))
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w, bias


def features_of(words: set[str]) -> set[str]:
    """A word's features begin with ``w`` and ``p``: itself, and its beginnings."""
    out = {"w" + w for w in words}
    for n in PREFIXES:
        out.update("p" + h for h in {w[:n] for w in words if len(w) > n})
    return out


def among_these(words: list[str], heads: set[str], wanted: set[str] | dict[str, int]) -> set[str]:
    """The features of ``words`` that are ``wanted``, whose first three letters are ``heads``."""
    return {f for f in features_of({w for w in words if w[:3] in heads}) if f in wanted}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Scorer:
    """Fit on all labelled documents out of the held-out fold.

    Words are counted in all of them. Beginnings of words are counted in those with the
    label and in about OTHERS times as many without: what is there commoner without than
    with it can't be chosen, and only the others are counted in the rest too.

    To the driver come the counts of features that may mark the label and of common
    words, and each set of chosen features that documents have, with the number of
    those documents, four bytes a feature.
    """
    spark = docs.sparkSession
    known = labels.where((fold("doc_id") != 2) & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = stage(known.groupBy("doc_id").agg(F.max("y").alias("y")), "tox-known")
    marked = known.where("y = 1").count()
    early = (F.col("y") == 1) | (uniform(F.col("doc_id"), F.lit("toxicity")) < OTHERS * marked / max(1, known.count() - marked))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            words = [" ".join(plain_words(text or "")) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], names=["doc_id", "words"])
        trim()

    picked = docs.where(fold("doc_id") != 2).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(among(known, "doc_id", KNOWN_BITS)(F.col("doc_id")))
    pairs = picked.mapInArrow(words_of, "doc_id long, words string").join(known, "doc_id")
    pairs = stage(pairs.select((F.col("y") == 1).cast("int").alias("y"), early.alias("early"), "words"), "tox-train")
    n, n1 = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[f] for f in names], pa.int64()) for s in seen]], names=["feature", "n0", "n1"])
            for s in seen:
                s.clear()
            return out

        for batch in batches:
            for y, whole, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = set(words.split())
                seen[y].update(features_of(own) if whole else ["w" + w for w in own])
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()
        trim()

    counts = pairs.mapInArrow(features, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    common = (F.substring("feature", 1, 1) == "w") & (F.col("n0") + F.col("n1") >= max(12, n // COMMON))
    own = {r["feature"]: (r["n0"], r["n1"]) for r in counts.where(((F.col("n1") >= 4) & (F.col("n1") >= F.col("n0"))) | common).collect()}
    begun = spark.sparkContext.broadcast({f for f, (a, b) in own.items() if f[0] == "p" and b >= 4 and b >= a})

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, heads = Counter(), {f[1:4] for f in begun.value}
        for batch in batches:
            for words in batch.column(0).to_pylist():
                seen.update(among_these(words.split(), heads, begun.value))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["feature", "n0"])

    if begun.value:
        for r in pairs.where("not early").select("words").mapInArrow(rest, "feature string, n0 long").groupBy("feature").agg(F.sum("n0").alias("n0")).collect():
            own[r["feature"]] = own[r["feature"]][0] + r["n0"], own[r["feature"]][1]
    size = n - n1, n1
    chosen = choose([(f, a, b) for f, (a, b) in own.items()], *size)
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(chosen)})

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {f[1:4] for f in number.value}
        for batch in batches:
            seen: Counter = Counter()
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                has = sorted(number.value[f] for f in among_these(words.split(), heads, number.value))
                seen[np.array(has, "<i4").tobytes(), y] += 1
            sets = list({has for has, _ in seen})
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *(pa.array([seen[has, y] for has in sets], pa.int64()) for y in (0, 1))], names=["has", "n0", "n1"])
        trim()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(0).to_pylist()
            values = [b"".join(has), np.array([len(x) // 4 for x in has], np.int32).tobytes(), *(batch.column(k).to_numpy().astype(np.int64).tobytes() for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in values], names=["has", "size", "n0", "n1"])

    weights: dict[str, float] = {}
    bias = math.log((size[1] + 0.5) / (size[0] + 0.5)) if sum(size) else -3.0
    if chosen:
        sets = pairs.select("y", "words").mapInArrow(occurring, "has binary, n0 long, n1 long").groupBy("has").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        # sorted: the same sums on every run
        got = stage(sets, "tox-sets").orderBy("has").mapInArrow(packed, "has binary, size binary, n0 binary, n1 binary").collect()
        table = [np.frombuffer(b"".join(r[k] for r in got), kind) for k, kind in enumerate((np.int32, np.int32, np.int64, np.int64))]
        del got
        w, bias = logistic(*table, len(chosen))
        weights = {f: float(x) for f, x in zip(chosen, w, strict=True) if x > 0.05}
    release(pairs)
    words = Counter({f[1:]: a + b for f, (a, b) in own.items() if f[0] == "w"})
    # what marks the label is what disguises hide
    for f in weights:
        words[f[1:]] += max(200, n // 120) if f[0] == "w" else max(40, n // 600)
    return Scorer(weights, bias, CharModel(words))


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score_toxicity(docs: DataFrame, model: Scorer, id_col: str = "doc_id") -> DataFrame:
    """doc_id, score in [0, 1] of every whole text.

    Null, empty and wordless texts have the score of the bias, as have all if nothing
    was learned; repeated rows each give a row; an empty table gives an empty result; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in by_bytes(batches, 1, BATCH_BYTES):
            scores = own.score_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
        own.memo.clear()
        trim()

    return bounded(docs).select(F.col(id_col).cast("long"), "text").mapInArrow(run, _OUT)
