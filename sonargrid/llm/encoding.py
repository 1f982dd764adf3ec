"""Text garbled by a wrong character encoding, found and restored by a hidden Markov model.

One state is clean text, one is text that can't be had any more, and every other stands for a pair of encodings: text
was written in the first and read in the second. A state emits the characters that its inverse transform makes of the
text: a character that takes several to spell is one emission. Emissions are scored by counts of character pairs over all
cells, hashed into a table of fixed size, first of cells without suspect characters, then of the text as labelled
by a first pass. The most likely labelling gives the garbled spans; each gets its state's inverse transform.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonargrid.session import checkpoint, join_checked

# Fixed values: (state, written in, read in); "utf-8*2" went through the same mistake twice.
PAIRS = [
    ("utf8_cp1252", "utf-8", "cp1252"), ("utf8_latin1", "utf-8", "latin-1"), ("utf8_twice", "utf-8*2", "cp1252"), ("utf8_cp437", "utf-8", "cp437"),
    ("utf8_cp850", "utf-8", "cp850"), ("utf8_mac", "utf-8", "mac_roman"), ("utf8_cp1251", "utf-8", "cp1251"), ("utf8_cp1250", "utf-8", "cp1250"),
    ("cp1252_cp850", "cp1252", "cp850"), ("cp1252_cp437", "cp1252", "cp437"), ("cp1252_mac", "cp1252", "mac_roman"), ("cp1250_cp1252", "cp1250", "cp1252"),
    ("koi8r_cp1251", "koi8_r", "cp1251"), ("cp1251_cp1252", "cp1251", "cp1252"), ("cp932_cp1252", "cp932", "cp1252"),
]
#: Buckets of character pairs, and of single characters.
PAIR_BITS, ONE_BITS = 18, 16
LOST = "�"
_START = "\u0002"
#: Further costs: of a guessed character, of leaving the clean state for a pair that turns one character into one, and of restoring a character that clean text never has.
GUESS, SINGLE, UNSEEN = 2.0, 1.0, 12.0
_SINGLE = {name for name, source, _ in PAIRS if not source.startswith(("utf-8", "cp932"))}


@cache
def _bytes_of(codec: str) -> dict[str, int]:
    """{character: byte} of an 8-bit encoding; bytes that it leaves undefined stand for the control characters of that number."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


@cache
def _byte_table(codec: str) -> np.ndarray:
    """The byte of every code point below 2**16, -1 where there is none; a last entry for all others."""
    out = np.full((1 << 16) + 1, -1, np.int32)
    for c, b in _bytes_of(codec).items():
        out[ord(c)] = b
    return out


@cache
def _char_table(codec: str) -> np.ndarray:
    """The code point of every byte, -1 where there is none."""
    out = np.full(256, -1, np.int32)
    for b in range(256):
        try:
            out[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            pass
    return out


@cache
def _pair_table(codec: str) -> np.ndarray:
    """The code point of two bytes, the second from 0x40, that are one character; -1 where they aren't."""
    out = np.full(1 << 16, -1, np.int32)
    for b in range(0x80, 256):
        for c in range(0x40, 256):
            try:
                got = bytes([b, c]).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(got) == 1:
                out[b << 8 | c] = ord(got)
    return out


def _coded(points: np.ndarray, codec: str) -> np.ndarray:
    """Bytes of code points, -1 for none."""
    return _byte_table(codec)[np.where((points >= 0) & (points < 1 << 16), points, 1 << 16)]


def _decoded(b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length, code point) of the UTF-8 character at each of four arrays of successive bytes, -1 being none; length 0 where there is none."""
    b0, b1, b2, b3 = b
    tail = lambda x: (x >= 0x80) & (x <= 0xBF)
    two = (b0 >= 0xC2) & (b0 <= 0xDF) & tail(b1)
    three = (b0 >= 0xE0) & (b0 <= 0xEF) & tail(b1) & tail(b2) & ((b0 != 0xE0) | (b1 >= 0xA0)) & ((b0 != 0xED) | (b1 <= 0x9F))
    four = (b0 >= 0xF0) & (b0 <= 0xF4) & tail(b1) & tail(b2) & tail(b3) & ((b0 != 0xF0) | (b1 >= 0x90)) & ((b0 != 0xF4) | (b1 <= 0x8F))
    size = np.select([(b0 >= 0) & (b0 < 0x80), two, three, four], [1, 2, 3, 4], 0).astype(np.int8)
    low = lambda x: x & 0x3F
    char = np.select([size == 1, size == 2, size == 3, size == 4], [b0, (b0 & 0x1F) << 6 | low(b1), (b0 & 0x0F) << 12 | low(b1) << 6 | low(b2), (b0 & 0x07) << 18 | low(b1) << 12 | low(b2) << 6 | low(b3)], -1)
    return size, char.astype(np.int32)


def inverse(points: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """(length, code point) that the inverse transform of a pair reads at each place of texts, a row each, padded with -1; length 0 where it reads nothing."""
    n, width = points.shape
    codes = np.full((n, width + 3), -1, np.int32)
    codes[:, :width] = _coded(points, target)
    if source.startswith("utf-8"):
        size, char = _decoded([codes[:, k : k + width] for k in range(4)])
        if source == "utf-8":
            return size, char
        inner = np.full((n, width + 1), -1, np.int32)  # the byte that each character read once stands for
        inner[:, :width] = np.where(size > 0, _coded(char, target), -1)
        step = np.zeros((n, width + 1), np.int32)
        step[:, :width] = size
        at = np.broadcast_to(np.arange(width), (n, width))
        row = np.arange(n)[:, None]
        held, ends = [], []
        for _ in range(4):
            held.append(inner[row, at])
            at = at + step[row, at]
            ends.append(at)
        twice, char = _decoded(held)
        end = np.select([twice == k for k in (1, 2, 3, 4)], ends, 0)
        return np.where(twice > 0, end - np.arange(width), 0).astype(np.int8), char
    b = codes[:, :width]
    if source == "cp932":
        follow = codes[:, 1 : width + 1]
        both = (b >= 0x80) & (follow >= 0x40)
        char = np.where(both, _pair_table("cp932")[np.where(both, b << 8 | follow, 0)], np.where((b >= 0) & (b < 0x80), b, -1))
        return np.where(char < 0, 0, np.where(both, 2, 1)).astype(np.int8), char
    char = np.where(b >= 0, _char_table(source)[np.maximum(b, 0)], -1)
    return (char >= 0).astype(np.int8), char


@cache
def _candidates(lead: int, follow: int | None) -> tuple[str, ...]:
    """Characters whose UTF-8 has this first byte and otherwise bytes of 0x80 to 0x9f, which were dropped; ``follow`` is a last byte that is left."""
    low = range(0x80, 0xA0)
    tails = [[x] for x in low] if lead < 0xE0 else [[x, y] for x in low for y in ([follow] if follow else low)]
    return tuple(bytes([lead, *t]).decode("utf-8") for t in tails if (lead, t[0]) >= (0xE0, 0xA0) or lead != 0xE0)


def _dropped(text: str, i: int, codes: list, likely) -> tuple[int, str]:
    """The character at a first byte of UTF-8 whose control characters were dropped, or whose no-break space became a space; ``codes`` are this byte and what follows."""
    b = codes[0]
    follow = codes[1] if len(codes) > 1 else None
    if b == 0xC3 and follow == 0x20:
        return 2, "à"
    if follow is not None and follow > 0x7F and b >= 0xE0 and 0xA0 <= follow <= 0xBF:
        return 2, likely(_candidates(b, follow), text[i - 1 : i], text[i + 2 : i + 3])
    return 1, likely(_candidates(b, None), text[i - 1 : i], text[i + 1 : i + 2])


def _rows_of(texts: list[str]) -> np.ndarray:
    """Code points of texts, a row each, padded with -1."""
    lengths = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _pair_buckets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) * 0x9E3779B1 ^ b.astype(np.int64) * 0x85EBCA77) >> 7) & ((1 << PAIR_BITS) - 1)


#: Code points of texts that are labelled together, and longest character that a pair reads.
BATCH, REACH = 1 << 17, 16
#: An ASCII stretch in which no state but the clean one is worth its cost, and what of it is kept at each end.
_IDLE, _EDGE = re.compile(r"[\x00-\x7f]{600,}"), 250


class Labeller:
    """The model with its counts; ``labels`` finds the most likely states of texts, many at a time."""

    def __init__(self, pairs: np.ndarray, ones: np.ndarray, enter: float) -> None:
        self.pairs, self.ones, self.enter = pairs, ones, enter
        total = float(ones.sum()) + 0.1 * len(ones)
        self.one, self.smooth = (ones + 0.1) / total, ones + 2
        self.log_one = np.log(self.one)
        self.entry = np.array([enter + (SINGLE if name in _SINGLE else 0.0) for name, _, _ in PAIRS])
        self.guesses: dict[tuple, str] = {}

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Log likelihoods of code points b after a."""
        o = b & ((1 << ONE_BITS) - 1)
        return (np.log((self.pairs[_pair_buckets(a, b)] + 2 * self.one[o]) / self.smooth[a & ((1 << ONE_BITS) - 1)]) + self.log_one[o]) / 2

    def likely(self, candidates: tuple[str, ...], before: str, after: str) -> str:
        """The candidate that fits best between its neighbours, as far as these are ASCII."""
        key = (candidates, before if before.isascii() else "", after if after.isascii() else "")
        if key not in self.guesses:
            points = np.array([ord(c) for c in candidates])
            fit = self.scores(np.full(len(points), ord(key[1])), points) if key[1] else np.log(self.ones[points & ((1 << ONE_BITS) - 1)] + 0.1)
            if key[2]:
                fit = fit + self.scores(points, np.full(len(points), ord(key[2])))
            self.guesses[key] = candidates[int(fit.argmax())]
        return self.guesses[key]

    def _emissions(self, texts: list[str], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, code point, cost) by pair, text and place: what is read there, dropped bytes guessed, for pairs that read anything odd in the text."""
        shape = (len(PAIRS), *points.shape)
        size, char, guess = np.zeros(shape, np.int8), np.full(shape, -1, np.int32), np.zeros(shape, bool)
        for k, (_, source, target) in enumerate(PAIRS):
            size[k], char[k] = inverse(points, source, target)
            if source == "utf-8" and target in ("cp1252", "latin-1"):
                codes = _coded(points, target)
                for r, i in np.argwhere((size[k] == 0) & np.isin(codes, (0xC3, 0xC4, 0xC5, 0xD0, 0xD1, 0xE2, 0xE3))):
                    around = [None if c < 0 else int(c) for c in codes[r, i : min(i + 2, len(texts[r]))]]
                    got = _dropped(texts[r], i, around, self.likely)
                    size[k, r, i], char[k, r, i], guess[k, r, i] = got[0], ord(got[1]), True
        odd = (size > 1) | ((size > 0) & (points > 127))
        size[~odd.any(2)] = 0
        unseen = (char >= 0x80) & (self.ones[char & ((1 << ONE_BITS) - 1)] == 0)
        return size, char, 0.05 + GUESS * guess + UNSEEN * unseen

    def labels(self, texts: list[str]) -> list[list[tuple[int, int, str, str]]]:
        """[(start, end, state, restored)] of the garbled spans of each text, in order; LOST stands for what can't be restored."""
        out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
        parts = []
        for t, text in enumerate(texts):
            if text.isascii():
                continue
            at = 0
            for idle in [*_IDLE.finditer(text), None]:  # the model is clean throughout a long ASCII stretch
                end = len(text) if idle is None else idle.start() + _EDGE
                if not text[at:end].isascii():
                    parts.append((t, at, text[at:end]))
                at = len(text) if idle is None else idle.end() - _EDGE
        parts.sort(key=lambda p: len(p[2]), reverse=True)
        i = 0
        while i < len(parts):
            n = max(1, BATCH // len(parts[i][2]))
            for (t, at, _), spans in zip(parts[i : i + n], self._viterbi([p[2] for p in parts[i : i + n]])):
                out[t] += [(a + at, b + at, state, new) for a, b, state, new in spans]
            i += n
        return [sorted(x) for x in out]

    def label(self, text: str) -> list[tuple[int, int, str, str]]:
        return self.labels([text])[0]

    def _viterbi(self, texts: list[str]) -> list[list[tuple[int, int, str, str]]]:
        """Garbled spans of texts in order of falling length: all move on together, character by character.

        State 0 is clean, 1 lost, then come the pairs. Only what is reached is computed: clean states in full, others by lists of (state, text).
        A pair is entered only where it reads something odd: before that it reads what the clean state reads, for a cost.
        """
        points = _rows_of(texts)
        n, width = points.shape
        lengths = np.array([len(t) for t in texts])
        size, char, cost = self._emissions(texts, points)
        ks, rs, at = np.nonzero((size > 1) | ((size > 0) & (points > 127)))
        order = np.argsort(at, kind="stable")
        ks, rs, at = ks[order], rs[order], at[order]
        bounds = np.searchsorted(at, np.arange(width + 1))
        states = len(PAIRS) + 2
        best = np.full((REACH, states, n), -np.inf)
        last = np.zeros((REACH, states, n), np.int64)
        odd_path = np.zeros((REACH, states, n), bool)
        back = np.zeros((width + 1, states, n), np.int8)  # how far back, and the state there
        from_ = np.zeros((width + 1, states, n), np.int8)
        best[0, 0], last[0, 0] = 0.0, ord(_START)
        waiting: dict[int, list[np.ndarray]] = {}
        ends = np.zeros(n, np.int64)
        dirty = np.zeros(n, bool)
        active = np.searchsorted(-lengths, -np.arange(width + 1), side="left")  # texts longer than i come first

        def put(i: int, k: np.ndarray, r: np.ndarray, z: np.ndarray, v: np.ndarray, d: np.ndarray, q) -> None:
            slot = (i + z) % REACH
            old = best[slot, k, r]
            won = v > old
            if not won.any():
                return
            fresh = won & np.isneginf(old)
            for step in np.unique(z[fresh]):
                of = fresh & (z == step)
                waiting.setdefault(i + int(step), []).append(k[of] * n + r[of])
            q = np.broadcast_to(q, won.shape)
            k, r, z, slot = k[won], r[won], z[won], slot[won]
            best[slot, k, r], last[slot, k, r], odd_path[slot, k, r] = v[won], d[won], True
            back[i + z, k, r], from_[i + z, k, r] = z, q[won]

        for i in range(width + 1):
            slot, m = i % REACH, int(active[i])
            over = np.flatnonzero(lengths == i)
            if len(over):
                ends[over] = best[slot][:, over].argmax(0)
                dirty[over] = odd_path[slot, ends[over], over]
            if i == width:
                break
            c = points[:m, i]
            lost = c == ord(LOST)
            v = best[slot, 0, :m] + np.where(lost, -60.0, self.scores(last[slot, 0, :m], c))
            prev = np.zeros(m, np.int8)
            path = odd_path[slot, 0, :m].copy()
            here = np.concatenate(waiting.pop(i)) if i in waiting else None
            if here is not None:
                k, r = np.divmod(here, n)
                live = r < m
                k, r = k[live], r[live]
                w = best[slot, k, r] + np.where(lost[r], -60.0, self.scores(last[slot, k, r], c[r])) - 1.0
                rank = np.lexsort((-k, w))
                top = np.full(m, -np.inf)
                top[r[rank]] = w[rank]  # the greatest is put last, of equals that of the first pair
                of = np.zeros(m, np.int8)
                of[r[rank]] = k[rank]
                won = top > v
                v[won], prev[won], path[won] = top[won], of[won], True
            nxt = (i + 1) % REACH
            best[nxt, 0, :m], last[nxt, 0, :m], odd_path[nxt, 0, :m] = v, c, path
            back[i + 1, 0, :m], from_[i + 1, 0, :m] = 1, prev
            if lost.any():
                r = np.flatnonzero(lost)
                one = np.ones(len(r), np.int64)
                put(i, one, r, one, best[slot, 0, r] - 8.0, c[r], 0)
                put(i, one, r, one, best[slot, 1, r] - 1.0, c[r], 1)
            a, b = bounds[i], bounds[i + 1]
            if b > a:
                k, r = ks[a:b], rs[a:b]
                z, d = size[k, r, i].astype(np.int64), char[k, r, i].astype(np.int64)
                put(i, k + 2, r, z, best[slot, 0, r] + self.scores(last[slot, 0, r], d) - cost[k, r, i] - self.entry[k], d, 0)
            if here is not None:
                k, r = np.divmod(here, n)
                on = (r < m) & (k > 1)
                k, r = k[on] - 2, r[on]
                on = size[k, r, i] > 0
                k, r = k[on], r[on]
                if len(k):
                    z, d = size[k, r, i].astype(np.int64), char[k, r, i].astype(np.int64)
                    put(i, k + 2, r, z, best[slot, k + 2, r] + self.scores(last[slot, k + 2, r], d) - cost[k, r, i], d, k + 2)
            best[slot] = -np.inf
        return [self._spans(t, texts[t], int(ends[t]), back, from_, char) if dirty[t] else [] for t in range(n)]

    def _spans(self, t: int, text: str, k: int, back: np.ndarray, from_: np.ndarray, char: np.ndarray) -> list[tuple[int, int, str, str]]:
        steps, i = [], len(text)
        while i > 0:
            j, before = i - int(back[i, k, t]), int(from_[i, k, t])
            if k:
                steps.append((j, i, k, LOST if k == 1 else chr(char[k - 2, t, j])))
            i, k = j, before
        spans: list[list] = []
        for a, b, k, d in reversed(steps):
            if k > 1 and text[a:b] == d:
                continue
            name = "lost" if k == 1 else PAIRS[k - 2][0]
            if spans and spans[-1][1] == a and spans[-1][2] == name:
                spans[-1][1], spans[-1][3] = b, spans[-1][3] + d
            else:
                spans.append([a, b, name, d])
        return [tuple(x) for x in spans]


def restore(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text with its garbled spans replaced."""
    out, at = [], 0
    for a, b, _, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


_SUSPECT = re.compile(r"[\u0080-\u009f\ufffd]|(?<=[^\W\d_])[^\w\s\x00-\x7f](?=[^\W\d_])")


def suspects(texts: list[str], model: Labeller | None) -> list[bool]:
    """Control characters, symbols or capitals within words, and what could be several bytes of one (seen) character: not for first counts."""
    out = [not t.isascii() and bool(_SUSPECT.search(t.replace("’", "")) or any(a.islower() and b.isupper() and ord(b) > 127 for a, b in zip(t, t[1:]))) for t in texts]
    open_ = sorted((i for i, t in enumerate(texts) if not out[i] and not t.isascii()), key=lambda i: len(texts[i]), reverse=True)
    at = 0
    while at < len(open_):
        part = open_[at : at + max(1, BATCH // len(texts[open_[at]]))]
        points = _rows_of([texts[i] for i in part])
        found = np.zeros(len(part), bool)
        for _, source, target in PAIRS:
            if source == "utf-8":
                size, char = inverse(points, source, target)
                several = size > 1
                if model is not None:
                    several &= model.ones[char & ((1 << ONE_BITS) - 1)] > 0
                found |= several.any(1)
        for i, f in zip(part, found):
            out[i] = bool(f)
        at += len(part)
    return out


def _counted(texts: list[str], n: list[int], pairs: np.ndarray, ones: np.ndarray) -> None:
    """Add the weighted pairs and characters of texts; what follows a lost character starts anew."""
    lost, start = ord(LOST), ord(_START)
    points = np.frombuffer(_START.join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    weight = np.repeat(np.array(n, np.int64), [len(t) + 1 for t in texts])
    points[points == lost] = start
    begin = points == start
    keep = np.concatenate([[True], ~(begin[1:] & begin[:-1])]) if len(points) else begin
    points, weight, begin = points[keep], weight[keep], begin[keep]
    ones += np.bincount(points & ((1 << ONE_BITS) - 1), weight, 1 << ONE_BITS).astype(np.int64)
    follow = ~begin[1:]
    pairs += np.bincount(_pair_buckets(points[:-1], points[1:])[follow], weight[1:][follow], 1 << PAIR_BITS).astype(np.int64)


def _count_kernel(model, label: bool):
    """(text, n) -> (bucket, n): weighted counts of pairs, then of single characters, of clean or restored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << PAIR_BITS, np.int64)
        ones = np.zeros(1 << ONE_BITS, np.int64)
        for b in batches:
            texts, n = (c.to_pylist() for c in b.columns)
            if label:
                texts = [restore(t, spans) if spans else t for t, spans in zip(texts, model.value.labels(texts))]
            else:
                clean = [not s for s in suspects(texts, model and model.value)]
                texts, n = ([x for x, ok in zip(xs, clean) if ok] for xs in (texts, n))
            if texts:
                _counted(texts, n, pairs, ones)
        counts = np.concatenate([pairs, ones])
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    return run


def _label_kernel(model):
    """(text, ..) -> (text, spans) of garbled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = model.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("state", pa.string()), ("new", pa.string())]))
        for b in batches:
            texts = b.column(0).to_pylist()
            out = [(t, [dict(zip(("start", "stop", "state", "new"), s)) for s in spans]) for t, spans in zip(texts, labeller.labels(texts)) if spans]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], kind)], names=["plain", "spans"])

    return run


def fit(texts: DataFrame, rounds: tuple[float, ...] = (5.0, 5.5)):
    """A broadcast Labeller from distinct texts (plain, n), counted over all of them.

    First come counts of texts without anything suspect, then of texts without what could stand for a character seen so far;
    each of ``rounds``, the cost of leaving the clean state, labels with the counts before it, and all but the last count again.
    """
    context = texts.sparkSession.sparkContext
    model = None
    steps = [(False, 0.0), (False, rounds[0]), *((True, enter) for enter in rounds[1:])]
    for label, enter in steps:
        counts = texts.mapInArrow(_count_kernel(model, label), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
        got = counts.toPandas()  # at most 2**18 + 2**16 rows
        held = np.zeros((1 << PAIR_BITS) + (1 << ONE_BITS))
        held[got.bucket.to_numpy()] = got.n.to_numpy()
        model = context.broadcast(Labeller(held[: 1 << PAIR_BITS], held[1 << PAIR_BITS :], enter))
    return model


def garbled(cells: DataFrame, rounds: tuple[float, ...] = (5.0, 5.5)) -> DataFrame:
    """The columns of ``cells`` with text garbled in whole or part, and ``restored`` and ``spans``, the places, states and new texts.

    ``cells`` has a column ``text`` and any others but ``plain``, ``restored`` and ``spans``. Null and empty texts and pure ASCII are never
    garbled. U+FFFD in ``restored`` stands for what can't be had. Rows keep their number: a repeated row is repeated.
    Digits tell nothing of an encoding, so texts that differ in digits only are labelled once.
    """
    cells = cells.withColumn("plain", F.translate("text", "123456789", "000000000"))
    spark = cells.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # few bytes, much work: not to be coalesced
    texts = checkpoint(cells.where("plain <> ''").groupBy("plain").agg(F.count("*").alias("n")).repartition(parts, "plain"))
    model = fit(texts, rounds)
    found = checkpoint(texts.where(F.col("plain").rlike("[^\\x00-\\x7F]")).mapInArrow(_label_kernel(model), "plain string, spans array<struct<start:int,stop:int,state:string,new:string>>"))
    rows = join_checked(cells.where(F.col("plain").rlike("[^\\x00-\\x7F]")), found, ["plain"])
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    put = lambda acc, s: F.struct(F.concat(acc["kept"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), s["new"]).alias("kept"), s["stop"].alias("at"))
    restored = F.aggregate("spans", start, put, lambda acc: F.concat(acc["kept"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    return rows.withColumn("restored", restored).drop("plain")


def text_cells(metadata: DataFrame, markers: DataFrame) -> DataFrame:
    """(origin, rec_id, item_no, field, text), distinct: values of section INFO, and labels and texts of markers."""
    info = metadata.where("coalesce(is_section, false) = false AND size(path) > 0").where(F.upper(F.try_element_at("path", F.lit(-1))) == "INFO")
    parts = [
        info.select(F.lit("metadata").alias("origin"), "rec_id", F.col("ord").cast("int").alias("item_no"), F.lit("value").alias("field"), F.col("value").alias("text")),
        *(markers.select(F.lit("markers").alias("origin"), "rec_id", F.col("marker_id").cast("int").alias("item_no"), F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("label", "text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text IS NOT NULL").distinct()
