"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of one document; it recurs if its words also start anywhere else.

1. Anchors. Of the short word sequences in a window the one of least hash is its anchor, so equal windows
   have equal anchors. Anchors that occur once rule out all their windows; a Bloom filter of fixed size holds
   the rest. What it lets through in error is only looked at once more.
2. Recurring passages are confirmed. Documents are cut into stretches, runs of windows with one recurring anchor, whose
   words go to the anchor's shard; there two occurrences of a window are compared word by word. Confirmed windows that
   follow one another are kept as one passage: its windows are phrases.
3. Each shard compiles Aho-Corasick automata of its phrases, PHRASES in one at most, and the stretches of all documents are
   streamed through those that their anchors name. What they match are the places, and nothing else is.
4. Places go back to their documents, whose covered words are removed.

Shards follow the number of stretches. Windows of a hot anchor are confirmed in blocks by their own hashes, and its
stretches are dealt by document to several homes, each of which has its phrases.
"""

from __future__ import annotations

import hashlib
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import _summed_slices
from .textscan import Words, mix, released, sequence_mix, slices, text_array

WINDOW = 35
ANCHOR = 8
BLOOM_BITS = 26
SLICE_BITS = 6
SHARDS = BLOCKS = 2  # for each shuffle partition
STRETCHES = 50_000  # of a shard, about
PHRASES = 20_000  # of one automaton
HOT_LEAST = 1_024
HELD = 16 << 20  # bytes of stretches that a task packs at once
_FIRST_CHAR = 0xE000  # behind the surrogates: one character stands for one word of a phrase
MOST_WORDS = 0x10FFFF - _FIRST_CHAR  # of one automaton


def least_in(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive items."""
    n = len(x) - w + 1
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[w - width : w - width + n])


def window_starts(words: Words, window: int) -> np.ndarray:
    """Positions at which a whole window of one document starts."""
    length = np.diff(words.first)
    ok = np.zeros(len(words.start) + 1, np.int32)
    full = length >= window
    np.add.at(ok, words.first[:-1][full], 1)
    np.add.at(ok, words.first[:-1][full] + length[full] - window + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def chosen_anchors(h: np.ndarray, at: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor at each place that is the anchor of a window starting at one of at; several places if there is a tie."""
    g = sequence_mix(h, anchor)
    w = window - anchor + 1
    least = np.zeros(len(g) - w + 1 + 2 * (w - 1), np.uint64)
    least[w - 1 + at] = least_in(g, w)[at]
    return g[~least_in(~least, w) == g]


def _places(x: np.ndarray):
    """Bits of the filter, all three within the slice that the upper bits of the value's hash name."""
    h = mix(x + np.uint64(0x7F))
    bits = BLOOM_BITS - SLICE_BITS
    inside = (h >> np.uint64(64 - SLICE_BITS)) << np.uint64(bits)
    for shift in (0, 19, 38):
        yield (inside | ((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1))).astype(np.int64)


def _range_of(x: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many ranges of hashes a value is in: one range has bits in a few slices of the filter only."""
    return ((mix(x + np.uint64(0x7F)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _tally(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs, or the sum of its n."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    n = np.ones(len(h), np.int64) if n is None else n[order].astype(np.int64)
    return h[begin], np.add.reduceat(n, begin) if len(begin) else n


def _groups(key: np.ndarray):
    """(key, places of it) for each different key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    a = 0
    for b in (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist() + [len(key)] * (len(key) > 0):
        yield int(key[a]), order[a:b]
        a = b


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(np.array([x.nbytes for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays), 1)


def _unpack(raw: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    at = np.cumsum(np.concatenate(([8 * len(types)], np.frombuffer(raw, np.int64, len(types))))).tolist()
    return [np.frombuffer(raw[a:b], t) for a, b, t in zip(at, at[1:], types, strict=False)]


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges of data, joined."""
    first = np.cumsum(size) - size
    return data[np.repeat(start - first, size) + np.arange(int(size.sum()))]


class Stretches:
    """Words of many short texts that are given as joined bytes and their sizes."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data = data
        offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
        hs, starts, ends, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in slices(texts):
            words = Words(texts, i, j)
            hs.append(words.hashes())
            starts.append(words.start + offsets[i])
            ends.append(words.end + offsets[i])
            counts.append(np.diff(words.first))
        self.h, self.start, self.end, n = (np.concatenate(x) for x in (hs, starts, ends, counts))
        self.first = np.concatenate(([0], np.cumsum(n)))

    def windows(self, window: int) -> np.ndarray:
        """Words at which a window starts that lies in one text."""
        n = np.maximum(np.diff(self.first) - window + 1, 0)
        return np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Anchors:
    """Recurring anchors as a Bloom filter, and how stretches are dealt by them.

    An anchor that holds more than a shard's share of all stretches is hot: the places it occurs at are dealt over as many homes as it
    fills, each of which gets its phrases.
    """

    def __init__(self, bits: np.ndarray, total: int, hot: np.ndarray, count: np.ndarray, parts: int):
        self.bits = bits
        self.shards = max(SHARDS * parts, total // STRETCHES)
        order = np.argsort(hot)
        self.hot = hot[order]
        self.salts = 1 + count[order] * self.shards // max(total, 1)
        self.base = self.shards + np.cumsum(self.salts) - self.salts

    def recur(self, anchor: np.ndarray) -> np.ndarray:
        there = np.ones(len(anchor), bool)
        for k in _places(anchor):
            there &= (self.bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
        return there

    def rank(self, anchor: np.ndarray) -> np.ndarray:
        """Place among the hot anchors, or -1."""
        if not len(self.hot):
            return np.full(len(anchor), -1)
        at = np.minimum(np.searchsorted(self.hot, anchor), len(self.hot) - 1)
        return np.where(self.hot[at] == anchor, at, -1)

    def shard(self, x: np.ndarray) -> np.ndarray:
        return (mix(x ^ np.uint64(0x51ED)) % np.uint64(self.shards)).astype(np.int64)


def _recurring_anchors(spark: SparkSession, docs: DataFrame, window: int, anchor: int, parts: int, hot_least: int):
    """The anchors that occur more than once, broadcast: a Bloom filter of fixed size, and 16 hot ones for each block at most."""

    def deal(batches):
        for batch in batches:
            texts = text_array(batch.column(0))
            held: list[np.ndarray] = []
            for i, j in slices(texts):
                words = Words(texts, i, j)
                at = window_starts(words, window)
                if len(at):
                    held.append(chosen_anchors(words.hashes(), at, window, anchor))
            if held:
                h, n = _tally(np.concatenate(held))
                out = [(k, h[at].tobytes(), n[at].astype(np.int32).tobytes()) for k, at in _groups(_range_of(h, BLOCKS * parts))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "h", "n"])

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for block, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(block, []).append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.int32)))
        bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        out = []
        for block, found in held.items():
            h, n = _tally(*(np.concatenate(x) for x in zip(*found, strict=True)))
            for k in _places(h[n > 1]):
                np.bitwise_or.at(bits, k >> 3, np.uint8(1) << (k & 7).astype(np.uint8))
            hot = (n >= hot_least) & (n * 16 > n.sum())
            out.append(((1 << SLICE_BITS) + block, np.concatenate(([n.sum()], h[hot].view(np.int64), n[hot])).astype(np.int64).tobytes()))
        size = len(bits) >> SLICE_BITS
        out += [(k, x.tobytes()) for k, x in enumerate(bits.reshape(-1, size)) if x.any()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([zlib.compress(x, 1) for _, x in out], pa.binary())], names=["slice", "raw"])

    rows = docs.select("text").mapInArrow(released(deal), "block int, h binary, n binary").repartition(parts, "block").mapInArrow(released(meet), "slice int, raw binary")
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    size = len(bits) >> SLICE_BITS
    total, hot, count = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, x in _summed_slices(rows, min(parts, 1 << SLICE_BITS), "bits"):
        if k < 1 << SLICE_BITS:
            bits[k * size : (k + 1) * size] = x
        else:
            x = np.frombuffer(x.tobytes(), np.int64)
            total += int(x[0])
            hot.append(x[1 : 1 + len(x) // 2])
            count.append(x[1 + len(x) // 2 :])
    return spark.sparkContext.broadcast(Anchors(bits, total, np.concatenate(hot).view(np.uint64), np.concatenate(count), parts))


def _stretches(words: Words, anchors: Anchors, window: int, anchor: int, split_hot: bool):
    """Runs of windows with one recurring anchor: (anchor, hash of the first window, first word, first byte, bytes); with split_hot each window of a hot anchor for itself."""
    at = window_starts(words, window)
    if not len(at):
        return None
    h = words.hashes()
    least = least_in(sequence_mix(h, anchor), window - anchor + 1)[at]
    there = anchors.recur(least)
    at, least = at[there], least[there]
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    if split_hot:
        new |= anchors.rank(least) >= 0
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    first, last = at[begin], at[end] + window - 1
    return least[begin], sequence_mix(h, window)[first], first, words.start[first], words.end[last] - words.start[first]


def _confirmed(data: np.ndarray, size: np.ndarray, more: np.ndarray, window: int):
    """(text, first byte, bytes) of the passages all of whose windows occur twice in the texts, compared word by word, or in one that counts more than once."""
    found = Stretches(data, size)
    at = found.windows(window)
    if not len(at):
        return [np.zeros(0, np.int64)] * 3
    row = np.searchsorted(found.first, at, side="right") - 1
    order = np.argsort(sequence_mix(found.h, window)[at], kind="stable")
    place, sums = at[order], sequence_mix(found.h, window)[at][order]
    same = sums[1:] == sums[:-1]
    pair = np.flatnonzero(same)
    for k in range(window):
        pair = pair[found.h[place[pair] + k] == found.h[place[pair + 1] + k]]
    twice = more[row[order]]
    twice[pair] = twice[pair + 1] = True
    first = np.ones(len(order), bool)
    first[pair + 1] = False  # of equal windows the first text's stands for all
    # a window is confirmed if any of those that it stands for is
    lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    sure = np.zeros(len(order), bool)
    sure[lead[twice]] = True
    chosen = np.sort(order[sure & first])
    if not len(chosen):
        return [np.zeros(0, np.int64)] * 3
    w, r = at[chosen], row[chosen]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(w)) - 1
    start = found.start[w[begin]]
    return r[begin], start, found.end[w[end] + window - 1] - start


def _phrases(docs: DataFrame, dealt_by, window: int, anchor: int, parts: int) -> DataFrame:
    """(home, raw): confirmed passages, of which all windows are phrases, for each home of their anchors.

    Equal stretches of a batch travel as one that counts more than once.
    """

    def deal(batches):
        anchors = dealt_by.value
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            keys = list(held)
            block, home, sub, more = (np.array(x) for x in zip(*held.values(), strict=True))
            out = []
            for k, at in _groups(block):
                texts = [keys[i] for i in at.tolist()]
                raw = _pack(np.array([len(x) for x in texts], np.int32), home[at].astype(np.int32), sub[at].astype(np.uint16), more[at].astype(bool), np.frombuffer(b"".join(texts), np.uint8))
                out.append((k, raw))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "raw"])

        for batch in batches:
            texts = text_array(batch.column(0))
            for i, j in slices(texts):
                words = Words(texts, i, j)
                found = _stretches(words, anchors, window, anchor, True)
                if found is None:
                    continue
                least, window_hash, _, start, length = found
                rank = anchors.rank(least)
                hot = rank >= 0
                home = anchors.shard(least)
                home[hot] = anchors.base[rank[hot]] if hot.any() else 0
                block = np.where(hot, anchors.shards + anchors.shard(window_hash), home)
                raw = words.data.tobytes()
                for s, n, *where in zip(start.tolist(), length.tolist(), block.tolist(), home.tolist(), _sub(least).tolist(), strict=True):
                    x = raw[s : s + n]
                    if x in held:
                        held[x][3] = True
                    else:
                        held[x] = [*where, False]
                        size += n
                if size > HELD:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def meet(batches):
        anchors = dealt_by.value

        def confirmed(found):
            size, home, sub, more, data = (np.concatenate(x) for x in zip(*found, strict=True))
            text, start, length = _confirmed(data, size, more, window)
            out = []
            for k, at in _groups(home[text]):
                raw = _pack(length[at].astype(np.int32), sub[text[at]], _cut(data, start[at], length[at]))
                hot = k >= anchors.shards
                out += [(k + salt, raw) for salt in range(int(anchors.salts[np.searchsorted(anchors.base, k)]) if hot else 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["home", "raw"])

        block, found = None, []
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != block and found:
                    yield from confirmed(found)
                    found = []
                block = k
                found.append(_unpack(raw, np.int32, np.int32, np.uint16, bool, np.uint8))
        if found:
            yield from confirmed(found)

    dealt = docs.select("text").mapInArrow(released(deal), "block int, raw binary")
    return dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(released(meet), "home int, raw binary")


def _sub(anchor: np.ndarray) -> np.ndarray:
    return (mix(anchor) >> np.uint64(48)).astype(np.uint16)


def _located(docs: DataFrame, phrases: DataFrame, dealt_by, window: int, anchor: int, parts: int) -> DataFrame:
    """(k1, k2, spans): all documents' stretches streamed through the automata of their anchors' homes; words that matches cover."""

    def deal(batches):
        anchors = dealt_by.value
        held: list[tuple] = []
        size = 0

        def flush():
            home, sub, k1, k2, first, length = (np.concatenate(x) for x in list(zip(*held, strict=True))[:6])
            data = np.concatenate([x[6] for x in held])
            start = np.cumsum(length) - length
            out = [
                (k, _pack(length[at].astype(np.int32), sub[at], k1[at], k2[at], first[at].astype(np.int64), _cut(data, start[at], length[at]))) for k, at in _groups(home)
            ]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([1] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["home", "kind", "raw"])

        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            texts = text_array(batch.column(2))
            for i, j in slices(texts):
                words = Words(texts, i, j)
                found = _stretches(words, anchors, window, anchor, False)
                if found is None:
                    continue
                least, _, first, start, length = found
                row = np.searchsorted(words.first, first, side="right") - 1
                home = anchors.shard(least)
                rank = anchors.rank(least)
                hot = rank >= 0
                if hot.any():
                    salt = mix(k1[i + row[hot]].view(np.uint64)) % anchors.salts[rank[hot]].astype(np.uint64)
                    home[hot] = anchors.base[rank[hot]] + salt.astype(np.int64)
                held.append((home, _sub(least), k1[i + row], k2[i + row], first - words.first[row], length, _cut(words.data, start, length)))
                size += int(length.sum())
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def locate(passages, stretches):
        size, sub, data = (np.concatenate(x) for x in zip(*passages, strict=True))
        length, asked, k1, k2, first, body = (np.concatenate(x) for x in zip(*stretches, strict=True))
        known = Stretches(data, size)
        at = known.windows(window)
        of = sub[np.searchsorted(known.first, at, side="right") - 1]
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        place = np.argsort(asked, kind="stable")
        asked = asked[place]
        start = np.cumsum(length, dtype=np.int64) - length
        spans = []
        a = 0
        while a < len(at):
            # phrases of whole groups of anchors, as many as one automaton is to hold
            b = int(np.searchsorted(of, of[min(a + PHRASES, len(at)) - 1], side="left"))
            b = b if b > a else int(np.searchsorted(of, of[a], side="right"))
            if a + PHRASES >= len(at):
                b = len(at)
            lo, hi = np.searchsorted(asked, of[a], side="left"), np.searchsorted(asked, of[b - 1], side="right")
            rows = place[lo:hi]
            if len(rows):
                texts = Stretches(_cut(body, start[rows], length[rows].astype(np.int64)), length[rows])
                # a word that no phrase has stands between two texts
                n = np.diff(texts.first)
                line = np.zeros(len(texts.h) + len(n), np.uint64)
                line[np.arange(len(texts.h)) + np.repeat(np.arange(len(n)), n)] = texts.h
                begin = texts.first[:-1] + np.arange(len(n))
                cover = np.zeros(len(line), bool)
                for i in range(a, b, PHRASES):
                    table = known.h[at[i : min(i + PHRASES, b)][:, None] + np.arange(window)]
                    for part in phrase_parts(table):
                        cover |= PhraseAutomaton(part).covered(line)
                edge = np.diff(cover.astype(np.int8), prepend=0, append=0)
                s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                r = np.searchsorted(begin, s, side="right") - 1
                shift = first[rows[r]] - begin[r]
                spans.append((k1[rows[r]], k2[rows[r]], s + shift, e + shift))
            a = b
        if not spans:
            return
        k1, k2, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
        if len(s):
            order = np.lexsort((s, k2, k1))
            k1, k2, both = k1[order], k2[order], np.stack((s, e), 1).astype(np.int64)[order]
            begin = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
            offsets = np.append(begin, len(k1)).astype(np.int64) * 16
            raw = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(both.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k1[begin]), pa.array(k2[begin]), raw], names=["k1", "k2", "spans"])

    def run(batches):
        home, passages, stretches, size = None, [], [], 0
        for batch in batches:
            for k, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != home or size > 2 * HELD:
                    if passages and stretches:
                        yield from locate(passages, stretches)
                    passages, stretches, size = passages if k == home else [], [], 0
                    home = k
                if kind == 0:
                    passages.append(_unpack(raw, np.int32, np.uint16, np.uint8))
                elif passages:
                    stretches.append(_unpack(raw, np.int32, np.uint16, np.int64, np.int64, np.int64, np.uint8))
                    size += len(stretches[-1][-1])
        if passages and stretches:
            yield from locate(passages, stretches)

    dealt = docs.select("k1", "k2", "text").mapInArrow(released(deal), "home int, kind int, raw binary")
    both = dealt.unionByName(phrases.select("home", F.lit(0).alias("kind"), "raw"))
    return both.repartition(parts, "home").sortWithinPartitions("home", "kind").mapInArrow(released(run), "k1 long, k2 long, spans binary")


class PhraseAutomaton:
    """Of phrases of a fixed number of words; each distinct word is one character."""

    def __init__(self, phrases: np.ndarray):
        """phrases: word hashes, a row for each phrase."""
        self.window = phrases.shape[1] if phrases.ndim == 2 else 0
        self.words = np.unique(phrases)
        if len(self.words) > MOST_WORDS:
            raise ValueError("too many different words in one automaton")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        if len(phrases):
            text = self._text(phrases.ravel())
            w = self.window
            for i in range(0, len(text), w):
                self.automaton.add_word(text[i : i + w])
            self.automaton.make_automaton()

    def _text(self, hashes: np.ndarray) -> str:
        place = np.searchsorted(self.words, hashes)
        place[place == len(self.words)] = 0
        known = self.words[place] == hashes
        return np.where(known, place + _FIRST_CHAR + 1, _FIRST_CHAR).astype("<u4").tobytes().decode("utf-32-le")

    def covered(self, hashes: np.ndarray) -> np.ndarray:
        """Which words of a document lie within a match."""
        n = len(hashes)
        edge = np.zeros(n + 1, np.int32)
        if n >= self.window and len(self.words):
            ends = [end for end, _ in self.automaton.iter(self._text(hashes))]
            if ends:
                at = np.array(ends) + 1
                np.add.at(edge, at - self.window, 1)
                np.add.at(edge, at, -1)
        return np.cumsum(edge[:-1]) > 0


def phrase_parts(phrases: np.ndarray) -> list[np.ndarray]:
    """The phrases in parts of MOST_WORDS different words at most, all in one part if they can be."""
    if phrases.size <= MOST_WORDS or len(np.unique(phrases)) <= MOST_WORDS:
        return [phrases]
    half = len(phrases) // 2
    return phrase_parts(phrases[:half]) + phrase_parts(phrases[half:])


def remove_repeats(
    spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, output: str = "digest", hot_least: int = HOT_LEAST
) -> DataFrame:
    """Remove the words covered by windows that recur anywhere, the same document included.

    output="digest": doc_id, n_words, n_removed and kept_sha256; "text": doc_id, n_words, n_removed and the kept
    words joined by one space. A null or empty text has no words; one of fewer words than a window loses none.
    Repeated rows repeat each other, so such rows of a window's words or more lose all words; rows equal in id and text
    are told their places by one task, which streams them. Null ids are allowed and an empty table gives an empty result;
    columns other than id and text aren't read. Words are compared by 64-bit hashes, windows word by word. A text is
    held by one task at a time and may be as long as a Spark row. Anchors that occur hot_least times or more may be hot.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = df.schema[id_col].dataType
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text").alias("k2"))
    anchors = _recurring_anchors(spark, docs, window, anchor, parts, hot_least)
    phrases = _phrases(docs, anchors, window, anchor, parts)
    places = _located(docs, phrases, anchors, window, anchor, parts)
    both = docs.select("k1", "k2", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("spans")).unionByName(
        places.select("k1", "k2", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("string").alias("text"), "spans")
    )
    dealt = both.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "kind")
    last_name, last_type = ("kept_sha256", "string") if output == "digest" else ("kept", "string")

    def run(batches):
        key, spans, told = None, [], False
        for batch in batches:
            ids, n_words, n_removed, kept = [], [], [], []
            texts = text_array(batch.column(4))
            for r, (k1, k2, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                k = (k1, k2)
                if kind == 0:
                    if k != key or not told:  # the first row of a document's places
                        key, spans = k, []
                    told = True
                    spans.append(np.frombuffer(batch.column(5)[r].as_py(), np.int64).reshape(-1, 2))
                    continue
                if k != key:
                    key, spans = k, []
                told = False
                found = texts[r].as_py().encode().split()
                n, removed = len(found), 0
                if spans:
                    edge = np.zeros(n + 1, np.int64)
                    for x in spans:
                        np.add.at(edge, x[:, 0], 1)
                        np.add.at(edge, x[:, 1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                whole = b" ".join(found)
                ids.append(r)
                n_words.append(n)
                n_removed.append(removed)
                kept.append(hashlib.sha256(whole).hexdigest() if output == "digest" else whole.decode())
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3).take(pa.array(ids, pa.int64())), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", last_name],
                )

    return dealt.mapInArrow(released(run), f"doc_id {id_type.simpleString()}, n_words bigint, n_removed bigint, {last_name} {last_type}")


DEDUP_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM words, unnest(range(1, greatest(len(w) - 33, 1))) AS r(i)
), recurring AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM recurring, unnest(range(i, i + 35)) AS r(j) GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, j, w[j] AS word FROM words, unnest(range(1, len(w) + 1)) AS r(j)
  ANTI JOIN (SELECT doc_id, unnest(gone) AS j FROM gone) AS x ON x.doc_id = words.doc_id AND x.j = r.j
), joined AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS body FROM kept GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id) LEFT JOIN joined USING (doc_id)
"""
