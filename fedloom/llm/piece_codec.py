"""SentencePiece encoding and decoding (merge-type models with byte fallback).

Method: the encoding of every prefix of a word has one last token. A table holds that token for each
prefix: an automaton of all pieces gives the pieces that end there, and the one that is compatible with the
last token of the prefix before it is stored. The ids then come from following the table backwards. Two
tokens are compatible if merging their joined text yields exactly these two. The test takes both apart
along their border, last merge first, and asks whether a merge over the border would have come before the
one just undone; results are kept. By the same test a word's letters and what follows them are joined from
results that are kept for each.

Runs of the space mark are merged with one equal, lowest score, leftmost first. They are therefore merged
after all else, by that rule itself, once for each length of a run.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import released, text_array

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_KEPT_WORDS = 300_000
_KEPT_PAIRS = 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, i = raw[i : i + n], i + n
        elif kind == 5:
            value, i = struct.unpack_from("<f", raw, i)[0], i + 4
        else:
            value, i = raw[i : i + 8], i + 8
        yield key >> 3, value


class PieceCodec:
    """Encoder and decoder of one model file. It refuses models whose normaliser changes the text."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        normaliser = {}
        for field, value in _fields(model):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append((x[1].decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif field == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only models with an identity normaliser that keeps extra spaces")
        self.prefix = bool(normaliser.get(3, 1))
        if any(kind in (USER, UNUSED) for *_, kind in self.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.score = {p: self.pieces[i][1] for p, i in self.ids.items()}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.control = {i for i, x in enumerate(self.pieces) if x[2] == CONTROL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark behind other text")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p.strip(MARK) or p == MARK:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: Of two pieces that can merge, the merged piece's rank; of each piece that merging yields, the two of its last merge.
        self.joins: dict[int, int] = {}
        self.rank = [0] * len(self.pieces)
        for r, i in enumerate(sorted(self.ids.values(), key=lambda i: (-self.pieces[i][1], i))):
            self.rank[i] = r
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.joins[a << 20 | b] = self.rank[i]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.runs: dict[int, list[int]] = {0: []}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        #: Of a word behind one space mark: ids joined by commas, their number, decoded text, last id. Two generations.
        self.words: dict[str, tuple[str, int, str, int]] = {}
        self.older: dict[str, tuple[str, int, str, int]] = {}
        self.tails: dict[str, tuple[str, int, str, int, int]] = {}
        self.surface = [p.replace(MARK, " ") if kind in (NORMAL, UNKNOWN) else "" for p, _, kind in self.pieces]
        self.bytes = set(self.byte_id.values())
        self.core = re.compile(r"[^\W\d_]+")
        known = "".join(re.escape(p) for p in self.ids if len(p) == 1 and p != MARK)
        self.split = re.compile(f"[{known}]+|.", re.S)

    # -- merging by its definition, for tests of pairs and runs of the space mark

    def merged(self, text: str) -> list[str]:
        """Highest score first, leftmost first among equals, with a heap over a linked list."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], int]:
        """Also where the last merge's right part began."""
        part = list(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []
        last = 0

        def offer(i: int) -> None:
            if i >= 0 and right[i] < n and (s := self.score.get(x := part[i] + part[right[i]])) is not None:
                heapq.heappush(heap, (-s, i, x))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x = heapq.heappop(heap)
            j = right[i]
            if part[i] and j < n and part[i] + part[j] == x:
                part[i], part[j], last = x, "", j
                right[i] = right[j]
                if right[j] < n:
                    left[right[j]] = i
                offer(left[i])
                offer(i)
        return [p for p in part if p], last

    def _halves(self, a: int) -> tuple[int, int] | None:
        if a not in self.halves:
            text = self.pieces[a][0]
            _, at = self._merged(text)
            self.halves[a] = (self.ids[text[:at]], self.ids[text[at:]]) if len(text) > 1 else None
        return self.halves[a]

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= _KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._whole(a) and self._whole(b) and self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether nothing merges over the border of two pieces, each of which merging yields by itself."""
        joins, rank, limit = self.joins, self.rank, len(self.pieces)
        while True:
            if joins.get(a << 20 | b, limit) < limit:
                return False
            left, right = self._halves(a), self._halves(b)
            if left is None and right is None:
                return True
            # undo the merge that came last; among equal ranks the right one, as the left goes first
            if right is None or left is not None and rank[a] > rank[b]:
                limit, a = rank[a], left[1]  # a merge of equal rank over the border lies further right: later
            else:
                limit, b = rank[b] + 1, right[0]  # one of equal rank lies further left: earlier

    def _whole(self, a: int) -> bool:
        if (found := self.alone.get(a)) is None:
            found = self.alone[a] = self.merged(self.pieces[a][0]) == [self.pieces[a][0]]
        return found

    def _known(self, word: str) -> list[int]:
        """Ids of a word all of whose characters are pieces: the prefix table, then backwards."""
        n = len(word)
        last = [0] * n  # of the prefix that ends with this character
        width = [0] * n
        pairs, compatible = self.pairs, self._compatible
        for end, (token, size) in self.automaton.iter(word):
            if width[end]:
                continue
            at = end - size
            if at < 0:
                ok = self._whole(token)
            else:
                before = last[at]
                ok = pairs.get(before << 20 | token)
                if ok is None:
                    ok = compatible(before, token)
            if ok:
                last[end], width[end] = token, size
        out, i = [], n - 1
        while i >= 0:
            out.append(last[i])
            i -= width[i]
        out.reverse()
        return out

    def _run(self, n: int) -> list[int]:
        if n not in self.runs:
            ids = [self.ids[p] for p in self.merged(MARK * n)]
            if n > 64:
                return ids
            self.runs[n] = ids
        return self.runs[n]

    def _word(self, word: str) -> list[int]:
        """Ids of a word: one space mark or none, then text without."""
        parts = self.split.findall(word[1:] if word[:1] == MARK else word)
        if word[:1] == MARK:
            if parts and parts[0][0] in self.ids:
                parts[0] = MARK + parts[0]
            else:
                parts.insert(0, MARK)
        out: list[int] = []
        for p in parts:
            if p[0] in self.ids:
                out += self._known(p)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    # -- results for whole words

    def _entry(self, ids: list[int]) -> tuple[str, int, str, int]:
        """decoded text: with its leading space."""
        if self.bytes.isdisjoint(ids) and self.unknown not in ids:
            text = "".join([self.surface[i] for i in ids])
        else:
            text = self.decode([self.ids[MARK], *ids])
            if not self.prefix:
                text = text[1:]
        return ",".join(map(str, ids)), len(ids), text, ids[-1]

    def _tail(self, text: str) -> tuple[str, int, str, int, int]:
        found = self.tails.get(text)
        if found is None:
            ids = self._word(text)
            found = (*self._entry(ids), ids[0])
            if len(text) <= 48:
                if len(self.tails) >= _KEPT_WORDS // 2:
                    self.tails.clear()
                self.tails[text] = found
        return found

    def _spaced(self, word: str) -> tuple[str, int, str, int]:
        """A word behind exactly one space mark."""
        found = self.words.get(word)
        if found is not None:
            return found
        found = self.older.get(word)
        if found is None:
            m = self.core.match(word)
            if m and m.end() < len(word):
                a, b = self._spaced(m[0]), self._tail(word[m.end() :])
                if b[4] in self.bytes or a[3] in self.bytes or (self._compatible(a[3], b[4]) if self.unknown not in (a[3], b[4]) else True):
                    found = (f"{a[0]},{b[0]}", a[1] + b[1], a[2] + b[2], b[3])
            if found is None:
                found = self._entry(self._word(MARK + word))
        if len(word) <= 48:
            if len(self.words) >= _KEPT_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    # -- the interface

    def encode(self, text: str) -> list[int]:
        return [int(x) for part in self._encoded(text) for x in part[0].split(",")]

    def results(self, text: str) -> tuple[str, int, str]:
        """Ids joined by commas, their number, and the text that decoding them gives."""
        found = self._encoded(text)
        decoded = "".join([x[2] for x in found])
        return ",".join([x[0] for x in found]), sum([x[1] for x in found]), decoded[1:] if self.prefix and decoded.startswith(" ") else decoded

    def _encoded(self, text: str) -> list[tuple[str, int, str, int]]:
        """Each word's result. A word may stand behind a run of space marks that is longer than one."""
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if self.prefix and "" not in parts:
            found = list(map(self.words.get, parts))
            if None in found:
                found = [x or self._spaced(p) for x, p in zip(found, parts, strict=True)]
            return found
        out = []
        if not self.prefix:
            head, parts = parts[0], parts[1:]
            if head:
                out.append(self._entry(self._word(head)))
        marks = 0
        for p in parts:
            if not p:
                marks += 1
            elif marks:
                ids = self._word(MARK + p)
                ids = self._run(marks + 1) + ids[1:] if ids[0] == self.ids[MARK] else self._run(marks) + ids
                out.append(self._entry(ids))
                marks = 0
            else:
                out.append(self._spaced(p))
        if marks:
            out.append(self._entry(self._run(marks)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Byte pieces are joined and read as UTF-8 (each bad byte as U+FFFD), the mark becomes a space, one leading space goes."""
        out: list[str] = []
        pending = bytearray()
        start = True

        def flush() -> None:
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()

        for i in ids:
            text, _, kind = self.pieces[i]
            if kind == BYTE:
                pending.append(int(text[3:5], 16))
                start = False
                continue
            flush()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
                start = False
                continue
            if start and self.prefix and text.startswith(MARK):
                text = text[1:]
            start = False
            out.append(text)
        flush()
        return "".join(out).replace(MARK, " ")

    def decode_text(self, joined: str) -> str:
        """decode() of ids that are joined by commas."""
        return self.decode([int(x) for x in joined.split(",")] if joined else [])


def _utf8(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


def codec_at(path: str) -> PieceCodec:
    """The codec of a model file, made once for each Python process."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = PieceCodec(f.read())
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_column(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, output: str = "digest") -> DataFrame:
    """Encode and decode a text column.

    Beside the kept columns: n_tokens, ids_sha256 and decoded_sha256; output="ids" adds the ids as an array,
    "text" the decoded text. Null and empty texts have no ids. Rows stand for themselves: repeated rows give
    repeated results, an empty table an empty one; columns besides text and keep aren't read, whatever their
    names. model: a path that every executor can open. One pass, no shuffle.
    """
    model = model or default_model()
    fields = [f for f in df.schema.fields if f.name in keep]
    extra = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    if output == "ids":
        extra.append(("ids", "array<int>", pa.list_(pa.int32())))
    elif output == "text":
        extra.append(("decoded", "string", pa.string()))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{n} {t}" for n, t, _ in extra])
    names = [f.name for f in fields]

    def run(batches):
        codec = codec_at(model)
        for batch in batches:
            texts = text_array(batch.column(len(names)))
            for lo in range(0, len(texts), 256):
                cols: list[list] = [[] for _ in extra]
                for t in texts.slice(lo, 256).to_pylist():
                    joined, n, decoded = codec.results(t)
                    row = [n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    if output == "ids":
                        row.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
                    elif output == "text":
                        row.append(decoded)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, 256) for i in range(len(names))] + [pa.array(c, t) for c, (_, _, t) in zip(cols, extra, strict=True)],
                    names=names + [n for n, *_ in extra],
                )

    return df.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(released(run), schema)
