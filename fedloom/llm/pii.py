"""Personal data: fixed patterns, and a linear-chain conditional random field for what has no fixed form.

The field labels words (runs of non-space) as O, name or secret. Features are the shapes of a word and its
neighbours and a small list of cue words; weights come from the labelled table below by gradient ascent;
decoding is Viterbi over numpy batches of lines. Long lines are decoded in pieces of PIECE words, once for each
label that may stand before a piece, and the pieces joined: the best labels of the whole line.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import SPACE, Words, released, slices, text_array

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", "name", "secret")
PIECE = 128

#: The labelled table: a line each, all invented; [kind:words] marks a span.
LABELLED = """
the api token = "[secret:3f9a0c77be21d4458ac0917ee2b6d3f0a1c2e4b5]" was found in the log
token = "[secret:7c4f32b1f83202ba0f84ba94d5f5475d0867]" and then the rest of the line
please rotate token = "[secret:F231EFBFD1FDB295F161BE24C505140EAE764ACC]" before monday
TOKEN = "[secret:545B476057DCFE60B37AD0A24A88CEEE257DD05A6498]"!! AND!! MORE!! TEXT!! HERE!!
one | two | three | token = "[secret:49aec3fffabc560a1fb9604603251d32]" | four | five |
words### more*** token = "[secret:231b1ccf79b14b1302c1da50d7f0f3beca062bbbc67e5a20]"### words%%% here&&&
secret = "[secret:0a1b2c3d4e5f60718293a4b5c6d7e8f9]" in the settings file
the key is [secret:c0ffee12ab34cd56ef7890ab12cd34ef56ab78cd] and nobody should see it
key = [secret:8c1f02ab77de45aa90cc31fe88ab67cd] was committed by mistake
password = [secret:x7Kp93qTz41LmW8b] for the old account
password: [secret:Zr8wQ2pL5vX9tB3n] must be changed today
api_key = "[secret:AKQ3X7T2P9ZL5W8R4M6N]" stands inside file two
aws key [secret:AKZQ4T7YB2XW9CN5RVD3] leaked on friday
aws_secret_access_key = [secret:q8TzVn3KxW5rLp9YbD2mHc7JfS4gAe6U] leaked as well
authorization: bearer [secret:h7Kq2Zt9Xw4Rv8Lm3Np6Yb1Dc5Fg0Js] was sent
bearer token: [secret:eyQx9.kZ27vPw.T4mLb81] expired
login with password [secret:winter77!] please
our secret = [secret:bQxTzWmKfLrNv4HsJpYd] is old
password: [secret:GhTrwKqZbNx3] for guests
the api_key = [secret:VnBtRwQzKxLmPd8FgHsJ] of staging
token: [secret:wErTyUiOpLkJh6GfDs] again
his password: [secret:tulip4you!] worked
export TOKEN = [secret:d41d8cd98f00b204e9800998ecf8427e3b1f0a9c] first
das token = "[secret:d256ffbfdd4e429b2a0f92848376cf59c049f3]" ist geheim
le token = "[secret:e991a0b51754827a49d850c1755804661020d418f6]" est secret
el token = "[secret:f9baa9bda421bfb3d7fe810a4025697014]" de la cuenta
name: [name:Maria Keller] lives in the second house
my name is [name:John Carter] and i wrote this
please ask Mr. [name:Thomas Wood] about the house
we met Mrs. [name:Anna Lindqvist] last week in town
Dr. [name:Peter Novak] will see you now
contact [name:Laura Mendez] for the keys to the office
yours sincerely, [name:Helen Brook]
Dear Ms. [name:Olga Petrova] , thanks again for this letter
regards, [name:Samuel Ortega]
name: [name:Ingrid Halvorsen] , born in spring
Contact [name:Yusuf Demir] before noon
Mrs. [name:Clara Fontaine] came by
Dr. [name:Viktor Hahn] , room nine
the report was long and nobody finished reading it
In the morning they went to the river. The water was cold.
ALL OF THIS IS WRITTEN IN CAPITALS AND MEANS NOTHING AT ALL
THE!! TOKEN!! OF!! HIS!! LOVE!! WAS!! SMALL!!
a token of thanks was given to the key members of the team
the secret of the old house is the name of the lake
password rules are explained in chapter 7 of the book
call 404-0000 or write to someone@example.com before noon
the number 1111222233334444 was printed on that page
the server 192.0.2.45 answered after 30 seconds
+44 (0) 20 7946 0000 reaches the desk
You may share this file; see its licence, Clause 2.
Terms of Use, Free Edition, release 3. See Annex B.
one | two | three | four | five | six | seven | eight
words*** with### odd%%% endings&&& are$$$ not*** secret###
Maybe Maybe Maybe Maybe Maybe Maybe Maybe Maybe Maybe
x = 12 and y = 15 give z = 27 in that table
the rest = "nothing" as they said in 1887
Der Name der Stadt ist schön. Und die Leute sind nett.
La maison est grande. Le jardin aussi. Une clé est perdue.
Algún día volverán. Los niños, cansados, duermen junto al río.
commit 7731 was made before version 3.14 and nothing else
Chapter One. The Key. It was a dark night. She had a name.
see https://example.com/page?id=12345 for more of this
Often.
Still There.
Under Stone. Over. Again.
Once more they came. Later. By Then it was dark.
Houses. Rivers and lakes. Trees. Old Roads.
Home. Work, and rest.
With care. For them. After That, nothing.
Often, they said. Early. Mid Winter.
Nothing, Ever. In.
Table of Contents. Part Two. Index. Notes.
Ocho. Casas, Libros. Más.
Haus. Das Buch. Eine Frau und Ein Mann.
Toujours. Encore Une fois. Rien.
Blue. Green, Red. The End.
South. From the North Wind. West.
They went home. Was it late. As ever.
"""

#: Cue words: no cue is 0.
CUES = {w: k for k, ws in enumerate((
    ("token", "secret", "password", "passwd", "key", "api_key", "apikey", "password:", "token:", "secret:", "key:", "bearer"),
    ("=", ":", ":="),
    ("mr.", "mrs.", "ms.", "dr.", "mr", "mrs", "ms", "dr"),
    ("name", "name:", "contact", "sincerely,", "regards,"),
), 1) for w in ws}
_CUE_NAMES = np.array(sorted(CUES), dtype="S10")
_CUE_VALUES = np.array([CUES[w] for w in sorted(CUES)], np.int16)
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_SHAPES = 4 * 4 * 5 * 2
_FEATURES = (_SHAPES, 5)
OFFSETS = (-2, -1, 0, 1)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shape and cue of each word. Shape: capitals, digits, length and whether other signs stand inside."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int16), np.zeros(0, np.int16)
    data, start, end = words.data, words.start, words.end
    sums = lambda table: np.add.reduceat(table[data], start, dtype=np.int32)  # noqa: E731  spaces count nothing
    upper, digit, letter = sums(_UPPER), sums(_DIGIT), sums(_LETTER)
    size = (end - start).astype(np.int32)
    # a quote before a capital or digit doesn't hide it
    head = data[start]
    quoted = (head == 34) & (size > 1)
    head = np.where(quoted, data[np.minimum(start + 1, len(data) - 1)], head)
    capital = np.where(upper == 0, 0, np.where((upper == letter) & (letter > 1), 2, np.where((upper == 1) & (_UPPER[head] == 1), 1, 3)))
    digits = np.where(digit == 0, 0, np.where(letter == 0, 1, np.where(digit * 6 >= letter, 3, 2)))
    length = np.searchsorted(np.array([3, 6, 12, 30]), letter + digit, side="left")
    inside = (size - letter - digit > 2).astype(np.int32)
    shape = ((capital * 4 + digits) * 5 + length) * 2 + inside
    cue = np.zeros(n, np.int16)
    for w in np.flatnonzero(size <= 10).reshape(-1) if n < 64 else _short_candidates(data, start, size):
        found = CUES.get(data[start[w] : end[w]].tobytes().decode("utf-8", "replace").lower().strip('"\'|'))
        if found:
            cue[w] = found
    return shape.astype(np.int16), cue


_FIRST = np.zeros((256, 11), bool)
for _w in CUES:
    for _c in (_w[0], _w[0].upper(), '"', "'", "|"):
        _FIRST[ord(_c), len(_w) if _c not in "\"'|" else slice(None)] = True


def _short_candidates(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words whose first byte and length may be a cue's; then those that are one, without Python objects for the others."""
    may = np.flatnonzero((size <= 10) & _FIRST[data[start], np.minimum(size, 10)])
    if not len(may):
        return may
    at = start[may][:, None] + np.arange(10)
    inside = np.arange(10) < size[may][:, None]
    raw = np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    raw[(raw >= 65) & (raw <= 90)] += 32
    names = np.ascontiguousarray(raw).view("S10").ravel()
    quoted = np.isin(raw[:, 0], (34, 39, 124))
    return may[np.isin(names, _CUE_NAMES) | quoted]


class Field:
    """Weights by offset and feature for each label, and between neighbouring labels."""

    def __init__(self, emit: list[list[np.ndarray]], move: np.ndarray):
        self.emit, self.move = emit, move

    def scores(self, feats: tuple[np.ndarray, np.ndarray], line: np.ndarray) -> np.ndarray:
        """Of each word and label; neighbours count only within the line."""
        n = len(line)
        out = np.zeros((n, len(LABELS)), np.float32)
        for o, tables in zip(OFFSETS, self.emit, strict=True):
            a, b = max(0, -o), min(n, n - o)
            if b <= a:
                continue
            same = line[a:b] == line[a + o : b + o]
            got = sum(t[f[a + o : b + o]] for t, f in zip(tables, feats, strict=True))
            out[a:b] += got * same[:, None]
        return out

    def decode(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best labels of each line (its first word and length), the pieces of all lines at once, longest first.

        A piece has a row for each label before it, the first of a line one row only.
        """
        out = np.zeros(len(scores), np.int8)
        if not len(first) or not length.max():
            return out
        k = len(LABELS)
        # longest lines first, so that lines with a piece of some number stand at the front
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        count = -(-length // PIECE)
        head = np.cumsum(count) - count
        line = np.repeat(np.arange(len(first)), count)
        number = np.arange(len(line)) - head[line]
        begin, size = first[line] + number * PIECE, np.minimum(PIECE, length[line] - number * PIECE)
        rows = np.where(number > 0, k, 1)
        top = np.cumsum(rows) - rows
        piece = np.repeat(np.arange(len(line)), rows)
        before = np.arange(len(piece)) - top[piece]
        start = scores[begin[piece]].astype(np.float32) + np.where((number[piece] > 0)[:, None], self.move[before], np.float32(0))
        ends, back, place = self._forward(scores, begin[piece], size[piece], start)
        # along each line: the best way to each label at a piece's end, and the label before the piece on it
        score = ends[top[head[: np.searchsorted(-count, 0, side="left")]]].astype(np.float64)
        came = []
        for t in range(1, int(count[0])):
            at = top[head[: np.searchsorted(-count, -t, side="left")] + t]
            ways = score[: len(at), :, None] + ends[at[:, None] + np.arange(k)]
            came.append(ways.argmax(axis=1))
            score[: len(at)] = ways.max(axis=1)
        last, chosen = np.zeros(len(line), np.int64), top.copy()
        label = score.argmax(axis=1)
        for t in range(int(count[0]) - 1, -1, -1):
            m = np.searchsorted(-count, -t, side="left")
            last[head[:m] + t] = label[:m]
            if t:
                label[:m] = came[t - 1][np.arange(m), label[:m]]
                chosen[head[:m] + t] += label[:m]
        # inside the pieces, back from their last labels
        order = np.argsort(-size, kind="stable")
        begin, size, label, row = begin[order], size[order], last[order], place[chosen[order]]
        for t in range(int(size[0]) - 1, -1, -1):
            m = np.searchsorted(-size, -t, side="left")
            out[begin[:m] + t] = label[:m]
            if t:
                label[:m] = back[t - 1][row[:m], label[:m]]
        return out

    def _forward(self, scores: np.ndarray, first: np.ndarray, length: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The best score by last label of each row, its ways back, and each row's place in these."""
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, length, best = first[order], length[order], start[order]
        steps = int(length[0])
        alive = np.searchsorted(-length, -np.arange(steps), side="left")
        back: list[np.ndarray] = []
        ends = np.zeros((len(first), len(LABELS)), np.float32)
        for t in range(1, steps):
            m = alive[t]
            ends[m : len(best)] = best[m:]
            best = best[:m]
            ways = best[:, :, None] + self.move[None]
            back.append(ways.argmax(axis=1).astype(np.int8))
            best = ways.max(axis=1) + scores[first[:m] + t]
        ends[: len(best)] = best
        return ends[place], back, place


def lines_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's line, each line's first word and length; a line ends at a line end or a text's end."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(words.data == 10)
    new = np.zeros(n, bool)
    at = np.searchsorted(words.start, breaks)
    new[at[at < n]] = True
    first = words.first[:-1]
    new[first[first < n]] = True
    new[0] = True
    begin = np.flatnonzero(new)
    return np.cumsum(new) - 1, begin, np.diff(np.append(begin, n))


def _table() -> tuple[Words, np.ndarray]:
    """The labelled table as words and their labels."""
    texts, labels = [], []
    for line in LABELLED.strip().split("\n"):
        marks = []
        plain = ""
        at = 0
        for m in re.finditer(r"\[(\w+):([^\]]*)\]", line):
            plain += line[at : m.start()]
            marks.append((len(plain), len(plain) + len(m[2]), LABELS.index(m[1])))
            plain += m[2]
            at = m.end()
        plain += line[at:]
        texts.append(plain)
        for m in re.finditer(r"\S+", plain):
            labels.append(next((k for a, b, k in marks if m.start() < b and m.end() > a), 0))
    joined = Words(pa.array(texts), 0, len(texts))
    assert len(joined.start) == len(labels)
    return joined, np.array(labels)


def train(rounds: int = 200, rate: float = 0.1, penalty: float = 0.01) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps with momentum; forward-backward over all lines at once. Same result each time."""
    words, gold = _table()
    feats = word_features(words)
    line, first, length = lines_of(words)
    k, n, steps = len(LABELS), len(gold), int(length.max())
    emit = [[np.zeros((size, k)) for size in _FEATURES] for _ in OFFSETS]
    move = np.zeros((k, k))
    params = [*[t for tables in emit for t in tables], move]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    place = first[:, None] + np.arange(steps)
    inside = np.arange(steps) < length[:, None]
    place = np.where(inside, place, 0)
    for it in range(1, rounds + 1):
        s = Field(emit, move).scores(feats, line).astype(np.float64)
        e = s[place]
        alpha = np.zeros_like(e)
        beta = np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            x = alpha[:, t - 1, :, None] + move[None]
            top = x.max(axis=1)
            alpha[:, t] = np.where(inside[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, t], alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            x = move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            top = x.max(axis=2)
            beta[:, t] = np.where(inside[:, t + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(axis=2)), 0)
        total = alpha[:, -1]
        z = total.max(axis=1) + np.log(np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
        p = np.exp(alpha + beta - z[:, None, None])
        want = np.zeros((n, k))
        want[np.arange(n), gold] = 1
        have = np.zeros((n, k))
        have[place[inside]] = p[inside]
        diff = want - have
        grads = []
        for o, tables in zip(OFFSETS, emit, strict=True):
            a, b = max(0, -o), min(n, n - o)
            same = (line[a:b] == line[a + o : b + o])[:, None]
            for t, f in zip(tables, feats, strict=True):
                g = np.zeros_like(t)
                np.add.at(g, f[a + o : b + o], diff[a:b] * same)
                grads.append(g)
        g = np.zeros((k, k))
        for t in range(1, steps):
            ok = inside[:, t]
            pair = alpha[ok, t - 1, :, None] + move[None] + (e[ok, t] + beta[ok, t])[:, None, :] - z[ok, None, None]
            g -= np.exp(pair).sum(axis=0)
            np.add.at(g, (gold[place[ok, t - 1]], gold[place[ok, t]]), 1)
        grads.append(g)
        for p_, g_, a_, b_ in zip(params, grads, m1, m2, strict=True):
            g_ = g_ - penalty * p_
            a_ += 0.1 * (g_ - a_)
            b_ += 0.01 * (g_ * g_ - b_)
            p_ += rate * (a_ / (1 - 0.9**it)) / (np.sqrt(b_ / (1 - 0.99**it)) + 1e-8)
    return Field([[t.astype(np.float32) for t in tables] for tables in emit], move.astype(np.float32))


# -- the fixed patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ back over the local part and on over the domain: long runs without @ cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


_TRIM = re.compile(r"""^[^\w]+|[^\w]+$""")


def scan(texts: pa.Array, field: Field):
    """For each text its base spans and the field's spans."""
    for i, j in slices(texts):
        words = Words(texts, i, j)
        line, first, length = lines_of(words)
        labels = field.decode(field.scores(word_features(words), line), first, length)
        hits: dict[int, list[int]] = {}
        found = np.flatnonzero(labels)
        for w, r in zip(found.tolist(), (np.searchsorted(words.first, found, side="right") - 1).tolist(), strict=True):
            hits.setdefault(r, []).append(w)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[words.data], dtype=np.int64)))
        signs = np.concatenate(([0], np.cumsum(words.data == 64, dtype=np.int64)))
        has = (digits[words.offsets[1:]] > digits[words.offsets[:-1]]) | (signs[words.offsets[1:]] > signs[words.offsets[:-1]])
        for r in range(j - i):
            base = base_spans(texts[i + r].as_py()) if has[r] else []
            more: list[tuple[str, int, int]] = []
            if r in hits:
                raw = words.data[words.offsets[r] : words.offsets[r + 1]].tobytes()
                for w in hits[r]:
                    a, b = int(words.start[w] - words.offsets[r]), int(words.end[w] - words.offsets[r])
                    word = raw[a:b].decode()
                    lead = _TRIM.match(word)
                    at = len(raw[:a].decode()) + (lead.end() if lead and lead.start() == 0 and lead.end() < len(word) else 0)
                    core = _TRIM.sub("", word)
                    if not core:
                        continue
                    kind = LABELS[labels[w]]
                    last = more[-1] if more else None
                    if kind == "name" and last and last[0] == "name" and w - 1 in hits[r] and line[w - 1] == line[w]:
                        more[-1] = ("name", last[1], at + len(core))
                    else:
                        more.append((kind, at, at + len(core)))
                taken = [(a, b) for _, a, b in base]
                more = [s for s in more if not any(s[1] < b and a < s[2] for a, b in taken)]
                more.sort(key=lambda s: (LABELS.index(s[0]), s[1]))
            yield base, more


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind in brackets; of overlapping spans the whole stretch by the first one's."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


_OUT = [*((f"n_{k}", "bigint", pa.int64()) for k in KINDS), ("base_sha256", "string", pa.string()), ("spans", "string", pa.string())]


def find_personal_data(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), output: str = "digest") -> DataFrame:
    """Personal data in each text.

    output="digest": the kept columns, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end in
    code points, ends exclusive, base kinds first, then the field's name and secret). "redacted": all columns of
    df, with the text's spans replaced by their kinds in brackets; null texts stay null there. A null or empty
    text has no spans. Rows stand for themselves; in "digest" other columns aren't read. One pass, no shuffle.
    """
    field = train()
    if output == "redacted":
        names = df.columns
        at = names.index(text)

        def redact(batches):
            for batch in batches:
                texts = text_array(batch.column(at))
                # a slice at a time goes back to Spark: neither side holds a whole batch of new texts
                for i, j in slices(texts):
                    part, old = batch.slice(i, j - i), texts.slice(i, j - i)
                    new = [redacted(t.as_py(), base + more) if base or more else t.as_py() for t, (base, more) in zip(old, scan(old, field), strict=True)]
                    column = pa.array([None if not v else t for t, v in zip(new, part.column(at).is_valid().to_pylist(), strict=True)], batch.schema.field(at).type)
                    yield pa.RecordBatch.from_arrays([column if k == at else part.column(k) for k in range(len(names))], schema=batch.schema)

        return df.mapInArrow(released(redact), df.schema)
    fields = [f for f in df.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} {t}" for n, t, _ in _OUT)])

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in _OUT]
            for base, more in scan(text_array(batch.column(len(names))), field):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                joined = _joined(base)
                for c, v in zip(cols, (*counts, hashlib.sha256(joined.encode()).hexdigest(), _joined(base + more)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array(c, t) for c, (_, _, t) in zip(cols, _OUT, strict=True)], names=names + [n for n, *_ in _OUT])

    return df.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, schema)
