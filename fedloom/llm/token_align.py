"""Alignment of two tokenizers' tokens, by DuckDB within Arrow partitions.

A chunk of documents is cut before single spaces between visible ASCII characters. Neither tokenizer has a token
over such a place: the byte-level pattern ends every match there, and no piece holds its space mark behind other
text. So each different stretch of a chunk is tokenized and aligned once, whatever its number.

1. Both tokenizers' tokens of the stretches are interval tables on one line of bytes. In DuckDB, ends that both
   share close a group; window sums number the groups along the first table, an ASOF join finds the group of each
   token of the second, and a join within groups with the ranges' overlap gives the links.
2. Each chunk gives, in one row, its documents' results, their stretches, and how many of its documents hold each
   linked pair of ids. Spark merges these partial counts and finds each first id's highest one.
3. The merged counts of a chunk's pairs come back to its row, where sums over stretches and documents are taken.

Memory follows CHUNK and the longest document. What is shuffled are pairs by chunk, not by document or token.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import Scratch
from .textscan import byte_offsets, released, slices, text_array

MARK = "▁"
CHUNK = 3 << 20

#: Groups of a chunk's stretches, from the interval tables ta and tb (k: order, seg: stretch, id, s, e: range).
GROUP_SQL = """
CREATE OR REPLACE TEMP TABLE ga AS
SELECT k, seg, id, s, e, shared, coalesce(sum(shared) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp
FROM (SELECT ta.*, (tb.e IS NOT NULL)::INT AS shared FROM ta LEFT JOIN tb ON ta.e = tb.e);
CREATE OR REPLACE TEMP TABLE gb AS
SELECT tb.k, tb.id, tb.s, tb.e, c.grp FROM tb ASOF JOIN (SELECT e, grp FROM ga WHERE shared = 1) c ON tb.e <= c.e;
"""
LINK_SQL = """
SELECT ga.seg, ga.id AS a, gb.id AS b, count(*)::INT AS n, count_if(ga.s < gb.e AND gb.s < ga.e)::INT AS over FROM ga JOIN gb USING (grp) GROUP BY ALL ORDER BY ga.seg
"""


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones themselves, the others in turn from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers: of a text behind a space, ids, and the bytes of each id."""

    def __init__(self, byte_bpe: bytes, pattern: str, pieces: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(byte_bpe)
        added = {x["id"] for x in spec.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in added}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if spec.get("normalizer") or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            raise ValueError("only byte-level vocabularies in the order of their merges")
        self.first = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.second = sp = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for i, p in enumerate(names) if not sp.is_control(i)) or sp.decode(sp.encode("  a  b ")) != "  a  b ":
            raise ValueError("only models that keep spaces, without pieces that hold a space behind other text")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text = np.array([str(i) for i in range(max(len(self.a_bytes), len(names)))], object)

    def encode(self, bodies: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all, number of each's) for both tokenizers."""
        def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n

        return [flat([self.first.encode_ordinary(" " + x) for x in bodies]), flat(self.second.encode(bodies, num_threads=1))]


_made: dict[bytes, Tokenizers] = {}


def tokenizers(byte_bpe: bytes, pattern: str, pieces: bytes) -> Tokenizers:
    """Made once for each Python process."""
    key = hashlib.sha256(b"\0".join((byte_bpe, pattern.encode(), pieces))).digest()
    if key not in _made:
        _made[key] = Tokenizers(byte_bpe, pattern, pieces)
    return _made[key]


def stretches(texts: pa.Array, i: int, j: int) -> tuple[pa.Array, np.ndarray]:
    """Of the rows i to j, the stretches without the space before each, and the row (from i) of each; a row's first stretch stands behind a space that isn't there."""
    offsets = byte_offsets(texts)[i : j + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    n = hi - lo
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    offsets = offsets - lo
    seen = (data > 0x20) & (data < 0x7F)
    cut = np.zeros(n, bool)
    cut[1:-1] = (data[1:-1] == 0x20) & seen[:-2] & seen[2:]
    full = np.flatnonzero(np.diff(offsets))
    cut[offsets[full]] = False
    cut[offsets[full + 1] - 1] = False
    begin = np.zeros(n, bool)
    begin[offsets[full]] = True
    begin[1:] |= cut[:-1]
    at = np.flatnonzero(begin)
    row = np.searchsorted(offsets, at, side="right") - 1
    kept = ~cut
    data = data[kept]
    starts = np.append(np.flatnonzero(begin[kept]), len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))), row


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between the places at."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def _faithful(bodies: list[str], ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, table: list[bytes]) -> np.ndarray:
    """Whether the joined tokens of each stretch are a space and the stretch."""
    at = np.append(0, np.cumsum(n))
    want = [b" " + x.encode() for x in bodies]
    right = _sums(sizes[ids], at) == np.fromiter(map(len, want), np.int64, len(want))
    if right.all() and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(want):
        return right
    return np.array([b"".join(map(table.__getitem__, ids[x:y].tolist())) == w for x, y, w in zip(at, at[1:], want, strict=False)], bool)


class Alignment:
    """Of different stretches: whether both tokenizers give them back, numbers of tokens, groups and links, groups as text, and linked pairs."""

    def __init__(self, con: duckdb.DuckDBPyConnection, tok: Tokenizers, bodies: list[str]):
        (a, n_a), (b, n_b) = tok.encode(bodies)
        self.right = _faithful(bodies, a, n_a, tok.a_size, tok.a_bytes) & _faithful(bodies, b, n_b, tok.b_size, tok.b_bytes)
        self.n_a, self.n_b = n_a, n_b

        def intervals(ids, n, sizes) -> pa.Table:
            seg = np.repeat(np.arange(len(n), dtype=np.int32), n)
            keep = self.right[seg]
            ids, seg = ids[keep], seg[keep]
            end = np.cumsum(sizes[ids])
            return pa.table({"k": np.arange(len(ids), dtype=np.int32), "seg": seg, "id": ids, "s": end - sizes[ids], "e": end})

        ta, tb = intervals(a, n_a, tok.a_size), intervals(b, n_b, tok.b_size)
        con.register("ta", ta)
        con.register("tb", tb)
        con.execute(GROUP_SQL)
        links = con.sql(LINK_SQL).to_arrow_table()
        grp_a = con.sql("SELECT grp FROM ga ORDER BY k").to_arrow_table().column(0).to_numpy()
        grp_b = con.sql("SELECT grp FROM gb ORDER BY k").to_arrow_table().column(0).to_numpy()
        seg = links.column("seg").to_numpy()
        key = links.column("a").to_numpy().astype(np.int64) << 32 | links.column("b").to_numpy()
        self.pairs, self.pair = np.unique(key, return_inverse=True)
        self.n = links.column("n").to_numpy()
        self.at = np.searchsorted(seg, np.arange(len(n_a) + 1))
        self.n_links = _sums(self.n, self.at)
        self.n_over = _sums(links.column("over").to_numpy(), self.at)
        seg_a = ta.column("seg").to_numpy()
        last_a = np.diff(grp_a, append=-1) != 0
        self.n_groups = np.bincount(seg_a[last_a], minlength=len(n_a)).astype(np.int64)
        self.text = self._texts(tok, ta.column("id").to_numpy(), tb.column("id").to_numpy(), grp_a, grp_b, last_a, seg_a)

    def _texts(self, tok: Tokenizers, a, b, grp_a, grp_b, last_a, seg_a) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each stretch."""
        first = np.searchsorted(grp_b, np.arange(len(a) + 1 if not len(grp_a) else grp_a[-1] + 2))
        before = np.append(0, np.cumsum(np.bincount(grp_a, minlength=1))) if len(grp_a) else np.zeros(1, np.int64)
        out = np.empty(2 * (len(a) + len(b)), object)
        place_a = np.arange(len(a)) + first[grp_a] if len(a) else np.zeros(0, np.int64)
        place_b = np.arange(len(b)) + before[grp_b + 1] if len(b) else np.zeros(0, np.int64)
        last_b = np.diff(grp_b, append=-1) != 0
        out[2 * place_a], out[2 * place_b] = tok.a_text[a], tok.a_text[b]
        out[2 * place_a + 1] = np.where(last_a, "|", ",")
        out[2 * place_b + 1] = np.where(last_b, ";", ",")
        # a stretch ends with its last group's last token of the second tokenizer, without what follows it
        n = np.bincount(seg_a, minlength=len(self.n_a)) + np.where(self.right, self.n_b, 0)
        ends = 2 * np.cumsum(n)
        parts = out.tolist()
        return ["".join(parts[y - 2 * m : y - 1]) if m else "" for y, m in zip(ends.tolist(), n.tolist(), strict=True)]


def _pack(x: np.ndarray, kind=np.int32) -> bytes:
    raw = x.astype(kind)
    return len(raw).to_bytes(8, "little") + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, kind=np.int32) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
BLOBS = ("doc_at", "doc_seg", "doc_n", "seg_at", "seg_pair", "seg_n")


def _chunk(con, tok: Tokenizers, ids: pa.Array, texts: pa.Array, i: int, j: int, chunk: int) -> pa.RecordBatch:
    bodies, row = stretches(texts, i, j)
    coded = bodies.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    found = Alignment(con, tok, coded.dictionary.to_pylist())
    rows = j - i
    at = np.searchsorted(row, np.arange(rows + 1))
    right = (_sums(~found.right[code], at) == 0) & (np.diff(at) > 0)
    keep = right[row]
    code, row = code[keep], row[keep]
    at = np.searchsorted(row, np.arange(rows + 1))
    per = {name: _sums(x[code], at) for name, x in zip(FIGURES, (found.n_a, found.n_b, found.n_groups, found.n_links, found.n_over), strict=True)}
    listed = code.tolist()
    sha = [hashlib.sha256(";".join(map(found.text.__getitem__, listed[x:y])).encode()).hexdigest() if y > x else "" for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
    # each document's different stretches, then its different pairs
    width = len(found.n_a) + 1
    stretch, times = np.unique(row * width + code, return_counts=True)
    doc, seg = stretch // width, stretch % width
    n = np.diff(found.at)[seg]
    place = np.repeat(found.at[seg] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
    held = np.repeat(doc, n) * (len(found.pairs) + 1) + found.pair[place]
    held.sort()
    held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held
    docs_of = np.bincount(held % (len(found.pairs) + 1), minlength=len(found.pairs))
    blobs = (np.searchsorted(doc, np.arange(rows + 1)), seg, times, found.at, found.pair, found.n)
    cols = [pa.array([chunk], pa.int64()), _listed(ids.slice(i, rows))]
    cols += [_listed(pa.array(per[k], pa.int64())) for k in FIGURES] + [_listed(pa.array(sha, pa.string()))]
    cols += [pa.array([_pack(x)], pa.binary()) for x in blobs]
    cols += [_listed(pa.array(x, t)) for x, t in ((found.pairs >> 32, pa.int32()), (found.pairs & 0xFFFFFFFF, pa.int32()), (docs_of, pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["chunk", "doc_id", *FIGURES, "groups_sha256", *BLOBS, "a", "b", "n"])


def _listed(x: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def default_files() -> tuple[str, str, str]:
    """Paths of the byte-level vocabulary and the piece model, and the former's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def align_tokens(spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id", files: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every row.

    Texts that are null or empty, or that the tokens of one tokenizer don't give back (a space mark in the text),
    have zeros and an empty groups_sha256. A pair's count is the number of rows that hold it linked, repeated rows
    each for itself; n_best counts links of a count that is their first id's highest. n_overlaps are links whose
    ranges overlap. Ids may be null or repeated; an empty table gives an empty result; columns besides id and text
    aren't read. The driver reads the files and ships their bytes.
    """
    byte_path, piece_path, pattern = files or default_files()
    shipped = spark.sparkContext.broadcast((Path(byte_path).read_bytes(), pattern, Path(piece_path).read_bytes()))
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunk_size = CHUNK

    def run(batches):
        tok = tokenizers(*shipped.value)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_array(batch.column(1))
            for i, j in slices(texts, chunk_size):
                with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False}) as con:
                    out = _chunk(con, tok, batch.column(0), texts, i, j, chunk)
                yield out
                chunk += 1

    figures = "".join(f"{k} array<bigint>, " for k in FIGURES)
    blobs = "".join(f"{k} binary, " for k in BLOBS)
    scratch = Scratch(spark)
    chunks = docs.mapInArrow(released(run), f"chunk bigint, doc_id array<{kind}>, {figures}groups_sha256 array<string>, {blobs}a array<int>, b array<int>, n array<bigint>")
    chunks = scratch.table(chunks, "aligned-chunks")
    partial = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("chunk", "at", "p.*")
    counts = scratch.table(partial.groupBy("a", "b").agg(F.sum("n").alias("total")), "aligned-counts")
    top = counts.groupBy("a").agg(F.max("total").alias("top"))
    told = counts.join(top, "a").select("a", "b", "total", (F.col("total") == F.col("top")).alias("best"))
    wanted = partial.select("chunk", "at", "a", "b").join(told, ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "at", "total", "best")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        at, seg, times, seg_at, pair, n = (_unpack(left.column(k)[0].as_py()) for k in BLOBS)
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("at").to_numpy()
        total[place] = right.column("total").to_numpy()
        best[place] = right.column("best").to_numpy(zero_copy_only=False)
        count_sum = _sums(_sums(total[pair] * n, seg_at)[seg] * times, at)
        n_best = _sums(_sums(best[pair] * n, seg_at)[seg] * times, at)
        cols = {k: left.column(k).combine_chunks().flatten() for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        cols |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table(cols | {k: left.column(k).combine_chunks().flatten() for k in ("groups_sha256", "n_overlaps")})

    rows = chunks.select("chunk", "doc_id", *FIGURES, "groups_sha256", *BLOBS)
    out = rows.groupBy("chunk").cogroup(wanted.groupBy("of_chunk")).applyInArrow(
        add, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, n_overlaps bigint"
    )
    out = scratch.table(out, "aligned")
    scratch.drop_but(out)
    return out
