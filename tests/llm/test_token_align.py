"""Alignment of two tokenizers against the libraries on whole texts, by definition."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from fedloom.llm import token_align

from .conftest import ODD, documents

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def brute(libraries, texts):
    first, second = libraries
    alphabet = token_align.byte_alphabet()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a = first.encode(" " + t, add_special_tokens=False)
        ia = [(i, bytes(alphabet[c] for c in s)) for i, s in zip(a.ids, a.tokens, strict=True)]
        ib = [(i, bytes([int((p := second.id_to_piece(i))[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(t)]
        want = (" " + t).encode()
        if b"".join(x for _, x in ia) != want or b"".join(x for _, x in ib) != want:
            docs.append(None)
            continue
        spans = []
        for ids in (ia, ib):
            at, out = 0, []
            for i, x in ids:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, p, q = [], 0, 0
        for e in ends:
            g = ([], [])
            while p < len(spans[0]) and spans[0][p][2] <= e:
                g[0].append(spans[0][p])
                p += 1
            while q < len(spans[1]) and spans[1][q][2] <= e:
                g[1].append(spans[1][q])
                q += 1
            groups.append(g)
        docs.append((len(spans[0]), len(spans[1]), groups))
    count = Counter()
    for d in docs:
        if d:
            count.update({(a[0], b[0]) for g in d[2] for a in g[0] for b in g[1]})
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        links = [(a, b) for g in d[2] for a in g[0] for b in g[1]]
        text = ";".join(",".join(str(a[0]) for a in g[0]) + "|" + ",".join(str(b[0]) for b in g[1]) for g in d[2])
        n = [count[a[0], b[0]] for a, b in links]
        out.append((d[0], d[1], len(d[2]), len(links), sum(x == top[a[0]] for x, (a, _) in zip(n, links, strict=True)), sum(n), hashlib.sha256(text.encode()).hexdigest(), sum(a[1] < b[2] and b[1] < a[2] for a, b in links)))
    return out


def check(spark, libraries, rows, **how):
    out = token_align.align_tokens(spark, documents(spark, rows, extra=True), **how)
    assert out.columns == COLUMNS
    want = Counter((i, *x) for (i, _), x in zip(rows, brute(libraries, [t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in out.collect()) == want


def strange(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "'s", "'ll", "don't", "▁", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x0A>", "é", "ß", "日本", "😀", "\x00", "1234", "3.14", "--", "...", "aaaa", "The", "ing", "tion", "x", "_", "\r\n", "́", "Ω", "ﬁ", "½"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_odd_rows(package, libraries):
    check(package, libraries, ODD)
    assert token_align.align_tokens(package, documents(package, [])).count() == 0
    check(package, libraries, [(1, None), (2, ""), (3, None)])


def test_strange_texts(package, libraries):
    check(package, libraries, list(enumerate(strange(1, 400))))


def test_small_chunks_give_the_same(package, libraries, monkeypatch):
    monkeypatch.setattr(token_align, "CHUNK", 300)
    check(package, libraries, [*enumerate(strange(2, 120)), (7, "the the the"), (7, "the the the")])


def test_query_over_the_documents(package, libraries, data):
    from fedloom.llm import queries
    from fedloom.plans.session import read_table

    rows = [(r["doc_id"], r["text"]) for r in read_table(package, data, "documents").collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute(libraries, [t for _, t in rows]), strict=True))
    assert Counter(tuple(r) for r in queries.queries()["op12_alignment"](package, data).collect()) == want


def test_vocabularies_out_of_order_are_refused():
    import json
    from pathlib import Path

    a, b, pattern = token_align.default_files()
    spec = json.loads(Path(a).read_text())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        token_align.Tokenizers(json.dumps(spec).encode(), pattern, Path(b).read_bytes())
