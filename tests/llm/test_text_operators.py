"""One-pass operators over texts, against brute force and libraries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fedloom.llm import license_scan, media, order_minhash, pii, piece_codec, quality, textscan
from fedloom.plans.session import read_table

from .conftest import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [t or "" for _, t in ODD]


def by_text(rows, texts=TEXTS):
    """Rows come in order: one pass keeps it."""
    assert len(rows) == len(texts)
    return zip(rows, texts, strict=True)


# -- words


def test_words_and_hashes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\té😀") for _ in range(rng.randint(0, 30))) for _ in range(300)] + TEXTS
    w = textscan.Words(pa.array(texts), 0, len(texts))
    seen = {}
    h = w.hashes()
    for r, t in enumerate(texts):
        assert [x.decode() for x in w.of(r)] == WORD.findall(t)
        for k, x in enumerate(WORD.findall(t)):
            assert seen.setdefault(x, h[w.first[r] + k]) == h[w.first[r] + k]
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("k", [1, 2, 5, 8, 35])
def test_sequence_hashes_depend_on_order(k):
    x = np.arange(1, 60, dtype=np.uint64)
    a, b = textscan.sequence_mix(x, k), textscan.sequence_mix(x[::-1].copy(), k)
    assert len(a) == 60 - k and len(set(a.tolist()) | set(b.tolist())) == (2 * len(a) if k > 1 else len(a))
    assert textscan.sequence_mix(np.concatenate((x, x)), k)[59] == a[0]


# -- SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


@pytest.fixture(scope="module")
def codec():
    return piece_codec.codec_at(piece_codec.default_model())


def test_codec_equals_the_library(library, codec, spark, data):
    rng = random.Random(3)
    bits = [" ", "  ", " " * 11, " " * 40, "▁", "\n", "\t", "\0", "é", "日", "①", "😀", "th", "The", "ing", "23", "...", "!!", "<s>", "</s>", "<unk>", "<0x41>", "⁇", "﻿", "\xa0", "z" * 5, "�"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [r["text"] for r in read_table(spark, data, "documents").select("text").collect()] + [t for t in TEXTS if len(t) < 10_000]
    for t in texts:
        ids = library.encode(t)
        joined, n, decoded = codec.results(t)
        assert codec.encode(t) == ids and n == len(ids) and joined == ",".join(map(str, ids))
        assert decoded == codec.decode(ids) == library.decode(ids)


def test_decode_of_any_ids(library, codec):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(2, 400) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_encode_column(library, odd, none):
    rows = piece_codec.encode_column(odd, output="ids").collect()
    for r, t in by_text(rows):
        ids = library.encode(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_column(none).count() == 0


def test_models_that_change_text_are_refused():
    with pytest.raises(ValueError):
        piece_codec.PieceCodec(b"")


# -- licences


def brute_phrases(text):
    words = [w.decode() for w in license_scan.words_of(text.encode())]
    found = []
    for p, label in license_scan.PHRASES.items():
        p = p.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


LICENSED = [
    "Licensed under the Apache License, Version 2.0.", "x\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. CC-BY cc  by!", "the mit license MIT LICENSE mit", "gnu general public", "CC\nBY", "ccby cc", "café mit license",
]


def test_scan_licenses(package, odd, none):
    texts = LICENSED + TEXTS
    rows = license_scan.scan_licenses(documents(package, list(enumerate(texts)), extra=True)).collect()
    for r, t in by_text(rows, texts):
        n, found = brute_phrases(t)
        labels = sorted({x for _, x in found})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(found), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert rows[0]["score"] == 1 and "gpl-3" in rows[1]["labels"] and "cc-by-nc" in rows[2]["labels"]
    assert license_scan.scan_licenses(none).count() == 0


def test_matching_statistics_by_brute_force():
    rng = random.Random(5)
    seqs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(4)]
    auto = license_scan.SuffixAutomaton(seqs)
    text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(300)]
    for i, (s, n) in enumerate(auto.statistics(text)):
        def stands(k):
            part = text[i + 1 - k : i + 1]
            return any(q[j : j + k] == part for q in seqs for j in range(len(q) - k + 1))

        assert (n == 0 or stands(n)) and (n > i or not stands(n + 1))
        for k, end in auto.ends[s] if n else ():
            assert seqs[k][end - n + 1 : end + 1] == text[i + 1 - n : i + 1]


def test_notice_matches_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        notices = [("x", " ".join(rng.choice("abc") for _ in range(rng.randint(2, 14)))) for _ in range(4)]
        scanner = license_scan.Scanner(notices, {}, min_match=3)
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        got = scanner.matches([(100, text)])
        for k, (_, notice) in enumerate(scanner.notices):
            want = []
            for a in range(len(text)):
                for p in range(len(notice)):
                    if a and p and text[a - 1] == notice[p - 1]:
                        continue
                    n = 0
                    while a + n < len(text) and p + n < len(notice) and text[a + n] == notice[p + n]:
                        n += 1
                    if n >= 3:
                        want.append((100 + a, p, n))
            assert got.get(k, []) == sorted(want)


def test_each_notice_gives_its_label_and_two_fifths_of_it_do_not(package):
    long = [(label, text.split()) for label, text in license_scan.NOTICES if len(text.split()) >= 15]
    whole = [f"some words before {' '.join(w)} and after" for _, w in long]
    part = [f"some words before {' '.join(w[: len(w) * 2 // 5])} and after" for _, w in long]
    rows = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan_licenses(documents(package, list(enumerate(whole + part)))).collect()}
    for k, (label, _) in enumerate(long):
        assert label in rows[k]
        assert label in license_scan.PHRASES.values() or label not in rows[k + len(long)]


def test_notices_are_covered_by_one_chain(package):
    far = "word " * 40
    one, two = "This work is licensed under the terms below ", "see the GNU General Public License version 3 "
    whole = "This work is licensed under the GNU General Public License, version 3"
    texts = [one + far + two, two + far + one, two + one, far + whole, f"{whole} {far}{whole}", "This work is licensed under the well known GNU General Public License, version 3", "to use, copy, modify, and/or distribute this software"]
    rows = license_scan.scan_licenses(documents(package, list(enumerate(texts)))).collect()
    for r in rows[:3]:
        assert r["labels"] == "gpl" and r["score"] == 7 / 12 and r["spans"] == ""
    assert [r["spans"] for r in rows[3:6]] == ["gpl-3:40:52", "gpl-3:0:12,gpl-3:52:64", "gpl-3:0:14"] and all(r["score"] == 1 for r in rows[3:6])
    # words that two notices share count for both, also where another one has a longer match
    shared = license_scan.Scanner([("x", "a b c d e f g"), ("y", "z b c d e f")], {})
    assert {k: share for share, k, _, _ in shared.spans([(0, b"a b c d e f".split())])} == {0: 6 / 7, 1: 5 / 6}


# -- media


def test_store_text(package, odd, none):
    rows = media.store_text(odd, with_media=True).collect()
    for r, t in by_text(rows):
        raw = t.encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["media_bytes"] == len(r["media"])
        (track,) = media.read_media(r["media"])
        assert media.payload_of(r["media"], track) == padded and track["samples"] == len(padded) // 576 == len(track["keyframes"])
        assert b"".join(bytes(r["media"])[a : a + n] for a, n in track["keyframes"]) == padded
    assert media.store_text(none).count() == 0


def test_broken_media(package):
    good = media.write_media(bytes(576))
    for cut in (1, 20, 300, len(good) - 5):
        with pytest.raises(media.MediaError):
            media.read_media(good[:cut] if cut > 1 else good + b"x")
    df = package.createDataFrame([(1, good), (2, good[:40]), (3, None)], "doc_id int, media binary")
    rows = {r["doc_id"]: r for r in media.media_column(df, keep=("doc_id",)).collect()}
    assert rows[1]["codec"] == "raw " and rows[1]["keyframes"][0]["bytes"] == 576 and rows[2]["error"] and rows[3]["error"] == "no bytes"


# -- personal data

BRUTE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := [int(c) for c in s if c.isdigit()]) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, (r, ok) in BRUTE.items() for m in re.finditer(r, t) if ok(m[0])]


def test_base_spans_equal_the_patterns(spark, data):
    rng = random.Random(6)
    bits = list("0123456789") * 2 + list(".-+ ()@ab_%Z") + ["4111111111111111", "1.2.3.4", "a@b.co", "+1 (555) 123-4567", " ", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(10_000)] + [r["text"] for r in read_table(spark, data, "documents").select("text").collect()]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_field_finds_secrets_and_leaves_prose(package, odd, none):
    key = "0123456789abcdef0123456789abcdef01234567"
    texts = [f'das token = "{key}" ist, a@b.co é +1 (555) 123-4567', "It was late. They went home. Once more.", *TEXTS]
    rows = pii.find_personal_data(documents(package, list(enumerate(texts)), extra=True)).collect()
    for r, t in by_text(rows, texts):
        base = brute_spans(t)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base))
    at = texts[0].index(key)
    assert f"secret:{at}:{at + len(key)}" in rows[0]["spans"] and rows[1]["spans"] == ""
    clean = pii.find_personal_data(documents(package, [(1, texts[0]), (2, None)]), output="redacted").collect()
    assert clean[0]["text"] == 'das token = "[secret]" ist, [email] é [phone]' and clean[1]["text"] is None
    assert pii.find_personal_data(none).count() == 0


def test_redaction_hands_back_a_slice_at_a_time():
    class Frame:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    texts = [f"{k} a@b.co " + "plain words " * 20_000 if k % 7 else None for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = list(pii.find_personal_data(Frame(), output="redacted")(iter([batch.slice(1)])))
    assert max(b.nbytes for b in out) <= textscan.CHUNK + 1000
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"doc_id": k, "text": t and t.replace("a@b.co", "[email]")} for k, t in enumerate(texts)][1:]


def test_viterbi_by_brute_force():
    import itertools

    rng = np.random.default_rng(2)
    field = pii.Field([], rng.normal(size=(3, 3)).astype(np.float32))
    length = np.array([3, 1, 5, 2])
    first = np.array([0, 3, 4, 9])
    scores = rng.normal(size=(11, 3)).astype(np.float32)
    got = field.decode(scores, first, length)
    for a, n in zip(first, length, strict=True):
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) + sum(field.move[x, y] for x, y in zip(p, p[1:], strict=False)))
        assert tuple(got[a : a + n]) == best


def uncut(field, scores):
    best, back = scores[0].astype(np.float64), []
    for s in scores[1:]:
        ways = best[:, None] + field.move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + s
    labels = [int(best.argmax())]
    for b in back[::-1]:
        labels.append(int(b[labels[-1]]))
    return labels[::-1]


def test_long_lines_are_decoded_whole():
    rng = np.random.default_rng(3)
    length = np.array([1, 700, 128, 129, 0, 256, 5, 127, 1000, 257, 300])
    first = np.cumsum(length) - length
    for scale in (0.2, 1, 3):
        scores = (scale * rng.normal(size=(length.sum(), 3))).astype(np.float32)
        field = pii.Field([], (3 * rng.normal(size=(3, 3))).astype(np.float32))
        got = field.decode(scores, first, length)
        for a, n in zip(first, length, strict=True):
            assert n == 0 or got[a : a + n].tolist() == uncut(field, scores[a : a + n])


def test_spans_keep_their_cues_anywhere_in_long_lines():
    field = pii.train()
    for what in ("password = x7Kp93qTz41LmW8b and then the rest", "we met Mr. Thomas Miller in the town"):
        for n in (4, *range(120, 132), 254, 255, 256, 2000):
            lead = "word " * n
            ((_, more),) = pii.scan(pa.array([lead + what]), field)
            ((_, near),) = pii.scan(pa.array(["word " * 10 + what]), field)
            assert near and more == [(k, a + len(lead) - 50, b + len(lead) - 50) for k, a, b in near]


def test_training_fits_its_table():
    words, gold = pii._table()
    field = pii.train()
    line, first, length = pii.lines_of(words)
    assert (field.decode(field.scores(pii.word_features(words), line), first, length) == gold).mean() > 0.99


# -- quality


def test_classifier_on_held_out_rows(package, data):
    sf = data.replace("sf0.001", "sf0.01")
    docs, labels = read_table(package, sf, "documents"), read_table(package, sf, "labels")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    for r in out:
        assert zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95
    good = [r for r in out if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in good]) > 0.97


def test_classifier_odd_rows(package, odd, none, data):
    labels = package.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).count() == len(ODD)
    same = {r["score"] for r in rows if r["doc_id"] == 7}
    assert len(same) == 1


def test_margins_by_a_dense_model():
    """The same model on a dense matrix: n-grams by definition, log-count ratios, hinge loss by projected gradient on the dual."""
    rng = random.Random(21)
    good, bad = [f"g{k}" for k in range(12)], [f"b{k}!" for k in range(12)]
    both = [f"c{k}" for k in range(12)]
    texts = [" ".join(rng.choice((good if k % 2 else bad) + both) for _ in range(rng.randint(4, 12))) for k in range(60)]
    y = np.array([1 if k % 2 else -1 for k in range(60)])
    arr = pa.array(texts)
    row, feature = quality.features(textscan.Words(arr, 0, len(texts)))
    rows = [feature[row == r] for r in range(len(texts))]
    # indicators of n-grams by definition: as many as the hashed ones, but for clashes
    for r in (0, 1, 2):
        w = texts[r].split()
        words = {tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
        assert 0 <= len(words) <= len(rows[r]) <= len(words) + 3 * len(w)
    used = np.unique(np.concatenate(rows))
    x = np.zeros((60, len(used)))
    for r, f in enumerate(rows):
        x[r, np.searchsorted(used, f)] = 1
    p, q = x[y > 0].sum(axis=0), x[y < 0].sum(axis=0)
    absent = (1 << quality.BITS) - len(used)
    a, b = quality.ALPHA + p, quality.ALPHA + q
    ratio = np.log((a / (a.sum() + absent * quality.ALPHA)) / (b / (b.sum() + absent * quality.ALPHA)))
    ratio[p + q < 2] = 0
    z = x * ratio
    norm = np.sqrt((z**2).sum(axis=1))
    z = np.hstack([z / np.where(norm > 0, norm, 1)[:, None], np.ones((60, 1))])
    gram, alpha = (z @ z.T) * np.outer(y, y), np.zeros(60)
    limit = quality.COST  # both classes are of one size here
    step = 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, limit)
    want = z @ (z.T @ (alpha * y))
    model = quality.fit([(f, int(v > 0)) for f, v in zip(rows, y, strict=True)])
    got = model.margins(row, feature, 60)
    assert np.abs(got - want).max() < 0.05 and (np.sign(got) == np.sign(want)).all()


def test_scores_replace_columns_of_their_names(package, data):
    model = quality.fit([(np.array([1, 2]), 1), (np.array([2, 3]), 0)])
    df = package.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 7), (None, None, "y", 8)], "doc_id bigint, text string, score string, predicted int")
    out = quality.score_quality(df, model)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "score", "predicted"] and len(rows) == 3 and rows[0] == rows[1] and isinstance(rows[2]["score"], float)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [(np.unique(np.concatenate(([int(y)], rng.integers(10, 200, 5)))).astype(np.int32), int(y)) for y in rng.integers(0, 2, 300)]
    m = quality.fit(rows)
    score = [m.scores(m.margins(np.zeros(len(f), np.int64), f, 1))[0] for f, _ in rows]
    assert all((s >= 0.5) == y for s, (_, y) in zip(score, rows, strict=True))


# -- fingerprints


def test_signatures_of_short_equal_and_repetitive_texts():
    sign = lambda t: order_minhash.signature(order_minhash.points_of(t))
    assert not sign("").any()
    for t in ("a", "abc", "x" * 5000, "ab" * 3000, PROSE_ := " ".join(map(str, range(3000)))):
        assert (sign(t) == sign(t)).all() and sign(t).any()
    near = order_minhash.likeness(sign(PROSE_), sign(PROSE_.replace("1500", "fifteen")))
    moved = order_minhash.likeness(sign(PROSE_), sign(PROSE_[len(PROSE_) // 2 :] + PROSE_[: len(PROSE_) // 2]))
    assert near > 0.8 > moved > 0.1  # the same k-mers in another order differ


def test_signature_by_definition():
    t = "the cat and the cat and the dog and the cat"
    h = order_minhash._kmers(order_minhash.points_of(t))
    seen, keyed = {}, []
    for x in h.tolist():
        keyed.append((x + seen.get(x, 0) * 0xA0761D6478BD642F) % (1 << 64))
        seen[x] = seen.get(x, 0) + 1
    want = []
    for seed in order_minhash._SEEDS.tolist():
        ranks = [int(textscan.mix(np.array([k ^ seed], np.uint64))[0]) for k in keyed]
        a, b = sorted(sorted(range(len(h)), key=ranks.__getitem__)[:2])
        x = (int(h[a]) * 0xD1342543DE82EF95 + int(h[b]) + seed) % (1 << 64)
        want.append(int(textscan.mix(np.array([x], np.uint64))[0]) >> 32)
    assert order_minhash.signature(order_minhash.points_of(t)).tolist() == want


@pytest.mark.parametrize("ranked", [1, order_minhash.RANKED])
def test_signatures_rank_all_occurrences(monkeypatch, ranked):
    monkeypatch.setattr(order_minhash, "RANKED", ranked)
    rng = random.Random(9)
    for n, signs in ((150, "ab"), (300, "abcdefgh "), (3000, "ab"), (9000, "abcdefghijklmnop "), (30_000, "abcd")):
        h = order_minhash._kmers(order_minhash.points_of(t := "".join(rng.choice(signs) for _ in range(n))))
        seen, numbers = {}, []
        for x in h.tolist():
            numbers.append(seen.get(x, 0))
            seen[x] = numbers[-1] + 1
        keyed = h + np.array(numbers, np.uint64) * np.uint64(0xA0761D6478BD642F)
        want = []
        for seed in order_minhash._SEEDS:
            a, b = sorted(np.argsort(textscan.mix(keyed ^ seed), kind="stable")[:2].tolist())
            want.append(int(textscan.mix(h[a : a + 1] * np.uint64(0xD1342543DE82EF95) + h[b] + seed)[0]) >> 32)
        assert order_minhash.signature(order_minhash.points_of(t)).tolist() == want


def test_edited_neighbours(package, odd, none):
    rows = [(i, t) for i, t in ODD if i is not None and i != 7] + [(7, "seven " * 40)]
    got = {r["doc_id"]: r for r in order_minhash.edited_neighbours(package, documents(package, rows, extra=True).repartition(5)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        changed = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        sign = {x: order_minhash.signature(order_minhash.points_of(x)) for x in (t, after, changed)}
        assert r["fingerprint"] == order_minhash.hexed(sign[t]) and r["edited_fingerprint"] == order_minhash.hexed(sign[changed])
        assert r["near_next"] == order_minhash.likeness(sign[t], sign[after]) and r["near_edited"] == order_minhash.likeness(sign[t], sign[changed])
    assert order_minhash.edited_neighbours(package, odd).count() == len(ODD)
    assert order_minhash.edited_neighbours(package, none).count() == 0
    one = order_minhash.edited_neighbours(package, documents(package, [(1, "alone at last")])).first()
    assert one["near_next"] == 1.0


def test_labelled_rows_are_invented():
    """No span, no long token and no whole line of the table stands in any document."""
    texts = "\n".join(t or "" for d in ("sf0.001", "sf0.01", "sf0.1") for t in pq.read_table(f"/root/testdata/{d}/documents.parquet", columns=["text"])["text"].to_pylist())
    for line in pii.LABELLED.strip().split("\n"):
        plain = re.sub(r"\[\w+:([^\]]*)\]", r"\1", line)
        assert plain not in texts
        for found in re.findall(r"\[\w+:([^\]]*)\]", line) + [w for w in plain.split() if len(w) > 12]:
            assert found not in texts, found


def held_out_lines():
    """Planted rows of forms that the table has, with other words: (line, kind, span)."""
    rng = random.Random(79)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    out = []
    for _ in range(40):
        for form, value in (('lorem ipsum token = "{}" dolor sit', hexes(40)), ("amet, secret = {} consectetur", mixed(24)), ("elit password: {} sed do", mixed(14) + "7"), ("tempor api_key = {} ut labore", hexes(32))):
            out.append((form.format(value), "secret", value))
    first, last = ["Maria", "Jean", "Anna", "Pablo", "Greta", "Ivan", "Lucia", "Omar"], ["Keller", "Dupont", "Schmidt", "Moreno", "Larsen", "Petrov", "Rossi", "Haddad"]
    for f in first:
        for x in last:
            for form in ("yesterday Mr. {} came home", "ask Dr. {} about it", "name: {} , of this town"):
                out.append((form.format(f"{f} {x}"), "name", f"{f} {x}"))
    return out


def test_held_out_names_and_secrets(package):
    """Recall on planted lines and precision beside clean ones; README has these figures."""
    planted = held_out_lines()
    rng = random.Random(78)
    words = "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore et magna aliqua".split()
    clean = [" ".join(rng.choice(words).capitalize() if k % 7 == 0 else rng.choice(words) for k in range(rng.randint(3, 20))) + "." for _ in range(400)]
    df = package.createDataFrame([(k, t) for k, t in enumerate([p[0] for p in planted] + clean)], "doc_id bigint, text string")
    got = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.find_personal_data(df).collect()}
    hit, wrong = Counter(), 0
    for k, (line, kind, value) in enumerate(planted):
        at = line.index(value)
        hit[kind] += any(x[0] == kind and int(x[1]) <= at + 1 and int(x[2]) >= at + len(value) - 1 for x in got[k])
        hit[f"all {kind}"] += 1
    wrong = sum(bool(got[k]) for k in range(len(planted), len(planted) + len(clean)))
    print(dict(hit), wrong)
    assert hit["secret"] >= 0.9 * hit["all secret"] and hit["name"] >= 0.95 * hit["all name"] and wrong <= 4


def test_training_is_bounded_in_rows_and_features(package, monkeypatch):
    """One row for each id, the one of least text hash; features end at the bound."""
    texts = [f"Good plain words number {k} of the set." for k in range(40)]
    docs = package.createDataFrame([(k % 4, t) for k, t in enumerate(texts)] + [(9, "lone text")], "doc_id bigint, text string")
    labels = package.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda examples: seen.append(examples))
    allowed = sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in (0, 1, 2, 3, 9))
    quality.train(docs, labels)
    assert len(seen[-1]) == allowed
    quality.train(docs, labels.where("doc_id < 4"), limit=2)
    assert len(seen[-1]) == 2
    quality.train(docs, labels, most=60)
    assert 1 <= len(seen[-1]) < allowed and sum(len(f) for f, _ in seen[-1][1:]) <= 60
    quality.train(docs, labels, most=1)
    assert len(seen[-1]) == 1


def test_whole_licences_are_covered_as_one_span(package):
    """Each licence as a whole, with a name filled in and a line changed, beside prose; three clauses aren't taken for two."""
    whole = license_scan.templates()[len(license_scan.NOTICES) :]
    texts = [f"Copyright 2020 Anna Kurz. {t.replace('IMPLIED', 'implied or other', 1)} and nothing else stands here" for _, t in whole]
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(documents(package, list(enumerate(texts)))).collect()}
    for k, (label, text) in enumerate(whole):
        assert label in rows[k]["labels"].split(",")
        spans = [x.split(":") for x in rows[k]["spans"].split(",")]
        longest = max(int(b) - int(a) for name, a, b in spans if name == label)
        assert longest >= 0.9 * len(license_scan.words_of(text.encode()))
    three = [label for label, _ in whole].index("bsd-3-clause")
    assert "bsd-2-clause" not in rows[three]["labels"].split(",")


def brute_chain(scanner, matches):
    """Most words of any chain, over all sequences of matches."""
    best = 0

    def go(last, words):
        nonlocal best
        best = max(best, words)
        for a, p, n in matches:
            if last is None:
                go((a, p, n), n)
            else:
                a0, p0, n0 = last
                gap, skip = a - a0 - n0, p - p0 - n0
                if a0 < a and p0 < p and a0 + n0 < a + n and p0 + n0 < p + n and gap - skip <= scanner.max_gap:
                    go((a, p, n), words + n + min(0, gap, skip))

    go(None, 0)
    return best


def test_chains_by_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        notice = [rng.choice("abcd") for _ in range(rng.randint(6, 14))]
        scanner = license_scan.Scanner([("x", " ".join(notice))], {}, min_match=2, max_gap=rng.randint(0, 3))
        text = []
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(notice))
            text += [rng.choice("abcde") for _ in range(rng.randint(0, 4))] + notice[i : i + rng.randint(1, 5)]
        found = scanner.matches([(0, [w.encode() for w in text])]).get(0, [])
        if found and len(found) < 14:
            assert scanner.chained(0, found)[0][0] == brute_chain(scanner, found)
