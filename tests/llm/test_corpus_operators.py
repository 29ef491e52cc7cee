"""Operators that compare or move documents, against SQL and brute force."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from fedloom.llm import components, mixing, ngram_join, queries, substring_dedup, warc
from fedloom.plans.session import Scratch, read_table

from ..helpers import same_as_sql
from .conftest import ODD, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(package, duck, data, name):
    same_as_sql(queries.queries()[name](package, data), duck, queries.oracle_sql()[name])


# -- substring dedup


def brute_dedup(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,anchor", [(35, 8), (6, 3), (4, 4)])
def test_remove_repeats_by_brute_force(package, window, anchor):
    rng = random.Random(window)
    texts = [t for _, t in ODD]
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 60))) for _ in range(6)]
    for _ in range(60):
        texts.append(" ".join(rng.choice([*passages, *(" ".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3))]) for _ in range(rng.randint(1, 5))))
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(package, documents(package, rows, extra=True), window=window, anchor=anchor).collect()}
    assert [got[k] for k in range(len(texts))] == brute_dedup(texts, window)


def test_remove_repeats_odd_rows(package, odd, none):
    rows = substring_dedup.remove_repeats(package, odd).collect()
    want = Counter(zip([i for i, _ in ODD], brute_dedup([t for _, t in ODD], 35), strict=True))
    assert Counter((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in rows) == want
    assert substring_dedup.remove_repeats(package, none).count() == 0


def test_phrases_of_more_words_than_one_automaton_holds():
    table = np.arange(1, 35 * 31_000 + 1, dtype=np.uint64).reshape(-1, 35)
    assert len(np.unique(table)) > substring_dedup.MOST_WORDS
    parts = substring_dedup.phrase_parts(table)
    assert (np.concatenate(parts) == table).all() and len(parts) == 2
    doc = np.concatenate((table[0], [0], table[-1])).astype(np.uint64)
    covers = [substring_dedup.PhraseAutomaton(p).covered(doc) for p in parts]
    assert np.flatnonzero(~(covers[0] | covers[1])).tolist() == [35] and not covers[0].all()


def test_confirmed_passages_are_the_repeated_windows():
    rng = random.Random(5)
    for w in (2, 5):
        for _ in range(60):
            texts = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
            more = [rng.random() < 0.2 for _ in texts]
            n = Counter()
            for t, m in zip(texts, more, strict=True):
                words = t.split()
                for i in range(len(words) - w + 1):
                    n[tuple(words[i : i + w])] += 1 + m
            raw = "".join(texts).encode()
            size = np.array([len(t) for t in texts])
            text, start, length = substring_dedup._confirmed(np.frombuffer(raw, np.uint8), size, np.array(more), w)
            found = Counter()
            for s, k in zip(start.tolist(), length.tolist(), strict=True):
                words = raw[s : s + k].decode().split()
                found.update(tuple(words[i : i + w]) for i in range(len(words) - w + 1))
            assert found == Counter({k for k, x in n.items() if x > 1})
            assert all(size[:r].sum() <= s < size[: r + 1].sum() for r, s in zip(text.tolist(), start.tolist(), strict=True))


def test_hot_anchors_and_many_automata(package, monkeypatch):
    rng = random.Random(8)
    hot = "u v w x"
    rows = [(k, " ".join([*rng.choices("abcdefgh", k=rng.randint(0, 9)), hot, *rng.choices("abcdefgh", k=rng.randint(0, 9))])) for k in range(150)]
    rows += [(k % 3, "one two three four five six seven") for k in range(40)]
    want = Counter(zip([k for k, _ in rows], brute_dedup([t for _, t in rows], 6), strict=True))
    monkeypatch.setattr(substring_dedup, "PHRASES", 7)
    for least in (2, 50):
        got = substring_dedup.remove_repeats(package, documents(package, rows), window=6, anchor=3, hot_least=least).collect()
        assert Counter((r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == want


def test_long_and_periodic_texts(package):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(100_000))
    alone = " ".join(str(rng.randrange(10**6)) for _ in range(50_000))
    rows = [(1, long), (2, f"x {long} y"), (3, "a " * 50_000), (4, "one line that stands here again and again\n" * 5_000), (5, alone)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(package, documents(package, rows), output="text").collect()}
    assert got == {1: (100_000, 100_000, ""), 2: (100_002, 100_000, "x y"), 3: (50_000, 50_000, ""), 4: (40_000, 40_000, ""), 5: (50_000, 0, alone)}


def test_locating_needs_the_phrases(package):
    """Without phrases no place is found: nothing but the automata knows one."""
    rows = documents(package, [(k, " ".join(map(str, range(50)))) for k in range(4)])
    docs = rows.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS k1", "xxhash64(text) AS k2")
    anchors = substring_dedup._recurring_anchors(package, docs, 35, 8, 2, 1024)
    phrases = substring_dedup._phrases(docs, anchors, 35, 8, 2)
    assert substring_dedup._located(docs, phrases, anchors, 35, 8, 2).count() >= 4
    assert substring_dedup._located(docs, phrases.limit(0), anchors, 35, 8, 2).count() == 0


# -- n-gram join


def brute_join(texts, n=5):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def variants(rng, groups, size):
    texts = []
    for _ in range(groups):
        base = [f"v{rng.randrange(60)}" for _ in range(rng.randint(5, 80))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"u{rng.randrange(9)}"
            texts.append(" ".join(t))
    return texts


def test_join_by_brute_force(package):
    rng = random.Random(11)
    texts = [t for _, t in ODD] + variants(rng, 12, 6) + variants(rng, 1, 60)
    rng.shuffle(texts)
    df = documents(package, list(enumerate(texts)), extra=True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(package, df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_join(texts)


def test_remaining_pairs_lose_nothing(package, monkeypatch):
    """With one hub and one nearest set, with small tiles, and with all columns frequent, results stay."""
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    monkeypatch.setattr(ngram_join, "NEAREST", 1)
    monkeypatch.setattr(ngram_join, "TILE", 7)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    texts = variants(random.Random(12), 3, 25)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(package, documents(package, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == brute_join(texts)


def test_join_odd_rows(package, odd, none):
    rows = ngram_join.similar_components(package, odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[1][0]["component_id"] == 1 and by[1][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2
    assert [r["component_id"] for r in by[7]] == [6, 6] and by[10][0]["component_id"] == 6
    assert {r["component_id"] for r in by[None]} == {None, 6}
    assert ngram_join.similar_components(package, none).count() == 0


def test_pairs_grow_with_a_group_and_not_with_its_square(package, monkeypatch):
    """Rows of pairs that one group of near copies makes, of all turns."""
    made = []
    compared = ngram_join._compared

    def counted(spark, scratch, docs, sets, pairs, percent):
        made.append(pairs.count())
        return compared(spark, scratch, docs, sets, pairs, percent)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    counts = []
    for size in (60, 240):
        rng = random.Random(4)
        base = [f"v{k}" for k in range(90)]
        texts = [" ".join(base[:k] + [f"u{rng.randrange(6)}"] + base[k + 1 :]) for k in (rng.randrange(90) for _ in range(size))]
        rows = ngram_join.similar_components(package, documents(package, list(enumerate(texts)))).collect()
        assert {r["component_id"] for r in rows} == {0}
        counts.append((sum(made), len(set(texts))))
        made.clear()
    for pairs, sets in counts:
        assert pairs <= 2 * (ngram_join.HUBS + ngram_join.NEAREST + ngram_join.SMALL) * sets


def test_a_few_outside_a_large_component_meet_all_of_it(package, monkeypatch):
    """Members of the largest component aren't tiled against each other, others are against all."""
    monkeypatch.setattr(ngram_join, "TILE", 5)
    monkeypatch.setattr(ngram_join, "FREQUENT", 10_000)
    texts = variants(random.Random(13), 1, 40) + variants(random.Random(14), 2, 12)
    shared = " ".join(f"s{k}" for k in range(30))
    texts += [f"{shared} {t}" for t in texts[:30]]
    for few in (1, 3):
        monkeypatch.setattr(ngram_join, "HUBS", few)
        monkeypatch.setattr(ngram_join, "NEAREST", few)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(package, documents(package, list(enumerate(texts)))).collect()}
        assert [got[k] for k in range(len(texts))] == brute_join(texts)


def test_work_tables_go(package):
    from fedloom.plans.session import shared_dir

    folder = Path(shared_dir(package).removeprefix("file://"))
    before = set(folder.iterdir())
    ngram_join.similar_components(package, documents(package, list(enumerate(variants(random.Random(15), 3, 6))))).collect()
    assert len({x.name.split("-")[1] for x in set(folder.iterdir()) - before}) <= 1


def test_bits_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        assert ngram_join.least_difference(ngram_join._bits(a), ngram_join._bits(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_long_path(package):
    links = package.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = dict(map(tuple, components.components(Scratch(package), links).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 43


# -- mixing


def test_mix_odd_rows(package, odd, none):
    rows = mixing.mix_sources(package, odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert mixing.mix_sources(package, none).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(package, documents(package, [(1, None), (2, "")])).collect()] == [0, 0]


def test_mix_of_single_documents_by_definition(package):
    """Late finish times count: of the third source, 1,290 words at time 2.04 still fit."""
    df = package.createDataFrame([(1, "w " * 1000, "a"), (2, "w " * 2610, "b"), (3, "w " * 1290, "c")], "doc_id bigint, text string, source string")
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_sources(package, df).collect()} == {1: 3000, 2: 0, 3: 1290}
    rng = random.Random(8)
    for _ in range(3):
        rows = [(k, "w " * rng.randint(1, 60), rng.choice("abcdefg")) for k in range(rng.randint(3, 14))]
        df = package.createDataFrame(rows, "doc_id bigint, text string, source string")
        got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix_sources(package, df).collect()}
        queue, times = defaultdict(int), []
        key = {k: hashlib.md5(f"{k}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest() for k, t, _ in rows}
        for k, t, s in sorted(rows, key=lambda r: (r[2], key[r[0]])):
            size, total, target, _ = got[k]
            queue[s] += size
            times += [((queue[s] + e * total) / target, s, key[k], k, e) for e in range(3)]
        left, taken = sum(x[0] for x in got.values()), dict.fromkeys(got, 0)
        for *_, k, _ in sorted(times):
            left -= got[k][0]
            if left < 0:
                break
            taken[k] += got[k][0]
        assert taken == {k: x[3] for k, x in got.items()}


def test_mix_comes_near_targets_and_repeats(package):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 40)))) for i in range(1500)]
    df = documents(package, rows)
    a = sorted(map(tuple, mixing.mix_sources(package, df).collect()))
    assert a == sorted(map(tuple, mixing.mix_sources(package, df.repartition(7)).collect()))
    taken, target = defaultdict(int), {}
    for _, _, source_size, goal, t in a:
        taken[source_size] += t
        target[source_size] = goal
    assert sum(target.values()) == pytest.approx(sum(target))
    for k, goal in target.items():
        assert abs(taken[k] - goal) < 0.02 * goal and goal <= 3 * k


# -- WARC


def payloads(records):
    return [x[4] for x in records if x[0] == "record"]


@pytest.mark.parametrize("size", [0, 1, 4_000, 4_096, 12_288, 100_000, 3_000_000])
def test_members_end_where_they_end(size):
    block = np.random.default_rng(size).bytes(size)
    raw = b"xyz" + gzip.compress(block) + gzip.compress(b"next") + b"junk" * 5_000
    stop = len(gzip.compress(block, mtime=0)) + 3
    assert warc._inflate(raw, 3) == (block, stop)
    assert warc._inflate(raw, stop)[0] == b"next"
    assert warc._inflate(raw[: stop - 1], 3) is None and warc._inflate(b"", 0) is None


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_skips_damage_and_logs_gaps(packed):
    wrap = warc.member if packed else (lambda x: x)
    recs = [wrap(warc.page_record(i, "http://x/", f"payload {i} é".encode() * 20, warc.digest32(f"payload {i} é".encode() * 20), None)) for i in range(6)]
    bad = bytearray(recs[2])
    bad[len(bad) // 2] ^= 0xFF
    raw = b"junk" + recs[0] + recs[1] + bytes(bad) + recs[3][: len(recs[3]) // 2] + recs[4] + b"\0\0" + recs[5][:-9]
    found = list(warc.salvage(raw))
    assert [p[:9] for p in payloads(found)] == [b"payload 0", b"payload 1", b"payload 4"]
    at = 0
    for kind, start, length, _, _ in found:
        assert start == at and length > 0
        at += length
    assert at == len(raw)
    assert list(warc.salvage(b"")) == []


def test_archives_round_trip(package):
    pages = [(1, "u", "same"), (5, "u", "same"), (3, "u\r\nx", "other"), (None, None, "same"), (7, "u", None), (9, "u", ""), (5, "u", "same"), (11, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")]
    df = package.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = warc.page_records(package, df).collect()
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    assert [g[2] for g in got] == ["revisit", "response", "response", "response", "revisit", "response", "response", "revisit"]
    assert [g[3] for g in got] == [5, None, None, None, 9, None, None, 5]
    for r in rows:
        body = next(h or "" for i, _, h in pages if i == r["page_id"]).encode()
        assert r["payload_digest"] == warc.digest32(body) and r["payload_bytes"] == len(body)
    full = warc.read_archives(warc.write_archives(package, df)).where("record_type = 'response'").collect()
    assert {bytes(r["payload"]) for r in full} == {(h or "").encode() for _, _, h in pages}
    assert warc.page_records(package, df.limit(0)).count() == 0


def test_small_payloads_are_never_revisits(package):
    df = package.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    rows = {r["page_id"]: r["record_type"] for r in warc.page_records(package, df, min_bytes=3).collect()}
    assert rows == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_pages_with_long_urls_stay_whole(package):
    url = "http://x/" + "y" * 200_000
    df = package.createDataFrame([(1, url, "one"), (2, url, "two"), (3, url, "one"), (4, "http://x/", "two")], "page_id bigint, url string, html string")
    rows = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_records(package, df).collect()}
    assert rows == {1: ("revisit", 3, 3), 2: ("revisit", 4, 3), 3: ("response", None, 3), 4: ("response", None, 3)}
    assert {r["target_uri"] for r in warc.read_archives(warc.write_archives(package, df)).collect()} == {url, "http://x/"}
    plain = b"".join(warc.page_record(i, url, b"x", warc.digest32(b"x"), None) for i in range(3))
    assert [kind for kind, *_ in warc.salvage(plain)] == ["record"] * 3


def test_gaps_in_own_archives_are_errors(package, monkeypatch):
    df = package.createDataFrame([("a", warc.member(warc.page_record(1, "u", b"x", warc.digest32(b"x"), None)) + b"junk")], "archive string, content binary")
    monkeypatch.setattr(warc, "write_archives", lambda *a, **b: df)
    with pytest.raises(Exception, match="a gap in a at"):
        warc.page_records(package, df).collect()


# -- the whole queries


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op11_search"}))  # its rows are items and ranks
def test_query_has_a_row_for_each_row(package, data, name):
    table = {"op5_warc": "pages", "op13_vectors": "embeddings"}.get(name, "documents")
    assert queries.queries()[name](package, data).count() == read_table(package, data, table).count()


# -- bounds


def test_long_headers_are_read_behind_damage():
    """A version line is enough, whatever the headers' length; many false ones take no longer than their bytes."""
    payload = b"x" * 100
    plain = warc.page_record(7, "http://a/" + "b" * 70_000, payload, warc.digest32(payload), None)
    found = list(warc.salvage(b"damaged" + plain))
    assert [(x[0], x[1]) for x in found] == [("gap", 0), ("record", 7)]
    assert found[1][4] == payload
    false = b"WARC/1.1\r\nA: b\r\n" * 20_000
    found = list(warc.salvage(b"?" + false + plain))
    assert [x[0] for x in found] == ["gap", "record"] and found[1][4] == payload
    assert [x[0] for x in warc.salvage(b"?" + false)] == ["gap"]
    assert [x[0] for x in warc.salvage(b"?WARC/1.1\r\n\r\n" + plain)] == ["gap", "record"]


def test_a_hot_payload_is_dealt_by_id(package):
    rows = [(k, "u", "same") for k in range(500)] + [(None, "u", "same"), (600, None, None), (601, None, "")]
    df = package.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.page_records(package, df).collect()}
    assert got[499] == ("response", None) and got[0] == ("revisit", 499) and got[None] == ("revisit", 499)
    assert got[600] == ("revisit", 601) and got[601] == ("response", None)
