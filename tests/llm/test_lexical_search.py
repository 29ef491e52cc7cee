"""Ranked search against its SQL, and by definition on whole documents."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from fedloom.llm import lexical_search as ls
from fedloom.llm import queries

from ..helpers import same_as_sql
from .conftest import ODD, documents


def brute(docs, items, k=10):
    terms = [ls.TERM.findall((t or "").translate(ls._LOWER)) for _, t in docs]
    full = [x for x in terms if x]
    n, total = len(full), sum(map(len, full))
    df = Counter(t for x in full for t in set(x))
    out = []
    for item, text in items:
        scores = []
        for (doc, _), x in zip(docs, terms, strict=True):
            tf = Counter(x)
            s = 0
            for t in set(ls.TERM.findall((text or "").translate(ls._LOWER))):
                if tf[t]:
                    m = 10 + 90 * len(x) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if s > 0:
                scores.append((s, doc))
        out += [(item, r + 1, doc, s) for r, (s, doc) in enumerate(sorted(scores, key=ls.better)[:k])]
    return Counter(out)


def found(spark, docs, items):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, rank int, score int")
    out = ls.rank_documents(spark, documents(spark, docs, extra=True), items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in out.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    pick = lambda m: " ".join(words[min(299, int(rng.paretovariate(0.6)) - 1)] for _ in range(m))
    docs = [(k, pick(rng.choice([1, 5, 40, 200]))) for k in range(n)]
    docs += [(n + k, docs[k][1]) for k in range(20)]  # copies: ties
    return docs, [(k, pick(rng.randint(1, 30))) for k in range(25)]


def test_op11_equals_sql(package, duck, data):
    same_as_sql(queries.queries()["op11_search"](package, data), duck, queries.oracle_sql()["op11_search"])


@pytest.mark.parametrize("shard", [200, 5000, 1 << 23])
def test_search_by_brute_force(package, monkeypatch, shard):
    monkeypatch.setattr(ls, "SHARD", shard)
    docs, items = corpus(shard, 300)
    assert found(package, docs, items) == brute(docs, items)


def test_items_in_blocks_and_odd_rows(package, monkeypatch):
    monkeypatch.setattr(ls, "ITEM_BYTES", 300)
    items = [(1, None), (2, ""), (3, "W1 w2 two ONE"), (3, "W1 w2 two ONE"), (None, "same x"), (5, "ÉÉ é 日本"), (6, "nothing-like-it"), (7, " ".join(f"w{i}" for i in range(300)))]
    assert found(package, ODD, items) == brute(ODD, items)
    assert found(package, [], items) == Counter()
    assert found(package, [(1, None), (2, "...")], items) == Counter()
    assert found(package, ODD, []) == Counter()


def least_cost(s, longest, cost):
    best = [0]
    for i in range(1, len(s) + 1):
        best.append(min(best[j] + cost + sum(max(s[j:i]) - x for x in s[j:i]) for j in range(max(0, i - longest), i)))
    return best[-1]


def test_blocks_are_best_cuts():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 60)
    at = np.append(0, np.cumsum(sizes)).astype(np.int32)
    score = rng.integers(1, 1000, int(at[-1])).astype(np.int32)
    end, top = ls.variable_blocks(score, at, longest=9, cost=700, held=16)
    assert set(at[1:].tolist()) <= set(end.tolist())
    begin = np.append(0, end[:-1])
    assert (end - begin).max() <= 9
    assert [score[a:b].max() for a, b in zip(begin, end, strict=True)] == top.tolist()
    for i in range(len(sizes)):
        s = score[at[i] : at[i + 1]].tolist()
        mine = [(a, b, m) for a, b, m in zip(begin, end, top, strict=True) if at[i] <= a < at[i + 1]]
        assert sum(700 + int(m) * (b - a) for a, b, m in mine) - sum(s) == least_cost(s, 9, 700)
    lone, _ = ls.variable_blocks(score[:30], np.array([0, 30]), piece=7)
    assert {7, 14, 21, 28, 30} <= set(lone.tolist())


def test_blocks_are_skipped():
    """With a good threshold most postings aren't looked at, and the best are still found."""
    rng = np.random.default_rng(2)
    rows = np.sort(rng.choice(20_000, 12_000, replace=False)).astype(np.int32)
    rare = np.sort(rng.choice(20_000, 30, replace=False)).astype(np.int32)
    docs = np.concatenate((rows, rare))
    at = np.array([0, len(rows), len(docs)], np.int32)
    impact = rng.integers(1000, 400_000, len(docs)).astype(np.int32)
    end, top = ls.variable_blocks(impact, at)
    import pyarrow as pa

    shard = ls.Shard(pa.array(np.arange(20_000)), pa.array(["a", "b"]), at, docs, impact, np.searchsorted(end, at, side="right").astype(np.int32), end, top)
    weights = np.array([100, 5000])
    got, scores = shard.search(np.array([0, 1]), weights, 10, 0)
    whole = np.zeros(20_000, np.int64)
    for t in (0, 1):
        whole[docs[at[t] : at[t + 1]]] += weights[t] * impact[at[t] : at[t + 1]].astype(np.int64)
    assert sorted(scores.tolist())[-10:] == sorted(whole.tolist())[-10:]
    assert (whole[got] == scores).all()
    assert shard.looked < len(docs) / 3


def test_a_task_never_buffers_all_its_shards(package, monkeypatch):
    from fedloom.plans.session import Scratch

    monkeypatch.setattr(ls, "SHARD", 1 << 14)
    monkeypatch.setattr(ls, "ROW_GROUP", 1 << 16)
    rng = random.Random(3)
    docs = documents(package, [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))) for i in range(200)]).coalesce(1)
    index, _, _ = ls.build_index(package, docs, Scratch(package))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 20
    assert max(g.num_rows for g in groups) <= 4
