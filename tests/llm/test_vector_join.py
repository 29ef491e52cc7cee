"""Product quantisation join, against all pairs."""

from collections import Counter

import numpy as np
import pytest

from fedloom.llm import queries, vector_join

from ..helpers import same_as_sql

SCHEMA = "vec_id bigint, embedding array<double>, label int, least string, node int, m int, hash int"


def brute(rows, least=0.98):
    """Links by definition, components by repeated least ids."""
    ok = [k for k, (_, v, lab) in enumerate(rows) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: set() for k in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].add(j)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        least_id = min(ids) if ids else None
        out.append((rows[k][0], len(near[k]), least_id, rows[k][0] == least_id))
    return Counter(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    out = vector_join.similar_vectors(spark, df, **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return Counter(tuple(r) for r in out.collect())


def planted(seed, n, dims, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    rows = []
    for k, x in enumerate(base):
        rows.append((len(rows), x.tolist(), k % 3))
        for _ in range(rng.integers(0, 4)):
            y = x * rng.uniform(0.5, 2) + rng.normal(size=dims) * noise * rng.uniform(0, 2)
            rows.append((len(rows), y.tolist(), int(rng.integers(0, 3)) if rng.random() < 0.2 else k % 3))
    return rows


def test_op13_equals_sql(package, duck, data):
    same_as_sql(queries.queries()["op13_vectors"](package, data), duck, queries.oracle_sql()["op13_vectors"])


@pytest.mark.parametrize("dims,noise", [(64, 0.14), (8, 0.15), (2, 0.02), (20, 0.2)])
def test_planted_pairs_by_brute_force(package, dims, noise):
    rows = planted(dims, 60, dims, noise)
    assert found(package, rows, margin=0.2) == brute(rows)


def test_recall_of_the_default_margin(package):
    """Pairs near the threshold, found over all that there are."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.normal(size=(700, 32))
    step -= (step * base).sum(1)[:, None] * base
    step *= 0.199 / np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate((base, base + step))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    got = found(package, rows)
    want = brute(rows)
    links = lambda c: sum(r[1] * n for r, n in c.items())
    assert links(want) >= 1400
    assert links(got) >= 0.95 * links(want)


def test_odd_rows(package):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 3.0], 0),
        (9, [1.0, float("inf"), 3.0], 0), (10, [1.0, 2.0], 0), (11, [1.0, 2.0, 3.0, 0.0], 0), (None, v, 0), (None, v, 1), (None, None, None), (12, [1e200, 2e200, 3e200], 0), (13, [1e-200, 2e-200, 3e-200], 0), (14, v, 1),
        (15, [-1.0, -2.0, -3.0], 0), (16, [-0.0, 1.0, 0.0], 2), (17, [0.0, 1.0, -0.0], 2),
    ]
    assert found(package, rows) == brute(rows)
    alone = [(None, v, 1), (None, v, 1)]
    assert Counter(tuple(r)[:3] for r in found(package, alone).elements()) == Counter({(None, 1, None): 2})
    assert found(package, [(3, [0.0], 1)]) == Counter({(3, 0, 3, True): 1})
    assert found(package, []) == Counter()


def test_large_groups_are_cut_into_tiles(package, monkeypatch):
    """A hot vector, a hot group of near copies and several tiles of one list."""
    monkeypatch.setattr(vector_join, "TILE", 16)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [(k, (centre + rng.normal(size=16) * 0.05).tolist(), 1) for k in range(120)]
    rows += [(200 + k, centre.tolist(), 1) for k in range(60)]
    rows += [(300 + k, rng.normal(size=16).tolist(), 1) for k in range(40)]
    assert found(package, rows, margin=0.2) == brute(rows)


def test_coding_never_loses_a_pair():
    """Distance by tables less the coding error is no more than the distance."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = vector_join.Quantiser(x[:200], 12)
    own, _, _ = q.lists(x, 0.1)
    codes, error = q.encode(x - q.centres[own])
    for at in np.unique(own):
        members = np.flatnonzero(own == at)
        far = sum(t[:, codes[members, m]] for m, t in enumerate(q.tables(x - q.centres[at])))
        true = np.sqrt(((x[:, None] - x[members][None]) ** 2).sum(2))
        assert (np.sqrt(np.maximum(far, 0)) - error[members] <= true + 1e-3).all()
