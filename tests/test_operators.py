"""Facts with known values, re-derivations in numpy and properties of the operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedloom.operators import aggregate as agg
from fedloom.operators import compress as cmp
from fedloom.operators import privacy as dp
from fedloom.operators import robust as byz
from fedloom.operators import rounds as orc
from fedloom.operators import secure as sec
from fedloom.operators import state as st
from fedloom.sources import weights as io

SCHEMA = "grp int, client int, param string, idx int, value double, w double, steps int"


def updates(spark, vectors, weights=None, steps=None):
    rows = [(0, c, "p", i, float(v), float((weights or [1] * len(vectors))[c]), (steps or [1] * len(vectors))[c]) for c, x in enumerate(vectors) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, col="value"):
    return [r[col] for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize(
    "vectors,weights,want", [([[1, 2, 3], [4, 5, 6]], [1, 1], [2.5, 3.5, 4.5]), ([[0, 0], [10, 10]], [1, 3], [7.5, 7.5])]
)
def test_weighted_mean_facts(spark, vectors, weights, want):
    assert values(agg.weighted_mean(updates(spark, vectors, weights))) == pytest.approx(want)


def test_empty_and_zero_weights(spark):
    assert agg.weighted_mean(spark.createDataFrame([], SCHEMA)).count() == 0
    assert values(agg.weighted_mean(updates(spark, [[1.0], [3.0]], [0, 0]))) == [None]
    assert values(agg.minibatch_mean(updates(spark, [[1.0], [3.0]], [0, 0]))) == [0.0]


def test_proximal_term_fact(spark):
    g = spark.createDataFrame([(0, "p", 0, 1.0), (0, "p", 1, 1.0)], "grp int, param string, idx int, value double")
    assert agg.proximal_term(updates(spark, [[2, 2]]), g, 0.1).first()["term"] == pytest.approx(0.1)


def test_weighted_mean_ignores_scale_of_weights_and_order(spark):
    v = [[1.0, -2.0], [0.5, 7.0], [3.0, 3.0]]
    a = values(agg.weighted_mean(updates(spark, v, [1, 2, 3])))
    b = values(agg.weighted_mean(updates(spark, v[::-1], [30, 20, 10])))
    assert a == pytest.approx(b)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_trimmed_mean(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    k = max(1, int(n * (1 / n)))
    want = x.mean() if n <= 2 * k else np.sort(x)[k : n - k].mean()
    assert values(agg.trimmed_mean(updates(spark, [[v] for v in x]))) == pytest.approx([want])


def test_apply_delta_is_strict(spark):
    base = spark.createDataFrame([(0, 1.0), (1, 2.0)], "idx int, value double")
    delta = spark.createDataFrame([(0, 1.0)], "idx int, value double")
    with pytest.raises(Exception, match="no delta"):
        agg.apply_delta(base, delta, ["idx"]).collect()
    assert values(agg.apply_delta(base, delta, ["idx"], strict=False)) == [2.0, 2.0]


def test_krum_keeps_the_near_and_passes_small_groups(spark):
    v = [[0, 0, 0, 0], [0.1, 0, 0, 0], [0, 0.1, 0, 0], [0, 0, 0.1, 0], [0.1, 0.1, 0, 0], [50, 50, 50, 50]]
    kept = {r["client"] for r in byz.krum_survivors(updates(spark, v), 1).collect()}
    assert 5 not in kept and len(kept) == 4
    assert byz.krum_survivors(updates(spark, v[:3]), 1).count() == 3
    assert byz.krum_survivors(updates(spark, v[:1]), 1).count() == 1


def test_krum_ties_go_to_the_lower_client(spark):
    assert byz.krum_survivors(updates(spark, [[1.0]] * 5), 1, multi=False).first()["client"] == 0


def test_geometric_median_steps(spark):
    p = np.array([[0, 0], [1, 0], [0, 1], [1, 1], [20.0, 20]])
    x = p.mean(axis=0)
    for _ in range(100):
        w = 1 / (np.linalg.norm(p - x, axis=1) + 1e-10)
        y = (p * w[:, None]).sum(axis=0) / w.sum()
        if np.linalg.norm(y - x) < 1e-3:
            break
        x = y
    assert values(byz.geometric_median(spark, updates(spark, p.tolist()), tol=1e-3)) == pytest.approx(x.tolist(), abs=1e-9)


@pytest.mark.parametrize("metric", ["variance", "max_dist"])
def test_subset_search(spark, metric):
    p = np.array([[0, 0], [1, 0], [0, 1], [9, 9], [1, 1.0]])

    def score(s):
        q = p[list(s)]
        return ((q - q.mean(axis=0)) ** 2).sum(axis=1).mean() if metric == "variance" else max(np.linalg.norm(a - b) for a, b in itertools.combinations(q, 2))

    best = min(itertools.combinations(range(5), 4), key=score)
    found = byz.subset_search(spark, updates(spark, p.tolist()), metric=metric)
    assert {r["client"] for r in found.collect()} == set(best)
    assert byz.subset_search(spark, updates(spark, p[:2].tolist())).count() == 2


@pytest.fixture(scope="module")
def deltas(spark):
    x = np.random.default_rng(1).normal(size=(2, 5))
    return x, spark.createDataFrame([(k, t, float(x[k, t])) for k in range(2) for t in range(5)], "k int, round int, value double")


def folded(df):
    return np.array([r["value"] for r in df.orderBy("k", "round").collect()]).reshape(2, 5)


def test_adam_and_yogi(deltas):
    x, df = deltas
    for yogi in (False, True):
        m, v, want = np.zeros(2), np.full(2, 1e-3 if yogi else 0.0), []
        for t in range(5):
            d = x[:, t]
            m = 0.9 * m + 0.1 * d
            v = 0.99 * v + (np.sign(v - 0.01 * d * d) * 0.01 * d * d if yogi else 0.01 * d * d)
            want.append(0.01 * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(np.abs(v) / (1 - 0.99 ** (t + 1))) + 1e-8 + (0 if yogi else 1e-7)))
        got = folded((st.yogi if yogi else st.adam)(df, ["k"]))
        assert got == pytest.approx(np.array(want).T, rel=1e-9)


def test_momentum_average_adagrad_control(deltas):
    x, df = deltas
    b = np.zeros(2)
    want = []
    for t in range(5):
        b = 0.9 * b + x[:, t]
        want.append(b)
    assert folded(st.momentum(df, ["k"])) == pytest.approx(np.array(want).T)
    assert folded(st.adagrad(df, ["k"])) == pytest.approx(0.01 * x / (np.sqrt(0.1 + np.cumsum(x * x, axis=1)) + 1e-8))
    assert folded(st.server_control(df, ["k"])) == pytest.approx(-np.cumsum(x, axis=1))
    r = x[:, 0]
    for t in range(1, 5):
        r = 0.99 * r + 0.01 * x[:, t]
    assert folded(st.running_average(df, ["k"]))[:, -1] == pytest.approx(r)


def test_early_stopping(spark):
    acc = [0.5, 0.6, 0.6, 0.605, 0.61, 0.8]
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate(acc)], "k string, round int, value double")
    rows = st.early_stopping(df, "k", 3, 0.01).orderBy("round").collect()
    assert [r["counter"] for r in rows] == [0, 0, 1, 2, 3, 0]
    assert [r["stop"] for r in rows] == [False, False, False, False, True, False]


def test_top_k_ties_zeros_and_single_values(spark):
    u = updates(spark, [[1.0, -1.0, 0.0, 1.0], [5.0]])
    kept = {(r["client"], r["idx"]) for r in cmp.top_k(u, 0.5).collect()}
    assert kept == {(0, 0), (0, 1), (1, 0)}
    back = cmp.scatter(cmp.top_k(u, 0.5).select("client", "idx", "value"), u.select("client", "idx"), ["client", "idx"])
    again = cmp.scatter(cmp.top_k(back.withColumn("param", F.lit("p")), 0.5).select("client", "idx", "value"), u.select("client", "idx"), ["client", "idx"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, again.collect()))
    assert cmp.top_k_global(u, 0.5).where("client = 0").count() == 3


def test_quantize_constant_negative_and_halves(spark):
    u = updates(spark, [[2.0, 2.0], [-1.0, 0.0, 1.0]])
    rows = {(r["client"], r["idx"]): r for r in cmp.quantize(u, 2 + 1).collect()}
    assert rows[0, 0]["restored"] == 2.0
    assert [rows[1, i]["code"] for i in range(3)] == [0, 1, 2]
    signs = cmp.sign_compress(updates(spark, [[0.0, 2.0]])).orderBy("idx").collect()
    assert [r["restored"] for r in signs] == [-1.0, 1.0]


def test_run_lengths_round_trip(spark):
    x = list("aabbbacdd")
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "g int, idx int, value string")
    runs = cmp.run_length_encode(df, ["g"], ["idx"])
    assert [(r["value"], r["n"]) for r in runs.orderBy("run").collect()] == [("a", 2), ("b", 3), ("a", 1), ("c", 1), ("d", 2)]
    back = cmp.run_length_decode(runs, ["g"]).orderBy("pos").collect()
    assert [r["value"] for r in back] == x


def test_random_k_is_repeatable_and_keeps_the_norm(spark):
    u = updates(spark, [list(range(1, 21))])
    a, b = cmp.random_k(u, 0.2, 3).collect(), cmp.random_k(u.repartition(3), 0.2, 3).collect()
    assert {r["idx"] for r in a} == {r["idx"] for r in b} and len(a) == 4
    assert math.sqrt(sum((r["value"] * r["norm_scale"]) ** 2 for r in a)) == pytest.approx(np.linalg.norm(np.arange(1, 21)))


def test_clip_and_noise(spark):
    u = updates(spark, [[3.0, 4.0], [0.3, 0.4]])
    norms = {r["client"]: r["norm"] for r in agg.update_norms(dp.clip(u, ["client"])).collect()}
    assert norms[0] == pytest.approx(1.0, abs=1e-5) and norms[1] == pytest.approx(0.5, abs=1e-5)
    big = spark.range(20000).select("id", F.lit(0.0).alias("value"))
    g = dp.add_gaussian(big, 2.0, 5, ["id"]).agg(F.avg("value"), F.stddev("value")).first()
    lap = dp.add_laplace(big, 2.0, 5, ["id"]).agg(F.avg("value"), F.stddev("value")).first()
    assert abs(g[0]) < 0.1 and g[1] == pytest.approx(2, rel=0.05)
    assert abs(lap[0]) < 0.15 and lap[1] == pytest.approx(2 * math.sqrt(2), rel=0.05)


@pytest.mark.parametrize("q,z,steps,want", [(0.01, 0.1, 100, 1.0), (0.01, 0.1, 1000, 10.0), (0.01, 1, 1000, 0.0040939), (0.01, 10, 1000, 0.1247237), (1, 0.1, 50, 0.1247237), (1, 1, 1, 0.4076545)])
def test_reference_accounting(spark, q, z, steps, want):
    log = spark.createDataFrame([(float(q), float(z), steps)], "sample_rate double, noise_multiplier double, steps int")
    assert dp.rdp_epsilon(dp.rdp_per_order(log, dp.orders(spark))).first()[0] == pytest.approx(want, rel=1e-4)


def test_compose_nothing(spark):
    assert tuple(dp.compose(spark.createDataFrame([], "epsilon double, delta double")).first()) == (0.0, 0.0)


def test_shares_give_the_secret_from_any_subset(spark):
    df = spark.createDataFrame([(0, 1, -2.5), (0, 2, 123456.789)], "client int, idx int, value double").select("client", "idx", sec.encode(F.col("value")).alias("secret"))
    shares = sec.share(df, 3, 5, 1, ("client", "idx"))
    for xs in ([1, 2, 3], [5, 1, 4]):
        rows = sec.reconstruct(shares, xs, 3, ("client", "idx")).orderBy("idx").select(sec.decode(F.col("secret"))).collect()
        assert [r[0] for r in rows] == pytest.approx([-2.5, 123456.789])
    with pytest.raises(ValueError):
        sec.reconstruct(shares, [1, 2], 3, ("client", "idx"))


def test_masks_cancel_and_hide(spark):
    v = spark.createDataFrame([(c, i, float(c - i)) for c in range(4) for i in range(3)], "client int, idx int, value double").withColumn("param", F.lit("p"))
    m = sec.masked(v, v.select("client").distinct(), 9)
    total = m.groupBy("idx").agg(sec.field(F.sum("masked")).alias("t")).select("idx", sec.decode(F.col("t")).alias("value"))
    assert values(total) == pytest.approx([6.0, 2.0, -2.0])
    assert m.join(v, ["client", "idx"]).where(sec.decode(F.col("masked")) == F.col("value")).count() == 0


def test_sampling(spark):
    reg = spark.createDataFrame([(i, True, float(i % 5)) for i in range(100)], "client int, enabled boolean, weight double")
    assert orc.sample_uniform(reg, 7, 1).count() == 7
    assert orc.sample_weighted(reg, 7, 1).where("weight = 0").count() == 0
    assert orc.sample_with_replacement(reg, 30, 1).count() == 30
    none = orc.weight_shares(reg.withColumn("weight", F.lit(0.0)))
    assert none.first()["share"] == pytest.approx(0.01)


def test_weights_files(spark, tmp_path):
    w = spark.createDataFrame([(0, "layer.running_mean", 0, 1.5), (0, "layer.running_mean", 1, -2.0), (0, "b", 0, 0.25)], io.WEIGHTS)
    io.save_weights(w, f"{tmp_path}/w")
    back = io.load_weights(spark, f"{tmp_path}/w").select("round", "param", "idx", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, w.collect()))
    j = io.from_json(io.to_json(w, ("round",)), ("round",))
    assert sorted(map(tuple, j.select("round", "param", "idx", "value").collect())) == sorted(map(tuple, w.collect()))


def two_params(spark):
    """Client 3 has no parameter b; 4 is far off in a alone."""
    rows = [(0, c, p, i, v, 1.0, 1) for c, p, i, v in (
        (1, "a", 0, 1.0), (1, "b", 0, 5.0), (2, "a", 0, 5.0), (2, "b", 0, 1.0), (3, "a", 0, 1.0),
    )]
    return spark.createDataFrame(rows, SCHEMA)


def test_parameters_are_kept_apart(spark):
    u = two_params(spark)
    dist = {(r["a"], r["b"]): r["dist"] for r in byz.pairwise_distance(u).collect()}
    assert dist == pytest.approx({(1, 2): 32**0.5, (1, 3): 0.0, (2, 3): 4.0})
    for op in (agg.weighted_mean, agg.coordinate_median, agg.trimmed_mean, agg.minibatch_mean, lambda x: byz.geometric_median(spark, x)):
        got = {r["param"]: r["value"] for r in op(u.where("client < 3")).collect()}
        assert got == pytest.approx({"a": 3.0, "b": 3.0})
    got = {r["param"]: r["value"] for r in agg.weighted_mean(u).collect()}
    assert got == pytest.approx({"a": 7 / 3, "b": 3.0})
    other = spark.createDataFrame([(0, 1, "a", 0, 1.0, 1.0, 1), (0, 2, "b", 0, 1.0, 1.0, 1)], SCHEMA)
    assert byz.pairwise_distance(other).count() == 0


def test_distances_by_numpy_where_clients_lack_parameters(spark):
    rng = np.random.default_rng(6)
    rows = [(g, c, p, i, float(rng.normal()), 1.0, 1) for g in range(2) for c in range(9) for p in "abc" if rng.random() < 0.8 for i in range(3)]
    u = spark.createDataFrame(rows, SCHEMA)
    of = {}
    for g, c, p, i, v, *_ in rows:
        of.setdefault((g, c), {})[p, i] = v
    want = {(g, a, b): math.dist([of[g, a][k] for k in sorted(s)], [of[g, b][k] for k in sorted(s)]) for g, a in of for h, b in of if g == h and a < b and (s := of[g, a].keys() & of[g, b].keys())}
    for blocks in (1, 3):
        got = {(r["grp"], r["a"], r["b"]): r["dist"] for r in byz.pairwise_distance(u, blocks).collect()}
        assert got == pytest.approx(want)


def test_any_aggregator_within_a_defence(spark):
    v = [[0, 0, 0, 0], [0.1, 0, 0, 0], [0, 0.1, 0, 0], [0, 0, 0.1, 0], [0.1, 0.1, 0, 0], [50, 50, 50, 50]]
    u = updates(spark, v, [1, 1, 1, 1, 1, 9])
    for base in (agg.coordinate_median, agg.minibatch_mean, agg.trimmed_mean):
        assert max(values(byz.krum_mean(u, base=base))) < 1
        assert max(values(byz.subset_mean(spark, u, base=base))) < 1
    many = updates(spark, [[float(k % 5)] for k in range(29)] + [[99.0]])
    assert values(byz.subset_mean(spark, many)) == pytest.approx([np.mean([k % 5 for k in range(29)])])


def test_commitments_are_of_exact_values_and_verified(spark):
    a = spark.createDataFrame([(1, "p", 0, 0.1), (1, "q", 0, 0.2), (2, "p", 0, 0.3)], "client int, param string, idx int, value double")
    b = a.withColumn("value", F.when(F.col("client") == 1, F.col("value") + 1e-12).otherwise(F.col("value")))
    swapped = a.withColumn("param", F.when(F.col("param") == "p", "q").otherwise("p"))
    made = sec.commitment(a, ("client",))
    valid = lambda x: {r["client"]: r["valid"] for r in sec.verify(made, x, ("client",)).collect()}
    assert valid(a) == {1: True, 2: True} and valid(b) == {1: False, 2: True} and valid(swapped) == {1: False, 2: False}
    assert valid(a.where("client = 1")) == {1: True, 2: False}


def test_noise_and_samples_ignore_partitions(spark):
    u = updates(spark, np.random.default_rng(2).normal(size=(20, 50)).tolist())
    for op in (lambda x: dp.add_gaussian(x, 1.0, 5), lambda x: dp.add_laplace(x, 1.0, 5), lambda x: cmp.random_k(x, 0.2, 5).drop("norm_scale")):
        assert sorted(op(u).collect()) == sorted(op(u.repartition(5)).collect())
    noise = np.array([r["value"] for r in dp.add_gaussian(u.withColumn("value", F.lit(0.0)), 2.0, 5).collect()])
    assert abs(noise.mean()) < 0.3 and abs(noise.std() - 2) < 0.2
    reg = spark.range(500).select(F.col("id").alias("client"), (F.col("id") % 3).cast("double").alias("weight"))
    drawn = [r["client"] for r in orc.sample_with_replacement(reg, 3000, 4).collect()]
    assert len(drawn) == 3000 and abs(np.mean([c % 3 == 2 for c in drawn]) - 2 / 3) < 0.05


def test_cluster_rounds_and_momentum_rounds(spark):
    rows = [(0, 1, "a", 1.0, 1.0, "x"), (0, 2, "a", 3.0, 1.0, "x"), (0, 3, "a", 8.0, 5.0, "y"), (1, 1, "a", 4.0, 2.0, "x"), (1, 2, "b", 5.0, 1.0, "y")]
    u = spark.createDataFrame(rows, "round int, client int, param string, value double, w double, cluster string")
    start = spark.createDataFrame([("a", 10.0)], "param string, value double")
    assert set(map(tuple, st.cluster_rounds(u, "cluster", ["param"], start).select("param", "round", "value").collect())) == {("a", 0, 15.0), ("a", 1, 19.0), ("b", 1, 5.0)}
    assert st.cluster_rounds(u.limit(0), "cluster", ["param"]).isEmpty()
    got = {(r["param"], r["round"]): r["value"] for r in st.momentum_rounds(u, ["param"], 0.5).collect()}
    assert got[("a", 0)] == pytest.approx(44 / 7) and got[("a", 1)] == pytest.approx(22 / 7 + 4) and got[("b", 1)] == 5.0


def test_sent_share_and_evaluation_of_nothing(spark):
    u = spark.createDataFrame([(1, "a", 0, 0.0), (1, "a", 1, 2.0), (2, "a", 0, 0.0)], "client int, param string, idx int, value double")
    share = cmp.sent_share(cmp.compress(u, "sparse"), u)
    assert {(r["client"], r["n"], r["sent"], r["share"]) for r in share.collect()} == {(1, 2, 1, 0.5), (2, 1, 0, 0.0)}
    none = spark.createDataFrame([], "label int, pred int, loss double")
    assert tuple(orc.evaluation(none).first()) == (0.0,) * 5
