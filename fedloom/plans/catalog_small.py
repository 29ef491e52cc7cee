"""Queries over compressors by name, checkpoints of runs, private steps, accountants, sampling by name, parties and descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import compress as cmp
from ..operators import privacy as dp
from ..operators import rounds as orc
from ..operators import secure as sec
from ..operators import state as st
from ..sources import weights as io
from . import bindings as b
from .bindings import with_sql
from .catalog import _QUANT, _RANDOM, _REG, _SENT, _SQL, _U, B1, B2, B4, _log, _LOG, _NOISE, out, query
from .session import new_path, read_table

_ON = ["client", "param", "idx"]


@query(f"{_RANDOM}, k AS (SELECT *, norm / (sqrt(sum(value * value) OVER (PARTITION BY client)) + 1e-10) AS s, n / k AS m FROM r WHERE rn <= k) SELECT b1.client, b1.idx, round(coalesce(k.value * s, 0), 6) + 0.0 AS by_norm, round(coalesce(k.value * m, 0), 6) + 0.0 AS by_mean FROM b1 LEFT JOIN k USING (client, idx)")
def randomk_decompressed(s, d):
    """All coordinates, those kept scaled so that the norm or the mean is restored."""
    u = b.vectors(s, d)
    kept = cmp.random_k(u, seed=7)
    x = u.select(*_ON)
    for name, scale in (("by_norm", "norm_scale"), ("by_mean", "mean_scale")):
        x = cmp.scatter(kept.select(*_ON, (F.col("value") * F.col(scale)).alias(name)), x, _ON, name)
    return out(x, "client", "idx", by_norm="by_norm", by_mean="by_mean")


_POW2 = _SQL["quantize_pow2"].split(" SELECT client, idx, CAST(i AS INT)")[0].replace(B1, "", 1).lstrip(", ").replace("range(8)", "range(16)").replace("m AS (", "pm AS (").replace("FROM m,", "FROM pm,").replace("c AS (", "pc AS (")


@query(f"""{_SENT}, {_POW2}, w AS (SELECT client, idx, top * pow(0.5, i) * CASE WHEN value > 0 THEN 1 ELSE -1 END AS v FROM pc WHERE r = 1)
SELECT p.client, p.idx, round(w.v, 6) + 0.0 AS pow2, round({_QUANT.replace('255', '15')}, 6) + 0.0 AS quantization FROM p JOIN w USING (client, idx)""")
def compressors_with_levels(s, d):
    """Sixteen levels, as asked: powers of two and even steps."""
    u = b.vectors(s, d)
    x = u.select(*_ON)
    for m in ("pow2", "quantization"):
        x = cmp.decompress(cmp.compress(u, m, levels=16), x, _ON).withColumnRenamed("value", m)
    return out(x, "client", "idx", pow2="pow2", quantization="quantization")


@query(f"{B2}, m AS (SELECT idx, sum(value * w) / sum(w) AS g FROM b2 GROUP BY idx) SELECT client, idx, round(value - g, 6) + 0.0 AS delta, round(value, 6) + 0.0 AS restored FROM b2 JOIN m USING (idx)")
def deltas_of_all_clients(s, d):
    """Each client's difference from the mean, and what adding it to the mean gives."""
    u = b.label_means(s, d)
    mean = agg.weighted_mean(u, ("idx",))
    every = u.select("client").distinct().join(F.broadcast(mean)).select("client", "idx", "value")
    delta = agg.compute_delta(u.select("client", "idx", "value"), every, ["client", "idx"])
    back = agg.apply_delta(every, delta, ["client", "idx"]).withColumnRenamed("value", "restored")
    return out(delta.join(back, ["client", "idx"]), "client", "idx", delta="value", restored="restored")


@query(f"{B4}, l AS (SELECT param, round, round(avg(value), 6) + 0.0 AS value, row_number() OVER (PARTITION BY param ORDER BY round) AS t FROM b4 GROUP BY param, round) SELECT param, round, value, (SELECT count(DISTINCT round) FROM b4)::BIGINT AS rounds FROM l WHERE round = (SELECT max(round) FROM b4)")
def run_checkpoints(s, d):
    """Checkpoints of a run after its first, second and last round: tables by name, of which the last ones are read back."""
    path = new_path(s, "run")
    m = b.daily(s, d).groupBy("param", "round").agg(F.avg("value").alias("value"))
    rounds = sorted(r[0] for r in m.select("round").distinct().collect())
    for k in sorted({0, min(1, len(rounds) - 1), len(rounds) - 1}):
        done = m.where(F.col("round") <= rounds[k])
        io.save_run(path, rounds[k], {"weights": done.where(F.col("round") == rounds[k]), "history": done.select("round").distinct()})
    _, tables = io.load_run(s, path)
    n = tables["history"].groupBy().agg(F.count("*").alias("rounds"))
    return out(tables["weights"].join(F.broadcast(n)), "param", "round", "rounds", value="value")


@query(f"""{B1}, c AS (SELECT client, idx, value * least(1.0, 2.0 / (sqrt(sum(value * value) OVER (PARTITION BY client)) + 1e-6)) AS v FROM b1)
SELECT client, idx, round(-0.1 * (v + 1.0 * sqrt(-2 * ln({_U.format(_NOISE.format('r:'))})) * cos(2 * pi() * {_U.format(_NOISE.format('a:'))})), 6) + 0.0 AS value FROM c""")
def private_step(s, d):
    """Clipped to a norm of 2, noise of half of it, and a step of a tenth against the result."""
    return out(dp.dp_step(b.vectors(s, d), 2.0, 0.5, 7, lr=0.1), "client", "idx", value="value")


@query("WITH l AS (SELECT event_id AS step, 0.001 * (1 + event_id % 10) AS q, 0.5 + (event_id % 4) AS z, 1 + event_id % 3 AS steps FROM events) SELECT step, CAST(sum(steps) OVER o AS BIGINT) AS steps, round(sum(steps * q * z) OVER o * sqrt(2 * ln(1 / 1e-5)), 6) + 0.0 AS epsilon, sum(steps * q * z) OVER o * sqrt(2 * ln(1 / 1e-5)) >= 50 AS exhausted FROM l WINDOW o AS (ORDER BY step)")
def privacy_spent_by_step(s, d):
    e = F.col("event_id")
    log = read_table(s, d, "events").select(e.alias("step"), (F.lit(0.001) * (1 + e % 10)).alias("sample_rate"), (F.lit(0.5) + e % 4).alias("noise_multiplier"), (1 + e % 3).alias("steps"))
    return out(dp.spent_so_far(log, total=50.0), "step", "steps", epsilon="epsilon", exhausted="exhausted")


@query(f"""{_LOG}, e AS (SELECT i, rdp / steps * alpha + ln(1e-5) / (alpha - 1) AS eps, rdp, steps FROM rdp), n AS (SELECT sum(steps)::BIGINT AS steps FROM log),
x AS (SELECT 'rdp' AS accountant, CASE WHEN max(rdp) = 0 THEN 0 WHEN count(*) FILTER (eps > 0) > 0 THEN arg_min(eps, i) FILTER (eps > 0) ELSE max(steps) * 0.01 END AS e FROM e
UNION ALL SELECT 'gdp', sum(steps * q) FROM log UNION ALL SELECT 'simple', sum(steps * q * z) * sqrt(2 * ln(1 / 1e-5)) FROM log)
SELECT accountant, 8.0::DOUBLE AS target_epsilon, round(e, 6) + 0.0 AS spent_epsilon, n.steps, round(least(1.0, e / 8.0), 6) + 0.0 AS ratio, e >= 8.0 AS exhausted FROM x, n""")
def accounting_by_each_accountant(s, d):
    parts = [dp.accounting_summary(_log(s, d), dp.orders(s), k).withColumn("steps", F.col("steps").cast("bigint")) for k in ("rdp", "gdp", "simple")]
    return out(parts[0].union(parts[1]).union(parts[2]), "accountant", target_epsilon="target_epsilon", spent_epsilon="spent_epsilon", steps="steps", ratio="ratio", exhausted="exhausted")


#: Bounds within which the multiplier lies: the largest that is within the target, by the formula solved for it.
_RUNS = "WITH u AS (SELECT c_custkey AS run, 1.0 + c_custkey % 20 AS target, 0.001 * (1 + c_custkey % 10) AS q, 100 + c_custkey % 900 AS steps FROM customer)"


@query(f"""{_RUNS}, a AS (SELECT CAST(1 + x / 10.0 AS DOUBLE) AS alpha FROM range(1, 100) t(x) UNION ALL SELECT x FROM range(12, 64) t(x)),
s AS (SELECT run, max((steps * alpha / 2) / nullif(greatest(target - ln(1e5) / (alpha - 1), 0), 0)) FILTER (false) AS none, min(sqrt((steps * alpha / 2) / nullif(greatest(target - ln(1e5) / (alpha - 1), 0), 0))) AS z FROM u, a GROUP BY run)
SELECT run, round(least(10.0, greatest(0.01, target / (steps * q * sqrt(2 * ln(1e5))))), 5) + 0.0 AS simple, CASE WHEN steps * q <= target THEN 10.0 ELSE 0.01 END::DOUBLE AS gdp, round(least(10.0, coalesce(z, 10.0)), 5) + 0.0 AS standard FROM u JOIN s USING (run)""")
def noise_for_target(s, d):
    """By bisection, against the formulas solved for the noise."""
    k = F.col("c_custkey")
    runs = read_table(s, d, "customer").select(k.alias("run"), (F.lit(1.0) + k % 20).alias("target_epsilon"), (F.lit(0.001) * (1 + k % 10)).alias("sample_rate"), (100 + k % 900).alias("steps"))
    x = runs.select("run")
    for kind in ("simple", "gdp", "standard"):
        x = x.join(dp.noise_for_target(runs, kind).withColumnRenamed("noise", kind), "run")
    return x.select("run", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("simple", "gdp", "standard")])


@query(f"{B1} SELECT client, CAST(count(*) AS BIGINT) AS masks, true AS within_the_field, true AS repeatable FROM b1 GROUP BY client")
def client_masks(s, d):
    u = b.vectors(s, d)
    m = sec.client_masks(u, 7).join(sec.client_masks(u.repartition(3, "idx"), 7).withColumnRenamed("mask", "again"), _ON)
    return m.groupBy("client").agg(F.count_distinct("mask").alias("masks"), F.bool_and((F.col("mask") >= 0) & (F.col("mask") < F.lit(sec.P))).alias("within_the_field"), F.bool_and(F.col("mask") == F.col("again")).alias("repeatable"))


_DRAW = _U.format("'7:' || client")


@query(f"{_REG}, a AS (SELECT * FROM registry WHERE enabled), u AS (SELECT 'uniform' AS how, client FROM a ORDER BY {_DRAW}, client LIMIT 15), w AS (SELECT 'weighted' AS how, client FROM a WHERE weight > 0 ORDER BY -ln({_DRAW}) / weight, client LIMIT 15) FROM u UNION ALL FROM w UNION ALL SELECT 'velocity', client FROM u")
def sample_by_name(s, d):
    """Names that aren't known are uniform."""
    r = b.registry(s, d)
    x = [orc.sample(r, 15, 7, how).select(F.lit(how).alias("how"), "client") for how in ("uniform", "weighted", "velocity")]
    return x[0].union(x[1]).union(x[2])


_E = "WITH e AS (SELECT vec_id % 50 AS sample, label AS client, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings), p AS (SELECT sample, client, dim, avg(value) AS value FROM e GROUP BY ALL)"


@query(_E + " SELECT sample, dim, round(sum(value * CASE WHEN client = 0 THEN 5 ELSE client END) / sum(CASE WHEN client = 0 THEN 5 ELSE client END), 6) + 0.0 AS value FROM p WHERE client < 4 GROUP BY sample, dim")
def embeddings_own_first(s, d):
    """A party's own embedding with a weight of 5, three others' with 1, 2 and 3."""
    x = b.vectors(s, d).groupBy((F.col("client") % 50).alias("sample"), F.col("grp").alias("place"), F.col("idx").alias("dim")).agg(F.avg("value").alias("value"))
    return out(orc.aggregate_embeddings(x.where("place = 0"), x.where("place BETWEEN 1 AND 3"), [5, 1, 2, 3]), "sample", "dim", value="value")


@query("SELECT label AS client, count(*) AS parties, CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label")
def embeddings_that_were_sent(s, d):
    e = read_table(s, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return orc.present_embeddings(e).groupBy(F.col("label").alias("client")).agg(F.count("*").alias("parties"), F.sum(F.size("embedding")).cast("bigint").alias("numbers"))


@query(f"{B4}, h AS (SELECT round, count(DISTINCT client) AS clients, sum(w) AS seconds FROM b4 GROUP BY round) SELECT count(*) AS rounds, CAST(sum(clients) AS BIGINT) AS clients, round(avg(seconds), 6) + 0.0 AS mean_seconds, round(sum(seconds), 6) + 0.0 AS seconds FROM h")
def experiment_totals(s, d):
    h = b.daily(s, d).groupBy("round").agg(F.count_distinct("client").alias("clients"), F.sum("w").alias("seconds"))
    return out(orc.experiment_totals(h), "rounds", "clients", mean_seconds="mean_seconds", seconds="seconds")


@query("SELECT 0.0::DOUBLE AS accuracy, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS loss FROM (SELECT count(*) AS n FROM labels WHERE quality > 9) WHERE n = 0")
def evaluation_of_nothing(s, d):
    """No row has such a label: all figures are 0."""
    x = read_table(s, d, "labels").where("quality > 9").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"), F.lit(1.0).alias("loss"))
    return out(orc.evaluation(x), accuracy="accuracy", precision="precision", recall="recall", f1="f1", loss="loss")


@query(f"{B2} SELECT client, CAST(any_value(w) AS DOUBLE) AS num_samples, CASE WHEN client % 2 = 0 THEN 'late' END AS note, CAST(NULL AS DOUBLE) AS privacy_noise FROM b2 GROUP BY client")
def update_descriptions(s, d):
    """Descriptions of updates as JSON and back: weights and what isn't in them come back as nothing."""
    u = b.label_means(s, d).select("client", "param", "idx", "value", F.col("w").alias("num_samples"), F.when(F.col("client") % 2 == 0, "late").alias("note"))
    j = io.updates_to_json(u, ("client",))
    return io.updates_from_json(j, "client int, num_samples double, note string, privacy_noise double")


@query("SELECT l_suppkey AS client, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def data_sizes(s, d):
    return io.data_sizes(read_table(s, d, "lineitem"), "l_suppkey")


@query("SELECT o_orderkey, round(o_totalprice, 6) + 0.0 AS o_totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def data_of_one_client(s, d):
    first = read_table(s, d, "orders").agg(F.min("o_custkey")).first()[0]
    return out(io.clients_data(s, f"{d}/orders.parquet", "o_custkey", first), "o_orderkey", o_totalprice="o_totalprice")


@query(f"{B2}, c AS (SELECT DISTINCT client FROM b2), k AS (SELECT DISTINCT param, idx FROM b2) SELECT client, param, idx, 0.0::DOUBLE AS value FROM c, k")
def zero_controls(s, d):
    u = b.label_means(s, d)
    return st.zero_controls(u, ["param", "idx"], u)


@query(f"{with_sql('registry')} SELECT count(*) AS clients, CAST(2 * count(*) // 3 AS INT) AS threshold FROM registry")
def share_threshold(s, d):
    return b.registry(s, d).groupBy().agg(F.count("*").alias("clients")).withColumn("threshold", F.floor(2 * F.col("clients") / 3).cast("int"))


