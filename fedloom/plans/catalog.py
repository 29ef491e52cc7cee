"""The registered queries and the SQL that states each in ANSI form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Rounds, Settings
from ..functions.columns import client_mu, r6, staleness_weight
from ..operators import aggregate as agg
from ..operators import compress as cmp
from ..operators import privacy as dp
from ..operators import robust as byz
from ..operators import rounds as orc
from ..operators import secure as sec
from ..operators import state as st
from ..operators import training
from ..sources import weights as io
from . import bindings as b
from .bindings import with_sql
from .session import new_path, read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with its SQL where that can state it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def out(df: DataFrame, *keys: str, **values) -> DataFrame:
    """Keys as they are (idx and the like as INT), doubles rounded to six places."""
    cols = [F.col(k) for k in keys]
    kinds = dict(df.dtypes)
    cols += [(r6(v) if isinstance(v, str) and kinds.get(v) == "double" else (F.col(v) if isinstance(v, str) else v)).alias(k) for k, v in values.items()]
    return df.select(*cols)


def untied(df: DataFrame, *keys: str) -> DataFrame:
    """As out: means of prices are often exact halves of the sixth place, so both sides round them as decimals of nine places."""
    keys = keys or ("grp", "param", "idx")
    return df.select(*keys, F.round(F.col("value").cast("decimal(30,9)"), 6).cast("double").alias("value"))


B1, B2, B3, B4 = with_sql("b1"), with_sql("b1", "b2"), with_sql("b3"), with_sql("b4")
DELTAS = with_sql("b4", "deltas", recursive=True)

# -- aggregation without state


@query(f"{B1} SELECT grp, idx, round(sum(value * w) / sum(w), 6) + 0.0 AS value FROM b1 GROUP BY grp, idx")
def fedavg_weighted_mean(s, d):
    return out(agg.weighted_mean(b.vectors(s, d)), "grp", "idx", value="value")


@query(f"{B3} SELECT grp, param, idx, CAST(round(CAST(CASE WHEN sum(w) > 0 THEN sum(value * w) / sum(w) ELSE sum(value * w) END AS DECIMAL(30, 9)), 6) AS DOUBLE) AS value FROM b3 GROUP BY grp, param, idx")
def fedavg_minibatch_mean(s, d):
    return untied(agg.minibatch_mean(b.lines(s, d)))


@query(f"{B1}, c AS (SELECT DISTINCT grp, client, w FROM b1) SELECT grp, count(*) AS num_clients, round(sum(w), 6) + 0.0 AS total_weight, round(avg(w), 6) + 0.0 AS avg_weight FROM c GROUP BY grp")
def fedavg_round_metrics(s, d):
    return out(agg.round_metrics(b.vectors(s, d)), "grp", "num_clients", total_weight="total_weight", avg_weight="avg_weight")


@query(f"{B1} SELECT grp, idx, round(median(value), 6) + 0.0 AS value FROM b1 GROUP BY grp, idx")
def coordinate_median(s, d):
    return out(agg.coordinate_median(b.vectors(s, d)), "grp", "idx", value="value")


_TRIM = f"{B1}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, idx ORDER BY value, client) AS rn, count(*) OVER (PARTITION BY grp, idx) AS n FROM b1), k AS (SELECT *, {{}} AS k FROM r)"


@query(_TRIM.format("1") + " SELECT grp, idx, round(CASE WHEN max(n) <= 2 * max(k) THEN avg(value) ELSE avg(value) FILTER (rn > k AND rn <= n - k) END, 6) + 0.0 AS value FROM k GROUP BY grp, idx")
def trimmed_mean_guarded(s, d):
    return out(agg.trimmed_mean(b.vectors(s, d), faulty=1), "grp", "idx", value="value")


@query(_TRIM.format("greatest(1, CAST(floor(n * 0.1) AS INT))") + " SELECT grp, idx, round(avg(value) FILTER (rn > k AND rn <= n - k), 6) + 0.0 AS value FROM k GROUP BY grp, idx")
def trimmed_mean_base(s, d):
    return out(agg.trimmed_mean(b.vectors(s, d), share=0.1, guarded=False), "grp", "idx", value="value")


_NORMS = f"{B1}, norms AS (SELECT grp, client, sqrt(sum(value * value)) AS norm FROM b1 GROUP BY grp, client)"


@query(f"{_NORMS} SELECT grp, round(avg(norm), 6) + 0.0 AS avg_norm, round(max(norm), 6) + 0.0 AS max_norm, round(min(norm), 6) + 0.0 AS min_norm FROM norms GROUP BY grp")
def fedprox_norm_metrics(s, d):
    n = agg.update_norms(b.vectors(s, d)).groupBy("grp").agg(F.avg("norm").alias("a"), F.max("norm").alias("b"), F.min("norm").alias("c"))
    return out(n, "grp", avg_norm="a", max_norm="b", min_norm="c")


@query(f"{B3}, layers AS (SELECT grp, client, param, sqrt(sum(value * value)) AS norm FROM b3 GROUP BY ALL), norms AS (SELECT grp, client, sum(norm) AS norm FROM layers GROUP BY ALL) SELECT grp, round(least(1.0, var_pop(norm) / (avg(norm) + 1e-8)), 6) + 0.0 AS mu FROM norms GROUP BY grp")
def fedprox_adaptive_mu_variance(s, d):
    return out(agg.adaptive_mu(b.lines(s, d), "variance", "param"), "grp", mu="mu")


@query(f"{_NORMS} SELECT grp, round(least(1.0, 1 / (avg(norm) + 1)), 6) + 0.0 AS mu FROM norms GROUP BY grp")
def fedprox_adaptive_mu_norm(s, d):
    return out(agg.adaptive_mu(b.vectors(s, d), "norm"), "grp", mu="mu")


_GLOBAL = ", g AS (SELECT grp, idx, sum(value * w) / sum(w) AS gv FROM b1 GROUP BY grp, idx)"


@query(f"{B1}{_GLOBAL} SELECT grp, client, round(0.5 * 0.1 * sum((value - gv) * (value - gv)), 6) + 0.0 AS term FROM b1 JOIN g USING (grp, idx) GROUP BY grp, client")
def fedprox_proximal_term(s, d):
    u = b.vectors(s, d)
    return out(agg.proximal_term(u, agg.weighted_mean(u), 0.1), "grp", "client", term="term")


@query("SELECT vec_id AS client, round(0.01 * (1 + 0.1 * (vec_id % 7)), 6) + 0.0 AS by_staleness, round(0.01 * (1 + 0.05 * (vec_id % 5)), 6) + 0.0 AS by_epochs, 0.01::DOUBLE AS by_distance FROM embeddings")
def adaptive_client_mu(s, d):
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("client"))
    lag, ep = F.col("client") % 7, F.col("client") % 5
    return e.select("client", r6(client_mu(0.01, "staleness", lag, ep)).alias("by_staleness"), r6(client_mu(0.01, "epochs", lag, ep)).alias("by_epochs"), client_mu(0.01, "distance", lag, ep).alias("by_distance"))


@query(f"{B1} SELECT grp, idx, round(sum(value * (w / greatest(steps, 1))) / sum(w / greatest(steps, 1)), 6) + 0.0 AS value FROM b1 GROUP BY grp, idx")
def fednova_normalized(s, d):
    return out(agg.weighted_mean(b.vectors(s, d), weight=agg.nova_weight()), "grp", "idx", value="value")


@query(f"{B1} SELECT grp, idx, round(sum(value * w) / sum(w), 6) + 0.0 AS value FROM b1 GROUP BY grp, idx")
def fednova_standard(s, d):
    return out(agg.weighted_mean(b.vectors(s, d), weight=agg.nova_weight(False)), "grp", "idx", value="value")


@query(f"{B1}{_GLOBAL}, n AS (SELECT grp, idx, sum(value * (w / greatest(steps, 1))) / sum(w / greatest(steps, 1)) AS r FROM b1 GROUP BY grp, idx) SELECT grp, idx, round(r - 0.01 * (r - gv), 6) + 0.0 AS value FROM n JOIN g USING (grp, idx)")
def fednova_proximal(s, d):
    u = b.vectors(s, d)
    return out(agg.toward(agg.weighted_mean(u, weight=agg.nova_weight()), agg.weighted_mean(u), 0.01), "grp", "idx", value="value")


_PAIR = f"{B2}, p AS (SELECT x.idx, x.value AS a, y.value AS c FROM b2 x JOIN b2 y USING (idx) WHERE x.client = 0 AND y.client = 1)"


@query(f"{_PAIR} SELECT idx, round(c - a, 6) + 0.0 AS value FROM p")
def compute_delta(s, d):
    u = b.label_means(s, d)
    one = lambda k: u.where(F.col("client") == k).select("idx", "value")
    return out(agg.compute_delta(one(1), one(0), ["idx"]), "idx", value="value")


@query(f"{_PAIR} SELECT idx, round(a + c, 6) + 0.0 AS value FROM p")
def apply_delta(s, d):
    u = b.label_means(s, d)
    one = lambda k: u.where(F.col("client") == k).select("idx", "value")
    return out(agg.apply_delta(one(0), one(1), ["idx"]), "idx", value="value")


@query(f"{B2}, reg AS (SELECT client, CASE WHEN client % 2 = 0 THEN client + 1.0 ELSE 1.0 END AS rw FROM (SELECT DISTINCT client FROM b2)), prev AS (SELECT idx, value AS p FROM b2 WHERE client = 0) SELECT idx, round(max(p) + sum(value * rw) / sum(rw), 6) + 0.0 AS value FROM b2 JOIN reg USING (client) JOIN prev USING (idx) GROUP BY idx")
def server_registry_weighted_round(s, d):
    u = b.label_means(s, d)
    reg = u.select("client").distinct().where("client % 2 = 0").withColumn("w", F.col("client") + 1.0)
    prev = u.where("client = 0").select("idx", "value")
    return out(agg.registry_round(u, reg, prev, ["idx"]), "idx", value="value")


@query(f"{B1}, m AS (SELECT grp, idx, sum(value * w) / sum(w) AS v FROM b1 GROUP BY grp, idx) SELECT idx, round(avg(v), 6) + 0.0 AS value FROM m GROUP BY idx")
def hierarchical_mean(s, d):
    return out(agg.hierarchical_mean(b.vectors(s, d), "grp"), "idx", value="value")


def _staleness(method: str, expr: str) -> None:
    sql = f"{B4}, x AS (SELECT *, (SELECT max(round) FROM b4) - round AS st FROM b4) SELECT round, client, param, round({expr}, 6) + 0.0 AS weight FROM x"

    def run(s, d):
        u = b.daily(s, d)
        last = u.groupBy().agg(F.max("round").alias("_m"))
        x = u.join(F.broadcast(last)).withColumn("st", F.col("_m") - F.col("round"))
        return x.select("round", "client", "param", r6(staleness_weight(F.col("w"), F.col("st"), method)).alias("weight"))

    query(sql, f"staleness_weight_{method}")(run)


_staleness("decay", "w * pow(0.99, st)")
_staleness("linear", "w * greatest(0.0, 1 - st / 10.0)")
_staleness("quadratic", "w * greatest(0.0, 1 - pow(st / 10.0, 2.0))")
_staleness("threshold", "CASE WHEN st <= 5 THEN w ELSE w * pow(0.99, st - 5) END")


@query(f"{B4}, x AS (SELECT *, (SELECT max(round) FROM b4) - round AS st FROM b4) SELECT param, idx, round(sum(value * w * pow(0.99, st)) / sum(w * pow(0.99, st)), 6) + 0.0 AS value FROM x WHERE st <= 10 GROUP BY param, idx")
def async_batch_aggregate(s, d):
    u = b.daily(s, d)
    last = u.groupBy().agg(F.max("round").alias("_m"))
    x = agg.drop_stale(u.join(F.broadcast(last)), F.col("_m")).withColumn("w", staleness_weight(F.col("w"), F.col("staleness")))
    return out(agg.weighted_mean(x, ("param", "idx")), "param", "idx", value="value")


@query(f"{B4}, x AS (SELECT *, (SELECT max(round) FROM b4) - round AS st, row_number() OVER (PARTITION BY client, param ORDER BY round DESC) AS rn FROM b4) SELECT client, param, round(CASE WHEN st > 0 THEN value * pow(0.7, st) ELSE value END, 6) + 0.0 AS value FROM x WHERE rn = 1")
def async_value_scaling(s, d):
    u = b.daily(s, d)
    last = u.groupBy().agg(F.max("round").alias("_m"))
    x = u.join(F.broadcast(last)).withColumn("staleness", F.col("_m") - F.col("round"))
    return out(agg.scale_stale_values(x, 0.7), "client", "param", value="value")


# -- with state


@query(f"{DELTAS}, f AS (SELECT param, round, t, value AS v FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, 0.9 * f.v + x.value FROM f JOIN deltas x ON x.param = f.param AND x.t = f.t + 1) SELECT param, CAST(round AS BIGINT) AS round, round(v, 6) + 0.0 AS value FROM f")
def momentum_fold(s, d):
    return out(st.momentum(b.deltas(s, d), ["param"]), "param", "round", value="value")


@query(f"{DELTAS}, f AS (SELECT param, round, t, value AS v FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, 0.99 * f.v + (1 - 0.99) * x.value FROM f JOIN deltas x ON x.param = f.param AND x.t = f.t + 1) SELECT param, CAST(round AS BIGINT) AS round, round(v, 6) + 0.0 AS value FROM f")
def ema_fold(s, d):
    return out(st.running_average(b.deltas(s, d), ["param"]), "param", "round", value="value")


@query(f"{DELTAS}, f AS (SELECT param, round, t, (1 - 0.9) * value AS v FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, 0.9 * f.v + (1 - 0.9) * x.value FROM f JOIN deltas x ON x.param = f.param AND x.t = f.t + 1) SELECT param, CAST(round AS BIGINT) AS round, round(v, 6) + 0.0 AS value FROM f")
def variance_reduction_fold(s, d):
    return out(st.running_average(b.deltas(s, d), ["param"], 0.9, from_first=False), "param", "round", value="value")


@query(f"{DELTAS}, e AS (SELECT param, round, t, value AS r, value AS g FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, 0.99 * e.r + (1 - 0.99) * x.value, x.value FROM e JOIN deltas x ON x.param = e.param AND x.t = e.t + 1) SELECT param, CAST(round AS BIGINT) AS round, round(coalesce(0.9 * lag(r) OVER (PARTITION BY param ORDER BY t) + (1 - 0.9) * g, g), 6) + 0.0 AS value FROM e")
def gradient_estimate(s, d):
    return out(st.gradient_estimate(b.deltas(s, d), ["param"]), "param", "round", value="value")


@query(f"{DELTAS} SELECT param, CAST(round AS BIGINT) AS round, round(0.01 * value / (sqrt(0.1 + sum(value * value) OVER (PARTITION BY param ORDER BY round)) + 1e-8), 6) + 0.0 AS value FROM deltas")
def adagrad_window(s, d):
    return out(st.adagrad(b.deltas(s, d), ["param"]).withColumn("round", F.col("round").cast("bigint")), "param", "round", value="value")


@query(f"{DELTAS} SELECT param, CAST(round AS BIGINT) AS round, round(0.0 - sum(value) OVER (PARTITION BY param ORDER BY round), 6) + 0.0 AS value FROM deltas")
def scaffold_server_control(s, d):
    return out(st.server_control(b.deltas(s, d), ["param"]).withColumn("round", F.col("round").cast("bigint")), "param", "round", value="value")


_ADAM = "SELECT param, CAST(round AS BIGINT) AS round, round(0.01 * (m / (1 - pow(0.9, t))) / (sqrt({v} / (1 - pow(0.99, t))) + {e}), 6) + 0.0 AS value FROM f"


@query(f"{DELTAS}, f AS (SELECT param, round, t, (1 - 0.9) * value AS m, (1 - 0.99) * value * value AS v FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, 0.9 * f.m + (1 - 0.9) * x.value, 0.99 * f.v + (1 - 0.99) * x.value * x.value FROM f JOIN deltas x ON x.param = f.param AND x.t = f.t + 1) " + _ADAM.format(v="v", e="1e-8 + 1e-7"))
def adam_fold(s, d):
    return out(st.adam(b.deltas(s, d), ["param"]), "param", "round", value="value")


@query(f"{DELTAS}, f AS (SELECT param, round, t, (1 - 0.9) * value AS m, 0.99 * 1e-3 + sign(1e-3 - (1 - 0.99) * value * value) * (1 - 0.99) * value * value AS v FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, 0.9 * f.m + (1 - 0.9) * x.value, 0.99 * f.v + sign(f.v - (1 - 0.99) * x.value * x.value) * (1 - 0.99) * x.value * x.value FROM f JOIN deltas x ON x.param = f.param AND x.t = f.t + 1) " + _ADAM.format(v="abs(v)", e="1e-8"))
def yogi_fold(s, d):
    return out(st.yogi(b.deltas(s, d), ["param"]), "param", "round", value="value")


@query(f"{B1}{_GLOBAL} SELECT grp, client, idx, round(value - CASE WHEN client % 2 = 0 THEN 0.5 * value ELSE 0.0 END + gv, 6) + 0.0 AS value FROM b1 JOIN g USING (grp, idx)")
def scaffold_correction(s, d):
    u = b.vectors(s, d)
    own = u.where("client % 2 = 0").select("client", "grp", "idx", (0.5 * F.col("value")).alias("value"))
    return out(st.control_correction(u, own, agg.weighted_mean(u), ["grp", "idx"]), "grp", "client", "idx", value="value")


# momentum is a sum of the rounds so far, each less by 0.9 for every round since
_MOMENTUM = """ SELECT a.param, CAST(a.round AS BIGINT) AS round, round(sum(pow(0.9, a.t - c.t) * c.value), 6) + 0.0 AS value
FROM x a JOIN x c ON a.param = c.param AND c.t <= a.t GROUP BY a.param, a.round"""
_TURN = "row_number() OVER (PARTITION BY param ORDER BY round) AS t"


@query(f"{B4}, x AS (SELECT param, round, sum(value * w / (1 + client % 5)) / sum(w / (1 + client % 5)) AS value, {_TURN} FROM b4 GROUP BY param, round){_MOMENTUM}")
def fednova_momentum(s, d):
    u = b.daily(s, d).withColumn("steps", 1 + F.col("client") % 5)
    return out(st.momentum_rounds(u, ["param"], weight=agg.nova_weight()), "param", "round", value="value")


@query(f"{B4}, g AS (SELECT param, avg(value) AS gv FROM b4 GROUP BY param), x AS (SELECT param, round, 0.9 * sum(value * w) / sum(w) + 0.1 * any_value(gv) AS value, {_TURN} FROM b4 JOIN g USING (param) GROUP BY param, round){_MOMENTUM}")
def fedprox_momentum(s, d):
    u = b.daily(s, d)
    return out(st.momentum_rounds(u, ["param"], globals_=u.groupBy("param").agg(F.avg("value").alias("value")), mu=0.1), "param", "round", value="value")


@query(f"""{B4}, g AS (SELECT param, avg(value) AS gv FROM b4 GROUP BY param), o AS (SELECT client, param, 0.5 * avg(value) AS ov FROM b4 WHERE client % 2 = 0 GROUP BY ALL),
x AS (SELECT param, round, sum((value - coalesce(ov, 0) + gv) * w) / sum(w) AS value, {_TURN} FROM b4 JOIN g USING (param) LEFT JOIN o USING (client, param) GROUP BY param, round){_MOMENTUM}""")
def scaffold_momentum(s, d):
    u = b.daily(s, d)
    own = u.where("client % 2 = 0").groupBy("client", "param").agg((0.5 * F.avg("value")).alias("value"))
    fixed = st.control_correction(u, own, u.groupBy("param").agg(F.avg("value").alias("value")), ["param"])
    return out(st.momentum_rounds(fixed, ["param"]), "param", "round", value="value")


@query(f"""{B4}, m AS (SELECT round, param, client % 4 AS cluster, sum(value * w) / sum(w) AS v FROM b4 GROUP BY ALL), g AS (SELECT round, param, avg(v) AS v FROM m GROUP BY ALL)
SELECT param, round, round(length(param) + sum(v) OVER (PARTITION BY param ORDER BY round), 6) + 0.0 AS value FROM g""")
def cluster_rounds(s, d):
    u = b.daily(s, d).withColumn("cluster", F.col("client") % 4)
    start = u.select("param", F.length("param").cast("double").alias("value")).distinct()
    return out(st.cluster_rounds(u, "cluster", ["param"], start), "param", "round", value="value")


# -- faulty clients

_DIST = f"{B1}, dist AS (SELECT x.grp, x.client AS a, y.client AS b, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist FROM b1 x JOIN b1 y ON x.grp = y.grp AND x.idx = y.idx AND x.client < y.client GROUP BY ALL)"
_SCORE = f"""{_DIST}, both_ AS (SELECT grp, a AS client, b AS other, dist FROM dist UNION ALL SELECT grp, b, a, dist FROM dist),
n AS (SELECT grp, count(DISTINCT client) AS n FROM b1 GROUP BY grp),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp, client ORDER BY dist, other) AS r FROM both_),
score AS (SELECT grp, client, n, n - 3 AS k, coalesce(sum(dist) FILTER (r <= n - 3), 0) AS score FROM ranked JOIN n USING (grp) GROUP BY grp, client, n),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, client) AS place FROM score)"""


@query(f"{_DIST} SELECT grp, a, b, round(dist, 6) + 0.0 AS dist FROM dist")
def pairwise_distance(s, d):
    return out(byz.pairwise_distance(b.vectors(s, d)), "grp", "a", "b", dist="dist")


@query(f"{_SCORE} SELECT grp, client, n, k, round(score, 6) + 0.0 AS score FROM score")
def krum_scores(s, d):
    return out(byz.krum_scores(b.vectors(s, d)), "grp", "client", "n", "k", score="score")


@query(f"{_SCORE} SELECT grp, client FROM placed WHERE k < 1 OR place <= 1")
def krum_single(s, d):
    return byz.krum_survivors(b.vectors(s, d), multi=False)


@query(f"{_SCORE} SELECT grp, client FROM placed WHERE k < 1 OR place <= n - 2")
def krum_multi(s, d):
    return byz.krum_survivors(b.vectors(s, d))


@query(f"{_SCORE} SELECT grp, idx, round(sum(value * w) / sum(w), 6) + 0.0 AS value FROM b1 SEMI JOIN (SELECT grp, client FROM placed WHERE k < 1 OR place <= n - 2) q USING (grp, client) GROUP BY grp, idx")
def krum_wrapped(s, d):
    return out(byz.krum_mean(b.vectors(s, d)), "grp", "idx", value="value")


@query(f"{_SCORE.replace(B1, B3).replace('b1', 'b3').replace('x.idx = y.idx', 'x.param = y.param AND x.idx = y.idx')} SELECT grp, param, idx, CAST(round(CAST(sum(value * w) / sum(w) AS DECIMAL(30, 9)), 6) AS DOUBLE) AS value FROM b3 SEMI JOIN (SELECT grp, client FROM placed WHERE k < 1 OR place <= n - 2 UNION ALL SELECT grp, min(client) FROM b3 GROUP BY grp HAVING count(DISTINCT client) = 1) q USING (grp, client) GROUP BY grp, param, idx")
def krum_by_param(s, d):
    """Four parameters, of which many clients lack some."""
    return untied(byz.krum_mean(b.lines(s, d)))


@query(f"{B3} SELECT grp, param, idx, CAST(round(CAST(median(value) AS DECIMAL(30, 9)), 6) AS DOUBLE) AS value FROM b3 GROUP BY grp, param, idx")
def median_by_param(s, d):
    return untied(agg.coordinate_median(b.lines(s, d)))


@query(f"{B3}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, param, idx ORDER BY value, client) AS rn, count(*) OVER (PARTITION BY grp, param, idx) AS n FROM b3) SELECT grp, param, idx, CAST(round(CAST(CASE WHEN max(n) <= 2 THEN avg(value) ELSE avg(value) FILTER (rn > 1 AND rn <= n - 1) END AS DECIMAL(30, 9)), 6) AS DOUBLE) AS value FROM r GROUP BY grp, param, idx")
def trimmed_mean_by_param(s, d):
    return untied(agg.trimmed_mean(b.lines(s, d)))


#: Weiszfeld steps as a recursion over whole states, the clients' vectors as lists.
_MEDIAN = """{b2}, v AS (SELECT client, list(value ORDER BY idx) AS v FROM b2 GROUP BY client),
s0 AS (SELECT list(x ORDER BY idx) AS x FROM (SELECT idx, sum(value * w) / sum(w) AS x FROM b2 GROUP BY idx)),
steps AS (
  SELECT 0 AS t, x, true AS moves FROM s0
  UNION ALL
  SELECT t + 1, CASE WHEN sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(y[i] - x[i], 2)))) >= 1e-6 THEN y ELSE x END,
         sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(y[i] - x[i], 2)))) >= 1e-6
  FROM (SELECT t, x, list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(range(1, len(ws) + 1), lambda j: ws[j] * vs[j][i])) / list_sum(ws)) AS y
        FROM (SELECT t, x, vs, list_transform(vs, lambda v: 1 / (sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: pow(v[i] - x[i], 2)))) + 1e-10)) AS ws
              FROM steps, (SELECT list(v ORDER BY client) AS vs FROM v) WHERE moves AND t < 100)))
"""


@query(_MEDIAN.format(b2=with_sql("b1", "b2", recursive=True)) + "SELECT 0 AS grp, CAST(i - 1 AS INT) AS idx, round(x[i], 6) + 0.0 AS value FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT x FROM steps ORDER BY t DESC LIMIT 1))")
def geometric_median(s, d):
    return out(byz.geometric_median(s, b.label_means(s, d)), "grp", "idx", value="value")


@query()
def geometric_median_by_param(s, d):
    return untied(byz.geometric_median(s, b.lines(s, d), most=4))


_SUBSETS = f"{B2}, ids AS (SELECT DISTINCT client FROM b2), sub AS (SELECT CAST(9 - o.client AS INT) AS subset, i.client FROM ids o JOIN ids i ON i.client <> o.client)"


@query(f"{_SUBSETS}, v AS (SELECT subset, idx, var_pop(value) AS v FROM sub JOIN b2 USING (client) GROUP BY subset, idx), sc AS (SELECT subset, sum(v) AS score FROM v GROUP BY subset), best AS (SELECT * FROM sc ORDER BY score, subset LIMIT 1) SELECT subset, client, round(score, 6) + 0.0 AS score FROM sub JOIN best USING (subset)")
def brute_force_variance(s, d):
    return out(byz.subset_search(s, b.label_means(s, d)), "subset", "client", score="score")


@query(f"{_SUBSETS}, dist AS (SELECT x.client AS a, y.client AS b, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist FROM b2 x JOIN b2 y ON x.idx = y.idx AND x.client < y.client GROUP BY ALL), sc AS (SELECT p.subset, max(dist) AS score FROM sub p JOIN sub q USING (subset) JOIN dist ON p.client = a AND q.client = b GROUP BY p.subset), best AS (SELECT * FROM sc ORDER BY score, subset LIMIT 1) SELECT subset, client, round(score, 6) + 0.0 AS score FROM sub JOIN best USING (subset)")
def brute_force_max_dist(s, d):
    return out(byz.subset_search(s, b.label_means(s, d), metric="max_dist"), "subset", "client", score="score")


# -- compression

_TOP = f"{B1}, r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY abs(value) DESC, idx) AS rn, rank() OVER (PARTITION BY client ORDER BY abs(value) DESC) AS rk, greatest(1, CAST(floor(count(*) OVER (PARTITION BY client) * 0.1) AS INT)) AS k FROM b1)"


@query(f"{_TOP} SELECT client, idx, round(value, 6) + 0.0 AS value FROM r WHERE rn <= k")
def topk_per_param(s, d):
    return out(cmp.top_k(b.vectors(s, d)), "client", "idx", value="value")


@query(f"{_TOP} SELECT client, idx, round(value, 6) + 0.0 AS value FROM r WHERE rk <= k")
def topk_global(s, d):
    return out(cmp.top_k_global(b.vectors(s, d)), "client", "idx", value="value")


@query(f"{_TOP} SELECT client, idx, round(CASE WHEN rn <= k THEN value ELSE 0.0 END, 6) + 0.0 AS value FROM r")
def topk_roundtrip(s, d):
    u = b.vectors(s, d)
    return out(cmp.scatter(cmp.top_k(u).select("client", "idx", "value"), u.select("client", "idx"), ["client", "idx"]), "client", "idx", value="value")


#: A number between 0 and 1 by the MD5 of a text, as functions.columns.uniform.
_U = "((CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"
_RANDOM = f"{B1}, r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY {_U.format(chr(39) + '7:' + chr(39) + ' || client || ' + chr(39) + ':embedding:' + chr(39) + ' || idx')}, idx) AS rn, greatest(1, CAST(floor(count(*) OVER (PARTITION BY client) * 0.1) AS INT)) AS k, count(*) OVER (PARTITION BY client) AS n, sqrt(sum(value * value) OVER (PARTITION BY client)) AS norm FROM b1)"


@query(f"{_RANDOM} SELECT client, idx, round(value, 6) + 0.0 AS value, round(norm / (sqrt(sum(value * value) OVER (PARTITION BY client)) + 1e-10), 6) + 0.0 AS norm_scale, round(n / k, 6) + 0.0 AS mean_scale FROM r WHERE rn <= k")
def randomk_hash(s, d):
    return out(cmp.random_k(b.vectors(s, d), seed=7), "client", "idx", value="value", norm_scale="norm_scale", mean_scale="mean_scale")


@query(f"{B1}, m AS (SELECT *, min(value) OVER (PARTITION BY client) AS lo, max(value) OVER (PARTITION BY client) AS hi FROM b1), q AS (SELECT *, CAST(round_even((value - lo) / (hi - lo + 1e-10) * 255, 0) AS INT) AS code FROM m) SELECT client, idx, code, round(lo + code / 255.0 * (hi - lo), 6) + 0.0 AS restored FROM q")
def quantize_uniform(s, d):
    return out(cmp.quantize(b.vectors(s, d)), "client", "idx", "code", restored="restored")


@query(f"{B1}, l AS (SELECT *, log2(abs(value) + 1e-10) AS x FROM b1), m AS (SELECT *, min(x) OVER (PARTITION BY client) AS lo, max(x) OVER (PARTITION BY client) AS hi FROM l), q AS (SELECT *, CAST(round_even((x - lo) / (hi - lo + 1e-10) * 255, 0) AS INT) AS code FROM m) SELECT client, idx, code, round(pow(2.0, lo + code / 255.0 * (hi - lo)) * sign(value), 6) + 0.0 AS restored FROM q")
def quantize_log(s, d):
    return out(cmp.quantize_log(b.vectors(s, d)), "client", "idx", "code", restored="restored")


@query(f"{B1}, m AS (SELECT *, max(abs(value)) OVER (PARTITION BY client) AS top FROM b1), c AS (SELECT client, idx, value, top, i, row_number() OVER (PARTITION BY client, idx ORDER BY abs(abs(value) - top * pow(0.5, i)), i) AS r FROM m, range(8) AS t(i)) SELECT client, idx, CAST(i AS INT) AS code, round(top * pow(0.5, i) * CASE WHEN value > 0 THEN 1 ELSE -1 END, 6) + 0.0 AS restored FROM c WHERE r = 1")
def quantize_pow2(s, d):
    return out(cmp.quantize_pow2(b.vectors(s, d)), "client", "idx", "code", restored="restored")


@query(_SQL["quantize_pow2"].replace(" * CASE WHEN value > 0 THEN 1 ELSE -1 END", ""))
def quantize_pow2_unsigned(s, d):
    return out(cmp.quantize_pow2(b.vectors(s, d), signed=False), "client", "idx", "code", restored="restored")


@query(f"{B1} SELECT client, count(*) AS n, count(*) FILTER (abs(value) > 0.5) AS sent, round(count(*) FILTER (abs(value) > 0.5) / count(*), 6) + 0.0 AS share FROM b1 GROUP BY client")
def sent_share(s, d):
    u = b.vectors(s, d)
    return out(cmp.sent_share(cmp.compress(u, "sparse", least=0.5), u), "client", "n", "sent", share="share")


@query(f"{B1} SELECT client, idx, CAST(value > 0 AS INT) AS bit, round((2 * CAST(value > 0 AS INT) - 1) * avg(abs(value)) OVER (PARTITION BY client), 6) + 0.0 AS restored FROM b1")
def sign_compress(s, d):
    return out(cmp.sign_compress(b.vectors(s, d)), "client", "idx", "bit", restored="restored")


@query(f"{B1} SELECT client, idx, round(CASE WHEN abs(value) > 0.5 THEN value ELSE 0.0 END, 6) + 0.0 AS value FROM b1")
def threshold_sparsify(s, d):
    return out(cmp.threshold(b.vectors(s, d), 0.5), "client", "idx", value="value")


@query(f"{B1}, t AS (SELECT client, quantile_cont(abs(value), 0.9) AS t FROM b1 GROUP BY client) SELECT client, idx, round(CASE WHEN abs(value) > t THEN value ELSE 0.0 END, 6) + 0.0 AS value FROM b1 JOIN t USING (client)")
def percentile_sparsify(s, d):
    return out(cmp.percentile_sparsify(b.vectors(s, d)), "client", "idx", value="value")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def value_frequencies(s, d):
    return cmp.value_frequencies(read_table(s, d, "lineitem"), "l_returnflag")


_RUNS = "WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)), r AS (SELECT *, sum(ch) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS run FROM c)"


def _runs(s, d):
    return cmp.run_length_encode(read_table(s, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_returnflag")


@query(_RUNS + " SELECT l_suppkey, CAST(run AS BIGINT) AS run, l_returnflag, count(*) AS n FROM r GROUP BY l_suppkey, run, l_returnflag")
def run_length_encode(s, d):
    return _runs(s, d).withColumn("run", F.col("run").cast("bigint")).select("l_suppkey", "run", "l_returnflag", "n")


@query("SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos, l_returnflag FROM lineitem")
def run_length_decode(s, d):
    return cmp.run_length_decode(_runs(s, d), ["l_suppkey"], "l_returnflag").withColumn("pos", F.col("pos").cast("bigint"))


@query(f"{B1}, n AS (SELECT client, count(*) AS n FROM b1 GROUP BY client), o AS (SELECT client, unnest(['top_k', 'quantization', 'sign']) AS method, unnest([1 - (12 * greatest(1, CAST(floor(n * 0.1) AS INT)) + 8) / (4.0 * n), 1 - (n + 16) / (4.0 * n), 1 - (n + 12) / (4.0 * n)]::DOUBLE[]) AS saving, unnest([0, 1, 2]) AS i FROM n) SELECT client, arg_max(method, saving) AS method, round(max(saving), 6) + 0.0 AS saving FROM o GROUP BY client")
def adaptive_method_choice(s, d):
    return out(cmp.method_choice(b.vectors(s, d), group=("client",)), "client", "method", saving="saving")


_SIM = f"{B4}, p AS (SELECT *, lag(value) OVER (PARTITION BY client, param, idx ORDER BY round) AS pv FROM b4), z AS (SELECT client, round, sqrt(sum((value - pv) * (value - pv))) AS df, sqrt(sum(value * value)) AS nv FROM p GROUP BY client, round), q AS (SELECT client, round, CASE WHEN df IS NULL THEN NULL WHEN nv = 0 THEN 1.0 ELSE 1 - least(1.0, df / (nv + 1e-10)) END AS similarity FROM z)"


@query(f"{_SIM} SELECT client, round, round(similarity, 6) + 0.0 AS similarity, coalesce(similarity >= 0.5, false) AS skipped FROM q")
def update_similarity(s, d):
    return out(cmp.update_similarity(b.daily(s, d), least=0.5), "client", "round", similarity="similarity", skipped="skipped")


@query(f"{_SIM} SELECT client, round(avg(CASE WHEN coalesce(similarity >= 0.5, false) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS skipped_ratio FROM q GROUP BY client")
def skip_ratio(s, d):
    return out(cmp.skip_ratio(cmp.update_similarity(b.daily(s, d), least=0.5)), "client", skipped_ratio="skipped_ratio")


_SENT = f"""{B1}, p AS (SELECT *, min(value) OVER g AS lo, max(value) OVER g AS hi, avg(abs(value)) OVER g AS m, count(*) OVER g AS n, row_number() OVER (PARTITION BY client ORDER BY abs(value) DESC, idx) AS r
FROM b1 WINDOW g AS (PARTITION BY client))"""
_QUANT = "lo + round_even((value - lo) / (hi - lo + 1e-10) * 255, 0) / 255.0 * (hi - lo)"


@query(f"{_SENT}, c AS (SELECT *, CASE WHEN 1 - (n + 12) / (4.0 * n) > 1 - (12 * greatest(1, CAST(floor(n * 0.5) AS INT)) + 8) / (4.0 * n) THEN 'sign' ELSE 'top_k' END AS method FROM p) SELECT client, idx, method, round(CASE WHEN method = 'sign' THEN CASE WHEN value > 0 THEN m ELSE -m END ELSE value END, 6) + 0.0 AS restored FROM c WHERE method = 'sign' OR r <= greatest(1, CAST(floor(n * 0.5) AS INT))")
def adaptive_compression(s, d):
    return out(cmp.compress(b.vectors(s, d), "adaptive", 0.5), "client", "idx", "method", restored="restored")


@query("WITH o AS (SELECT o_orderkey AS client, 0 AS idx, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 1, -o_totalprice FROM orders WHERE o_orderkey % 3 = 0) SELECT client, idx, CAST(NULL AS VARCHAR) AS method, round(value, 6) + 0.0 AS restored FROM o")
def adaptive_compression_none(s, d):
    """Groups of one or two values, for which no method saves a byte."""
    o = read_table(s, d, "orders").select(F.col("o_orderkey").alias("client"), F.lit("price").alias("param"), F.posexplode(F.when(F.col("o_orderkey") % 3 == 0, F.array("o_totalprice", -F.col("o_totalprice"))).otherwise(F.array("o_totalprice"))).alias("idx", "value"))
    return out(cmp.compress(o, "adaptive", 0.5), "client", "idx", "method", restored="restored")


_METHODS = ("top_k", "quantization", "sign", "sparse", "dft")


@query(f"""{_SENT}, k AS (SELECT *, r <= greatest(1, CAST(floor(n * 0.1) AS INT)) AS big FROM p)
SELECT client, idx, round(CASE WHEN big THEN value ELSE 0 END, 6) + 0.0 AS top_k, round({_QUANT}, 6) + 0.0 AS quantization, round(CASE WHEN value > 0 THEN m ELSE -m END, 6) + 0.0 AS sign,
round(CASE WHEN abs(value) > 0.01 THEN value ELSE 0 END, 6) + 0.0 AS sparse, round(CASE WHEN big THEN value ELSE 0 END, 6) + 0.0 AS dft FROM k""")
def compressor_dispatch(s, d):
    """What each method named gives back at every coordinate; names that aren't known are top_k."""
    on = ["client", "param", "idx"]
    u = b.vectors(s, d)
    x = u.select(*on)
    for m in _METHODS:
        x = cmp.decompress(cmp.compress(u, m), x, on).withColumnRenamed("value", m)
    return out(x, "client", "idx", **{m: m for m in _METHODS})


@query(f"{B1} SELECT client, CAST(idx AS BIGINT) AS pos, round(value, 6) + 0.0 AS value FROM b1")
def coder_roundtrip(s, d):
    packed = cmp.encode(b.vectors(s, d), ["client"], ["idx"], piece=10)
    return out(cmp.decode(packed, ["client"], piece=10), "client", "pos", value="value")


# -- privacy


@query(f"{B1} SELECT client, idx, round(value * least(1.0, 1.0 / (sqrt(sum(value * value) OVER (PARTITION BY client, idx // 8)) + 1e-6)), 6) + 0.0 AS value FROM b1")
def clip_rows(s, d):
    u = b.vectors(s, d).withColumn("row", F.floor(F.col("idx") / 8))
    return out(dp.clip(u, ["client", "row"]), "client", "idx", value="value")


@query(f"{B1} SELECT client, idx, round(value * least(1.0, 1.0 / (sqrt(sum(value * value) OVER (PARTITION BY client)) + 1e-6)), 6) + 0.0 AS value FROM b1")
def clip_global(s, d):
    return out(dp.clip(b.vectors(s, d), ["client"]), "client", "idx", value="value")


@query(f"{_NORMS} SELECT round(quantile_cont(norm, 0.5), 6) + 0.0 AS max_norm FROM norms")
def adaptive_clip_norm(s, d):
    return out(dp.adaptive_norm(b.vectors(s, d), ["client"]), max_norm="max_norm")


_LOG = """WITH log AS (SELECT event_id, 0.001 * (1 + event_id % 10) AS q, 0.5 + (event_id % 4) AS z, 1 + event_id % 3 AS steps FROM events),
sums AS (SELECT sum(steps * q * q * z * z) AS a, sum(steps * q * q * q * z * z * z) AS b, sum(steps) AS steps FROM log),
orders AS (SELECT CAST(x - 1 AS INT) AS i, 1 + x / 10.0 AS alpha FROM range(1, 100) t(x) UNION ALL SELECT CAST(99 + x - 12 AS INT), x FROM range(12, 64) t(x)),
rdp AS (SELECT i, alpha, CASE WHEN alpha < 2 THEN 0 ELSE 0.5 * alpha * a + CASE WHEN alpha > 2 THEN (alpha - 1) * b / 6 ELSE 0 END END AS rdp, steps FROM orders, sums)"""


def _log(s, d):
    e = F.col("event_id")
    return read_table(s, d, "events").select((F.lit(0.001) * (1 + e % 10)).alias("sample_rate"), (F.lit(0.5) + e % 4).alias("noise_multiplier"), (1 + e % 3).alias("steps"))


@query(f"{_LOG} SELECT i, round(alpha, 6) + 0.0 AS alpha, round(rdp, 6) + 0.0 AS rdp FROM rdp")
def rdp_per_order(s, d):
    return out(dp.rdp_per_order(_log(s, d), dp.orders(s)), "i", alpha="alpha", rdp="rdp")


@query(f"{_LOG}, e AS (SELECT i, rdp / steps * alpha + ln(1e-5) / (alpha - 1) AS eps, rdp, steps FROM rdp) SELECT round(CASE WHEN max(rdp) = 0 THEN 0 WHEN count(*) FILTER (eps > 0) > 0 THEN arg_min(eps, i) FILTER (eps > 0) ELSE max(steps) * 0.01 END, 6) + 0.0 AS epsilon FROM e")
def rdp_epsilon(s, d):
    return out(dp.rdp_epsilon(dp.rdp_per_order(_log(s, d), dp.orders(s))), epsilon="epsilon")


@query(f"{_LOG} SELECT round(sum(steps * q), 6) + 0.0 AS mu, round(sqrt(sum(steps * q * q * z * z)), 6) + 0.0 AS sigma FROM log")
def gdp_mu(s, d):
    return out(dp.gdp(_log(s, d)), mu="mu", sigma="sigma")


@query(f"{_LOG} SELECT round(sum(steps * q * z) * sqrt(2 * ln(1 / 1e-5)), 6) + 0.0 AS epsilon FROM log")
def simple_epsilon(s, d):
    return out(dp.simple_epsilon(_log(s, d)), epsilon="epsilon")


@query("WITH g AS (SELECT 0.1 * (1 + r_regionkey) AS e, 1e-6 * (1 + r_regionkey) AS d FROM region) SELECT round(max(e) * sqrt(2 * count(*) * ln(1 / max(d))), 6) + 0.0 AS epsilon, round(count(*) * max(d) * 1e6, 6) + 0.0 AS delta_ppm, round(sum(e), 6) + 0.0 AS sequential, round(sum(e) * sqrt(CAST(count(*) AS DOUBLE)), 6) + 0.0 AS other FROM g")
def compose_guarantees(s, d):
    k = F.col("r_regionkey")
    g = read_table(s, d, "region").select((F.lit(0.1) * (1 + k)).alias("epsilon"), (F.lit(1e-6) * (1 + k)).alias("delta"))
    x = dp.compose(g).join(dp.compose(g, "sequential").select(F.col("epsilon").alias("sequential"))).join(dp.compose(g, "root").select(F.col("epsilon").alias("other")))
    return x.select(r6("epsilon").alias("epsilon"), r6(F.col("delta") * 1e6).alias("delta_ppm"), r6("sequential").alias("sequential"), r6("other").alias("other"))


@query("SELECT r_regionkey, round(sqrt(2 * ln(1.25 / 1e-5)) * (1 + r_regionkey) / 2.0, 6) + 0.0 AS gaussian, round((1 + r_regionkey) / 2.0, 6) + 0.0 AS laplace FROM region")
def calibrate_noise(s, d):
    sens = (1 + F.col("r_regionkey")).cast("double")
    f = lambda how: r6(dp.calibrated_noise(F.lit(2.0), F.lit(1e-5), sens, how)).alias(how)
    return read_table(s, d, "region").select("r_regionkey", f("gaussian"), f("laplace"))


@query(f"{_NORMS} SELECT round(0.5 * (1 + 0.1 * avg(norm)), 6) + 0.0 AS noise FROM norms")
def adaptive_noise(s, d):
    return out(dp.adaptive_noise(b.vectors(s, d), 0.5, ["client"]), noise="noise")


@query("SELECT r_regionkey, round(greatest(0.0, 2.0 - 0.75 * r_regionkey), 6) + 0.0 AS remaining, round(least(1.0, 0.75 * r_regionkey / 2.0), 6) + 0.0 AS ratio, 2.0 - 0.75 * r_regionkey <= 0 AS exhausted FROM region")
def privacy_budget(s, d):
    x = read_table(s, d, "region").select("r_regionkey", dp.budget(F.lit(2.0), F.lit(0.75) * F.col("r_regionkey")).alias("x")).select("r_regionkey", "x.*")
    return out(x, "r_regionkey", remaining="remaining", ratio="ratio", exhausted="exhausted")


_NOISE = "'7:{}' || client || ':embedding:' || idx"


@query(f"{B1} SELECT client, idx, round(value + 0.1 * sqrt(-2 * ln({_U.format(_NOISE.format('r:'))})) * cos(2 * pi() * {_U.format(_NOISE.format('a:'))}), 6) + 0.0 AS value FROM b1")
def gaussian_noise(s, d):
    return out(dp.add_gaussian(b.vectors(s, d), 0.1, 7), "client", "idx", value="value")


@query(f"{B1}, x AS (SELECT *, {_U.format(_NOISE.format(''))} - 0.5 AS u FROM b1) SELECT client, idx, round(value - 0.1 * sign(u) * ln(greatest(1 - 2 * abs(u), 1e-300)), 6) + 0.0 AS value FROM x")
def laplace_noise(s, d):
    return out(dp.add_laplace(b.vectors(s, d), 0.1, 7), "client", "idx", value="value")


# -- secure aggregation

_FIX = f"{B2}, f AS (SELECT client, idx, CAST(trunc(value * 1000000) AS BIGINT) AS v FROM b2)"


def _fixed(s, d):
    return b.label_means(s, d).select("client", "param", "idx", F.round("value", 9).alias("value"))


@query(_FIX.replace("value * 1000000", "round(value, 9) * 1000000") + " SELECT client, idx, round(v / 1000000.0, 6) + 0.0 AS value FROM f")
def shamir_roundtrip(s, d):
    keys = ("client", "idx")
    x = _fixed(s, d).select("client", "idx", sec.encode(F.col("value")).alias("secret"))
    shares = sec.share(x, 3, 5, 7, keys)
    return out(sec.reconstruct(shares, [5, 2, 4], 3, keys).withColumn("value", sec.decode(F.col("secret"))), *keys, value="value")


_SUMMED = _FIX.replace("value * 1000000", "round(value, 9) * 1000000") + " SELECT idx, round(sum(v) / 1000000.0, 6) + 0.0 AS value FROM f GROUP BY idx"


@query(_SUMMED)
def fixed_point_sum(s, d):
    x = _fixed(s, d).select("client", "idx", sec.encode(F.col("value")).alias("secret"))
    total = sec.shared_sum(sec.share(x, 3, 5, 7, ("client", "idx")), ("idx",))
    return out(sec.reconstruct(total, [1, 3, 5], 3, ("idx",)).withColumn("value", sec.decode(F.col("secret"))), "idx", value="value")


@query(_SUMMED)
def pairwise_mask_sum(s, d):
    x = _fixed(s, d)
    m = sec.masked(x, x.select("client"), 7).groupBy("idx").agg(sec.field(F.sum("masked")).alias("t"))
    return out(m.withColumn("value", sec.decode(F.col("t"))), "idx", value="value")


@query("SELECT c_custkey AS client, sha256(CAST(CAST(round(c_acctbal * 1000000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(c_nationkey * 1000000.0) AS BIGINT) AS VARCHAR)) AS commitment FROM customer")
def hash_commitment(s, d):
    x = read_table(s, d, "customer").select(F.col("c_custkey").alias("client"), F.posexplode(F.array("c_acctbal", F.col("c_nationkey").cast("double"))).alias("idx", "value"))
    return sec.commitment(x, ("client",), places=6)


# -- budgets


@query("SELECT r_regionkey, round(greatest(0.0, 2.0 - 0.25 * r_regionkey), 6) + 0.0 AS remaining, round(greatest(0.0, 3.0 - r_regionkey), 6) + 0.0 AS remaining_delta, 2.0 - 0.25 * r_regionkey <= 0 OR 3.0 - r_regionkey <= 0 AS exhausted FROM region")
def privacy_budget_both(s, d):
    k = F.col("r_regionkey")
    x = read_table(s, d, "region").select("r_regionkey", dp.budget(F.lit(2.0), F.lit(0.25) * k, F.lit(3.0), k.cast("double")).alias("x")).select("r_regionkey", "x.*")
    return out(x, "r_regionkey", remaining="remaining", remaining_delta="remaining_delta", exhausted="exhausted")


@query("SELECT user_id, event_id, round(greatest(0.5, 8.0 - sum(0.001 * (1 + event_id % 10)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) + 0.0 AS left_over FROM events")
def budget_trace(s, d):
    e = read_table(s, d, "events").select("user_id", "event_id", (F.lit(0.001) * (1 + F.col("event_id") % 10)).alias("spent"))
    return out(dp.budget_trace(e, "user_id", "event_id", 8.0, 0.5), "user_id", "event_id", left_over="left")


@query("SELECT c_custkey AS client, round((c_custkey % 50) * 0.01 / nullif((c_custkey % 4) * 0.5, 0), 6) + 0.0 AS spent, round(greatest(0.0, 0.3 - (c_custkey % 50) * 0.01 / nullif((c_custkey % 4) * 0.5, 0)), 6) + 0.0 * nullif((c_custkey % 4) * 0.5, 0) AS remaining FROM customer")
def client_privacy_spent(s, d):
    k = F.col("client")
    c = read_table(s, d, "customer").select(F.col("c_custkey").alias("client"))
    x = c.select("client", dp.client_spent((k % 50).cast("double"), (k % 4) * F.lit(0.5), F.lit(0.3)).alias("x")).select("client", "x.*")
    return out(x.withColumn("remaining", F.when(F.col("spent").isNotNull(), F.col("remaining"))), "client", spent="spent", remaining="remaining")


@query(f"{_LOG}, t AS (SELECT sum(steps * q * z) * sqrt(2 * ln(1 / 1e-5)) AS e, sum(steps) AS steps FROM log) SELECT 'simple' AS accountant, 8.0::DOUBLE AS target_epsilon, round(e, 6) + 0.0 AS spent_epsilon, CAST(steps AS BIGINT) AS steps, round(least(1.0, e / 8.0), 6) + 0.0 AS ratio, e >= 8.0 AS exhausted FROM t")
def accounting_summary(s, d):
    x = dp.accounting_summary(_log(s, d), dp.orders(s), "simple").withColumn("steps", F.col("steps").cast("bigint"))
    return out(x, "accountant", target_epsilon="target_epsilon", spent_epsilon="spent_epsilon", steps="steps", ratio="ratio", exhausted="exhausted")


@query("""WITH u AS (SELECT c_custkey AS run, 1 + c_custkey % 5 AS epochs, 10 + c_custkey % 90 AS bs, 100 + c_custkey AS n, 0.1 * (1 + c_custkey % 30) AS z FROM customer),
o AS (SELECT CAST(x - 1 AS INT) AS i, 1 + x / 10.0 AS alpha FROM range(1, 100) t(x) UNION ALL SELECT CAST(99 + x - 12 AS INT), x FROM range(12, 64) t(x)),
e AS (SELECT run, CAST(epochs * (n // bs) AS BIGINT) AS steps, bs / n AS q, z, i, alpha FROM u, o),
f AS (SELECT run, steps, i, CASE WHEN alpha < 2 THEN 0 ELSE 0.5 * alpha * q * q * z * z + CASE WHEN alpha > 2 THEN (alpha - 1) * q * q * q * z * z * z / 6 ELSE 0 END END * alpha + ln(1e-5) / (alpha - 1) AS eps FROM e)
SELECT run, steps, round(CASE WHEN steps = 0 THEN 0 WHEN count(*) FILTER (eps > 0) > 0 THEN arg_min(eps, i) FILTER (eps > 0) ELSE steps * 0.01 END, 6) + 0.0 AS epsilon FROM f GROUP BY run, steps""")
def run_epsilon(s, d):
    k = F.col("c_custkey")
    runs = read_table(s, d, "customer").select(k.alias("run"), (1 + k % 5).alias("epochs"), (10 + k % 90).alias("batch_size"), (100 + k).alias("dataset_size"), (F.lit(0.1) * (1 + k % 30)).alias("noise_multiplier"))
    return out(dp.run_epsilon(s, runs), "run", "steps", epsilon="epsilon")


# -- whole rounds

_T, _LR = 4, 0.3


def _rounds_sql(stats: tuple[str, ...], start: tuple[str, ...], change: str, then: tuple[str, ...]) -> str:
    """All clients take part with one step each, so a round's mean is a step over all rows: d0, d1. stats and then name a strategy's state of both coordinates ({i})."""
    cols = [x.format(i=i) for i in (0, 1) for x in stats]
    first = "".join(f", {v}::DOUBLE AS {c}" for c, v in zip(cols, start * 2, strict=True))
    later = "".join(", " + e.format(i=i) for i in (0, 1) for e in then)
    return f"""WITH RECURSIVE x AS (SELECT l_quantity / 50 AS a, l_extendedprice / 100000 AS y FROM lineitem),
g AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a) AS sa, sum(a * y) AS ay, sum(y) AS sy FROM x),
r AS (SELECT 0 AS t, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1{first}
UNION ALL SELECT t + 1, w0 + {change.format(i=0)}, w1 + {change.format(i=1)}{later}
FROM (SELECT r.*, -{_LR} * (aa * w0 + sa * w1 - ay) / n AS d0, -{_LR} * (sa * w0 + n * w1 - sy) / n AS d1 FROM r, g) WHERE t < {_T})
SELECT CAST(t AS INT) AS round, CAST(unnest([0, 1]) AS INT) AS idx, round(unnest([w0, w1]), 6) + 0.0 AS value FROM r"""


def _rounds(strategy: str, resumed: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        x = read_table(s, d, "lineitem").select((F.col("l_suppkey") % 10).alias("client"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("y"))
        registry = s.range(10).select(F.col("id").alias("client"), F.lit(True).alias("enabled"), F.lit(1.0).alias("weight"))
        seen: dict[int, list[float]] = {}
        path = new_path(s, "run") if resumed else None

        def go(rounds: int, **more) -> None:
            settings = Settings(Rounds(rounds=rounds, strategy=strategy, checkpoint_every=2))
            seen[rounds], _ = training.run_rounds(s, x, registry, ["a"], "y", settings, lr=_LR, on_round=lambda t, w, e: seen.update({t: w}), checkpoints=path, **more)

        if resumed:
            go(2)
        go(_T, resume=resumed)
        rows = [(t, i, float(v)) for t, w in seen.items() for i, v in enumerate(w)]
        return out(s.createDataFrame(rows, "round int, idx int, value double"), "round", "idx", value="value")

    return run


_MOMENTS = ("m{i}", "v{i}")
_PLAIN = _rounds_sql((), (), "d{i}", ())
_YOGI = "0.99 * v{i} + sign(v{i} - (1 - 0.99) * d{i} * d{i}) * (1 - 0.99) * d{i} * d{i}"
_STEP = "0.01 * ((0.9 * m{{i}} + (1 - 0.9) * d{{i}}) / (1 - pow(0.9, t + 1))) / (sqrt({} / (1 - pow(0.99, t + 1))) + {})"
_SQUARE = "(0.99 * v{i} + (1 - 0.99) * d{i} * d{i})"
_FIRST = "0.9 * m{i} + (1 - 0.9) * d{i}"
_ROUND_SQL = {
    "fedavg": _PLAIN,
    "fednova": _PLAIN,
    "async": _PLAIN,
    "fedavgm": _rounds_sql(("b{i}",), ("0",), "0.9 * b{i} + d{i}", ("0.9 * b{i} + d{i}",)),
    "fedadam": _rounds_sql(_MOMENTS, ("0", "0"), _STEP.format(_SQUARE, "1e-8 + 1e-7"), (_FIRST, _SQUARE)),
    "fedyogi": _rounds_sql(_MOMENTS, ("0", "0.001"), _STEP.format(f"abs({_YOGI})", "1e-8"), (_FIRST, _YOGI)),
    "fedadagrad": _rounds_sql(("q{i}",), ("0.1",), "0.01 * d{i} / (sqrt(q{i} + d{i} * d{i}) + 1e-8)", ("q{i} + d{i} * d{i}",)),
    "scaffold": _rounds_sql(("c{i}",), ("0",), "d{i} + c{i}", ("c{i} - (d{i} + c{i})",)),
}
for _name, _text in _ROUND_SQL.items():
    query(_text, f"rounds_{_name}")(_rounds(_name))
query(_ROUND_SQL["fedadam"], "rounds_resumed")(_rounds("fedadam", True))


# -- rounds, metrics, vertical


_REG = with_sql("registry")
_DRAWN = _U.format("'7:' || client")


@query(f"{_REG} SELECT client FROM registry ORDER BY {_DRAWN}, client LIMIT 20")
def sample_uniform(s, d):
    return orc.sample_uniform(b.registry(s, d), 20, 7).select("client")


@query(f"{_REG} SELECT client FROM registry WHERE weight > 0 ORDER BY -ln({_DRAWN}) / weight, client LIMIT 20")
def sample_weighted(s, d):
    return orc.sample_weighted(b.registry(s, d), 20, 7).select("client")


@query(f"{_REG}, line AS (SELECT client, sum(weight) OVER (ORDER BY md5(CAST(client AS VARCHAR)), client) AS hi, weight FROM registry WHERE weight > 0), draws AS (SELECT draw, {_U.format(chr(39) + '7:' + chr(39) + ' || draw')} * (SELECT max(hi) FROM line) AS place FROM range(20) r(draw)) SELECT draw, client FROM draws JOIN line ON place < hi AND place >= hi - weight")
def sample_with_replacement(s, d):
    return orc.sample_with_replacement(b.registry(s, d), 20, 7)


@query(f"{DELTAS}, f AS (SELECT param, round, t, value AS best, 0 AS counter FROM deltas WHERE t = 1 UNION ALL SELECT x.param, x.round, x.t, CASE WHEN x.value > f.best + 0.5 THEN x.value ELSE f.best END, CASE WHEN x.value > f.best + 0.5 THEN 0 ELSE f.counter + 1 END FROM f JOIN deltas x ON x.param = f.param AND x.t = f.t + 1) SELECT param, CAST(round AS BIGINT) AS round, round(best, 6) + 0.0 AS best, counter, counter >= 3 AS stop FROM f")
def early_stopping_trace(s, d):
    x = st.early_stopping(b.deltas(s, d), "param", 3, 0.5).withColumn("counter", F.col("counter").cast("int"))
    return out(x, "param", "round", best="best", counter="counter", stop="stop")


@query("WITH last AS (SELECT user_id AS client, event_type AS param, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT client, param, round(value, 6) + 0.0 AS value FROM last")
def last_write_wins(s, d):
    e = read_table(s, d, "events").select(F.col("user_id").alias("client"), F.col("event_type").alias("param"), "event_id", "value")
    return out(orc.latest_updates(e, ["client", "param"], "event_id"), "client", "param", value="value")


@query(f"{B4} SELECT round, count(DISTINCT client) AS clients FROM b4 GROUP BY round HAVING count(DISTINCT client) >= 10")
def round_quorum(s, d):
    return orc.quorum(b.daily(s, d), 10)


_E = "WITH e AS (SELECT vec_id AS sample, label AS client, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def _parties(s, d):
    return b.vectors(s, d).select((F.col("client") % 50).alias("sample"), F.col("grp").alias("client"), F.col("idx").alias("dim"), "value")


@query(_E.replace("vec_id AS sample", "vec_id % 50 AS sample") + ", w AS (SELECT DISTINCT client, client + 1.0 AS w FROM e) SELECT sample, dim, round(sum(value * w) / (SELECT sum(w) FROM w), 6) + 0.0 AS value FROM e JOIN w USING (client) GROUP BY sample, dim")
def vertical_weighted_mean(s, d):
    x = _parties(s, d)
    return out(orc.combine_embeddings(x, x.select("client").distinct().withColumn("w", F.col("client") + 1.0)), "sample", "dim", value="value")


@query(_E.replace("vec_id AS sample", "vec_id % 50 AS sample") + " SELECT sample, dim, round(avg(value), 6) + 0.0 AS value FROM e GROUP BY sample, dim")
def vertical_mean(s, d):
    return out(orc.combine_embeddings(_parties(s, d)), "sample", "dim", value="value")


@query(_E + " SELECT client, dim, round(avg(value), 6) + 0.0 AS value FROM e GROUP BY client, dim")
def local_embedding(s, d):
    return out(orc.local_embedding(_parties(s, d)), "client", "dim", value="value")


_F = "WITH f AS (SELECT DISTINCT s_nationkey AS client, s_suppkey % 17 AS feature FROM supplier)"


def _features(s, d):
    return read_table(s, d, "supplier").select(F.col("s_nationkey").alias("client"), (F.col("s_suppkey") % 17).alias("feature"))


@query(f"{_F} SELECT client, string_agg(CAST(feature AS VARCHAR), ',' ORDER BY feature) AS features FROM f GROUP BY client")
def feature_alignment(s, d):
    return orc.feature_alignment(_features(s, d)).withColumn("features", F.array_join(F.transform("features", lambda x: x.cast("string")), ","))


@query(f"{_F} SELECT count(DISTINCT feature) AS features, count(DISTINCT client) AS clients FROM f")
def feature_overlap(s, d):
    return orc.feature_overlap(_features(s, d))


@query("SELECT o_orderkey, o_totalprice, q FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def entity_alignment(s, d):
    a = read_table(s, d, "orders").select("o_orderkey", "o_totalprice")
    c = read_table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return orc.align_entities([a, c], "o_orderkey")


def _metrics(s, d):
    return read_table(s, d, "events").select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("seq"))


@query("SELECT event_type AS name, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS latest, count(*) AS n FROM events GROUP BY event_type")
def metrics_summary(s, d):
    return out(orc.metrics_summary(_metrics(s, d)), "name", mean="mean", std="std", min="min", max="max", latest="latest", n="n")


@query("SELECT event_type AS name, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS latest FROM events GROUP BY event_type")
def metrics_latest(s, d):
    return out(orc.metrics_summary(_metrics(s, d)), "name", latest="latest")


@query(f"{B4}, m AS (SELECT round, param, avg(value) AS v FROM b4 GROUP BY ALL) SELECT round, param AS name, round(v, 6) + 0.0 AS value FROM m")
def round_metric_means(s, d):
    rows = b.daily(s, d).groupBy("round", "client").agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("metrics"))
    return out(orc.metric_means(rows, ["round"]), "round", "name", value="value")


@query(f"{B4}, m AS (SELECT round, param, avg(value) AS v FROM b4 GROUP BY ALL) SELECT param AS name, round(max(v), 6) + 0.0 AS best, round(arg_max(v, round), 6) + 0.0 AS last FROM m GROUP BY param")
def experiment_best(s, d):
    m = b.daily(s, d).groupBy("round", F.col("param").alias("name")).agg(F.avg("value").alias("value"))
    return out(orc.experiment_summary(m), "name", best="best", last="last")


@query("WITH c AS (SELECT quality AS label, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT label, sum(n) AS support, coalesce(sum(n) FILTER (label = pred), 0) AS hit FROM c GROUP BY label), p AS (SELECT pred AS label, sum(n) AS called FROM c GROUP BY pred), x AS (SELECT *, coalesce(hit / nullif(called, 0), 0) AS pr, hit / support AS re FROM l LEFT JOIN p USING (label)), y AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM x) SELECT round(sum(hit) / sum(support), 6) + 0.0 AS accuracy, round(sum(pr * support) / sum(support), 6) + 0.0 AS precision, round(sum(re * support) / sum(support), 6) + 0.0 AS recall, round(sum(f * support) / sum(support), 6) + 0.0 AS f1 FROM y")
def weighted_precision_recall_f1(s, d):
    x = orc.classification_report(read_table(s, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred")))
    return out(x, accuracy="accuracy", precision="precision", recall="recall", f1="f1")


@query(f"SELECT x.*, loss FROM ({_SQL['weighted_precision_recall_f1']}) x, (SELECT round(avg((quality - toxic) * (quality - toxic)), 6) + 0.0 AS loss FROM labels) y")
def evaluation_with_loss(s, d):
    gap = F.col("quality") - F.col("toxic")
    x = orc.evaluation(read_table(s, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"), (gap * gap).cast("double").alias("loss")))
    return out(x, accuracy="accuracy", precision="precision", recall="recall", f1="f1", loss="loss")


@query(f"{with_sql('registry')} SELECT client FROM registry WHERE enabled")
def active_clients(s, d):
    return orc.active_clients(b.registry(s, d)).select("client")


@query(f"{with_sql('registry')} SELECT client, round(1000 * weight / sum(weight) OVER (), 6) + 0.0 AS share_per_mille FROM registry WHERE enabled")
def client_weight_shares(s, d):
    return orc.weight_shares(b.registry(s, d)).select("client", r6(F.col("share") * 1000).alias("share_per_mille"))


@query(f"{with_sql('registry')} SELECT client, enabled, round(CASE WHEN client % 10 = 0 THEN 2 * weight ELSE weight END, 6) + 0.0 AS weight FROM registry WHERE client % 7 <> 0")
def registry_upsert_remove(s, d):
    r = b.registry(s, d)
    changed = orc.upsert(r, r.where("client % 10 = 0").withColumn("weight", 2 * F.col("weight")))
    return out(orc.remove(changed, r.where("client % 7 = 0")), "client", "enabled", weight="weight")


@query("SELECT vec_id AS client, round(CAST(embedding[4] AS DOUBLE), 6) + 0.0 AS f3, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS f0, CAST(NULL AS DOUBLE) AS beyond FROM embeddings")
def extract_features(s, d):
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("client"), F.col("embedding").cast("array<double>").alias("features"))
    x = orc.extract_features(e, (3, 0, 900))
    return out(x, "client", f3=r6(F.col("features")[0]), f0=r6(F.col("features")[1]), beyond=F.col("features")[2])


@query("SELECT c_custkey AS client, round(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE coalesce(n, 1) END, 6) + 0.0 AS weight FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def default_weights(s, d):
    r = read_table(s, d, "customer").select(F.col("c_custkey").alias("client"), F.col("c_acctbal").alias("weight"))
    sizes = read_table(s, d, "orders").groupBy(F.col("o_custkey").alias("client")).agg(F.count("*").alias("n"))
    return out(orc.default_weights(r, sizes), "client", weight="weight")


@query(f"{B4}, m AS (SELECT round, param AS name, avg(value) AS v FROM b4 GROUP BY ALL), l AS (SELECT max(round) AS r FROM m) SELECT round, name, round(v, 6) + 0.0 AS value FROM m, l WHERE name = 'click' AND round >= r - 2")
def metric_log(s, d):
    """Two parts of a log that are appended one after the other, one metric's last three rounds read back."""
    path = new_path(s, "log")
    m = b.daily(s, d).groupBy("round", F.col("param").alias("name")).agg(F.avg("value").alias("value"))
    io.append_log(m.where("round % 2 = 0"), path)
    io.append_log(m.where("round % 2 = 1"), path)
    last = io.read_log(s, path).agg(F.max("round")).first()[0] or 0
    return out(io.read_log(s, path, "click", [last - 2, last - 1, last]), "round", "name", value="value")


@query(f"{B4}, h AS (SELECT round, count(DISTINCT client) AS clients, sum(w) AS seconds FROM b4 GROUP BY round) SELECT count(*) AS done, round(count(*) / 100.0, 6) + 0.0 AS share, round(avg(seconds), 6) + 0.0 AS avg_seconds, round(avg(clients), 6) + 0.0 AS avg_clients FROM h")
def round_progress(s, d):
    h = b.daily(s, d).groupBy("round").agg(F.count_distinct("client").alias("clients"), F.sum("w").alias("seconds"))
    return out(orc.progress(h, 100), "done", share="share", avg_seconds="avg_seconds", avg_clients="avg_clients")


# -- sources and sinks

_B2 = f"{B2} SELECT client, idx, round(value, 6) + 0.0 AS value FROM b2"


@query(_B2)
def weights_json_roundtrip(s, d):
    w = b.label_means(s, d).withColumn("param", F.lit("embedding"))
    return out(io.from_json(io.to_json(w, ("client",)), ("client",)), "client", "idx", value="value")


@query(_B2)
def parquet_checkpoint_roundtrip(s, d):
    path = new_path(s, "checkpoint")
    w = b.label_means(s, d).select("client", "idx", "value")
    io.save_checkpoint(w.withColumn("value", F.col("value") * 0), path, 0)
    io.save_checkpoint(w, path, 1)
    return out(io.load_checkpoint(s, path), "client", "idx", value="value")


@query(_B2.replace("SELECT client, idx, round", "SELECT CAST(client AS VARCHAR) AS param, idx, round"))
def weights_by_param_roundtrip(s, d):
    path = new_path(s, "weights")
    w = b.label_means(s, d).select(F.lit(0).alias("round"), F.col("client").cast("string").alias("param"), "idx", "value")
    io.save_weights(w, path)
    return out(io.load_weights(s, path), "param", "idx", value="value")


from . import catalog_large, catalog_small  # noqa: E402, F401  register further queries


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
