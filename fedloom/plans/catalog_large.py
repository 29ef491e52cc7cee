"""Queries over absent and repeated values, moving rounds, long histories, clients' own state, coding, transforms and raw bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import aggregate as agg
from ..operators import coding, transforms
from ..operators import robust as byz
from ..operators import secure as sec
from ..operators import state as st
from ..sources import raw
from ..sources.client_state import ClientState
from ..streaming import moving
from . import bindings as b
from .bindings import with_sql
from .catalog import B1, B2, B3, B4, out, query
from .session import new_path, read_table, work_table

# -- absent and repeated values

#: Every seventh value is null, and every fifth row comes again with a value that is 1 lower.
GAPS = f"{B1}, g1 AS (SELECT grp, client, param, idx, CASE WHEN (client + idx) % 7 = 0 THEN NULL ELSE value END AS value, w, steps FROM b1)"


def _gaps(s: SparkSession, d: str) -> DataFrame:
    return b.vectors(s, d).withColumn("value", F.when((F.col("client") + F.col("idx")) % 7 != 0, F.col("value")))


def _repeats(s: SparkSession, d: str) -> DataFrame:
    x = _gaps(s, d)
    return x.unionByName(x.where((F.col("client") + F.col("idx")) % 5 == 0).withColumn("value", F.col("value") - 1))


@query(f"{GAPS} SELECT grp, idx, round(sum(value * w) / sum(w) FILTER (value IS NOT NULL), 6) + 0.0 AS value FROM g1 GROUP BY grp, idx")
def weighted_mean_with_gaps(s, d):
    return out(agg.weighted_mean(_gaps(s, d)), "grp", "idx", value="value")


@query(f"{GAPS} SELECT grp, idx, round(sum(value * w) / sum(w) FILTER (value IS NOT NULL), 6) + 0.0 AS value FROM g1 GROUP BY grp, idx")
def minibatch_mean_with_gaps(s, d):
    return out(agg.minibatch_mean(_gaps(s, d)), "grp", "idx", value="value")


@query(f"{GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, idx ORDER BY value, client) AS rn, count(*) OVER (PARTITION BY grp, idx) AS n FROM g1 WHERE value IS NOT NULL) SELECT grp, idx, round(avg(value) FILTER (rn > 2 AND rn <= n - 2), 6) + 0.0 AS value FROM r GROUP BY grp, idx")
def trimmed_mean_with_gaps(s, d):
    return out(agg.trimmed_mean(_gaps(s, d), faulty=2), "grp", "idx", value="value")


@query(f"{GAPS} SELECT grp, client, idx, round(value, 6) + 0.0 AS value FROM g1 WHERE value IS NOT NULL")
def last_of_repeated_rows(s, d):
    return out(agg.last_rows(_repeats(s, d)), "grp", "client", "idx", value="value")


@query(f"""{GAPS}, dist AS (SELECT x.grp, x.client AS a, y.client AS b, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist, count(*) AS n FROM g1 x JOIN g1 y ON x.grp = y.grp AND x.idx = y.idx AND x.client < y.client WHERE x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY ALL)
SELECT grp, a, b, round(dist, 6) + 0.0 AS dist FROM dist""")
def pairwise_distance_with_repeats(s, d):
    """Coordinates that one of both lacks don't count, and of repeated ones the greatest value does."""
    return out(byz.pairwise_distance(_repeats(s, d)), "grp", "a", "b", dist="dist")


# -- rounds of a stream that move on

_PARTS = 4


def _moving(s: SparkSession, d: str, least: int, wait_ms: int | None) -> DataFrame:
    """A log of the events in four parts, which come one after the other; each hundredth event opens a round."""
    e = read_table(s, d, "events")
    i, none = F.col("event_id"), F.lit(None)
    updates = e.select(i.alias("seq"), F.lit("update").alias("kind"), F.lit(0).cast("bigint").alias("grp"), (F.floor(i / 100) - i % 13).cast("bigint").alias("round"), F.col("event_type").alias("param"), (F.col("user_id") % 4).cast("int").alias("idx"), "value", F.lit(1.0).alias("w"))
    rounds = e.where(i % 100 == 0).select(i.alias("seq"), F.lit("round").alias("kind"), F.lit(0).cast("bigint").alias("grp"), F.floor(i / 100).cast("bigint").alias("round"), none.cast("string").alias("param"), none.cast("int").alias("idx"), none.cast("double").alias("value"), none.cast("double").alias("w"))
    log = updates.unionByName(rounds)
    n = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    path = new_path(s, "log")
    for k in range(_PARTS):
        log.where((F.col("seq") >= k * n // _PARTS) & (F.col("seq") < (k + 1) * n // _PARTS)).coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = new_path(s, "released")
    moving.run_to_end(moving.moving_rounds(stream, moving.blocks_of(updates), least, wait_ms), new_path(s, "stream"), found)
    return out(s.read.parquet(found), "param", "release", "idx", value="value", n="n", reason="reason")


_LOG_SQL = "WITH e AS (SELECT event_id, event_type AS param, CAST(user_id % 4 AS INT) AS idx, value, pow(0.99, event_id % 13) AS w FROM events WHERE event_id % 13 <= 10)"
_RELEASED = "SELECT param, CAST(release AS BIGINT) AS release, idx, round(sum(value * w) / sum(w), 6) + 0.0 AS value, CAST(any_value(n) AS BIGINT) AS n, '{}' AS reason FROM r JOIN g USING (param, release) GROUP BY param, release, idx"


@query(f"{_LOG_SQL}, r AS (SELECT *, (row_number() OVER (PARTITION BY param ORDER BY event_id) - 1) // 5 AS release FROM e), g AS (SELECT param, release, count(*) AS n FROM r GROUP BY ALL HAVING count(*) = 5) {_RELEASED.format('count')}")
def moving_rounds_by_count(s, d):
    return _moving(s, d, 5, None)


@query(f"{_LOG_SQL}, t AS (SELECT max(event_id) + 1 AS n FROM events), r AS (SELECT e.*, CASE WHEN event_id >= 2 * n // 4 THEN 1 ELSE 0 END AS release FROM e, t), g AS (SELECT param, release, count(*) AS n FROM r GROUP BY ALL) {_RELEASED.format('time')}")
def moving_rounds_by_time(s, d):
    """A timer of a millisecond is due in the next micro-batch, so two of them are released together."""
    return _moving(s, d, 1 << 40, 1)


# -- long histories: each line of an order is a round of its return flag

_LONG = """WITH x AS (SELECT l_returnflag AS param, l_orderkey * 8 + l_linenumber AS round, max(l_quantity) AS value FROM lineitem GROUP BY ALL),
h AS (SELECT param, round, row_number() OVER (PARTITION BY param ORDER BY round) AS t, list(value) OVER (PARTITION BY param ORDER BY round ROWS 400 PRECEDING) AS v FROM x)"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("param"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("round")).agg(F.max("l_quantity").alias("value"))


@query(f"{_LONG} SELECT param, CAST(round AS BIGINT) AS round, round(list_reduce(v, lambda a, x: 0.9 * a + x), 6) + 0.0 AS value FROM h")
def momentum_of_lines(s, d):
    return out(st.momentum(_lines(s, d), ["param"]), "param", "round", value="value")


@query(f"{_LONG} SELECT param, CAST(round AS BIGINT) AS round, round(list_reduce(list_prepend(0.0, v), lambda a, x: 0.9 * a + (1 - 0.9) * x) / (1 - pow(0.9, t)), 6) + 0.0 AS value FROM h")
def average_of_lines(s, d):
    """The first moment by itself, freed of its start at 0."""
    x = st.linear_scan(_lines(s, d), ["param"], {"m": (0.9, (1 - 0.9) * F.col("value"))})
    return out(x.withColumn("round", F.col("round").cast("bigint")).withColumn("value", F.col("m") / (1 - F.pow(F.lit(0.9), F.col("_t")))), "param", "round", value="value")


# -- clients' own controls

_CONTROL = f"""WITH RECURSIVE {with_sql('b4')[5:]},
u AS (SELECT dense_rank() OVER (ORDER BY round) AS t, client, param, value, w FROM b4), k AS (SELECT DISTINCT client, param FROM u),
s AS (SELECT 0::BIGINT AS t, client, param, 0.0::DOUBLE AS ci, 0.0::DOUBLE AS c, NULL::DOUBLE AS fixed FROM k
UNION ALL SELECT s.t + 1, s.client, s.param, CASE WHEN u.value IS NULL THEN ci ELSE ci - c - u.value END,
c - coalesce(sum((u.value - ci + c) * u.w) OVER (PARTITION BY s.param) / sum(u.w) OVER (PARTITION BY s.param), 0), u.value - ci + c
FROM s LEFT JOIN u ON u.t = s.t + 1 AND u.client = s.client AND u.param = s.param WHERE s.t < 3)"""


def _control_rounds(s: SparkSession, d: str):
    u = b.daily(s, d)
    first = [r[0] for r in u.select("round").distinct().orderBy("round").limit(3).collect()]
    state = ClientState(s, new_path(s, "controls"), "client bigint, param string, value double", 16)
    control, fixed = None, []
    for t, round_ in enumerate(first, 1):
        now = u.where(F.col("round") == round_).select(F.col("client").cast("bigint").alias("client"), "param", "value", "w")
        x, control = st.control_round(now, state, control, t, ["param"])
        fixed.append(work_table(s, x.select(F.lit(t).cast("bigint").alias("t"), "client", "param", "value"), "fixed"))
        control = work_table(s, control, "control")
    return state, control, fixed


@query(f"{_CONTROL} SELECT t, client, param, round(fixed, 6) + 0.0 AS value FROM s WHERE fixed IS NOT NULL")
def scaffold_rounds(s, d):
    """Three rounds of corrections, with clients' controls that move when they take part."""
    _, _, fixed = _control_rounds(s, d)
    return out(fixed[0].union(fixed[1]).union(fixed[2]), "t", "client", "param", value="value")


@query(f"{_CONTROL} SELECT client, param, round(ci, 6) + 0.0 AS value FROM s WHERE t = 3 AND EXISTS (SELECT 1 FROM s z WHERE z.client = s.client AND z.param = s.param AND z.fixed IS NOT NULL)")
def scaffold_client_controls(s, d):
    """What the bucketed state holds after three rounds."""
    state, _, _ = _control_rounds(s, d)
    return out(state.read(), "client", "param", value="value")


_CHECKED = f"{B2} SELECT client, idx, round(CASE WHEN client % 3 = 0 THEN value + 1 ELSE value END, 6) + 0.0 AS value, CASE WHEN client % 3 = 0 THEN 2 ELSE 1 END AS local_steps FROM b2"


@query(_CHECKED)
def client_checkpoints(s, d):
    """Every client's weights and steps, then those of a third of them once more: only these clients' buckets are written again."""
    w = b.label_means(s, d).select(F.col("client").cast("bigint").alias("client"), "idx", "value", F.lit(1).alias("local_steps"))
    state = ClientState(s, new_path(s, "clients"), "client bigint, idx int, value double, local_steps int", 8)
    state.write(w, 1)
    state.write(w.where("client % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("local_steps", F.lit(2)), 2)
    return out(state.read(), "client", "idx", "local_steps", value="value")


# -- entropy coding: the quantities of a line number, by order

_CODED = "WITH x AS (SELECT l_linenumber AS line, l_orderkey AS o, l_quantity AS value FROM lineitem)"


def _quantities(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "lineitem").select(F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_quantity").alias("x"), F.col("l_orderkey").alias("o"), F.col("l_quantity").alias("value"))


def _coded(s: SparkSession, d: str, how: str, piece: int = 20_000) -> tuple[DataFrame, DataFrame]:
    x = _quantities(s, d)
    table = coding.code_table(x, ["line"])
    return coding.entropy_encode(x, table, ["line"], "o", how, piece=piece), table


_POSITIONS = f"{_CODED} SELECT line, row_number() OVER (PARTITION BY line ORDER BY o, CAST(value AS VARCHAR)) - 1 AS pos, value FROM x"


@query(_POSITIONS)
def huffman_roundtrip(s, d):
    coded, table = _coded(s, d, "huffman")
    return coding.entropy_decode(coded, table, ["line"])


@query(_POSITIONS)
def arithmetic_roundtrip(s, d):
    coded, table = _coded(s, d, "arithmetic")
    return coding.entropy_decode(coded, table, ["line"], "arithmetic")


@query("WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(n) AS BIGINT) AS n, CAST(CASE WHEN count(*) = 3 THEN 2 * sum(n) - max(n) ELSE sum(n) END AS BIGINT) AS bits FROM c GROUP BY l_suppkey")
def huffman_bits(s, d):
    """Of three symbols at most: the most frequent one has one bit, two others two."""
    return coding.coded_bits(coding.code_table(read_table(s, d, "lineitem"), ["l_suppkey"], "l_returnflag"), ["l_suppkey"])


@query(f"{_CODED}, c AS (SELECT line, value, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT line, sum(n) AS total FROM c GROUP BY line) SELECT line, round(sum(n * log2(total / n)) / 8, 4) + 0.0 AS entropy_bytes, true AS huffman_below_two_percent, true AS arithmetic_below_one_percent FROM c JOIN t USING (line) GROUP BY line")
def coded_sizes(s, d):
    """Bytes of both coders beside the entropy of the counts: 1 or 2 percent more, and 16 bytes for each piece's ends."""
    huffman, table = _coded(s, d, "huffman", 1 << 40)
    arithmetic, _ = _coded(s, d, "arithmetic", 1 << 40)
    size = lambda x, name: x.groupBy("line").agg(F.sum(F.octet_length("data")).alias(name), F.count("*").alias(f"{name}_pieces"))
    n = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    bits = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c * F.log2(F.col("_n") / c))
    h = table.withColumn("_n", n).select("line", (bits / 8).alias("h"))
    x = h.join(size(huffman, "a"), "line").join(size(arithmetic, "b"), "line")
    below = lambda name, share: F.col(name) <= F.col("h") * share + 16 * F.col(f"{name}_pieces")
    return x.select("line", (F.round("h", 4) + F.lit(0.0)).alias("entropy_bytes"), below("a", 1.02).alias("huffman_below_two_percent"), below("b", 1.01).alias("arithmetic_below_one_percent"))


# -- transforms

_HAAR = f"""{B1}, l AS (SELECT client, CAST(unnest(range(1, 7)) AS INT) AS level, idx, value FROM b1),
c AS (SELECT client, level, CAST(idx // (1 << level) AS BIGINT) AS pos, sum(CASE WHEN (idx // (1 << (level - 1))) % 2 = 0 THEN value ELSE -value END) / sqrt(any_value(1 << level)) AS value FROM l GROUP BY ALL
UNION ALL SELECT client, 0, 0, sum(value) / 8 FROM b1 GROUP BY client)"""


@query(f"{_HAAR} SELECT client, level, pos, round(value, 6) + 0.0 AS value FROM c")
def haar_coefficients(s, d):
    return out(transforms.haar(b.vectors(s, d), ("client",)), "client", "level", "pos", value="value")


@query(f"{_HAAR}, r AS (SELECT *, rank() OVER (PARTITION BY client ORDER BY round(abs(value), 12) DESC) AS rk FROM c) SELECT client, level, pos, round(value, 6) + 0.0 AS value FROM r WHERE rk <= 16")
def haar_largest(s, d):
    return out(transforms.largest(transforms.haar(b.vectors(s, d), ("client",)), 0.25, ("client",)), "client", "level", "pos", value="value")


@query(f"{B1} SELECT client, CAST(idx AS BIGINT) AS idx, round(value, 6) + 0.0 AS value FROM b1")
def haar_roundtrip(s, d):
    """All coefficients kept, in blocks of eight, so that two passes are needed."""
    u = b.vectors(s, d)
    sizes = u.groupBy("client").agg(F.count("*").alias("n"))
    return out(transforms.haar_inverse(transforms.haar(u, ("client",), 3), sizes, ("client",), 3), "client", "idx", value="value")


_DFT = f"""{B1}, k AS (SELECT CAST(unnest(range(33)) AS INT) AS k),
z AS (SELECT client, k, sum(value * cos(2 * pi() * k * idx / 64)) AS re, -sum(value * sin(2 * pi() * k * idx / 64)) AS im FROM b1, k GROUP BY client, k)"""


@query(f"{_DFT} SELECT client, 0::BIGINT AS block, k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM z")
def dft_coefficients(s, d):
    return out(transforms.dft(b.vectors(s, d), ("client",)), "client", "block", "k", re="re", im="im")


@query(f"{B1} SELECT client, CAST(idx AS BIGINT) AS idx, round(value, 6) + 0.0 AS value FROM b1")
def dft_roundtrip(s, d):
    u = b.vectors(s, d)
    return out(transforms.dft_inverse(transforms.dft(u, ("client",), 24), u, ("client",), 24), "client", "idx", value="value")


# -- raw bytes and exact shares


@query(f"{B3} SELECT grp, client, param, idx, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) + 0.0 AS value FROM b3")
def raw_bytes_roundtrip(s, d):
    """Four parameters of four numbers, in pieces of five; what a client lacks comes back as NaN and is left out."""
    u = work_table(s, b.lines(s, d).drop("w", "steps"), "raw-lines")  # read several times
    shapes = u.groupBy("param").agg((F.max("idx") + 1).alias("n"))
    back = raw.from_bytes(raw.to_bytes(u, shapes, ("grp", "client"), 5), shapes, ("grp", "client"), 5).where(~F.isnan("value"))
    return back.select("grp", "client", "param", "idx", (F.round(F.col("value").cast("double"), 2) + F.lit(0.0)).alias("value"))


@query(f"{B3}, p AS (SELECT DISTINCT param FROM b3), k AS (SELECT DISTINCT grp, client FROM b3) SELECT grp, client, CAST((SELECT count(*) FROM p) * 16 AS BIGINT) AS bytes, 1::BIGINT AS pieces FROM k")
def raw_bytes_layout(s, d):
    u = work_table(s, b.lines(s, d).drop("w", "steps"), "raw-lines")  # read several times
    shapes = u.groupBy("param").agg((F.max("idx") + 1).alias("n"))
    return raw.to_bytes(u, shapes, ("grp", "client")).groupBy("grp", "client").agg(F.sum(F.octet_length("data")).cast("bigint").alias("bytes"), F.count("*").alias("pieces"))


@query(f"{B1} SELECT client, idx, CASE WHEN idx = 63 THEN value / 3 ELSE value END AS value FROM b1")
def shared_doubles(s, d):
    """Two limbs of each double's bits, put together again from three of five shares: equal to the last bit."""
    u = b.vectors(s, d).select("client", "idx", F.when(F.col("idx") == 63, F.col("value") / 3).otherwise(F.col("value")).alias("value"))
    return sec.reconstruct_doubles(sec.share_doubles(u, 3, 5, 7, ("client", "idx")), [4, 1, 5], 3, ("client", "idx"))
