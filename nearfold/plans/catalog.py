"""Every query of the engine by name, with its SQL twin where SQL can express it.

Points come from ``embeddings`` (four of its dimensions, cut to integers; every tenth row is R), from
``lineitem`` (classification at scale) and from ``part`` and ``customer`` (regression).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfold.functions import curves, prepare
from nearfold.operators import knn, metrics, predict, ranges, split, tune
from nearfold.plans import sessions
from nearfold.plans.config import KnnConfig
from nearfold.sources import text
from nearfold.sources.tables import scratch

K, D, BITS = 5, 4, 15
VECTORS = [[0, 0, 0, 0], [137, 4211, 9001, 2718]]
LABELS = list(range(10))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- points ---------------------------------------------------------------------------------------


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, is_r, coords): (embedding + 1) * 1000 cut to integers, first four dimensions."""
    coords = F.array(*(((F.col("embedding")[i].cast("double") + 1.0) * 1000.0).cast("bigint") for i in range(D)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).alias("label"), (F.col("vec_id") % 10 == 0).alias("is_r"), coords.alias("coords"))


def r_and_s(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return points.filter("is_r").drop("is_r"), points.filter("NOT is_r").drop("is_r")


PTS = "pts AS (SELECT vec_id AS id, label + 1 AS label, vec_id % 10 = 0 AS is_r, " + ", ".join(f"CAST(trunc((CAST(embedding[{i + 1}] AS DOUBLE) + 1.0) * 1000.0) AS BIGINT) AS c{i}" for i in range(D)) + " FROM embeddings)"


def d2_sql(a: str, b: str, d: int = D) -> str:
    return " + ".join(f"({a}.c{i} - {b}.c{i}) * ({a}.c{i} - {b}.c{i})" for i in range(d))


def z_sql(columns: list[str], bits: int) -> str:
    d = len(columns)
    return " | ".join(f"((({c} >> {p}) & 1) << {p * d + d - 1 - k})" for p in range(bits) for k, c in enumerate(columns))


def copies_sql(vectors: list[list[int]], source: str = "pts", d: int = D) -> str:
    one = lambda i, v: f"SELECT *, {i} AS shift, " + ", ".join(f"c{k} + {v[k]} AS m{k}" for k in range(d)) + f" FROM {source}"
    return "moved AS (" + " UNION ALL ".join(one(i, v) for i, v in enumerate(vectors)) + ")"


def join_sql(vectors: list[list[int]], k: int = K, gray: bool = False, d: int = D, bits: int = BITS, hilbert: bool = False) -> str:
    """CTEs from pts to top(rid, sid, d2, rank)."""
    z = z_sql([f"h{i}" if hilbert else f"m{i}" for i in range(d)], bits)
    code = "xor(z, z >> 1)" if gray else "z"
    turned = f"{hilbert_sql('moved', [f'm{i}' for i in range(d)], 'turned', bits)}, " if hilbert else ""
    return f"""{copies_sql(vectors, d=d)}, {turned}coded0 AS (SELECT *, {z} AS z FROM {'turned' if hilbert else 'moved'}), coded AS (SELECT * EXCLUDE (z), {code} AS z FROM coded0),
ranked AS (SELECT *, CAST(sum(CASE WHEN is_r THEN 0 ELSE 1 END) OVER (PARTITION BY shift ORDER BY z, is_r, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS srank FROM coded),
edges AS (SELECT r.id AS rid, s.id AS sid, min({d2_sql('r', 's', d)}) AS d2 FROM ranked r JOIN ranked s ON r.is_r AND NOT s.is_r AND r.shift = s.shift AND s.srank BETWEEN r.srank - {k - 1} AND r.srank + {k} GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT rid, sid, d2, CAST(row_number() OVER (PARTITION BY rid ORDER BY d2, sid) AS INTEGER) AS rank FROM edges) WHERE rank <= {k})"""


def hilbert_sql(source: str, columns: list[str], out: str, bits: int = BITS) -> str:
    """CTEs up to ``out``: ``source`` with h0, h1, ..., whose interleaved bits are the Hilbert index of the columns."""
    d = len(columns)
    x = [f"h{i}" for i in range(d)]
    steps = [(f"{out}_0", f"SELECT *, {', '.join(f'{c} AS {h}' for c, h in zip(columns, x))} FROM {source}")]

    def then(**new: str) -> None:
        prior = steps[-1][0]
        steps.append((f"{out}_{len(steps)}", f"SELECT * EXCLUDE ({', '.join(new)}), {', '.join(f'{e} AS {c}' for c, e in new.items())} FROM {prior}"))

    for p in range(bits - 1, 0, -1):
        q, low = 1 << p, (1 << p) - 1
        then(h0=f"CASE WHEN h0 & {q} <> 0 THEN xor(h0, {low}) ELSE h0 END")
        for h in x[1:]:
            then(**{"h0": f"CASE WHEN {h} & {q} <> 0 THEN xor(h0, {low}) ELSE xor(h0, xor(h0, {h}) & {low}) END", h: f"CASE WHEN {h} & {q} <> 0 THEN {h} ELSE xor({h}, xor(h0, {h}) & {low}) END"})
    for k in range(1, d):
        then(**{x[k]: f"xor({x[k]}, {x[k - 1]})"})
    turn = "0"
    for p in range(bits - 1, 0, -1):
        turn = f"xor({turn}, CASE WHEN {x[-1]} & {1 << p} <> 0 THEN {(1 << p) - 1} ELSE 0 END)"
    steps.append((f"{out}_t", f"SELECT *, {turn} AS turn FROM {steps[-1][0]}"))
    steps.append((out, f"SELECT * EXCLUDE ({', '.join(x)}, turn), {', '.join(f'xor({h}, turn) AS {h}' for h in x)} FROM {steps[-1][0]}"))
    return ", ".join(f"{n} AS MATERIALIZED ({q})" for n, q in steps)


VOTES = """near AS (SELECT t.rid, s.label, sqrt(CAST(d2 AS DOUBLE)) AS d, min(sqrt(CAST(d2 AS DOUBLE))) OVER w AS lo, max(sqrt(CAST(d2 AS DOUBLE))) OVER w AS hi FROM top t JOIN pts s ON s.id = t.sid WINDOW w AS (PARTITION BY t.rid)),
votes AS (SELECT rid, label, CAST(sum(CAST(round((CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - d) / (hi - lo) END) * 1000000000) AS BIGINT)) AS BIGINT) AS votes, count(*) AS n FROM near GROUP BY 1, 2),
predicted AS (SELECT rid, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY votes DESC, label) AS nth FROM votes) WHERE nth = 1),
pairs AS (SELECT p.rid AS id, p.predicted, s.label AS real FROM predicted p JOIN pts s ON s.id = p.rid)"""
TOP = "SELECT rid, sid, d2, rank FROM top"
EMB = f"WITH {PTS}, {join_sql(VECTORS)}"


def emb_edges(spark: SparkSession, sf_dir: str, **more) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, s = r_and_s(embedded(spark, sf_dir))
    return r, s, knn.approximate_knn(r, s, K, more.pop("vectors", VECTORS), D, BITS, **more)


# --- points and codes -----------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, CASE WHEN x > -9999 AND NOT isnan(x) THEN x ELSE 0 END AS repaired FROM (SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN 'NaN' ELSE CAST(c_custkey - 10050 AS VARCHAR) END AS FLOAT) AS x FROM customer) WHERE x IS NOT NULL
UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey % 7 = 0""")
def repair_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 7 == 0, "n/a").when(F.col("c_custkey") % 11 == 0, "NaN").otherwise((F.col("c_custkey") - 10050).cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), prepare.repaired(raw).alias("repaired"))


@query("SELECT p_partkey AS id, CAST(trunc(p_size * 3.0 * 10.0) AS BIGINT) AS q1, CAST(trunc(p_retailprice * 0.5 * 10.0) AS BIGINT) AS q2, CAST(trunc(-p_retailprice * 2.0 * 10.0) AS BIGINT) AS q3 FROM part")
def quantize_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), -F.col("p_retailprice"))
    q = prepare.quantized(prepare.scaled(features, [3.0, 0.5, 2.0]))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.alias("q")).select("id", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))


@query("SELECT p_partkey AS id, CAST(p_size * 29.0 * 29.0 AS DOUBLE) AS s1, CAST(p_size * 29.0 AS DOUBLE) AS s0 FROM part")
def scale_compounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.array(F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), prepare.scaled(size, [29.0], 1, compound=True)[0].alias("s1"), prepare.scaled(size, [29.0], 0, compound=True)[0].alias("s0"))


@query(f"WITH {PTS}, {copies_sql(VECTORS)} SELECT id, shift, m0, m1, m2, m3 FROM moved")
def shift_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.shifted(embedded(spark, sf_dir), VECTORS).select("id", "shift", *(F.col("moved")[i].alias(f"m{i}") for i in range(D)))


@query("SELECT c_custkey AS id, CAST(trunc(c_acctbal) AS BIGINT) - (SELECT min(CAST(trunc(c_acctbal) AS BIGINT)) FROM customer) AS lifted FROM customer")
def lift_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("bigint")).alias("coords"))
    return points.select("id", prepare.lifted(F.col("coords"), prepare.minima(points, 1))[0].alias("lifted"))


@query(f"WITH {PTS} SELECT id, {z_sql(['c0', 'c1', 'c2', 'c3'], BITS)} AS z FROM pts")
def zorder_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).select("id", curves.z_encode(F.col("coords"), D, BITS).alias("z"))


@query(f"WITH {PTS} SELECT id, c0, c1, c2, c3 FROM pts")
def zorder_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = embedded(spark, sf_dir).select("id", curves.z_decode(curves.z_encode(F.col("coords"), D, BITS), D, BITS).alias("b"))
    return back.select("id", *(F.col("b")[i].alias(f"c{i}") for i in range(D)))


@query("WITH " + PTS + " SELECT id, " + " || ".join(f"CAST((c{k} >> {p}) & 1 AS VARCHAR)" for p in range(31, -1, -1) for k in range(D)) + " AS z FROM pts")
def zorder_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded(spark, sf_dir).select("id", curves.z_encode(F.col("coords"), D, 32).alias("z"))


@query(f"WITH {PTS}, z AS (SELECT id, {z_sql(['c0', 'c1', 'c2', 'c3'], BITS)} AS z FROM pts) SELECT id, xor(z, z >> 1) AS g, lpad(CAST(xor(z, z >> 1) AS VARCHAR), 19, '0') AS padded FROM z")
def gray_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = embedded(spark, sf_dir).select("id", curves.gray_encode(F.col("coords"), D, BITS).alias("g"))
    return g.select("id", "g", curves.zero_pad(F.col("g"), curves.code_digits(D, BITS)).alias("padded"))


@query(f"WITH {PTS} SELECT id, c0, c1, c2, c3 FROM pts")
def gray_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = embedded(spark, sf_dir).select("id", curves.gray_decode(curves.gray_encode(F.col("coords"), D, BITS), D, BITS).alias("b"))
    return back.select("id", *(F.col("b")[i].alias(f"c{i}") for i in range(D)))


@query(f"WITH {PTS}, {hilbert_sql('pts', ['c0', 'c1', 'c2', 'c3'], 'turned')} SELECT id, {z_sql(['h0', 'h1', 'h2', 'h3'], BITS)} AS h FROM turned")
def hilbert_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = embedded(spark, sf_dir).withColumn("t", curves.hilbert_transpose(F.col("coords"), D, BITS))
    return moved.select("id", curves.z_encode(F.col("t"), D, BITS).alias("h"))


@query(f"WITH {PTS} SELECT id, c0, c1, c2, c3 FROM pts")
def hilbert_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = hilbert_code(spark, sf_dir).select("id", curves.hilbert_decode(F.col("h"), D, BITS).alias("b"))
    return back.select("id", *(F.col("b")[i].alias(f"c{i}") for i in range(D)))


# --- samples and ranges ---------------------------------------------------------------------------


@query("SELECT is_r, n, least(1.0, 1.0 / (0.05 * 0.05 * n)) AS rate FROM (SELECT vec_id % 10 = 0 AS is_r, count(*) AS n FROM embeddings GROUP BY 1)")
def bernoulli_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {r.is_r: r.n for r in embedded(spark, sf_dir).groupBy("is_r").agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame([(flag, n, ranges.sample_rate(n, 0.05)) for flag, n in counts.items()], "is_r boolean, n bigint, rate double")


@query("SELECT CAST(l_orderkey % 10 = 0 AS INTEGER) AS src, count(*) AS n, true AS as_many_as_said, true AS all_known FROM lineitem GROUP BY 1")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source its rows, whether the sample of them has the size of its rate by four standard errors, and whether all of it are rows of the table."""
    tagged = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 10 == 0).cast("int").alias("src"))
    rates = {0: 0.1, 1: 0.5}
    drawn = ranges.bernoulli(tagged, rates, "src", 17)
    rate = F.when(F.col("src") == 0, rates[0]).otherwise(rates[1])
    sizes = tagged.groupBy("src").agg(F.count("*").alias("n")).join(drawn.groupBy("src").agg(F.count("*").alias("m")), "src", "left")
    strange = drawn.join(tagged, ["l_orderkey", "l_linenumber", "src"], "left_anti").groupBy("src").agg(F.count("*").alias("strange"))
    near = F.abs(F.coalesce("m", F.lit(0)) - F.col("n") * rate) <= 4 * F.sqrt(F.col("n") * rate * (1 - rate))
    return sizes.join(strange, "src", "left").select("src", "n", near.alias("as_many_as_said"), F.coalesce("strange", F.lit(0)).eqNullSafe(F.lit(0)).alias("all_known"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey * 7919) % 10007 < 1001")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.hash_sample(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 0.1)


@query("""WITH q AS (SELECT i, ceil(i / 8.0 * 100) AS org FROM range(1, 9) t(i)), v AS (SELECT i, org, floor(org * 0.1) AS lo, ceil(org * 0.1) AS hi FROM q)
SELECT CAST(i AS INTEGER) AS i, CAST(greatest(1, CASE WHEN abs(trunc(lo / 0.1) - org) < abs(trunc(hi / 0.1) - org) THEN lo ELSE hi END) AS INTEGER) AS est_rank FROM v""")
def estimator_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, ranges.estimator_index(i, 100, 0.1, 8)) for i in range(1, 9)], "i int, est_rank int")


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """R's sample with codes, and the ranks of eight equal ranges in it."""
    r, _ = r_and_s(embedded(spark, sf_dir))
    n = r.count()
    return knn.coded(r, VECTORS, D, BITS), [ranges.estimator_index(i, n, 1.0, 8) for i in range(1, 9)]


BOUNDS = f"""WITH {PTS}, {copies_sql(VECTORS)}, coded AS (SELECT *, {z_sql(['m0', 'm1', 'm2', 'm3'], BITS)} AS z FROM moved),
rr AS (SELECT shift, z, row_number() OVER (PARTITION BY shift ORDER BY z) AS rank, count(*) OVER (PARTITION BY shift) AS n FROM coded WHERE is_r),
ends AS (SELECT shift, CAST(p AS INTEGER) - 1 AS pid, z FROM rr JOIN range(1, 9) t(p) ON rank = ceil(p / 8.0 * n)),
bounds AS (SELECT shift, pid, lag(z) OVER (PARTITION BY shift ORDER BY pid) AS low, CASE WHEN pid < 7 THEN z END AS high FROM ends)"""


@query(BOUNDS + " SELECT shift, pid, coalesce(low, -1) AS low, coalesce(high, -1) AS high FROM bounds")
def range_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, at = _sampled(spark, sf_dir)
    return ranges.range_bounds(sample, at).fillna(-1)


@query(BOUNDS + """, s AS (SELECT shift, z, lag(z, 3) OVER w AS below, lead(z, 3) OVER w AS above FROM coded WHERE NOT is_r WINDOW w AS (PARTITION BY shift ORDER BY z))
SELECT b.shift, b.pid, coalesce((SELECT arg_min_null(below, z) FROM s WHERE s.shift = b.shift AND s.z >= b.low), -1) AS low, coalesce((SELECT arg_min_null(above, z) FROM s WHERE s.shift = b.shift AND s.z >= b.high), -1) AS high FROM bounds b""")
def range_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, at = _sampled(spark, sf_dir)
    _, s = r_and_s(embedded(spark, sf_dir))
    return ranges.padded_bounds(ranges.range_bounds(sample, at), knn.coded(s, VECTORS, D, BITS), 3).fillna(-1)


@query(BOUNDS + " SELECT c.shift, b.pid, c.id, c.is_r FROM coded c JOIN bounds b ON c.shift = b.shift AND (b.low IS NULL OR c.z >= b.low) AND (b.high IS NULL OR c.z < b.high)")
def range_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, at = _sampled(spark, sf_dir)
    coded = knn.coded(embedded(spark, sf_dir), VECTORS, D, BITS)
    return ranges.route(coded, ranges.range_bounds(sample, at)).select("shift", "pid", "id", "is_r")


@query(BOUNDS + " SELECT c.shift, b.pid, c.shift * 8 + b.pid AS group_key, count(*) AS n FROM coded c JOIN bounds b ON c.shift = b.shift AND (b.low IS NULL OR c.z >= b.low) AND (b.high IS NULL OR c.z < b.high) GROUP BY 1, 2")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_route(spark, sf_dir).groupBy("shift", "pid").agg((F.first("shift") * 8 + F.first("pid")).alias("group_key"), F.count("*").alias("n"))


@query(BOUNDS + " SELECT c.shift, b.pid, c.id, row_number() OVER (PARTITION BY c.shift, b.pid ORDER BY c.z, c.id) AS place, count(DISTINCT b.pid) OVER (PARTITION BY c.shift, b.pid) AS parts FROM coded c JOIN bounds b ON c.shift = b.shift AND (b.low IS NULL OR c.z >= b.low) AND (b.high IS NULL OR c.z < b.high)")
def range_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place as the rows lie in the partitions, and how many partitions hold its range (one)."""
    sample, at = _sampled(spark, sf_dir)
    routed = ranges.route(knn.coded(embedded(spark, sf_dir), VECTORS, D, BITS), ranges.range_bounds(sample, at))
    laid = ranges.partitioned(routed, 8).select("shift", "pid", "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    own = Window.partitionBy("shift", "pid")
    return laid.select("shift", "pid", "id", F.row_number().over(own.orderBy("at")).cast("bigint").alias("place"), F.size(F.collect_set("part").over(own)).cast("bigint").alias("parts"))


@query("SELECT i AS shift, j AS feature, CASE WHEN i = 0 THEN 0 END AS zero, true AS in_bounds FROM range(0, 3) a(i), range(0, 9) b(j)")
def shift_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shift vectors of nine features: the first is zero, all lie in 0..10000, and a seed gives the same ones again."""
    vectors = prepare.shift_vectors(3, 9, 17)
    frame = prepare.shift_frame(spark, vectors).select("shift", F.posexplode("vector").alias("feature", "value"))
    again = F.lit(vectors == prepare.shift_vectors(3, 9, 17))
    return frame.select(F.col("shift").cast("bigint").alias("shift"), F.col("feature").cast("bigint").alias("feature"), F.when(F.col("shift") == 0, F.col("value").cast("int")).alias("zero"), (F.col("value").between(0, 10000) & again).alias("in_bounds"))


# --- joins ----------------------------------------------------------------------------------------


EXACT = f"exact AS (SELECT * FROM (SELECT rid, sid, d2, CAST(row_number() OVER (PARTITION BY rid ORDER BY d2, sid) AS INTEGER) AS rank FROM (SELECT r.id AS rid, s.id AS sid, {d2_sql('r', 's')} AS d2 FROM pts r, pts s WHERE r.is_r AND NOT s.is_r)) WHERE rank <= {K})"


@query(f"WITH {PTS}, {EXACT} SELECT * FROM exact")
def exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.exact_knn(*r_and_s(embedded(spark, sf_dir)), K, D)


@query(f"WITH {PTS}, {join_sql(VECTORS[:1])} {TOP}")
def knn_join_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_edges(spark, sf_dir, vectors=VECTORS[:1])[2]


@query(f"{EMB} {TOP}")
def knn_join_multi_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_edges(spark, sf_dir)[2]


@query(f"{EMB} {TOP}")
def knn_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_edges(spark, sf_dir, partitions=8)[2]


@query(f"WITH {PTS}, {join_sql(VECTORS, gray=True)} {TOP}")
def knn_join_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_edges(spark, sf_dir, curve="gray", partitions=8)[2]


@query(f"WITH {PTS}, {join_sql(VECTORS, hilbert=True)} {TOP}")
def knn_join_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb_edges(spark, sf_dir, curve="hilbert", partitions=8)[2]


@query(f"{EMB} {TOP}")
def knn_join_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve cut at ranks of samples that epsilon sizes: the same result for any cuts."""
    return emb_edges(spark, sf_dir, partitions=8, epsilon=0.06)[2]


WIDE_D, WIDE_K, WIDE_BITS = 9, 15, 32
WIDE_VECTORS = [[0] * WIDE_D, [137, 4211, 9001, 2718, 77, 5005, 8191, 6007, 3331]]
WIDE_PTS = "pts AS (SELECT vec_id AS id, label + 1 AS label, vec_id % 10 = 0 AS is_r, " + ", ".join(f"CAST(trunc((CAST(embedding[{i + 1}] AS DOUBLE) + 1.0) * 1000.0) AS BIGINT) AS c{i}" for i in range(WIDE_D)) + " FROM embeddings)"
#: Coordinates stay below 2^15, so 15 of the 32 bits of each tell codes apart; as text, for 9 x 15 bits fit no BIGINT.
WIDE_Z = " || ".join(f"CAST((m{k} >> {p}) & 1 AS VARCHAR)" for p in range(14, -1, -1) for k in range(WIDE_D))
WIDE_JOIN = join_sql(WIDE_VECTORS, WIDE_K, d=WIDE_D, bits=1).replace(z_sql([f"m{i}" for i in range(WIDE_D)], 1), WIDE_Z)


@query(f"WITH {WIDE_PTS}, {WIDE_JOIN} {TOP}")
def knn_join_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default settings: 9 dimensions of 32 bits, codes as digit strings, 15 neighbours."""
    coords = F.array(*(((F.col("embedding")[i].cast("double") + 1.0) * 1000.0).cast("bigint") for i in range(WIDE_D)))
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 10 == 0).alias("is_r"), coords.alias("coords"))
    return knn.approximate_knn(*r_and_s(points), WIDE_K, WIDE_VECTORS, WIDE_D, WIDE_BITS, partitions=8)


@query(f"WITH {PTS}, few AS (SELECT * FROM pts WHERE is_r OR id < 4), {copies_sql(VECTORS, 'few')}, " + join_sql(VECTORS).split("), ", 1)[1].replace("pts", "few") + f" {TOP}")
def knn_join_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S has fewer rows than k: every R row gets what there is."""
    r, s = r_and_s(embedded(spark, sf_dir))
    return knn.approximate_knn(r, s.filter("id < 4"), K, VECTORS, D, BITS, partitions=4)


@query(f"{EMB}, {EXACT} SELECT count(*) AS true_pairs, count(t.sid) AS found_pairs, round(count(t.sid) / count(*), 6) AS recall FROM exact e LEFT JOIN top t ON t.rid = e.rid AND t.sid = e.sid")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, found = emb_edges(spark, sf_dir)
    return knn.recall(found, knn.exact_knn(r, s, K, D))


# --- predictions and metrics ----------------------------------------------------------------------


@query(f"{EMB}, {VOTES} SELECT p.rid, p.predicted, n.n_neighbors FROM predicted p JOIN (SELECT rid, CAST(sum(n) AS BIGINT) AS n_neighbors FROM votes GROUP BY 1) n USING (rid)")
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, found = emb_edges(spark, sf_dir, partitions=8)
    return predict.classify(found, s)


@query(f"{EMB}, {VOTES} SELECT rid, " + ", ".join(f"round(coalesce(sum(CASE WHEN label = {c} THEN votes END), 0) / sum(votes), 6) AS p_{c}" for c in range(1, 11)) + " FROM votes GROUP BY 1")
def knn_class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, found = emb_edges(spark, sf_dir)
    return predict.classify(found, s, list(range(1, 11))).drop("predicted", "n_neighbors")


@query(f"{EMB}, {VOTES} SELECT rid, label, round(votes / sum(votes) OVER (PARTITION BY rid), 6) AS probability FROM votes")
def knn_label_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s, found = emb_edges(spark, sf_dir)
    return predict.probabilities(found, s)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, found = emb_edges(spark, sf_dir)
    return metrics.joined(predict.classify(found, s), r, "label")


@query(f"{EMB}, {VOTES} SELECT round(100 * sum(CASE WHEN predicted = real THEN 1 ELSE 0 END) / count(DISTINCT id), 6) AS accuracy FROM pairs")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_pairs(spark, sf_dir))


@query(f"""{EMB}, {VOTES}, c AS (SELECT CAST(sum(CASE WHEN predicted = 2 AND real = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, sum(CASE WHEN predicted = 2 AND real <> 2 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN predicted <> 2 AND real = 2 THEN 1 ELSE 0 END) AS fn FROM pairs),
pr AS (SELECT tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f_measure FROM pr""")
def f_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.f_measure(_pairs(spark, sf_dir), positive=2)


PART_K, PART_D, PART_BITS = 5, 2, 20
PART_VECTORS = [[0, 0], [5003, 1009]]
PART_PTS = "pts AS (SELECT p_partkey AS id, p_partkey % 10 = 0 AS is_r, CAST(trunc(p_size * 100.0 * 10.0) AS BIGINT) AS c0, CAST(trunc(p_partkey % 1000 * 2.0 * 10.0) AS BIGINT) AS c1, p_retailprice AS value FROM part)"
PART = f"""WITH {PART_PTS}, {join_sql(PART_VECTORS, PART_K, d=PART_D, bits=PART_BITS)}, predicted AS (SELECT t.rid, round(avg(s.value), 6) AS predicted, count(*) AS n_neighbors FROM top t JOIN pts s ON s.id = t.sid GROUP BY 1),
pairs AS (SELECT p.rid AS id, p.predicted, s.value AS real FROM predicted p JOIN pts s ON s.id = p.rid)"""


def _part(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 1000).cast("double")).alias("f"), F.col("p_retailprice").alias("value"))
    points = rows.select("id", prepare.quantized(prepare.scaled(F.col("f"), [100.0, 2.0])).alias("coords"), "value", (F.col("id") % 10 == 0).alias("is_r"))
    r, s = r_and_s(points)
    return r, s, predict.regress(knn.approximate_knn(r, s, PART_K, PART_VECTORS, PART_D, PART_BITS, partitions=8), s)


@query(f"{PART} SELECT rid, predicted, n_neighbors FROM predicted")
def knn_regress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part(spark, sf_dir)[2]


@query(f"{PART} SELECT round(sqrt(avg(pow(predicted - real, 2))), 6) AS rmse FROM pairs")
def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, found = _part(spark, sf_dir)
    return metrics.rmse(metrics.joined(found, r, "value"))


@query(f"{PART} SELECT round(sqrt(avg(pow(predicted - real, 2))), 6) AS rmse FROM (SELECT id, predicted, CASE WHEN id % 20 = 0 THEN 0 ELSE real END AS real FROM pairs) WHERE real <> 0")
def rmse_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, found = _part(spark, sf_dir)
    return metrics.rmse(metrics.joined(found, r.withColumn("value", F.when(F.col("id") % 20 == 0, 0.0).otherwise(F.col("value"))), "value"), exclude_zero=True)


@query(f"{PART}, m AS (SELECT avg(real) AS mean FROM pairs) SELECT round(1 - sum(pow(real - predicted, 2)) / sum(pow(real - mean, 2)), 6) AS r_squared FROM pairs, m")
def r_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, found = _part(spark, sf_dir)
    return metrics.r_squared(metrics.joined(found, r, "value"), r, "value")


@query(f"{PART}, m AS (SELECT avg(value) AS mean FROM pts WHERE is_r) SELECT round(1 - sum(pow(predicted - mean, 2)) / sum(pow(real - mean, 2)), 6) AS r_squared FROM pairs, m WHERE real <> 0")
def r_squared_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, found = _part(spark, sf_dir)
    return metrics.r_squared(metrics.joined(found, r, "value"), r, "value", "explained", exclude_zero=True)


LINE_D, LINE_BITS, LINE_K = 3, 20, 5
LINE_VECTORS = [[0, 0, 0], [4001, 977, 7919]]
LINE_PTS = """pts AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey % 50 = 0 AS is_r, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS label,
CAST(trunc(l_quantity * 100.0 * 10.0) AS BIGINT) AS c0, CAST(trunc(l_extendedprice * 0.1 * 10.0) AS BIGINT) AS c1, CAST(trunc(l_discount * 10000.0 * 10.0) AS BIGINT) AS c2 FROM lineitem)"""


@query(f"WITH {LINE_PTS}, {join_sql(LINE_VECTORS, LINE_K, d=LINE_D, bits=LINE_BITS)}, {VOTES} SELECT rid, predicted FROM predicted")
def knn_classify_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table: every fiftieth order's lines against all others."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") % 50 == 0).alias("is_r"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("label"),
        prepare.quantized(prepare.scaled(F.array("l_quantity", "l_extendedprice", "l_discount"), [100.0, 0.1, 10000.0])).alias("coords"),
    )
    r, s = r_and_s(rows)
    return predict.classify(knn.approximate_knn(r, s, LINE_K, LINE_VECTORS, LINE_D, LINE_BITS, partitions=16), s).select("rid", "predicted")


# --- splits and chaining --------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) > floor(count(*) OVER () * 0.9) THEN 'R' ELSE 'S' END AS part FROM events")
def split_90_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = split.positional(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"])
    return r.select("event_id", F.lit("R").alias("part")).union(s.select("event_id", F.lit("S")))


@query("SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-06-16' AND DATE '1995-06-30' THEN 'R' ELSE 'S' END AS part FROM orders")
def split_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date is read from an id laid out as meter and date, as the filter on ids wants it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 11, "0"), F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("id"))
    r, s = split.by_condition(orders, split.id_date(F.col("id")).between("1995-06-16", "1995-06-30"))
    return r.select("o_orderkey", F.lit("R").alias("part")).union(s.select("o_orderkey", F.lit("S")))


@query("WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () // 7 AS size FROM events) SELECT event_id, CASE WHEN (rn - 1) // size < 7 THEN CAST((rn - 1) // size AS INTEGER) ELSE -1 END AS fold FROM p")
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_fold(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 7).fillna(-1)


@query(f"{EMB}, {VOTES} SELECT s.id, s.label FROM pts s WHERE s.is_r AND EXISTS (SELECT 1 FROM predicted p WHERE p.rid = s.id AND p.predicted = 2)")
def semi_join_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s, found = emb_edges(spark, sf_dir)
    return split.chain(r, s, predict.classify(found, s))[0].select("id", "label")


CHAIN = f"""{EMB}, {VOTES}, r2 AS (SELECT s.* FROM pts s JOIN predicted p ON p.rid = s.id AND p.predicted = 2), s2 AS (SELECT * FROM pts WHERE NOT is_r AND label = 2)"""


@query(f"{CHAIN} SELECT id, label, 'R' AS part FROM r2 UNION ALL SELECT id, label, 'S' FROM s2")
def chained_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R and S of the regression after the classification, as one bag."""
    r, s, found = emb_edges(spark, sf_dir)
    r2, s2 = split.chain(r, s, predict.classify(found, s))
    return r2.select("id", "label", F.lit("R").alias("part")).unionByName(s2.select("id", "label", F.lit("S").alias("part")))


@query(f"""{CHAIN}, t2 AS (WITH pts AS (SELECT id, label, true AS is_r, c0, c1, c2, c3 FROM r2 UNION ALL SELECT id, label, false, c0, c1, c2, c3 FROM s2), {join_sql(VECTORS)} SELECT rid, sid FROM top),
g AS (SELECT t.rid, round(avg(CAST(s.c0 AS DOUBLE)), 6) AS v FROM t2 t JOIN s2 s ON s.id = t.sid GROUP BY 1) SELECT p.id, coalesce(g.v, 0.0) AS value FROM pts p LEFT JOIN g ON g.rid = p.id WHERE p.is_r""")
def final_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification, then regression of the first coordinate for those predicted positive; 0 for the others."""
    r, s, found = emb_edges(spark, sf_dir)
    r2, s2 = split.chain(r, s, predict.classify(found, s))
    s2 = s2.withColumn("value", F.col("coords")[0].cast("double"))
    return split.final_series(r, predict.regress(knn.approximate_knn(r2, s2, K, VECTORS, D, BITS), s2))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END AS src FROM embeddings")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, s = r_and_s(embedded(spark, sf_dir))
    return r.select("id", F.lit(0).alias("src")).unionByName(s.select("id", F.lit(1).alias("src")))


@query("SELECT vec_id AS id, label FROM embeddings")
def rebalanced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt evenly over partitions: the same rows."""
    return prepare.rebalanced(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), 4)


@query("SELECT id, CASE WHEN nth > floor(n * 0.9) THEN 'R' ELSE 'S' END AS part FROM (SELECT id, row_number() OVER (ORDER BY id) AS nth, count(*) OVER () AS n FROM (SELECT 'M' || CAST(event_id * 7919 % 10007 AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS id FROM events))")
def split_by_text_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional split where ids are text, as those of meters are."""
    key = F.concat(F.lit("M"), (F.col("event_id") * 7919 % 10007).cast("string"), F.lit("-"), F.col("event_id").cast("string"))
    r, s = split.positional(table(spark, sf_dir, "events").select(key.alias("id")), ["id"])
    return r.select("id", F.lit("R").alias("part")).union(s.select("id", F.lit("S")))


def fold_sql(fold: int) -> str:
    pts = f"pts AS (SELECT * EXCLUDE (is_r, fold), coalesce(fold = {fold}, false) AS is_r FROM (SELECT *, CASE WHEN (rn - 1) // size < 3 THEN (rn - 1) // size END AS fold FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () // 3 AS size FROM all_pts)))"
    return f"(WITH {pts}, {join_sql(VECTORS)}, {VOTES} SELECT {fold} AS fold, round(100 * sum(CASE WHEN predicted = real THEN 1 ELSE 0 END) / count(DISTINCT id), 6) AS accuracy FROM pairs)"


@query(f"WITH {PTS.replace('pts AS', 'all_pts AS', 1)} SELECT round(avg(accuracy), 6) AS accuracy, count(*) AS folds FROM ({' UNION ALL '.join(map(fold_sql, range(3)))})")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = split.with_fold(embedded(spark, sf_dir).drop("is_r"), ["id"], 3)
    scores = []
    for fold in range(3):
        r, s = split.fold_pair(folded, fold)
        found = predict.classify(knn.approximate_knn(r, s, K, VECTORS, D, BITS), s)
        scores.append(metrics.accuracy(metrics.joined(found, r, "label")).withColumn("fold", F.lit(fold)))
    return metrics.fold_average(reduce(DataFrame.unionByName, scores), ["accuracy"])


@query("SELECT event_type AS phase, user_id % 4 AS thread, CAST(sum(value) AS DOUBLE) AS seconds FROM (SELECT event_type, user_id, CAST(value AS DECIMAL(18, 4)) AS value FROM events) GROUP BY 1, 2")
def phase_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), (F.col("user_id") % 4).alias("thread"), F.col("value").cast("decimal(18,4)").alias("seconds"))
    return metrics.phase_times(log).withColumn("seconds", F.col("seconds").cast("double"))


# --- text, sessions, tuning -----------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS FLOAT) AS f1, CAST(p_retailprice AS FLOAT) AS f2, CAST(p_retailprice AS FLOAT) AS value, p_size % 3 + 1 AS label FROM part")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as CSV and parsed again."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("features"), F.col("p_retailprice").cast("float").alias("value"), (F.col("p_size") % 3 + 1).alias("label"))
    path = scratch(spark)
    text.write_rows(rows, path)
    back = text.read_rows(spark, path, 2, value_at=2, class_at=3)
    return back.select("id", F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), "value", "label")


@query(f"{EMB}, {VOTES} SELECT rid, real, predicted FROM (SELECT CAST(id AS VARCHAR) AS rid, CAST(real AS DOUBLE) AS real, CAST(predicted AS DOUBLE) AS predicted FROM pairs)")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification results written as text lines and read again."""
    r, s, found = emb_edges(spark, sf_dir)
    path = scratch(spark)
    text.write_lines(text.classification_lines(predict.classify(found, s, [1, 2]), r, [1, 2]), path)
    return text.read_results(spark, path)


THREE = KnnConfig(k=K, shifts=1, dimension=D, classes=10, partitions=4, bits=BITS)


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    features = F.array(*((F.col("embedding")[i].cast("double") + 1.0) * 100.0 for i in range(D)))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), features.alias("features"), (F.col("label") + 1).alias("label"), (F.col("vec_id") % 10 == 0).alias("is_r"))
    return r_and_s(rows)


RAW_PTS = "raw AS (SELECT vec_id AS id, label + 1 AS label, vec_id % 10 = 0 AS is_r, " + ", ".join(f"CAST(trunc(((CAST(embedding[{i + 1}] AS DOUBLE) + 1.0) * 100.0) * 10.0) AS BIGINT) AS c{i}" for i in range(D)) + " FROM embeddings), pts AS (SELECT id, label, is_r, " + ", ".join(f"c{i} - min(c{i}) OVER () AS c{i}" for i in range(D)) + " FROM raw)"


@query(f"WITH {RAW_PTS}, {join_sql(VECTORS[:1])}, {VOTES} SELECT rid, predicted FROM predicted")
def one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.run(*_features(spark, sf_dir), THREE).select("rid", "predicted")


@query(f"WITH {RAW_PTS}, {join_sql(VECTORS[:1])}, {VOTES} SELECT rid, predicted FROM predicted")
def three_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in three jobs with tables between them."""
    path = scratch(spark)
    sessions.phase1(*_features(spark, sf_dir), THREE, path)
    sessions.phase2(spark, THREE, path)
    return sessions.phase3(spark, THREE, path).select("rid", "predicted")


@query(f"{PART} SELECT CAST(id AS VARCHAR) AS rid, CAST(real AS DOUBLE) AS real, CAST(predicted AS DOUBLE) AS predicted FROM pairs")
def regression_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression results written as text lines and read again."""
    r, _, found = _part(spark, sf_dir)
    path = scratch(spark)
    text.write_lines(text.regression_lines(found, r), path)
    return text.read_results(spark, path)


@query("SELECT count(*) AS lines, CAST(1 AS BIGINT) AS files FROM nation")
def single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written by one writer: one file has them all."""
    path = scratch(spark)
    text.write_lines(table(spark, sf_dir, "nation").select(F.col("n_name").cast("string").alias("value")).repartition(4), path, files=1)
    return spark.read.text(path).select("value", F.input_file_name().alias("file")).agg(F.count("*").alias("lines"), F.count_distinct("file").alias("files"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS FLOAT) AS f1, CAST(0 AS FLOAT) AS value, 1 AS label FROM nation WHERE n_nationkey % 2 = 0")
def overwrite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write to a path leaves nothing of the first."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.array(F.col("n_nationkey").cast("float")).alias("features"), F.lit(0.0).alias("value"), F.lit(1).alias("label"))
    path = scratch(spark)
    text.write_rows(rows, path)
    text.write_rows(rows.filter(F.col("id").cast("int") % 2 == 0), path)
    return text.read_rows(spark, path, 1, value_at=1, class_at=2).select("id", F.col("features")[0].alias("f1"), "value", "label")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}, {x})" for i, v in enumerate(VECTORS) for k, x in enumerate(v)) + ") t(shift, feature, value)")
def shift_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift vectors written to a file and read again."""
    path = scratch(spark)
    text.write_shifts(spark, VECTORS, path)
    return prepare.shift_frame(spark, text.read_shifts(spark, path)).select("shift", F.posexplode("vector").alias("feature", "value")).withColumn("value", F.col("value").cast("int"))


@query(BOUNDS + " SELECT shift, pid, coalesce(low, -1) AS low, coalesce(high, -1) AS high FROM bounds")
def range_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges written for a later session and read by it."""
    path = scratch(spark)
    text.write_ranges(ranges.range_bounds(*_sampled(spark, sf_dir)), path)
    return text.read_ranges(spark, path).fillna(-1)


VALUED = KnnConfig(k=PART_K, shifts=1, dimension=2, task="regress", partitions=4, bits=PART_BITS, folds=3, epsilon=0.1)
VALUED_PTS = "SELECT p_partkey AS id, CAST(trunc(p_size * 10.0) AS BIGINT) AS c0, CAST(trunc(p_partkey % 1000 * 10.0) AS BIGINT) AS c1, p_retailprice AS value FROM part"


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 1000).cast("double")).alias("features"), F.col("p_retailprice").alias("value"))


def valued_sql(is_r: str) -> str:
    """CTEs to predicted(rid, predicted) of a regression of part, R by this condition."""
    lift = "pts AS (SELECT id, is_r, value, c0 - min(c0) OVER () AS c0, c1 - min(c1) OVER () AS c1 FROM (SELECT *, " + is_r + " AS is_r FROM raw))"
    return f"{lift}, {join_sql([[0, 0]], PART_K, d=2, bits=PART_BITS)}, predicted AS (SELECT t.rid, round(avg(s.value), 6) AS predicted FROM top t JOIN pts s ON s.id = t.sid GROUP BY 1)"


@query(f"WITH raw AS ({VALUED_PTS}), {valued_sql('id % 10 = 0')} SELECT rid, predicted FROM predicted")
def regression_three_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression in three jobs with tables between them."""
    r, s = split.by_condition(_valued(spark, sf_dir), F.col("id") % 10 == 0)
    path = scratch(spark)
    sessions.phase1(r, s, VALUED, path)
    sessions.phase2(spark, VALUED, path)
    return sessions.phase3(spark, VALUED, path).select("rid", "predicted")


def _valued_fold(fold: int) -> str:
    return f"(WITH {valued_sql(f'coalesce(fold = {fold}, false)')} SELECT {fold} AS fold, round(sqrt(avg(pow(predicted - value, 2))), 6) AS rmse FROM predicted p JOIN pts s ON s.id = p.rid)"


@query(f"WITH raw AS (SELECT *, CASE WHEN (rn - 1) // size < 3 THEN (rn - 1) // size END AS fold FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn, count(*) OVER () // 3 AS size FROM ({VALUED_PTS}))) {' UNION ALL '.join(map(_valued_fold, range(3)))}")
def regression_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of a regression on each of three folds."""
    return sessions.cross_validate(_valued(spark, sf_dir), ["id"], VALUED).select("fold", "rmse")


@query("SELECT CAST(i AS INTEGER) AS generation, true AS never_worse, true AS is_share FROM range(0, 3) t(i)")
def genetic_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short search for feature scales: each generation's best accuracy is a share, and no less than the one before."""
    from dataclasses import replace

    r, s = (x.persist() for x in _features(spark, sf_dir))
    config = replace(THREE, max_shift=100)

    def score(genes: tune.Genes) -> float:
        own = replace(config, scale=tuple(float(g) for g in genes))
        return float(metrics.accuracy(metrics.joined(sessions.run(r, s, own), r, "label")).first().accuracy or 0.0)

    genes, best, history = tune.genetic(score, (3,) * D, tune.Search(population=3, generations=2, seed=5))
    found = [*history, best]
    return spark.createDataFrame([(i, h >= found[max(0, i - 1)], 0.0 <= h <= 100.0) for i, h in enumerate(found)], "generation int, never_worse boolean, is_share boolean")


@query("SELECT true AS scales_in_domain, true AS is_best_of_all, true AS scored_as_said")
def tuned_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scales tuned over cross-validated regressions: they lie in the domain, no generation had better ones, and score again as said."""
    from dataclasses import replace

    rows = _valued(spark, sf_dir).filter("id <= 150")
    config = replace(VALUED, folds=2, scale_domain=(5, 5))
    best, score, history = sessions.tuned(rows, ["id"], config, tune.Search(population=3, generations=1, seed=3))
    again = metrics.fold_average(sessions.cross_validate(rows, ["id"], best), ["rmse"]).first().rmse
    return spark.createDataFrame([(all(0 <= x <= 5 for x in best.scale), score <= min(history), again == score)], "scales_in_domain boolean, is_best_of_all boolean, scored_as_said boolean")
