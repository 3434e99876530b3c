"""Registered queries over the fixture tables, and the SQL they equal.

Each query drives operators from a whole table: ``embeddings`` stands for images
(i = vec_id, j = position), mazes (v > 0) and balls (dims 0 to 3), ``events`` for
moves and series, ``lineitem`` for vectors, ``customer`` for points of the plane.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce as reduce_all

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lanes, registers
from ..functions import scalar as S
from ..operators import escape, harness, index, moves, neighbor, particles, reduce, regions, track
from ..session import checkpoint_dir, cut, remove
from ..sources import arrays, generators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): one pixel for each value of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return rows.where("i is not null")


def balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, vx, vy) in double, from the first four dimensions."""
    at = [F.get("embedding", k).cast("double").alias(c) for k, c in enumerate(("x", "y", "vx", "vy"))]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *at)


_PIX = "pix AS (SELECT vec_id::INTEGER AS i, unnest(range(0, len(embedding)))::INTEGER AS j, unnest(embedding) AS v FROM embeddings)"


def _median_sql(passes: int, where: str = "") -> str:
    parts, source = [_PIX], "pix"
    for k in range(passes):
        r = f"coalesce(lag(v) OVER x, v) AS l, v, coalesce(lead(v) OVER x, v) AS r FROM {source} WINDOW x AS (PARTITION BY i ORDER BY j)"
        parts.append(f"a{k} AS (SELECT i, j, {r})")
        cols = ", ".join(f"coalesce({f}({c}) OVER y, {c}) AS {c}_{f}" for c in "lvr" for f in ("lag", "lead"))
        parts.append(f"b{k} AS (SELECT i, j, l, v, r, {cols} FROM a{k} WINDOW y AS (PARTITION BY j ORDER BY i))")
        nine = ", ".join(f"{c}, {c}_lag, {c}_lead" for c in "lvr")
        parts.append(f"m{k} AS (SELECT i, j, list_sort([{nine}])[5] AS v FROM b{k})")
        source = f"m{k}"
    return f"WITH {', '.join(parts)} SELECT i, j, v FROM {source} {where}"


@query(_median_sql(1))
def median_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbor.median_3x3(image(spark, sf_dir))


@query(_median_sql(1, "WHERE i >= 1 AND (i - 1) % 4 = 0"))
def median_3x3_stripe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbor.median_3x3(image(spark, sf_dir), offset=1, step=4)


@query(_median_sql(2))
def median_3x3_iter2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbor.median_3x3(image(spark, sf_dir), iterations=2)


@query(f"""WITH {_PIX}, size AS (SELECT max(i) AS h, max(j) AS w FROM pix)
SELECT a.i, a.j, a.v, b.v AS near FROM pix a, size LEFT JOIN pix b ON b.i = greatest(0, least(h, a.i - 1)) AND b.j = greatest(0, least(w, a.j + 1))""")
def clamped_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = image(spark, sf_dir)
    h, w = reduce.extents(pixels).first()
    return neighbor.fetch_clamped(pixels, -1, 1, h or 0, w or 0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a grid of the plane: 64 columns over [-2, 0.625), rows by id."""
    k = F.col("c_custkey")
    re, im = (k % 64) * 0.041015625 - 2.0, (F.floor(k / 64) % 64) * 0.0390625 - 1.25
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), re.alias("re"), im.alias("im"))


_POINTS = "p AS (SELECT c_custkey AS id, (c_custkey % 64) * 0.041015625::DOUBLE - 2.0::DOUBLE AS re, ((c_custkey // 64) % 64) * 0.0390625::DOUBLE - 1.25::DOUBLE AS im FROM customer)"


@query(f"""WITH RECURSIVE {_POINTS}, z(id, re, im, x, y, n) AS (
  SELECT id, re, im, re, im, 0 FROM p
  UNION ALL SELECT id, re, im, x * x - y * y + re, 2 * x * y + im, n + 1 FROM z WHERE n < 511 AND x * x + y * y < 4)
SELECT id, max(n)::INTEGER AS n FROM z GROUP BY id""")
def escape_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", escape.escape_time(F.col("re"), F.col("im"), 1, 511).alias("n"))


_ESCAPE2 = f"""WITH RECURSIVE {_POINTS}, z(id, re, im, x, y, n) AS (
  SELECT id, re::FLOAT, im::FLOAT, 0::FLOAT, 0::FLOAT, 0 FROM p
  UNION ALL SELECT id, re, im, x * x - y * y + re, x * y + x * y + im, n + 1 FROM z WHERE n < 1023 AND NOT (x::DOUBLE * x::DOUBLE + y::DOUBLE * y::DOUBLE > 4))"""


@query(f"{_ESCAPE2} SELECT id, max(n)::INTEGER AS n FROM z GROUP BY id")
def escape_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", escape.escape_time(F.col("re"), F.col("im"), 2, 1024).alias("n"))


@query(f"{_ESCAPE2}, e AS (SELECT id, max(n) AS n FROM z GROUP BY id) SELECT count(*) AS points, sum(n)::BIGINT AS iterations, round(max(ln(n + 1)), 9) AS brightest FROM e")
def escape_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = points(spark, sf_dir).select(escape.escape_time(F.col("re"), F.col("im"), 2, 1024).alias("n"))
    return n.agg(F.count("*").alias("points"), F.sum("n").alias("iterations"), F.round(F.max(S.log_intensity(F.col("n"))), 9).alias("brightest"))


@query(f"WITH {_POINTS} SELECT id, round(re * re + im * im, 9) AS m FROM p")
def squared_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", F.round(S.magnitude_squared(F.col("re"), F.col("im")), 9).alias("m"))


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_IDX = f"v AS (SELECT row_number() OVER (ORDER BY {', '.join(ORDER)}, l_quantity) - 1 AS idx, l_quantity AS x FROM lineitem)"


def vector(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(idx, x) and how many rows."""
    rows, n = index.counted_by(table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity"), *ORDER, "l_quantity")  # the last key settles ties
    return rows.select("idx", F.col("l_quantity").alias("x")), n


@query(f"WITH {_IDX} SELECT (idx % 64)::INTEGER AS g, round(sum(x), 2) AS total FROM v GROUP BY ALL")
def strided_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.sum_strided(vector(spark, sf_dir)[0], 64).withColumn("total", F.round("total", 2))


@query(f"WITH {_IDX}, n AS (SELECT ceil(count(*) / 64)::BIGINT AS k FROM v) SELECT (idx // k)::INTEGER AS g, round(sum(x), 2) AS total FROM v, n GROUP BY ALL")
def blocked_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = vector(spark, sf_dir)
    return reduce.sum_blocked(rows, 64, n).withColumn("total", F.round("total", 2))


@query("""WITH p AS (SELECT l_orderkey % 64 AS g, sum(l_quantity) AS total FROM lineitem GROUP BY 1), t AS (SELECT unnest(range(7)) AS level), s AS (SELECT level, unnest(range(64 >> level)) AS slot FROM t)
SELECT level::INTEGER AS level, slot::INTEGER AS slot, round(coalesce(sum(total), 0), 2) AS total FROM s LEFT JOIN p ON p.g % (64 >> level) = slot GROUP BY ALL""")
def tree_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 workers' sums (orders dealt by key, which needs no sort) and every
    level of the tree in which they merge."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_quantity").alias("x"))
    return reduce.tree_levels(reduce.sum_strided(rows, 64), 64).withColumn("total", F.round("total", 2))


@query(f"""WITH {_IDX}, s AS (SELECT idx % 64 AS g, sum(x) AS t FROM v GROUP BY 1), n AS (SELECT ceil(count(*) / 64)::BIGINT AS k FROM v), b AS (SELECT idx // k AS g, sum(x) AS t FROM v, n GROUP BY 1), w AS (SELECT sum(x) AS t FROM v)
SELECT 'strided' AS kind, abs(sum(s.t) - any_value(w.t)) < 1e-4 * abs(any_value(w.t)) AS close FROM s, w UNION ALL SELECT 'blocked', abs(sum(b.t) - any_value(w.t)) < 1e-4 * abs(any_value(w.t)) FROM b, w""")
def sum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the partials' sums within 1e-4 of the sum of all rows?"""
    rows, n = vector(spark, sf_dir)
    whole = rows.agg(F.sum("x").alias("w"))
    kinds = {"strided": reduce.sum_strided(rows, 64), "blocked": reduce.sum_blocked(rows, 64, n)}
    out = None
    for kind, parts in kinds.items():
        one = parts.agg(F.sum("total").alias("t")).join(F.broadcast(whole)).select(F.lit(kind).alias("kind"), (F.abs(F.col("t") - F.col("w")) < 1e-4 * F.abs("w")).alias("close"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT part::INTEGER AS part, coalesce(sum(o_custkey), 0)::BIGINT AS total FROM range(36) t(part) LEFT JOIN orders ON o_orderkey % 24 = part GROUP BY part")
def partition_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical partitions of all orders; the last third has no keys and gives 0."""
    return reduce.sum_partitions(table(spark, sf_dir, "orders"), F.col("o_orderkey") % 24, 36, F.col("o_custkey"))


@query("SELECT coalesce(sum(o_custkey), 0)::BIGINT AS total FROM orders")
def physical_partition_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums by physical partition, then their sum."""
    parts = reduce.sum_physical_partitions(table(spark, sf_dir, "orders"), "o_custkey")
    return parts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


CELLS = 16


@query(f"""WITH m AS (SELECT user_id AS grp, list([(event_id % 7), (event_id % {CELLS})]::BIGINT[] ORDER BY event_id) AS steps FROM events GROUP BY 1),
r AS (SELECT grp, list_reduce(steps, lambda c, s: CASE WHEN c[s[1] + 1] > 0 THEN list_transform(c, lambda v, k: v + (k = s[2] + 1)::BIGINT - (k = s[1] + 1)::BIGINT) ELSE c END, [v % 3 for v in range({CELLS})]::BIGINT[]) AS c FROM m)
SELECT grp, unnest(range({CELLS}))::INTEGER AS cell, unnest(c) AS n FROM r""")
def guarded_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events move counters between that user's own 16 cells."""
    events = table(spark, sf_dir, "events").where("user_id is not null")
    steps = events.select(F.col("user_id").alias("grp"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).cast("int").alias("src"), (F.col("event_id") % CELLS).cast("int").alias("dest"))
    counts = events.select(F.col("user_id").alias("grp")).distinct().select("grp", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")).withColumn("n", F.col("cell") % 3)
    return moves.guarded_moves(counts, steps)


RING, ROUNDS = 1000, 2


@query(f"""WITH m AS (SELECT list([event_id % {RING}, (event_id % {RING} + event_id * 7 % 21 - 10 + {RING}) % {RING}]::BIGINT[] ORDER BY event_id) AS steps FROM events WHERE event_id IS NOT NULL),
r AS (SELECT list_reduce(steps || steps, lambda c, s: CASE WHEN c[s[1] + 1] > 0 AND s[1] <> s[2] THEN c[1:least(s[1], s[2])] || [c[least(s[1], s[2]) + 1] + CASE WHEN s[1] < s[2] THEN -1 ELSE 1 END] || c[least(s[1], s[2]) + 2:greatest(s[1], s[2])] || [c[greatest(s[1], s[2]) + 1] + CASE WHEN s[1] < s[2] THEN 1 ELSE -1 END] || c[greatest(s[1], s[2]) + 2:] ELSE c END, range({RING})) AS c FROM m)
SELECT 0::BIGINT AS grp, unnest(range({RING}))::INTEGER AS cell, unnest(c)::BIGINT AS n FROM r""")
def ring_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, in order and twice, as one sequence of moves to a cell nearby
    on a ring of 1,000 cells that start with their number."""
    e = F.col("event_id")
    steps = table(spark, sf_dir, "events").where("event_id is not null").select(e.alias("seq"), (e % RING).cast("int").alias("src"), S.wrap(e % RING + e * 7 % 21 - 10, RING).cast("int").alias("dest"))
    return moves.guarded_moves(generators.counters(spark, RING), steps, repeat=ROUNDS)


@query(f"SELECT ({RING} * ({RING} - 1) // 2)::BIGINT AS total, true AS conserved, 0::BIGINT AS below_zero")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves keep the sum of all counters, and no counter falls below zero."""
    out = ring_moves(spark, sf_dir)
    total = F.sum("n")
    return out.agg(total.alias("total"), (total == RING * (RING - 1) // 2).alias("conserved"), F.count_if(F.col("n") < 0).alias("below_zero"))


@query("SELECT i::INTEGER AS i, j::INTEGER AS j, round((-0.575 - 0.00125 + j * (0.0025 / 63))::DOUBLE, 5) AS re, round((-0.575 - 0.00125 + i * (0.0025 / 63))::DOUBLE, 5) AS im FROM range(64) a(i), range(64) b(j)")
def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's window of the plane, in 64 x 64 points."""
    out = generators.coords(spark, count=64)
    return out.select("i", "j", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("re", "im")])


@query()
def exact_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step with collisions in the order of ids."""
    return particles.exact_step(balls(spark, sf_dir), RADIUS, 0.01)


WIDTH = 64
_REGIONS = f"""WITH RECURSIVE {_PIX}, fg AS (SELECT i::BIGINT * {WIDTH} + j AS id, i, j FROM pix WHERE v > 0),
e AS (SELECT a.id AS a, b.id AS b FROM fg a JOIN fg b ON (a.i = b.i AND abs(a.j - b.j) = 1) OR (a.j = b.j AND abs(a.i - b.i) = 1)),
reach(id, label) AS (SELECT id, id FROM fg UNION SELECT e.b, r.label FROM reach r JOIN e ON e.a = r.id WHERE r.label < e.b),
low AS (SELECT id, min(label) AS label FROM reach GROUP BY id), size AS (SELECT (max(i) + 1)::BIGINT * {WIDTH} AS sentinel FROM pix)"""


def maze(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    pixels = image(spark, sf_dir).select(F.col("j").alias("x"), F.col("i").alias("y"), "v")
    return pixels, (pixels.agg(F.max("y")).first()[0] or 0) + 1


@query(f"{_REGIONS} SELECT j AS x, i AS y, coalesce(label, sentinel) AS label FROM pix CROSS JOIN size LEFT JOIN low ON low.id = i::BIGINT * {WIDTH} + j")
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = image(spark, sf_dir).select(F.col("j").alias("x"), F.col("i").alias("y"), "v")
    return regions.label_regions(pixels, WIDTH).select("x", "y", "label")


@query(f"{_REGIONS} SELECT count(DISTINCT label) AS regions FROM low")
def region_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, height = maze(spark, sf_dir)
    return reduce.count_labels(regions.label_regions(pixels, WIDTH, height), F.lit(WIDTH * height))


@query(f"""WITH {_PIX}, size AS (SELECT (max(i) + 1)::BIGINT * {WIDTH} AS s FROM pix),
l AS (SELECT i, j, CASE WHEN v > 0 THEN i::BIGINT * {WIDTH} + j ELSE s END AS label, s FROM pix, size)
SELECT a.j AS x, a.i AS y, a.label, coalesce(b.label, a.s) AS near FROM l a LEFT JOIN l b ON b.i = a.i AND b.j = a.j + 1""")
def clamped_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, height = maze(spark, sf_dir)
    labels = pixels.select("x", "y", regions.initial_label(WIDTH, height).alias("label"))
    return regions.clamped_label(labels, 1, 0, WIDTH, height)


RADIUS = 0.02
_BALLS = "b AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS vx, embedding[4]::DOUBLE AS vy FROM embeddings)"
_NEAR = f"(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) < {4.0 * RADIUS * RADIUS!r}::DOUBLE"
_PAIRS = f"SELECT p.id AS id1, q.id AS id2 FROM b p JOIN b q ON p.id < q.id AND {_NEAR}"


@query(f"WITH {_BALLS} {_PAIRS}")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles.pairs(balls(spark, sf_dir), RADIUS).select("id1", "id2")


@query(f"WITH {_BALLS}, n AS ({_PAIRS}) SELECT id, count(*) AS overlaps FROM (SELECT id1 AS id FROM n UNION ALL SELECT id2 FROM n) GROUP BY id")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = particles.pairs(balls(spark, sf_dir), RADIUS)
    return met.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("overlaps"))


_WALL = "CASE WHEN ({x} < 0.02 AND {v} < 0) OR ({x} > 1 - 0.02::DOUBLE AND {v} > 0) THEN -{v} ELSE {v} END"


@query(f"WITH {_BALLS} SELECT id, {_WALL.format(x='x', v='vx')} AS vx, {_WALL.format(x='y', v='vy')} AS vy FROM b")
def wall_bounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balls(spark, sf_dir)
    return b.select("id", S.wall_bounce(F.col("x"), F.col("vx"), RADIUS).alias("vx"), S.wall_bounce(F.col("y"), F.col("vy"), RADIUS).alias("vy"))


@query(f"WITH {_BALLS} SELECT id, x + vx * 0.01::DOUBLE AS x, y + vy * 0.01::DOUBLE AS y FROM b")
def advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balls(spark, sf_dir)
    return b.select("id", S.advance(F.col("x"), F.col("vx"), 0.01).alias("x"), S.advance(F.col("y"), F.col("vy"), 0.01).alias("y"))


_HITS = """m AS (SELECT p.id AS id1, q.id AS id2, p.x - q.x AS dx, p.y - q.y AS dy, p.vx - q.vx AS ux, p.vy - q.vy AS uy FROM {b} p JOIN {b} q ON p.id < q.id AND {near}),
h AS (SELECT *, CASE WHEN dx * ux + dy * uy <= 0 AND dx * dx + dy * dy > 0 THEN (ux * dx + uy * dy) / (dx * dx + dy * dy) ELSE 0 END AS k FROM m)"""


@query(f"WITH {_BALLS}, {_HITS.format(b='b', near=_NEAR)} SELECT id1, id2, round(k * dx, 6) + 0.0::DOUBLE AS dvx, round(k * dy, 6) + 0.0::DOUBLE AS dvy FROM h")
def collide(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = particles.pairs(balls(spark, sf_dir), RADIUS, ("vx", "vy"))
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "vx1", "vy1", "vx2", "vy2")}
    hit = F.when(~S.moving_apart(**c), S.collide(**c))
    return met.select("id1", "id2", *[(F.round(F.coalesce(hit[k], F.lit(0.0)), 6) + 0.0).alias(f"dv{k[1]}") for k in ("dx", "dy")])


def _step_sql(k: int, source: str) -> str:
    """One step of the balls in ``source``: the table n{k}."""
    walls = f"w{k} AS (SELECT id, x, y, {_WALL.format(x='x', v='vx')} AS vx, {_WALL.format(x='y', v='vy')} AS vy FROM {source})"
    hits = _HITS.format(b=f"w{k}", near=_NEAR).replace("m AS", f"m{k} AS").replace("h AS", f"h{k} AS").replace("FROM m)", f"FROM m{k})")
    return f"""{walls},
{hits},
d{k} AS (SELECT id1 AS id, -k * dx AS ax, -k * dy AS ay FROM h{k} UNION ALL SELECT id2, k * dx - 1e-5::DOUBLE * dx, k * dy - 1e-5::DOUBLE * dy FROM h{k}),
s{k} AS (SELECT id, sum(ax) AS ax, sum(ay) AS ay FROM d{k} GROUP BY id),
v{k} AS (SELECT w{k}.id, x, y, vx + coalesce(ax, 0) AS vx, vy + coalesce(ay, 0) AS vy FROM w{k} LEFT JOIN s{k} USING (id)),
n{k} AS (SELECT id, x + vx * 0.01::DOUBLE AS x, y + vy * 0.01::DOUBLE AS y, vx, vy FROM v{k})"""


_STATE = "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(vx, 6) AS vx, round(vy, 6) AS vy FROM"


@query(f"WITH {_BALLS}, {_step_sql(1, 'b')} {_STATE} n1")
def particle_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = particles.step(balls(spark, sf_dir), RADIUS, 0.01)
    return new.select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "vx", "vy")])


@query(f"WITH {_BALLS}, {_step_sql(1, 'b')}, {_step_sql(2, 'n1')}, {_step_sql(3, 'n2')} {_STATE} n3")
def simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps, each from the written state of the one before."""
    new = particles.simulate(balls(spark, sf_dir), RADIUS, 0.01, 3)
    return new.select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "vx", "vy")])


@query(f"WITH {_BALLS} SELECT floor(x / 0.05::DOUBLE)::INTEGER AS gx, floor(y / 0.05::DOUBLE)::INTEGER AS gy, max(id) AS id FROM b GROUP BY ALL")
def cell_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = balls(spark, sf_dir).select("id", S.grid_cell(F.col("x"), 0.05).alias("gx"), S.grid_cell(F.col("y"), 0.05).alias("gy"), F.lit(0).alias("o"))
    return reduce.scatter(at, ["gx", "gy"], "id", "o")


@query(f"WITH {_BALLS} SELECT count(*) AS balls, count_if((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) < 0.0625)::BIGINT AS inside FROM b")
def masked_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balls(spark, sf_dir)
    dx, dy = F.col("x") - 0.5, F.col("y") - 0.5
    return b.agg(F.count("*").alias("balls"), F.count_if(dx * dx + dy * dy < 0.0625).alias("inside"))


@query(f"WITH {_BALLS} SELECT id, round(sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)), 9) AS r FROM b WHERE NOT sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)) < 0.25")
def outside_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = particles.without_hole(balls(spark, sf_dir))
    return out.select("id", F.round(S.distance(F.col("x"), F.col("y")), 9).alias("r"))


_Z = " + ".join(f"(((gx >> {b}) & 1) << {2 * b}) + (((gy >> {b}) & 1) << {2 * b + 1})" for b in range(16))


@query(f"WITH {_BALLS}, g AS (SELECT id, floor((x + 8) / 0.05::DOUBLE)::BIGINT AS gx, floor((y + 8) / 0.05::DOUBLE)::BIGINT AS gy FROM b) SELECT id, ({_Z})::BIGINT AS z FROM g")
def location_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = balls(spark, sf_dir)
    return b.select("id", S.z_order(S.grid_cell(F.col("x") + 8, 0.05), S.grid_cell(F.col("y") + 8, 0.05)).alias("z")).orderBy("z", "id")


def _lanes() -> tuple[Column, Column]:
    a = [F.col(c).cast("float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")]
    return F.array(*a), F.array(*reversed(a))


_LANES = "l AS (SELECT {keys}, [l_quantity::FLOAT, l_extendedprice::FLOAT, l_discount::FLOAT, l_tax::FLOAT, l_linenumber::FLOAT, l_partkey::FLOAT, l_suppkey::FLOAT, l_orderkey::FLOAT] AS a FROM lineitem), z AS (SELECT *, list_reverse(a) AS b FROM l)".format(keys=", ".join(ORDER))
_T = "list_transform(range(1, 9), lambda k: {})"


def _by_lane_sql(**registers_: str) -> str:
    cols = ", ".join(f"{v} AS {k}" for k, v in registers_.items())
    out = ", ".join(f"unnest({k}) AS {k}" for k in registers_)
    return f"WITH {_LANES}, r AS (SELECT {', '.join(ORDER)}, {cols} FROM z) SELECT {', '.join(ORDER)}, unnest(range(8))::INTEGER AS lane, {out} FROM r"


@query(_by_lane_sql(
    added=_T.format("(a[k] + b[k])::FLOAT"), subtracted=_T.format("(a[k] - b[k])::FLOAT"), multiplied=_T.format("(a[k] * b[k])::FLOAT"),
    divided=_T.format("CASE WHEN b[k] = 0 THEN NULL ELSE (a[k]::DOUBLE / b[k]::DOUBLE)::FLOAT END"), roots=_T.format("sqrt(a[k]::DOUBLE)::FLOAT"),
    fma=_T.format("((a[k] * b[k])::FLOAT + a[k])::FLOAT"), fms=_T.format("((a[k] * b[k])::FLOAT - a[k])::FLOAT"),
    lower=_T.format("CASE WHEN a[k] < b[k] THEN a[k] ELSE 0::FLOAT END"), upper=_T.format("CASE WHEN a[k] > b[k] THEN 0::FLOAT ELSE a[k] END")))
def lane_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lanes()
    rows = lanes.rows(table(spark, sf_dir, "lineitem"), ORDER, a=a, b=b)
    x, y = F.col("a"), F.col("b")
    ops = {
        "added": lanes.add.lane(x, y), "subtracted": lanes.sub.lane(x, y), "multiplied": lanes.mul.lane(x, y), "divided": lanes.div.lane(x, y), "roots": lanes.sqrt.lane(x),
        "fma": lanes.fmadd.lane(x, y, x), "fms": lanes.fmsub.lane(x, y, x), "lower": lanes.bitwise_and.lane(x, lanes.less_than.lane(x, y)), "upper": lanes.bitwise_andnot.lane(lanes.greater_than.lane(x, y), x)}
    return rows.select(*ORDER, "lane", *[c.alias(k) for k, c in ops.items()])


@query(f"WITH {_LANES} SELECT {', '.join(ORDER)}, list_sum({_T.format('CASE WHEN a[k] - b[k] < 0 THEN 1 << (k - 1) ELSE 0 END')})::INTEGER AS signs FROM z")
def lane_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lanes()
    return table(spark, sf_dir, "lineitem").select(*ORDER, lanes.signs(F.array(*[lanes.sub.lane(a[k], b[k]) for k in range(lanes.LANES)])).alias("signs"))


@query(_by_lane_sql(
    least_of=_T.format("CASE WHEN a[k] < b[k] THEN a[k] ELSE b[k] END"), greatest_of=_T.format("CASE WHEN a[k] > b[k] THEN a[k] ELSE b[k] END"),
    blended=_T.format("CASE WHEN a[k] <= b[k] THEN b[k] ELSE a[k] END"), addsub=_T.format("CASE WHEN k % 2 = 1 THEN a[k] - b[k] ELSE a[k] + b[k] END"),
    hadd="[a[1] + a[2], a[3] + a[4], b[1] + b[2], b[3] + b[4], a[5] + a[6], a[7] + a[8], b[5] + b[6], b[7] + b[8]]",
    nearest=_T.format("round_even(a[k]::DOUBLE, 0)::INTEGER"), truncated=_T.format("trunc(a[k]::DOUBLE)::INTEGER"),
    low="[a[1], b[1], a[2], b[2], a[5], b[5], a[6], b[6]]", halves="[b[1], b[2], b[3], b[4], a[1], a[2], a[3], a[4]]", even_lanes="[a[1], a[1], a[3], a[3], a[5], a[5], a[7], a[7]]"))
def register_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lanes()
    moved = {"hadd": registers.hadd(a, b), "low": registers.unpack(a, b, False), "halves": registers.permute_halves(a, b, 0x02), "even_lanes": registers.duplicate(a, False)}
    rows = lanes.rows(table(spark, sf_dir, "lineitem"), ORDER, a=a, b=b, **moved)
    x, y = F.col("a"), F.col("b")
    ops = {
        "least_of": registers.least_of.lane(x, y), "greatest_of": registers.greatest_of.lane(x, y), "blended": registers.blend.lane(x, y, registers.compare_lane("le")(x, y)),
        "addsub": registers.addsub_lane(x, y, F.col("lane")), "nearest": registers.convert_lane(x, "int"), "truncated": registers.convert_lane(x, "int", True)}
    return rows.select(*ORDER, "lane", *[c.alias(k) for k, c in ops.items()], *moved)


@query(_by_lane_sql(
    splat=_T.format("2.5::FLOAT"), made="[l_orderkey::FLOAT, l_suppkey::FLOAT, l_partkey::FLOAT, l_linenumber::FLOAT, l_tax::FLOAT, l_discount::FLOAT, l_extendedprice::FLOAT, l_quantity::FLOAT]",
    hsub="[a[1] - a[2], a[3] - a[4], b[1] - b[2], b[3] - b[4], a[5] - a[6], a[7] - a[8], b[5] - b[6], b[7] - b[8]]",
    loaded=_T.format("CASE WHEN a[k] < b[k] THEN a[k] ELSE 0::FLOAT END"), stored=_T.format("CASE WHEN a[k] < b[k] THEN b[k] ELSE a[k] END"),
    inserted="[a[1], a[2], a[3], a[4], b[1], b[2], b[3], b[4]]", picked="[a[8], a[1], a[1], a[2], a[3], a[5], a[8], a[6]]",
    up=_T.format("ceil(a[k]::DOUBLE)"), down=_T.format("floor(a[k]::DOUBLE)"), even=_T.format("round_even(a[k]::DOUBLE, 0)"), chopped=_T.format("trunc(a[k]::DOUBLE)"),
    unequal=_T.format("a[k] <> b[k]"), not_less=_T.format("NOT a[k] < b[k]"), and_bits=_T.format("trunc(a[k]::DOUBLE)::BIGINT & trunc(b[k]::DOUBLE)::BIGINT"), or_bits=_T.format("trunc(a[k]::DOUBLE)::BIGINT | trunc(b[k]::DOUBLE)::BIGINT"), xor_bits=_T.format("xor(trunc(a[k]::DOUBLE)::BIGINT, trunc(b[k]::DOUBLE)::BIGINT)"), andnot_bits=_T.format("~(trunc(a[k]::DOUBLE)::BIGINT) & trunc(b[k]::DOUBLE)::BIGINT")).replace("FROM lineitem)", ", l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)", 1))
def register_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads, stores, rounding, comparison, bits and moves of whole registers."""
    a, b = _lanes()
    high_first = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")]
    moved = {
        "splat": lanes.splat(F.lit(2.5)), "made": lanes.make(*high_first), "hsub": registers.hsub(a, b), "inserted": registers.insert_half(a, registers.extract_half(b, 0), 1),
        "picked": registers.permute(a, F.array(*map(F.lit, (7, 0, 0, 1, 2, 4, 7, 5))))}
    rows = lanes.rows(table(spark, sf_dir, "lineitem"), ORDER, a=a, b=b, **moved)
    x, y, low = F.col("a"), F.col("b"), lanes.less_than.lane(F.col("a"), F.col("b"))
    i, j = x.cast("long"), y.cast("long")
    ops = {
        "loaded": registers.masked_load.lane(x, low), "stored": registers.blend.lane(x, y, low), "up": registers.rounded_lane("up")(x), "down": registers.rounded_lane("down")(x), "even": registers.rounded_lane("nearest")(x), "chopped": registers.rounded_lane("zero")(x),
        "unequal": registers.compare_lane("neq")(x, y), "not_less": registers.compare_lane("nlt")(x, y), "and_bits": registers.bits_lane("and")(i, j), "or_bits": registers.bits_lane("or")(i, j), "xor_bits": registers.bits_lane("xor")(i, j), "andnot_bits": registers.bits_lane("andnot")(i, j)}
    return rows.select(*ORDER, "lane", *[c.alias(k) for k, c in ops.items()], *moved)


def _any(lane: str) -> str:
    return f"list_contains({_T.format(lane)}, true)"


@query(f"""WITH {_LANES}, m AS (SELECT *, {_T.format('a[k] < 5')} AS p, {_T.format('b[k] < 50')} AS q FROM z)
SELECT {', '.join(ORDER)}, (a[1] * b[1] + a[2] * b[2])::DOUBLE AS dot, NOT {_any('p[k] AND q[k]')} AS z, NOT {_any('NOT p[k] AND q[k]')} AS c,
  {_any('p[k] AND q[k]')} AND {_any('NOT p[k] AND q[k]')} AS nzc, round(1.0::DOUBLE / nullif(b[1], 0), 9) AS rcp, round(1.0::DOUBLE / sqrt(nullif(b[1], 0)::DOUBLE), 9) AS rsqrt FROM m""")
def register_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result a register: dot products, whole-vector tests, reciprocals."""
    a, b = _lanes()
    p, q = F.array(*[a[k] < 5 for k in range(8)]), F.array(*[b[k] < 50 for k in range(8)])
    dot = registers.dot(a, b, 0x31)[0].cast("double")
    one = lambda f: F.round(f(F.array(b[0].cast("double")))[0], 9)
    return table(spark, sf_dir, "lineitem").select(*ORDER, dot.alias("dot"), *[registers.test(p, q, k).alias(k) for k in ("z", "c", "nzc")], one(registers.reciprocal).alias("rcp"), one(registers.reciprocal_sqrt).alias("rsqrt"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN sqrt(l_tax * 100)::FLOAT <= 2 THEN sqrt(l_tax * 100)::FLOAT ELSE 0::FLOAT END AS root FROM lineitem")
def masked_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ORDER, S.masked_sqrt(F.col("l_tax") * 100).alias("root"))


@query("SELECT user_id, count(*) AS n, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.9::DOUBLE * s + 0.1::DOUBLE * x), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY user_id")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.ema(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("ema", F.round("ema", 6))


@query("""WITH s AS (SELECT user_id, count(*) AS n, list_reduce(list([value, 1] ORDER BY ts, event_id), lambda s, z: [s[1] + (s[2] + 0.01::DOUBLE) / (s[2] + 1.01::DOUBLE) * (z[1] - s[1]), (1 - (s[2] + 0.01::DOUBLE) / (s[2] + 1.01::DOUBLE)) * (s[2] + 0.01::DOUBLE)]) AS s FROM events WHERE value IS NOT NULL GROUP BY user_id)
SELECT user_id, n, round(s[1], 6) AS m, round(s[2], 6) AS p FROM s""")
def kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = track.kalman_scalar(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "n", F.round("m", 6).alias("m"), F.round("p", 6).alias("p"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
s(user_id, k, bucket, frames, elapsed) AS (
  SELECT user_id, k, 0::BIGINT, 1::BIGINT, coalesce(value, 0) FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, bucket + (elapsed > 100)::BIGINT, CASE WHEN elapsed > 100 THEN 1 ELSE frames + 1 END, CASE WHEN elapsed > 100 THEN 0 ELSE elapsed END + coalesce(e.value, 0)
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, bucket, frames, round(elapsed, 6) AS elapsed, round(frames / elapsed, 9) AS rate FROM s WHERE elapsed > 100""")
def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = track.frame_rates(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", ["ts", "event_id"], "value", 100.0)
    return out.withColumns({"elapsed": F.round("elapsed", 6), "rate": F.round("rate", 9)})


def _axis_sql(name: str, at: int, gain: float, noise: float, push: float) -> str:
    """One axis of the filter: position, velocity and their covariance.  The last
    dims may be no whole measurement (then ``ok`` is 0): nothing is corrected."""
    d, c, q, u = (f"{v!r}::DOUBLE" for v in (0.01, gain, noise * noise, push))
    return f"""{name}(id, k, x, v, a, b, e) AS (
  SELECT vec_id, 0, 0::DOUBLE, 0::DOUBLE, 0.01::DOUBLE, 0::DOUBLE, 0.01::DOUBLE FROM m
  UNION ALL SELECT id, k + 1, px + c * pa / s * (z - c * px), pv + c * pb / s * (z - c * px), pa - c * pa / s * c * pa, pb - c * pa / s * c * pb, pe - c * pb / s * c * pb
  FROM (SELECT *, c * c * pa + 1 AS s FROM (SELECT id, k, x + {d} * v AS px, v + {u} AS pv, a + 2 * {d} * b + {d} * {d} * e AS pa, b + {d} * e AS pb, e + {q} AS pe, {c} * (len(m.embedding) >= 3 * (k + 2))::INTEGER AS c,
    coalesce(m.embedding[3 * (k + 1) + {at} + 1], 0)::DOUBLE AS z FROM {name} JOIN m ON m.vec_id = id WHERE 3 * (k + 1) < len(m.embedding))))"""


@query(f"""WITH RECURSIVE m AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) > 0),
{_axis_sql('fx', 0, 1.0, 0.25, 0.0)}, {_axis_sql('fy', 1, 5.0, 0.25, 0.0)}, {_axis_sql('fz', 2, 5.0, 0.1, -9.81 * 0.01)}
SELECT id AS vec_id, k::INTEGER AS k, {', '.join(f'round({c}, 4) + 0.0::DOUBLE AS {n}' for c, n in (('fx.x', 'x'), ('fy.x', 'y'), ('fz.x', 'z'), ('fx.v', 'vx'), ('fy.v', 'vy'), ('fz.v', 'vz')))}
FROM fx JOIN fy USING (id, k) JOIN fz USING (id, k)""")
def kalman_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's dims as a noisy 3-D series, three dims a measurement."""
    steps = F.expr("transform(sequence(0, cast(ceil(size(embedding) / 3) as int) - 1), k -> struct(k as k, get(embedding, 3 * k) as mx, get(embedding, 3 * k + 1) as my, get(embedding, 3 * k + 2) as mz))")
    series = table(spark, sf_dir, "embeddings").where("vec_id is not null and size(embedding) > 0").select("vec_id", F.inline(steps))
    out = track.kalman_track(series, "vec_id", [0.0] * 6)
    return out.select("vec_id", "k", *[(F.round(c, 4) + 0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


@query(f"""WITH RECURSIVE {_BALLS}, s(id, k, x, y, z, vx, vy, vz) AS (
  SELECT id, 0, x, y, 0::DOUBLE, vx, vy, 1::DOUBLE FROM b
  UNION ALL SELECT id, k + 1, x + 0.01::DOUBLE * vx, y + 0.01::DOUBLE * vy, z + 0.01::DOUBLE * vz, vx, vy, vz - 0.0981::DOUBLE FROM s WHERE k < 9)
SELECT id, k::INTEGER AS k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(vz, 6) AS vz FROM s""")
def blind_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = balls(spark, sf_dir).withColumns({"z": F.lit(0.0), "vz": F.lit(1.0)})
    out = track.predict(start, "id", 10)
    return out.select("id", "k", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "vz")])


@query(f"WITH {_PIX} SELECT (i // 2 - 10)::INTEGER AS i, (j // 2 - 4)::INTEGER AS j, v FROM pix WHERE i % 2 = 0 AND j % 2 = 0 AND i // 2 BETWEEN 10 AND 199 AND j // 2 BETWEEN 4 AND 27")
def subsample_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.crop(arrays.subsample(image(spark, sf_dir)), 10, 200, 4, 28)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(l_quantity + 1), 9) AS bright, CASE WHEN l_discount > 0 THEN round(ln(l_discount), 9) END AS dark FROM lineitem")
def log_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*ORDER, F.round(S.log_intensity(F.col("l_quantity")), 9).alias("bright"), F.round(S.log_intensity(F.col("l_discount"), False), 9).alias("dark"))


@query("SELECT l_returnflag AS kind, l_linenumber AS workgroups, round(sum(l_extendedprice), 2) AS seconds FROM lineitem GROUP BY ALL ORDER BY seconds, kind, workgroups LIMIT 1")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("workgroups")).agg(F.round(F.sum("l_extendedprice"), 2).alias("seconds"))
    return reduce.best(times)


@query("SELECT 'g' || g AS kind, g AS workgroups, w AS workers FROM (SELECT unnest([8, 16, 32, 64, 128, 256, 512]) AS g), (SELECT unnest([4, 8, 16, 32, 64, 128]) AS w)")
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = reduce.sweep(spark, workgroups=[2**k for k in range(3, 10)], workers=[2**k for k in range(2, 8)])
    return grid.select(F.concat(F.lit("g"), F.col("workgroups").cast("string")).alias("kind"), "workgroups", "workers")


@query(f"WITH {_PIX} SELECT max(i) + 1 AS height, max(j) + 1 AS width FROM pix")
def image_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.extents(image(spark, sf_dir))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 4).alias("total"))


@query("SELECT p_partkey, ceil(p_size / 8.0)::BIGINT AS groups, (ceil(p_size / 8.0) * 8)::BIGINT AS padded, ((p_size - 30) % 1000 + 1000) % 1000 AS ring FROM part")
def padded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", S.ceil_div(n, 8).alias("groups"), S.round_up(n, 8).alias("padded"), S.wrap(n - 30, 1000).alias("ring"))


@query("SELECT s_suppkey, round(s_acctbal * 2, 6) AS result FROM supplier")
def ordered_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.ordered_map(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", lambda v: v * 2).withColumn("result", F.round("result", 6))


_SIX = ("x", "y", "z", "vx", "vy", "vz")


@query(f"SELECT vec_id, {', '.join(f'embedding[{k + 1}]::DOUBLE AS {c}' for k, c in enumerate(_SIX))} FROM embeddings")
def text_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six dims of every embedding, written as text and read back."""
    path = f"{checkpoint_dir(spark)}/series-{uuid.uuid4().hex}"
    dims = [F.get("embedding", k).alias(c) for k, c in enumerate(_SIX)]
    arrays.write_series(table(spark, sf_dir, "embeddings").select("vec_id", *dims), path)
    rows = cut(arrays.read_series(spark, path, ["vec_id", *_SIX]))
    remove(spark, path)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), *_SIX)


@query("SELECT l_suppkey::INTEGER AS i, l_linenumber AS j, round(ln(count(*) + 1), 9) AS v FROM lineitem GROUP BY ALL")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by supplier and number, as an image of log counts."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("i"), F.col("l_linenumber").alias("j")).agg(F.count("*").alias("v"))
    return arrays.log_counts(counts).withColumn("v", F.round("v", 9))


@query("SELECT i::INTEGER AS cell, i AS n FROM range(1000) t(i)")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.counters(spark)


@query("SELECT * FROM (VALUES ('balls', 10000::BIGINT, 10000::BIGINT), ('jobs', 10, 10), ('moves', 1000000, 1000000), ('near moves', 1000000, 1000000), ('uniform', 1000000, 1000000)) t(kind, n, within)")
def generated_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each random input there are, and how many are in range."""
    on_ring = lambda c: F.col(c).between(0, 999)
    apart = F.pmod(F.col("dest") - F.col("src"), F.lit(1000))
    free = (S.distance(F.col("x"), F.col("y")) > 0.25 - 1e-6) & F.greatest("x", "y").between(0.002 - 1e-6, 0.998 + 1e-6) & F.least("x", "y").between(0.002 - 1e-6, 0.998 + 1e-6) & (F.greatest(F.abs("vx"), F.abs("vy")) <= 0.25)
    inputs = {
        "balls": (generators.balls(spark, 10_000, 0.002), free), "jobs": (generators.jobs(spark), F.col("job").between(0, 9)), "uniform": (generators.uniform(spark, 1_000_000), (F.col("x") >= 0) & (F.col("x") <= 1)),
        "moves": (generators.moves(spark, 1_000_000), on_ring("src") & on_ring("dest")), "near moves": (generators.moves(spark, 1_000_000, spread=10), on_ring("src") & on_ring("dest") & ((apart <= 10) | (apart >= 990)))}
    rows = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count_if(within).alias("within")) for kind, (df, within) in inputs.items()]
    return reduce_all(DataFrame.unionByName, rows)
