"""The engine's own queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import intensity as it
from .operators import labels as lb
from .operators import metrics as mt
from .operators import stencils as st
from .plans import fixtures as fx

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None, base: str = fx.SQL):
    """Register a query, and its SQL after the fixtures' CTEs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base + sql
        return f

    return add


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_PAIRS = """, ov AS (SELECT r.label AS t, p.label AS p, count(*) AS n FROM ref r JOIN pred p USING (z, y, x) GROUP BY 1, 2),
nt AS (SELECT label AS t, count(*) AS n_t FROM ref GROUP BY 1), np AS (SELECT label AS p, count(*) AS n_p FROM pred GROUP BY 1),
iou AS (SELECT t, p, n, n_t, n_p, n / (n_t + n_p - n) AS iou, 2 * n / (n_t + n_p) AS dice FROM ov JOIN nt USING (t) JOIN np USING (p))
"""


@query(_PAIRS + """, th AS (SELECT unnest([0.5::DOUBLE, 0.65, 0.75, 0.8, 0.9, 0.95]) AS threshold),
tp AS (SELECT threshold, least(count(DISTINCT t), count(DISTINCT p)) AS tp FROM iou, th WHERE iou >= threshold GROUP BY 1),
c AS (SELECT threshold, coalesce(tp, 0) AS tp, (SELECT max(label) FROM pred) - coalesce(tp, 0) AS fp, (SELECT max(label) FROM ref) - coalesce(tp, 0) AS fn FROM th LEFT JOIN tp USING (threshold))
SELECT threshold, tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp + fn), 6) AS ap FROM c""")  # fmt: skip
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mt.average_precision(fx.ref(spark, d), fx.pred(spark, d), (0.5, 0.65, 0.75, 0.8, 0.9, 0.95)), "ap")


@query(_PAIRS + "SELECT t, p, n FROM ov")
def label_overlap(spark, d):
    return mt.label_overlap(fx.ref(spark, d), fx.pred(spark, d))


@query(_PAIRS + "SELECT t, p, n, n_t, n_p, round(iou, 6) AS iou, round(dice, 6) AS dice FROM iou")
def iou_pairs(spark, d):
    return _rounded(mt.iou_pairs(fx.ref(spark, d), fx.pred(spark, d)), "iou", "dice")


@query(_PAIRS + "SELECT t, p, round(iou, 6) AS iou, n FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY iou DESC, p) AS k FROM iou) WHERE k = 1")
def best_matches(spark, d):
    return _rounded(mt.best_matches(fx.ref(spark, d), fx.pred(spark, d)), "iou")


@query(_PAIRS + """, u AS (SELECT count(*) AS total FROM (SELECT z, y, x FROM ref UNION SELECT z, y, x FROM pred))
SELECT CAST(m AS BIGINT) AS matched, total, round(m / total, 6) AS aji FROM (SELECT coalesce(sum(n), 0) AS m FROM iou WHERE iou > 0.5), u""")
def jaccard_at_half(spark, d):
    return _rounded(mt.jaccard_at_half(fx.ref(spark, d), fx.pred(spark, d)), "aji")


@query("WITH s AS (SELECT sum((1 - quality) * toxic) AS i, sum(1 - quality) AS a, sum(toxic) AS b FROM labels) SELECT round((i + 0.001) / (a + b - i + 0.001), 6)::DOUBLE AS iou, round(2 * (i + 0.001) / (a + b + 0.001), 6)::DOUBLE AS dice FROM s", base="")
def class_scores(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").select((1 - F.col("quality")).alias("a"), F.col("toxic").alias("b"))
    return _rounded(mt.class_scores(rows, "a", "b"), "iou", "dice")


@query("""SELECT label, count(*) AS area, min(z) AS min_z, max(z) + 1 AS max_z, round(avg(z), 6) AS c_z, min(y) AS min_y, max(y) + 1 AS max_y, round(avg(y), 6) AS c_y,
min(x) AS min_x, max(x) + 1 AS max_x, round(avg(x), 6) AS c_x FROM ref GROUP BY label""")
def region_props(spark, d):
    return _rounded(lb.region_props(fx.ref(spark, d)), "c_z", "c_y", "c_x")


@query("SELECT z, y, x, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS label FROM pred")
def relabel_sequential(spark, d):
    return lb.relabel_sequential(fx.pred(spark, d))


@query(""", o AS (SELECT label, CAST(row_number() OVER (ORDER BY avg(z), avg(y), avg(x), label) AS INT) AS n FROM pred GROUP BY label)
SELECT z, y, x, n AS label FROM pred JOIN o USING (label)""")
def reorder_labels(spark, d):
    return lb.reorder_labels(fx.pred(spark, d))


@query("SELECT z, y, x, label FROM pred WHERE label IN (SELECT label FROM pred GROUP BY 1 HAVING count(*) >= 64)")
def remove_small_labels(spark, d):
    return lb.remove_small_labels(fx.pred(spark, d), 64)


@query(", n AS (SELECT label, count(*) AS c FROM ref GROUP BY 1) SELECT z, y, x, label FROM ref WHERE label IN (SELECT label FROM n WHERE NOT c > (SELECT avg(c) + stddev_pop(c) FROM n))")
def size_statistics_filter(spark, d):
    return lb.size_statistics_filter(fx.ref(spark, d), 1.0)


@query(", m AS (SELECT label, avg(v) AS m FROM ref JOIN vol USING (z, y, x) GROUP BY 1) SELECT z, y, x, label FROM ref WHERE label IN (SELECT label FROM m WHERE m >= 52)")
def intensity_filter(spark, d):
    return lb.intensity_filter(fx.ref(spark, d), fx.volume(spark, d), 52.0)


@query("""SELECT label, count(*) AS area, round(covar_samp(z, z), 6) AS cov_zz, round(covar_samp(z, y), 6) + 0.0 AS cov_zy, round(covar_samp(z, x), 6) + 0.0 AS cov_zx,
round(covar_samp(y, y), 6) AS cov_yy, round(covar_samp(y, x), 6) + 0.0 AS cov_yx, round(covar_samp(x, x), 6) AS cov_xx FROM ref GROUP BY label""")
def shape_covariance(spark, d):
    return lb.shape_covariance(fx.ref(spark, d)).select("label", "area", *[(F.round(f"cov_{c}", 6) + F.lit(0.0)).alias(f"cov_{c}") for c in ("zz", "zy", "zx", "yy", "yx", "xx")])


@query(""", m AS (SELECT label, count(*) AS n, covar_samp(z, z) AS zz, covar_samp(z, y) AS zy, covar_samp(z, x) AS zx, covar_samp(y, y) AS yy, covar_samp(y, x) AS yx, covar_samp(x, x) AS xx FROM ref GROUP BY label),
t AS (SELECT *, (zz + yy + xx) / 3 AS q FROM m WHERE n > 20),
s AS (SELECT *, sqrt(((zz - q) * (zz - q) + (yy - q) * (yy - q) + (xx - q) * (xx - q) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM t),
e AS (SELECT label, q, p, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((zz - q) * ((yy - q) * (xx - q) - yx * yx) - zy * (zy * (xx - q) - yx * zx) + zx * (zy * yx - (yy - q) * zx)) / (2 * p * p * p)))) / 3 AS phi FROM s)
SELECT z, y, x, label FROM ref WHERE label IN (SELECT label FROM e WHERE p = 0 OR (q + 2 * p * cos(phi)) / greatest(q + 2 * p * cos(phi + 2 * pi() / 3), 1e-12) <= 3.05::DOUBLE)""")
def remove_eccentric_shapes(spark, d):
    return lb.remove_eccentric_shapes(fx.ref(spark, d), 20, 3.05)


@query(""", o AS (SELECT a.i AS i, b.i AS j, c.i AS k FROM ax a, ax b, ax c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4)
SELECT DISTINCT z + i AS z, y + j AS y, x + k AS x FROM pred, o WHERE z + i BETWEEN 0 AND 31 AND y + j BETWEEN 0 AND 63 AND x + k >= 0 AND x + k < (SELECT w FROM width)""")
def dilate_ball(spark, d):
    return lb.dilate_ball(fx.pred(spark, d), 2, fx.shape(spark, d))


@query(""", o AS (SELECT a.i AS i, b.i AS j, c.i AS k FROM ax a, ax b, ax c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 1),
n AS (SELECT z, y, x, z + i AS nz, y + j AS ny, x + k AS nx FROM ref, o WHERE z + i BETWEEN 0 AND 31 AND y + j BETWEEN 0 AND 63 AND x + k >= 0 AND x + k < (SELECT w FROM width))
SELECT z, y, x FROM ref EXCEPT SELECT n.z, n.y, n.x FROM n LEFT JOIN ref r ON r.z = nz AND r.y = ny AND r.x = nx WHERE r.z IS NULL""")
def erode_ball(spark, d):
    return lb.erode_ball(fx.ref(spark, d), 1, fx.shape(spark, d))


@query(""", o AS (SELECT a.i AS i, b.i AS j, c.i AS k FROM ax a, ax b, ax c WHERE a.i * a.i + b.i * b.i + c.i * c.i = 1),
n AS (SELECT z, y, x, label, z + i AS nz, y + j AS ny, x + k AS nx FROM ref, o WHERE z + i BETWEEN 0 AND 31 AND y + j BETWEEN 0 AND 63 AND x + k >= 0 AND x + k < (SELECT w FROM width))
SELECT DISTINCT n.z, n.y, n.x, n.label FROM n LEFT JOIN ref r ON r.z = nz AND r.y = ny AND r.x = nx WHERE r.label IS NULL OR r.label <> n.label""")
def boundary_voxels(spark, d):
    return lb.boundary_voxels(fx.ref(spark, d), fx.shape(spark, d))


def _cc(src: str, reach: int, same: str = "1", axes: str = "zyx") -> str:
    """CTEs: comp (z, y, x, same, root), the components of ``src`` with neighbours that differ in at most ``reach`` coordinates.

    Without z among the ``axes`` each slice is on its own. Runs along x are the nodes; a keyed recursion hands each the smallest id it can reach. root grows in raster order.
    """
    steps = [(i, j, int(reach > abs(i) + abs(j))) for i in ((-1, 0, 1) if axes == "zyx" else (0,)) for j in (-1, 0, 1) if (i or j) and abs(i) + abs(j) <= reach]
    near = ", ".join(f"({i}, {j}, {t})" for i, j, t in steps)
    return f""", cell AS (SELECT *, x - row_number() OVER (PARTITION BY same, z, y ORDER BY x) AS g FROM (SELECT DISTINCT {same} AS same, z, y, x FROM {src})),
run AS (SELECT same, z, y, g, min(x) AS a, max(x) AS b, (CAST(z AS BIGINT) * 1000000 + y) * 1000000 + min(x) AS id FROM cell GROUP BY same, z, y, g),
step AS (SELECT * FROM (VALUES {near}) s(i, j, t)),
edge AS MATERIALIZED (SELECT r.id AS u, o.id AS w FROM (SELECT run.*, z + i AS nz, y + j AS ny, t FROM run, step) r JOIN run o ON o.same = r.same AND o.z = nz AND o.y = ny AND o.a <= r.b + t AND o.b >= r.a - t),
near(id, root) USING KEY (id) AS (SELECT id, id FROM run UNION
  SELECT edge.u, min(n.root) FROM near n JOIN edge ON n.id = edge.w JOIN recurring.near o ON o.id = edge.u WHERE n.root < o.root GROUP BY edge.u),
comp AS (SELECT cell.z, cell.y, cell.x, cell.same, near.root FROM cell JOIN run USING (same, z, y, g) JOIN near USING (id))
"""


_REC = fx.SQL.replace("WITH", "WITH RECURSIVE", 1)


@query(_cc("pred", 1) + "SELECT z, y, x, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS comp FROM comp", base=_REC)
def components_6(spark, d):
    return lb.components(fx.pred(spark, d).select("z", "y", "x"), 6)


@query(_cc("pred", 1) + """, s AS (SELECT root, count(*) AS n FROM comp GROUP BY root)
SELECT z, y, x FROM comp WHERE root = (SELECT root FROM s ORDER BY n DESC, root LIMIT 1)""", base=_REC)
def largest_component(spark, d):
    return lb.largest_component(fx.pred(spark, d).select("z", "y", "x"), 6)


@query(_cc("pred", 1) + "SELECT z, y, x FROM comp WHERE root IN (SELECT root FROM comp GROUP BY root HAVING count(*) >= 200)", base=_REC)
def remove_small_components(spark, d):
    return lb.remove_small_components(fx.pred(spark, d).select("z", "y", "x"), 200, 6)


@query(_cc("ref", 3, "label") + """, n AS (SELECT same, root, row_number() OVER (ORDER BY same, root) AS label FROM comp GROUP BY same, root HAVING count(*) >= 8)
SELECT z, y, x, CAST(n.label AS INT) AS label FROM comp JOIN n USING (same, root)""", base=_REC)
def split_components(spark, d):
    return lb.split_components(fx.ref(spark, d), 8).select("z", "y", "x", "label")


@query(_cc("ref", 1, "label") + """, n AS (SELECT same, root, row_number() OVER (PARTITION BY same ORDER BY count(*) DESC, root) AS k FROM comp GROUP BY same, root)
SELECT z, y, x, same AS label FROM comp JOIN n USING (same, root) WHERE k = 1""", base=_REC)
def largest_component_per_label(spark, d):
    return lb.largest_component_per_label(fx.ref(spark, d)).select("z", "y", "x", "label")


@query("SELECT z, y, x FROM ref")
def fill_holes(spark, d):
    """The boundary of the reference volume's foreground, filled again."""
    own = fx.ref(spark, d).select("z", "y", "x", F.lit(1).alias("label"))
    return lb.fill_holes(lb.boundary_voxels(own, fx.shape(spark, d)), fx.shape(spark, d))


@query(_cc("pred", 3) + """, c AS (SELECT root FROM comp LEFT JOIN ref USING (z, y, x) GROUP BY root HAVING count(label) / count(*) >= 0.01::DOUBLE)
SELECT z, y, x FROM comp JOIN c USING (root)""", base=_REC)
def valid_region(spark, d):
    return mt.valid_region(fx.ref(spark, d), fx.pred(spark, d))


@query(", p AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.998) AS b FROM vol) SELECT z, y, x, round((v - a) / (b - a + 1e-20), 6) AS v FROM vol, p")
def percentile_normalize(spark, d):
    return _rounded(it.percentile_normalize(fx.volume(spark, d)), "v")


@query(", p AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM vol) SELECT z, y, x, round(least(greatest((v - a) / (b - a), 0), 1), 6) AS v FROM vol, p")
def adjust_contrast(spark, d):
    return _rounded(it.adjust_contrast(fx.volume(spark, d), 5, 95), "v")


@query("SELECT z, y, x, CASE WHEN v <= 12 THEN (SELECT median(v) FROM vol WHERE v > 12) ELSE v END AS v FROM vol")
def fill_median(spark, d):
    return it.fill_low(fx.volume(spark, d), 12, "median")


_HIST = """, m AS (SELECT min(v) AS lo, (max(v) - min(v)) / 256 AS w FROM vol),
h AS (SELECT CAST(least(floor((v - lo) / w), 255) AS INT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM vol, m GROUP BY 1),
hist AS (SELECT bin, n, lo + (bin + 0.5::DOUBLE) * w AS centre FROM h)
"""


@query(_HIST + "SELECT bin, n, round(centre, 6) AS centre FROM hist")
def histogram_256(spark, d):
    return _rounded(it.histogram(fx.volume(spark, d)), "centre")


@query(_HIST + """, c AS (SELECT centre, sum(n) OVER o AS w0, sum(n * centre) OVER o AS s0, sum(n) OVER () AS w, sum(n * centre) OVER () AS s FROM hist WINDOW o AS (ORDER BY bin)),
b AS (SELECT centre, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS var FROM c WHERE w > w0)
SELECT round(centre, 6) AS threshold FROM b ORDER BY var DESC, centre LIMIT 1""")
def otsu(spark, d):
    return _rounded(it.otsu(fx.volume(spark, d)), "threshold")


@query(_HIST + """, c AS (SELECT bin, centre, CAST(sum(n) OVER o AS DOUBLE) AS w, sum(n * centre) OVER o AS s FROM hist WINDOW o AS (ORDER BY bin)),
t AS (SELECT max(w) AS w, max_by(s, bin) AS s FROM c),
p AS (SELECT a.centre AS low, b.centre AS high, round(a.s * a.s / a.w + (b.s - a.s) * (b.s - a.s) / (b.w - a.w) + (t.s - b.s) * (t.s - b.s) / (t.w - b.w), 3) AS var FROM c a, c b, t WHERE a.bin < b.bin AND b.w < t.w)
SELECT round(low, 6) AS low, round(high, 6) AS high FROM p ORDER BY var DESC, low, high LIMIT 1""")
def multi_otsu(spark, d):
    return _rounded(it.multi_otsu(fx.volume(spark, d)), "low", "high")


@query(", bg AS (SELECT z, y, x, v, CAST(z + y AS DOUBLE) AS bg FROM vol), m AS (SELECT avg(bg) AS m FROM bg) SELECT z, y, x, round(m / (bg + 0.1::DOUBLE) * v, 6) AS v FROM bg, m")
def background_correct(spark, d):
    df = fx.volume(spark, d).withColumn("bg", (F.col("z") + F.col("y")).cast("double"))
    return _rounded(it.background_correct(df).drop("bg"), "v")


def _box(cols: dict[str, str], src: str = "vol", size: int = 3) -> str:
    """CTEs b_z, b_y, b_x: box means along one axis after the other over mirrored rows."""
    before, after, out, last = size // 2, (size - 1) // 2, "", None
    for a, n in (("z", "32"), ("y", "64"), ("x", "(SELECT w FROM width)")):
        rest = [k for k in "zyx" if k != a]
        rows = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {src}" if last is None else f"SELECT * FROM {last}"
        ends = f"SELECT *, {a} AS i_ FROM ({rows}) UNION ALL SELECT *, -1 - {a} FROM ({rows}) WHERE {a} < {before} UNION ALL SELECT *, 2 * {n} - 1 - {a} FROM ({rows}) WHERE {a} >= {n} - {after}"
        out += f""", m_{a} AS ({ends}),
b_{a} AS (SELECT {', '.join(rest)}, CAST(i_ AS INT) AS {a}, {', '.join(c for c in cols)} FROM (SELECT {', '.join(rest)}, i_, {', '.join(f'avg({c}) OVER (PARTITION BY {rest[0]}, {rest[1]} ORDER BY i_ ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS {c}' for c in cols)} FROM m_{a}) WHERE i_ >= 0 AND i_ < {n})"""
        last = f"b_{a}"
    return out


@query(_box({"bm": "v"}) + " SELECT z, y, x, round(bm, 6) AS v FROM b_x")
def box_mean(spark, d):
    return _rounded(st.box_mean(fx.volume(spark, d), ["v"], 3, fx.shape(spark, d)), "v")


@query(_box({"bm": "v", "bs": "v * v"}) + " SELECT z, y, x, round(bs - bm * bm, 5) AS var FROM b_x")
def local_variance(spark, d):
    return _rounded(st.local_variance(fx.volume(spark, d), 3, fx.shape(spark, d)).drop("v"), "var", digits=5)


@query(_box({"bm": "v"}) + " SELECT z, y, x, round(v - bm, 6) + 0.0 AS v FROM b_x JOIN vol USING (z, y, x)")
def difference_of_means(spark, d):
    return st.difference_of_means(fx.volume(spark, d), 3, fx.shape(spark, d), False).withColumn("v", F.round("v", 6) + F.lit(0.0))


@query(_box({"m1": "v", "s1": "v * v", "m2": "(v * 2 + x)", "s2": "(v * 2 + x) * (v * 2 + x)"}) + """
, w AS (SELECT z, y, x, v AS a, CAST(v * 2 + x AS DOUBLE) AS b, 1 / (s1 - m1 * m1 + 1) AS wa, 1 / (s2 - m2 * m2 + 1) AS wb FROM b_x JOIN vol USING (z, y, x))
SELECT z, y, x, round((a * wa + b * wb) / (wa + wb + 1e-20), 5) AS v FROM w""")
def combine_by_variance(spark, d):
    v = fx.volume(spark, d)
    return _rounded(st.combine_by_variance([v, v.withColumn("v", F.col("v") * 2 + F.col("x"))], 3, fx.shape(spark, d)), "v", digits=5)


@query(_box({"mi": "v", "mg": "(v + x)", "gg": "(v + x) * (v + x)", "ig": "v * (v + x)"}) + """
, q AS (SELECT z, y, x, v + x AS g, (ig - mi * mg) / (gg - mg * mg + 0.01::DOUBLE) AS a, mi, mg FROM b_x JOIN vol USING (z, y, x))
SELECT z, y, x, round(a * g + mi - a * mg, 4) AS q FROM q""")
def guided_filter(spark, d):
    v = fx.volume(spark, d).select("z", "y", "x", F.col("v").alias("i"), (F.col("v") + F.col("x")).alias("g"))
    return _rounded(st.guided_filter(v, 3, 0.01, fx.shape(spark, d)), "q", digits=4)


def _grad(a: str) -> str:
    rest = ", ".join(k for k in "zyx" if k != a)
    lo, hi = (f"{f}(v) OVER (PARTITION BY {rest} ORDER BY {a})" for f in ("lag", "lead"))
    return f"CASE WHEN {lo} IS NULL THEN {hi} - v WHEN {hi} IS NULL THEN v - {lo} ELSE ({hi} - {lo}) / 2 END AS g_{a}"


@query(f"SELECT z, y, x, v, {_grad('z')}, {_grad('y')}, {_grad('x')} FROM vol")
def gradient(spark, d):
    return st.gradient(fx.volume(spark, d))


@query(""", k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY frame) AS n FROM frames),
f AS (SELECT channel, frame, thr, thr AS good, n FROM k WHERE n = 1
      UNION ALL SELECT k.channel, k.frame, k.thr, CASE WHEN abs(k.thr / f.good - 1) <= 0.05::DOUBLE THEN k.thr ELSE f.good END, k.n FROM f JOIN k ON k.channel = f.channel AND k.n = f.n + 1)
SELECT channel, frame, round(thr, 6) AS thr, round(good, 6) AS used FROM f""", base=fx.SQL.replace("WITH", "WITH RECURSIVE", 1))
def carry_forward(spark, d):
    return _rounded(it.carry_forward(fx.frames(spark, d), 1.05), "thr", "used")
