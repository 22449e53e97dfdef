"""Further queries: fields, thresholds, slices, flows and the aggregation pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import fields as fd
from .operators import flows as fl
from .operators import labels as lb
from .operators import matching as mc
from .operators import mesh as ms
from .operators import slices as sl
from .operators import smooth as sm
from .operators import thresholds as th
from .plans import fixtures as fx
from .plans import pipelines as pl
from .operators import planes as pn
from .operators import refine as rf
from .plans.params import Aggregation, Binary, CombineProbs, Descent, Indirect, Postprocess, Preprocess
from .queries import _REC, _cc, _rounded, query

_FLOW = """, flow AS (SELECT ref.z, ref.y, ref.x, ref.label, CAST(cz - ref.z AS DOUBLE) / n AS dz, CAST(cy - ref.y AS DOUBLE) / n AS dy, CAST(cx - ref.x AS DOUBLE) / n AS dx
FROM (SELECT ref.*, cz, cy, cx, sqrt(greatest(1, (cz - ref.z) * (cz - ref.z) + (cy - ref.y) * (cy - ref.y) + (cx - ref.x) * (cx - ref.x))) AS n FROM ref JOIN seeds ON seeds.id = ref.label) ref)
"""


def _flow(spark, d):
    """Unit vectors from each voxel of the reference to its object's centre."""
    s = fx._seeds(spark, d).select(F.col("id").alias("label"), "cz", "cy", "cx")
    j = fx.ref(spark, d).join(s, "label")
    gap = {a: (F.col(f"c{a}") - F.col(a)) for a in "zyx"}
    n = F.sqrt(F.greatest(F.lit(1), sum(g * g for g in gap.values())))
    return j.select("z", "y", "x", "label", *[(g.cast("double") / n).alias(f"d{a}") for a, g in gap.items()]).hint("merge")


def _xy(spark, d):
    return fx.ref(spark, d).select(F.col("z").alias("slice"), F.col("y").alias("r"), F.col("x").alias("c"), "label")


@query("""SELECT page_id, regexp_extract(u, '^(.*)[/\\\\][^/\\\\]*$', 1) AS folder, regexp_extract(regexp_replace(regexp_extract(u, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '^(.*?)[0-9]*$', 1) AS body,
regexp_extract(regexp_replace(regexp_extract(u, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '([0-9]*)$', 1) AS number, regexp_extract(regexp_extract(u, '([^/\\\\]*)$', 1), '(\\.[^.]*)$', 1) AS ext
FROM (SELECT page_id, url AS u FROM pages)""", base="")  # fmt: skip
def file_parts(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", *[c.alias(n) for n, c in fd.file_parts(F.col("url")).items()])


@query("SELECT event_id, ms // 3600000 AS h, (ms // 60000) % 60 AS m, (ms // 1000) % 60 AS s, ms % 1000 AS ms FROM (SELECT event_id, CAST(event_id AS BIGINT) * 1234567 AS ms FROM events)", base="")
def clock(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", fd.clock(F.col("event_id").cast("double") * 1234.567).alias("t")).select("event_id", "t.*")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings", base="")
def vector_norms(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(fd.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1", base="")
def multiplicity(spark, d):
    return fd.multiplicity(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem), m AS (SELECT median(v) AS m FROM l), r AS (SELECT l.*, pow(v - m, 2) AS r FROM l, m)
SELECT l_orderkey, l_linenumber, v FROM r WHERE r > (SELECT median(r) FROM r) * pow(1.4826::DOUBLE, 2) * 1.44""", base="")  # fmt: skip
def robust_outliers(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    return th.robust_outliers(l, "v", 1.2)


@query("""WITH v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem),
q AS (SELECT min(v) AS lo, 2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) * pow(count(*), -1.0::DOUBLE / 3) AS w FROM v)
SELECT CAST(floor((v - lo) / w) AS BIGINT) AS bin, count(*) AS n FROM v, q GROUP BY 1""", base="")  # fmt: skip
def optimal_histogram(spark, d):
    return th.optimal_histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice")


@query(""", f AS (SELECT v FROM vol WHERE v <> 0), m AS (SELECT min(v) AS lo, (max(v) - min(v)) / 256 AS w FROM f),
h AS (SELECT CAST(least(floor((v - lo) / w), 255) AS INT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM f, m GROUP BY 1), c AS (SELECT bin, n, lo + (bin + 0.5::DOUBLE) * w AS centre FROM h),
p AS (SELECT bin AS pb, n AS pn FROM c ORDER BY n DESC, bin LIMIT 1), e AS (SELECT bin AS eb, n AS en FROM c ORDER BY bin DESC LIMIT 1),
d AS (SELECT centre, bin, (eb - pb) / 256 AS dx, (en - pn) / pn AS dy, (bin - pb) / 256 AS ax, (n - pn) / pn AS ay FROM c, p, e WHERE bin >= pb)
SELECT centre AS threshold FROM d ORDER BY round((dy * ax - dx * ay) / sqrt(dx * dx + dy * dy + 1e-300), 9) DESC, bin LIMIT 1""")  # fmt: skip
def rosin_threshold(spark, d):
    return th.rosin(fx.volume(spark, d))


@query(""", m AS (SELECT min(v) AS lo, (max(v) - min(v)) / 64 AS w FROM vol), h AS (SELECT CAST(least(floor((v - lo) / w), 63) AS INT) AS bin, count(*) AS n FROM vol, m GROUP BY 1),
b AS (SELECT bin, lo + (bin + 0.5::DOUBLE) * w AS centre, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 64)) AS bin) LEFT JOIN h USING (bin), m),
s AS (SELECT bin, centre, avg(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM b),
e AS (SELECT *, coalesce(lag(n) OVER (ORDER BY bin), 0) AS lo, coalesce(lead(n) OVER (ORDER BY bin), 0) AS hi FROM s), t AS (SELECT min(bin) AS t FROM e WHERE n > lo AND n >= hi)
SELECT min_by(centre, bin) AS threshold FROM e, t WHERE bin > t AND n <= lo AND n < hi""")  # fmt: skip
def first_minimum_threshold(spark, d):
    return th.first_minimum(fx.volume(spark, d))


@query("SELECT z - 4 AS z, y - 8 AS y, x - 8 AS x, label FROM ref WHERE z >= 4 AND z < 28 AND y >= 8 AND y < 40 AND x >= 8 AND x < 50")
def crop(spark, d):
    return th.crop(fx.ref(spark, d), {"z": 4, "y": 8, "x": 8}, {"z": 28, "y": 40, "x": 50})


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer", base="")
def set_union(spark, d):
    a, b = (spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("k")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey")))
    return a.union(b).distinct()


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT s_suppkey FROM supplier", base="")
def set_minus(spark, d):
    a, b = (spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("k")) for t, c in (("part", "p_partkey"), ("supplier", "s_suppkey")))
    return a.subtract(b)


@query("SELECT z AS slice, y AS r, x AS c, CAST(dense_rank() OVER (ORDER BY z, label) AS INT) AS label FROM ref")
def unique_slice_labels(spark, d):
    return sl.unique_slices(_xy(spark, d))


@query(""", t AS (SELECT z, CAST(max(label) AS BIGINT) AS top, row_number() OVER (ORDER BY z) AS k FROM ref GROUP BY z),
o AS (SELECT z, k, 0::HUGEINT AS off, top FROM t WHERE k = 1 UNION ALL SELECT t.z, t.k, o.off + o.off + o.top, t.top FROM o JOIN t ON t.k = o.k + 1)
SELECT z AS slice, y AS r, x AS c, CAST(label + off AS BIGINT) AS label FROM ref JOIN o USING (z)""", base=fx.SQL.replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def relabel_slices(spark, d):
    return sl.relabel_slices(_xy(spark, d))


_PIECE = _cc("ref", 2, "label", axes="yx")


@query(_PIECE + ", o AS (SELECT same, z, root, row_number() OVER (ORDER BY z, root) AS n FROM comp GROUP BY same, z, root) SELECT z AS slice, y AS r, x AS c, n AS label FROM comp JOIN o USING (same, z, root)", base=_REC)
def component_slices(spark, d):
    return sl.component_slices(_xy(spark, d))


@query(_PIECE + ", o AS (SELECT same, z, root, row_number() OVER (PARTITION BY z ORDER BY same, root) AS n FROM comp GROUP BY same, z, root HAVING count(*) > 10) SELECT z AS slice, y AS r, x AS c, n AS label FROM comp JOIN o USING (same, z, root)", base=_REC)
def filter_slice_labels(spark, d):
    return sl.filter_slice_labels(_xy(spark, d), 10)


_BESIDE = """, off AS (SELECT unnest([-2, -1, 0, 1]) AS o),
own AS (SELECT z, y, x, label, o, CASE WHEN z + o < 0 THEN -(z + o) WHEN z + o >= 32 THEN 62 - (z + o) ELSE z + o END AS at FROM ref, off),
shared AS (SELECT own.z, own.label, own.at, own.o, r.label AS other, count(*) AS n FROM own JOIN ref r ON r.z = own.at AND r.y = own.y AND r.x = own.x GROUP BY ALL)
"""


@query(_BESIDE + """, hit AS (SELECT DISTINCT z, label, o FROM shared), g AS (SELECT *, o - row_number() OVER (PARTITION BY z, label ORDER BY o) AS g FROM hit),
runs AS (SELECT z, label, count(*) AS len, min(o) AS lo, max(o) AS hi FROM g GROUP BY z, label, g.g), best AS (SELECT *, row_number() OVER (PARTITION BY z, label ORDER BY len DESC, lo) AS k FROM runs)
SELECT ref.z AS slice, y AS r, x AS c, ref.label FROM ref JOIN best b ON b.z = ref.z AND b.label = ref.label WHERE k = 1 AND len >= 3 AND lo <= 0 AND hi >= -1""")  # fmt: skip
def persistent_slices(spark, d):
    return sl.persistent_slices(_xy(spark, d), fx.Z, 5)


@query(_BESIDE + """, a AS (SELECT z, label, count(*) AS a FROM ref GROUP BY ALL),
j AS (SELECT s.*, a.a AS b, row_number() OVER (PARTITION BY s.z, s.label, s.o ORDER BY a.a DESC, other) AS k FROM shared s JOIN a ON a.z = s.at AND a.label = s.other),
i AS (SELECT j.z, j.label, j.n / (a.a + j.b - j.n) AS iou FROM j JOIN a ON a.z = j.z AND a.label = j.label WHERE k = 1),
v AS (SELECT z, label, sqrt(greatest(sum(iou * iou) / 4 - pow(sum(iou) / 4, 2), 0)) AS sd FROM i GROUP BY ALL)
SELECT ref.z AS slice, y AS r, x AS c, ref.label FROM ref LEFT JOIN v ON v.z = ref.z AND v.label = ref.label WHERE NOT coalesce(sd > 0.3::DOUBLE, false)""")  # fmt: skip
def stable_slices(spark, d):
    return sl.stable_slices(_xy(spark, d), fx.Z, 5, 0.3)


@query(_FLOW + "SELECT label, round(avg(dz * dz + dy * dy + (dx - 1) * (dx - 1)), 6) AS error FROM flow GROUP BY label")
def flow_errors(spark, d):
    f = _flow(spark, d)
    other = f.select("z", "y", "x", F.lit(0.0).alias("dz"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dx"))
    return _rounded(fl.flow_errors(f.select("z", "y", "x", "label"), f, other), "error")


@query(_FLOW + "SELECT z, y, x, label FROM ref WHERE label IN (SELECT label FROM flow GROUP BY label HAVING round(avg(dz * dz + dy * dy + (dx - 1) * (dx - 1)), 9) <= 2.0::DOUBLE)")
def remove_bad_flows(spark, d):
    f = _flow(spark, d)
    other = f.select("z", "y", "x", F.lit(0.0).alias("dz"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dx"))
    return fl.remove_bad_flows(f.select("z", "y", "x", "label"), f, other, 2.0)


def _smooth(sigma: float) -> str:
    """CTEs g_z, g_y, g_x: Gaussian means along one axis after the other over rows mirrored at both ends."""
    r, last, out = int(4 * sigma + 0.5), "vol", f", wt AS (SELECT o, w / sum(w) OVER () AS w FROM (SELECT o, exp(-0.5::DOUBLE * o * o / {sigma * sigma}::DOUBLE) AS w FROM (SELECT unnest(range(-{int(4 * sigma + 0.5)}, {int(4 * sigma + 0.5) + 1})) AS o)))"
    for a, n in (("z", "32"), ("y", "64"), ("x", "(SELECT w FROM width)")):
        rest = ", ".join(k for k in "zyx" if k != a)
        out += f""", e_{a} AS (SELECT {rest}, {a} AS i_, v FROM {last} UNION ALL SELECT {rest}, -1 - {a}, v FROM {last} WHERE {a} < {r} UNION ALL SELECT {rest}, 2 * {n} - 1 - {a}, v FROM {last} WHERE {a} >= {n} - {r}),
g_{a} AS (SELECT {rest}, CAST(i_ + o AS INT) AS {a}, sum(v * wt.w) AS v FROM e_{a}, wt WHERE i_ + o >= 0 AND i_ + o < {n} GROUP BY {rest}, i_ + o)"""
        last = f"g_{a}"
    return out


@query(_smooth(1.0) + " SELECT z, y, x, round(v, 6) AS v FROM g_x")
def gaussian(spark, d):
    return _rounded(sm.gaussian(fx.volume(spark, d), ["v"], 1.0, fx.shape(spark, d)), "v")


@query()
def slice_flows(spark, d):
    return _rounded(fl.slice_flows(fl.slices(fx.ref(spark, d)), fx.shape(spark, d), "edt"), "dist", "d_row", "d_col")


@query()
def advect_cluster(spark, d):
    f = _flow(spark, d)
    return fl.vote_clusters(fl.advect(f.select("z", "y", "x"), f, fx.shape(spark, d), n_iter=50), fx.shape(spark, d))


@query()
def aggregate_indirect(spark, d):
    p = Aggregation(binary=Binary(remove_small=20), descent=Descent(n_iter=100), indirect=Indirect(method="edt"))
    return pl.aggregate_indirect(fl.slices(fx.ref(spark, d)), fx.shape(spark, d), p)


@query()
def true_positives(spark, d):
    return mc.true_positives(fx.ref(spark, d), fx.pred(spark, d), (0.1, 0.3, 0.5))


@query()
def aggregated_jaccard(spark, d):
    return _rounded(mc.aggregated_jaccard(fx.ref(spark, d), fx.pred(spark, d)), "aji")


@query()
def match_statistics(spark, d):
    return _rounded(mc.match_statistics(fx.ref(spark, d), fx.pred(spark, d)), "pre", "rec", "f1", "iou", "dice")


@query()
def mesh_properties(spark, d):
    m = ms.mesh_of_mask(fx.ref(spark, d).select("z", "y", "x"), fx.shape(spark, d))
    return _rounded(ms.mesh_properties(*m), "volume", "area", digits=4)


@query()
def aggregate_direct(spark, d):
    """Three views of the same probabilities and flows of the reference labels."""
    shape, ref = fx.shape(spark, d), fx.ref(spark, d)
    v = fx.volume(spark, d).withColumn("v", F.when(F.col("v") >= 40, 4.0).otherwise(-4.0))
    rows = fl.slices(ref)
    p = Aggregation(probs=CombineProbs(prob_thresh=0.5, logits=True), binary=Binary(remove_small=20), descent=Descent(n_iter=50))
    return pl.aggregate_direct({k: v for k in fl.VIEWS}, fl.slice_flows(rows, shape, "edt"), shape, p)


@query()
def preprocess(spark, d):
    return _rounded(pl.preprocess(fx.volume(spark, d), fx.shape(spark, d), Preprocess(factor=0.5))[0], "v")


@query()
def postprocess(spark, d):
    return pl.postprocess(fx.ref(spark, d), fx.shape(spark, d), None, Postprocess(min_size=20))


@query()
def diffuse_objects(spark, d):
    return rf.diffuse_objects(fx.ref(spark, d), fx.volume(spark, d), fx.shape(spark, d), pad=3, iters=10)


@query()
def guide_objects(spark, d):
    return rf.guide_objects(fx.ref(spark, d), fx.volume(spark, d), fx.shape(spark, d), pad=3, radius=5)


@query(_cc("pred", 3, "label") + """, s AS (SELECT same, root, row_number() OVER (ORDER BY same, root) AS k, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx FROM comp GROUP BY same, root HAVING count(*) >= 10),
n AS (SELECT same, root, CAST(row_number() OVER (ORDER BY cz, cy, cx, k) AS INT) AS label FROM s) SELECT z, y, x, n.label FROM comp JOIN n USING (same, root)""", base=_REC)
def relabel_truth(spark, d):
    return lb.relabel_truth(fx.pred(spark, d), 10)


@query()
def expand_labels(spark, d):
    return lb.expand_labels(fx.pred(spark, d), fx.ref(spark, d))


@query()
def advect_tiles(spark, d):
    f = _flow(spark, d)
    return fl.vote_clusters(fl.advect(f.select("z", "y", "x"), f, fx.shape(spark, d), tile=(32, 64, 64), n_iter=50), fx.shape(spark, d))


@query()
def median_filter(spark, d):
    return sm.median_filter(fx.volume(spark, d), 3, fx.shape(spark, d))


@query()
def ridge_filter(spark, d):
    return _rounded(sl.ridge_filter(fx.volume(spark, d), (2,)), "v")


@query()
def anisotropic_diffusion(spark, d):
    return _rounded(sl.anisotropic_diffusion(fx.volume(spark, d), 2), "v")


@query()
def local_equalize(spark, d):
    return _rounded(sl.local_equalize(fx.volume(spark, d), (32, 32)), "v")


@query("SELECT z, round(avg(v), 6) AS score FROM vol GROUP BY z")
def slice_contrast(spark, d):
    return _rounded(pn.slice_contrast(fx.volume(spark, d)), "score")


@query()
def watershed_planes(spark, d):
    shape, own = fx.shape(spark, d), _xy(spark, d)
    flow = fl.slice_flows(fl.slices(fx.ref(spark, d), ("xy",)), shape, "edt")
    return pn.cluster_planes(pn.advect_planes(own.select("slice", "r", "c"), flow, shape[1:], n_iter=50), shape[1:])
