"""Queries of lookups, names, sequences, colours, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import fields as fd
from .functions import optics as op
from .operators import labels as lb
from .operators import thresholds as th
from .plans import fixtures as fx
from .queries import _rounded, query

_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_IDS = (10002, 10612, 10005, 12005, 7)
_STOPS = [(0, 0, 128), (0, 255, 255), (255, 255, 0), (128, 0, 0)]


@query(f"""WITH l(lens_id, na, magnification) AS (VALUES {_values(op.LENSES)})
SELECT s_suppkey, l.na::DOUBLE AS na, CAST(l.magnification AS INT) AS magnification FROM supplier LEFT JOIN l ON l.lens_id = list_extract({list(_IDS)}, CAST(s_suppkey % 5 + 1 AS INT))""", base="")  # fmt: skip
def lens_lookup(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.element_at(F.array(*map(F.lit, _IDS)), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("lens"))
    return op.with_lens(s, "lens").select("s_suppkey", "na", "magnification")


_NAMES = ["GFP", "mCherry", "dapi", "none", "Cy5"]


@query(f"""WITH f(name, nm) AS (VALUES {_values(op.FLUOROPHORES)})
SELECT p_partkey, CAST(nm AS INT) AS nm FROM part LEFT JOIN f ON f.name = lower(list_extract({_NAMES}, CAST(p_partkey % 5 + 1 AS INT)))""", base="")  # fmt: skip
def emission_lookup(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"))
    return op.with_emission(p, "name").select("p_partkey", "nm")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, 370 + CAST(l_quantity AS DOUBLE) * 8.3::DOUBLE AS nm FROM lineitem),
c AS (SELECT *, 0.8::DOUBLE * CASE WHEN nm > 700 THEN 0.3::DOUBLE + 0.7::DOUBLE * (780 - nm) / 80 WHEN nm < 420 THEN 0.3::DOUBLE + 0.7::DOUBLE * (nm - 380) / 40 ELSE 1 END AS k FROM w)
SELECT l_orderkey, l_linenumber,
round(k * CASE WHEN nm < 380 THEN NULL WHEN nm < 440 THEN (440 - nm) / 60 WHEN nm < 510 THEN 0 WHEN nm < 580 THEN (nm - 510) / 70 WHEN nm <= 780 THEN 1 END, 6) + 0.0 AS red,
round(k * CASE WHEN nm < 380 THEN NULL WHEN nm < 440 THEN 0 WHEN nm < 490 THEN (nm - 440) / 50 WHEN nm < 580 THEN 1 WHEN nm < 645 THEN (645 - nm) / 65 WHEN nm <= 780 THEN 0 END, 6) + 0.0 AS green,
round(k * CASE WHEN nm < 380 THEN NULL WHEN nm < 490 THEN 1 WHEN nm < 510 THEN (510 - nm) / 20 WHEN nm <= 780 THEN 0 END, 6) + 0.0 AS blue FROM c""", base="")  # fmt: skip
def wavelength_colours(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.lit(370) + F.col("l_quantity").cast("double") * 8.3).alias("nm"))
    return l.select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in op.spectral_colour(F.col("nm")).items()])


@query("SELECT l_orderkey, bool_and(l_linenumber BETWEEN 1 AND 7 AND (l_linenumber - 1) % 2 = 0) AS ok FROM lineitem GROUP BY 1", base="")
def all_in_sequence(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(fd.all_in_sequence(F.col("l_linenumber"), 1, 7, 2).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 2 AND 40 AND (CAST(l_quantity AS INT) - 2) % 3 = 0 AS ok FROM lineitem", base="")
def in_sequence(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", fd.in_sequence(F.col("l_quantity").cast("int"), 2, 40, 3).alias("ok"))


@query("""SELECT page_id, CASE WHEN contains(u, '/') AND contains(u, chr(92)) THEN NULL WHEN contains(u, '/') THEN '/' WHEN contains(u, chr(92)) THEN chr(92) WHEN u IN ('', '~') THEN '/' WHEN regexp_full_match(u, '[A-Z]:?') THEN chr(92) END AS sep
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, '/', chr(92)) WHEN 2 THEN url || chr(92) ELSE 'C:' END AS u FROM pages)""", base="")  # fmt: skip
def path_separator(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    u = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.translate("url", "/", "\\")).when(F.col("page_id") % 4 == 2, F.concat("url", F.lit("\\"))).otherwise(F.lit("C:"))
    return p.select("page_id", fd.separator(u).alias("sep"))


@query("""WITH p AS (SELECT page_id, list_reverse(string_split(rtrim(url, '/'), '/')) AS a, list_reverse(string_split(rtrim(regexp_replace(url, '^[a-z]+://[^/]*', '/data'), '/'), '/')) AS b FROM pages WHERE url IS NOT NULL),
k AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS n FROM p)
SELECT page_id, array_to_string(list_reverse(a[n + 1:]), '/') AS old_root, array_to_string(list_reverse(b[n + 1:]), '/') AS new_root, array_to_string(list_reverse(a[:n]), '/') AS common FROM k""", base="")  # fmt: skip
def relocation_roots(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").where("url is not null")
    return p.select("page_id", fd.relocation_roots(F.col("url"), F.regexp_replace("url", "^[a-z]+://[^/]*", "/data")).alias("r")).select("page_id", "r.*")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'file:/mnt/' || substr(url, 9) ELSE url END AS path FROM pages", base="")
def relocate_paths(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fd.relocate(F.col("url"), "https://", "file:/mnt/").alias("path"))


_PLATE = "CASE WHEN p_partkey % 7 = 0 THEN 'plate' ELSE 'plate_x' || (p_partkey % 3) || '_' || chr(CAST(65 + p_partkey % 16 AS INT)) || lpad(CAST(1 + p_partkey % 24 AS VARCHAR), 2, '0') || '_s' || (1 + p_partkey % 4) || '_w' || (1 + p_partkey % 3) || '.TIF' END"


def _plate_names(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", F.expr(_PLATE.replace("chr(CAST(65 + p_partkey % 16 AS INT))", "char(65 + p_partkey % 16)").replace("VARCHAR", "STRING")).alias("name"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(name, '_[A-Za-z][0-9][0-9][^0-9]') THEN length(regexp_extract(name, '^(.*?)_[A-Za-z][0-9][0-9][^0-9]', 1)) + 2 ELSE 0 END AS place FROM (SELECT p_partkey, {_PLATE} AS name FROM part)", base="")
def well_tokens(spark, d):
    return _plate_names(spark, d).select("p_partkey", fd.well_token(F.col("name")).cast("long").alias("place"))


@query(f"""WITH w AS (SELECT p_partkey, {_PLATE} AS name FROM part), k AS (SELECT p_partkey, ascii(nullif(regexp_extract(name, '_([A-P])[0-9][0-9][_.]', 1), '')) - 65 AS r, TRY_CAST(regexp_extract(name, '_[A-P]([0-9][0-9])[_.]', 1) AS INT) AS c,
TRY_CAST(regexp_extract(name, '_s([0-9]+)[_.]', 1) AS INT) AS site, TRY_CAST(regexp_extract(name, '_w([0-9]+)', 1) AS INT) AS channel FROM w), o AS (SELECT min(r) AS r0, min(c) AS c0 FROM k)
SELECT p_partkey, CAST(r - r0 AS INT) AS row_no, CAST(c - c0 AS INT) AS col_no, site, channel FROM k, o""", base="")  # fmt: skip
def plate_cells(spark, d):
    return fd.plate(_plate_names(spark, d), "name").drop("name")


@query("SELECT DISTINCT f AS folder FROM (SELECT regexp_extract(url, '^(.*)[/\\\\][^/\\\\]*$', 1) AS f FROM pages) WHERE regexp_matches(regexp_extract(f, '([^/\\\\]*)$', 1), '^[a-z]+$')", base="")
def folders_like(spark, d):
    return fd.folders_like(spark.read.parquet(f"{d}/pages.parquet"), "url", "^[a-z]+$")


@query("""WITH p AS (SELECT l_linenumber AS c, l_orderkey AS t, min(epoch(l_shipdate)) AS s FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS t, CAST(s - (SELECT min(s) FROM p) AS DOUBLE) AS elapsed FROM orders LEFT JOIN p ON p.c = 1 AND p.t = o_orderkey""", base="")  # fmt: skip
def plane_times(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("c"), F.col("l_orderkey").alias("t")).agg(F.min(F.unix_timestamp("l_shipdate")).alias("seconds"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("t"), F.lit(1).alias("c"))
    return fd.elapsed(l, o, ("c", "t")).select("t", F.col("elapsed").cast("double").alias("elapsed"))


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, least(greatest((CAST(l_extendedprice AS DOUBLE) - 1000) / 49000, 0), 1) * 3 AS x FROM lineitem),
k AS (SELECT *, CAST(least(floor(x), 2) AS INT) AS k FROM v), s AS (SELECT {[list(x) for x in _STOPS]} AS s)
SELECT l_orderkey, l_linenumber, {', '.join(f"CAST(round(s[k + 1][{i + 1}] + (x - k) * (s[k + 2][{i + 1}] - s[k + 1][{i + 1}])) AS INT) AS {c}" for i, c in enumerate(("red", "green", "blue")))} FROM k, s""", base="")  # fmt: skip
def value_colours(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    return l.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in fd.colour_of(F.col("l_extendedprice").cast("double"), 1000.0, 50000.0, _STOPS).items()])


@query("SELECT z, y, x, label, " + ", ".join(f"CAST(round(255 * least(greatest(abs(((label - 1) % 16) / 16 * 6 + {o} - 6 * floor((((label - 1) % 16) / 16 * 6 + {o}) / 6) - 3) - 1, 0), 1)) AS INT) AS {c}" for c, o in (("red", 0), ("green", 4), ("blue", 2))) + " FROM ref")
def label_colours(spark, d):
    return fd.palette(fx.ref(spark, d))


@query("SELECT l_returnflag, " + ", ".join(f"count(*) FILTER (l_linenumber = {c}) AS class_{c}" for c in range(1, 8)) + " FROM lineitem GROUP BY 1", base="")
def class_one_hot(spark, d):
    return fd.one_hot(spark.read.parquet(f"{d}/lineitem.parquet"), "l_linenumber", list(range(1, 8)), by=("l_returnflag",))


@query("SELECT l_returnflag, CAST(l_linenumber AS INT) AS label, count(*) AS n FROM lineitem GROUP BY 1, 2", base="")
def class_rows(spark, d):
    return fd.melted(class_one_hot(spark, d), list(range(1, 8)), ("l_returnflag",))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer", base="")
def set_intersect(spark, d):
    a, b = (spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("k")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey")))
    return a.intersect(b)


@query()
def track_sample(spark, d):
    return fd.sampled_tracks(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts"), "user_id", 0.1)


@query("SELECT vec_id, list_transform(list_zip(embedding, range(0, len(embedding))), lambda p: round(CASE WHEN p[2] = 0 THEN 0 ELSE CAST(p[1] AS DOUBLE) - 1 END, 6)) AS v FROM embeddings", base="")
def across_direction(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    ones = F.transform("embedding", lambda x: F.lit(1.0))
    axis = F.transform("embedding", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return e.select("vec_id", F.transform(fd.perpendicular(ones, axis, F.col("embedding")), lambda x: F.round(x, 6)).alias("v"))


@query(""", m AS (SELECT label, avg(v) AS m FROM ref JOIN vol USING (z, y, x) GROUP BY 1), e AS (SELECT min(m) AS lo, (max(m) - min(m)) / 256 AS w FROM m),
h AS (SELECT CAST(least(floor((m - lo) / w), 255) AS INT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM m, e GROUP BY 1), hist AS (SELECT bin, n, lo + (bin + 0.5::DOUBLE) * w AS centre FROM h),
c AS (SELECT centre, sum(n) OVER o AS w0, sum(n * centre) OVER o AS s0, sum(n) OVER () AS w, sum(n * centre) OVER () AS s FROM hist WINDOW o AS (ORDER BY bin)),
b AS (SELECT centre, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS var FROM c WHERE w > w0), t AS (SELECT centre AS t FROM b ORDER BY var DESC, centre LIMIT 1)
SELECT z, y, x, label FROM ref WHERE label IN (SELECT label FROM m, t WHERE m.m >= t.t)""")  # fmt: skip
def intensity_filter_otsu(spark, d):
    return lb.intensity_filter(fx.ref(spark, d), fx.volume(spark, d), "otsu")


@query(""", n AS (SELECT z, count(*) AS n, avg(v) AS a, min(v) AS lo FROM vol GROUP BY z) SELECT z AS frame, round(a, 6) AS mean, n, lo FROM n""")
def frame_statistics(spark, d):
    return _rounded(th.frame_statistics(fx.volume(spark, d).withColumnRenamed("z", "frame")), "mean")


@query(""", f AS (SELECT z AS frame, v FROM vol WHERE v > 0), e AS (SELECT frame, min(v) AS lo, (max(v) - min(v)) / 64 AS w FROM f GROUP BY frame),
h AS (SELECT frame, CAST(least(floor((v - lo) / w), 63) AS INT) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w FROM f JOIN e USING (frame) GROUP BY 1, 2), hist AS (SELECT frame, bin, n, lo + (bin + 0.5::DOUBLE) * w AS centre FROM h),
c AS (SELECT frame, centre, sum(n) OVER o AS w0, sum(n * centre) OVER o AS s0, sum(n) OVER t AS w, sum(n * centre) OVER t AS s FROM hist WINDOW o AS (PARTITION BY frame ORDER BY bin), t AS (PARTITION BY frame)),
b AS (SELECT frame, centre, round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS var FROM c WHERE w > w0),
t AS (SELECT frame, greatest(centre, 0) AS thr FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY var DESC, centre) AS k FROM b) WHERE k = 1)
SELECT frame, round(thr, 6) AS thr, count(*) FILTER (v > thr) AS n FROM vol JOIN t ON t.frame = z GROUP BY frame, thr""")  # fmt: skip
def frame_masks(spark, d):
    v = fx.volume(spark, d).withColumnRenamed("z", "frame")
    t = th.frame_thresholds(v, bins=64, exclude_zero=True)
    return _rounded(th.frame_masks(v, t).groupBy("frame", "thr").agg(F.count_if("on").alias("n")), "thr")


@query()
def binned_gradient_threshold(spark, d):
    return _rounded(th.binned_gradient(fx.volume(spark, d), fx.shape(spark, d), 4.0, smooth=0.5), "threshold")
