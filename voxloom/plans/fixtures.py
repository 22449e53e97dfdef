"""Synthetic volumes over the supplier and events tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: z and y of the volume; every block of 100 suppliers adds 64 to its x.
Z, Y, BLOCK = 32, 64, 64
#: Suppliers whose balls one task draws.
SEEDS = 1000

SQL = """
WITH seeds AS (SELECT CAST(s_suppkey + 1 AS INT) id, CAST(6 + (s_suppkey * 7) % 20 AS INT) cz, CAST(6 + (s_suppkey * 13) % 52 AS INT) cy,
                      CAST(6 + (s_suppkey * 29) % 52 + 64 * (s_suppkey // 100) AS INT) cx, CAST(3 + s_nationkey % 3 AS INT) r FROM supplier),
width AS (SELECT CAST(64 * (max(s_suppkey) // 100 + 1) AS INT) AS w FROM supplier),
pseeds AS (SELECT id, cz, cy, cx + (id % 3) - 1 AS cx, r - (id % 2) AS r FROM seeds WHERE id % 11 <> 10),
ax AS (SELECT CAST(i AS INT) i FROM range(-5, 6) t(i)),
ref AS (SELECT cz + a.i AS z, cy + b.i AS y, cx + c.i AS x, min(id) AS label FROM seeds, ax a, ax b, ax c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= r * r GROUP BY 1, 2, 3),
pred AS (SELECT cz + a.i AS z, cy + b.i AS y, cx + c.i AS x, min(id) AS label FROM pseeds, ax a, ax b, ax c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= r * r GROUP BY 1, 2, 3),
grid AS (SELECT CAST(a.i AS INT) z, CAST(b.i AS INT) y, CAST(c.i AS INT) x FROM range(0, 32) a(i), range(0, 64) b(i), (SELECT unnest(range(0, w)) AS i FROM width) c),
vol AS (SELECT g.z, g.y, g.x, CAST((g.z * 31 + g.y * 17 + g.x * 7) % 13 + CASE WHEN label IS NULL THEN 0 ELSE 40 + (label % 5) * 6 END AS DOUBLE) AS v
        FROM grid g LEFT JOIN ref ON ref.z = g.z AND ref.y = g.y AND ref.x = g.x),
frames AS (SELECT event_type AS channel, CAST(day(ts) AS INT) AS frame, avg(value) AS thr FROM events GROUP BY 1, 2)
"""


def _balls(s: DataFrame) -> DataFrame:
    """Voxels (z, y, x, label) of the balls of ``s``.

    The table of suppliers is a small file, so its rows are dealt over as many tasks as their balls need, and
    as Spark takes the balls for as small as the file, joins are told to sort and not to broadcast them.
    """
    axis = lambda a: F.explode(F.sequence(F.lit(-5), F.lit(5))).alias(a)
    s = s.repartition(s.count() // SEEDS + 1, "id")
    s = s.select("*", axis("i")).select("*", axis("j")).select("*", axis("k")).where("i * i + j * j + k * k <= r * r")
    return s.groupBy((F.col("cz") + F.col("i")).alias("z"), (F.col("cy") + F.col("j")).alias("y"), (F.col("cx") + F.col("k")).alias("x")).agg(F.min("id").alias("label")).hint("merge")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "cast(s_suppkey + 1 as int) id", "cast(6 + (s_suppkey * 7) % 20 as int) cz", "cast(6 + (s_suppkey * 13) % 52 as int) cy",
        "cast(6 + (s_suppkey * 29) % 52 + 64 * (s_suppkey div 100) as int) cx", "cast(3 + s_nationkey % 3 as int) r",
    )


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The volume's extent, which grows with the suppliers."""
    top = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(F.max("s_suppkey")).first()[0]
    return Z, Y, BLOCK * (int(top or 0) // 100 + 1)


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference labels: balls that overlap, the lowest id on top."""
    return _balls(_seeds(spark, sf_dir))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted labels: shifted and shrunk, some missing."""
    s = _seeds(spark, sf_dir).where("id % 11 <> 10")
    return _balls(s.selectExpr("id", "cz", "cy", "cx + (id % 3) - 1 as cx", "r - (id % 2) as r"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense intensities over the whole grid: pieces of lines, each with its labels, are joined and then spread."""
    n = shape(spark, sf_dir)[2] // BLOCK
    g = spark.range(Z * Y * n).selectExpr(f"cast(id div {Y * n} as int) z", f"cast(id div {n} % {Y} as int) y", f"cast(id % {n} as int) b")
    own = ref(spark, sf_dir).groupBy("z", "y", F.floor(F.col("x") / BLOCK).cast("int").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("x", "label"))).alias("own"))
    j = g.join(own, ["z", "y", "b"], "left").selectExpr("z", "y", f"explode(sequence(b * {BLOCK}, b * {BLOCK} + {BLOCK - 1})) x", "own").selectExpr("z", "y", "x", "try_element_at(own, x) label")
    return j.selectExpr("z", "y", "x", "cast((z * 31 + y * 17 + x * 7) % 13 + case when label is null then 0 else 40 + (label % 5) * 6 end as double) v").hint("merge")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("channel"), F.dayofmonth("ts").alias("frame")).agg(F.avg("value").alias("thr"))
