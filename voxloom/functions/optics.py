"""Lookups of lenses and fluorophores, and colours of wavelengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lens id, numerical aperture, magnification; of rows of one id the last counts.
LENSES = [
    (10002, 1.40, 100), (10006, 1.40, 100), (10612, 1.42, 60), (12003, 1.40, 100), (0, 1.40, None), (10005, 1.35, None), (10105, 1.40, None),
    (10403, 1.35, None), (10003, 1.35, None), (12005, None, None), (10007, 1.40, 100), (99999, 1.4, 100), (10211, 1.40, 100), (10602, 1.40, 60),
]
# Fluorophore, emission wavelength in nm.
FLUOROPHORES = [
    ("bfp", 440), ("ebfp", 440), ("cfp", 475), ("egfp", 507), ("gfp", 509), ("alexa488", 519), ("yfp", 527), ("alexa555", 565), ("dtomato", 581),
    ("tdtomato", 581), ("dsred", 583), ("tagrfp", 584), ("alexa568", 603), ("rfp", 607), ("mrfp", 607), ("mcherry", 610), ("texasred", 615),
    ("alexa647", 665), ("cy3", 570), ("cy5", 670), ("alexa594", 617), ("dapi", 470), ("fluosphere605", 605), ("meos", 563), ("turborfp", 574),
    ("mruby2", 600), ("tmr", 578), ("mneongreen", 517), ("cyofp", 589),
]
# From nm, to nm, and (value at from, value at to) of red, green and blue between them.
SPECTRUM = [
    (380, 440, (1, 0), (0, 0), (1, 1)), (440, 490, (0, 0), (0, 1), (1, 1)), (490, 510, (0, 0), (1, 1), (1, 0)),
    (510, 580, (0, 1), (1, 1), (0, 0)), (580, 645, (1, 1), (1, 0), (0, 0)), (645, 781, (1, 1), (0, 0), (0, 0)),
]
GAMMA = 0.8


def lenses(spark: SparkSession) -> DataFrame:
    """(lens_id, na, magnification)."""
    return spark.createDataFrame(list({r[0]: r for r in LENSES}.values()), "lens_id int, na double, magnification int")


def fluorophores(spark: SparkSession) -> DataFrame:
    """(fluorophore, nm) by wavelength."""
    return spark.createDataFrame(sorted(FLUOROPHORES, key=lambda r: r[1]), "fluorophore string, nm int")


def with_lens(df: DataFrame, lens_id: str) -> DataFrame:
    """``df`` with na and magnification; null for an unknown lens."""
    own = lenses(df.sparkSession).withColumnRenamed("lens_id", lens_id)
    return df.join(F.broadcast(own), lens_id, "left")  # a row for each lens of the table above


def with_emission(df: DataFrame, name: str) -> DataFrame:
    """``df`` with nm, the emission wavelength by name in any case; null for an unknown one."""
    own = fluorophores(df.sparkSession).withColumnRenamed("fluorophore", "_f")
    return df.join(F.broadcast(own), F.lower(name) == F.col("_f"), "left").drop("_f")  # a row for each fluorophore of the table above


def spectral_colour(nm: Column) -> dict[str, Column]:
    """red, green and blue (0..1) of a wavelength in nm, dimmed towards both ends of 380 to 780; null outside."""
    dim = F.when(nm > 700, 0.3 + 0.7 * (780 - nm) / 80).when(nm < 420, 0.3 + 0.7 * (nm - 380) / 40).otherwise(1.0)

    def part(i: int) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for low, high, *ramps in SPECTRUM:
            a, b = ramps[i]
            out = out.when((nm >= low) & (nm < high) & (nm <= 780), F.lit(float(a)) + (b - a) * (nm - low) / (high - low))
        return out * dim * GAMMA

    return {c: part(i) for i, c in enumerate(("red", "green", "blue"))}
