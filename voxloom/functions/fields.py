"""Column functions on file names, times, sequences and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_parts(path: Column) -> dict[str, Column]:
    """folder, body, number (the digits the name ends with) and ext of a path; missing parts are empty."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return {
        "folder": F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1), "body": F.regexp_extract(stem, r"^(.*?)[0-9]*$", 1),
        "number": F.regexp_extract(stem, r"([0-9]*)$", 1), "ext": F.regexp_extract(name, r"(\.[^.]*)$", 1),
    }


def natural_order(path: Column) -> list[Column]:
    """Sort keys that put file2 before file10."""
    p = file_parts(path)
    return [p["folder"], p["body"], p["number"].try_cast("long"), path]


def relocate(path: Column, old: str, new: str) -> Column:
    """Paths below ``old`` moved below ``new``; others stay."""
    under = path.startswith(old)
    return F.when(under, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def well(path: Column) -> dict[str, Column]:
    """row (A is 0), column, site and channel of names such as x_B03_s2_w1.tif; null where absent."""
    part = lambda p, i: F.nullif(F.regexp_extract(path, p, i), F.lit(""))
    return {
        "row": F.ascii(part(r"_([A-P])(\d\d)(?=[_.])", 1)) - 65, "column": part(r"_([A-P])(\d\d)(?=[_.])", 2).cast("int"),
        "site": part(r"_s(\d+)(?=[_.])", 1).cast("int"), "channel": part(r"_w(\d+)", 1).cast("int"),
    }


def clock(seconds: Column) -> Column:
    """Struct h, m, s, ms of a duration."""
    ms = F.round(seconds * 1000).cast("long")
    return F.struct((ms / 3_600_000).cast("long").alias("h"), F.pmod((ms / 60_000).cast("long"), F.lit(60)).alias("m"), F.pmod((ms / 1000).cast("long"), F.lit(60)).alias("s"), F.pmod(ms, F.lit(1000)).alias("ms"))


def in_sequence(x: Column, start: int, stop: int, step: int = 1) -> Column:
    """Membership in start, start + step, … up to stop."""
    return x.between(start, stop) & (F.pmod(x - start, F.lit(step)) == 0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def normalized(v: Column) -> Column:
    """The vector over its length; zeros for a vector of length zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def perpendicular(point: Column, direction: Column, v: Column) -> Column:
    """The part of ``v`` - ``point`` across a unit direction."""
    d = F.zip_with(v, point, lambda x, y: x.cast("double") - y)
    along = dot(d, direction)
    return F.zip_with(d, direction, lambda x, y: x - along * y)


def multiplicity(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of the finite values."""
    x = F.col(col)
    return df.where(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))).groupBy(x.alias("value")).agg(F.count("*").alias("n"))


def palette(df: DataFrame, label: str = "label", colours: int = 16) -> DataFrame:
    """Columns red, green, blue (0..255): evenly spaced hues by label; label 0 is black."""
    h = F.pmod(F.col(label) - 1, F.lit(colours)) / colours * 6
    ramp = lambda off: F.round(255 * F.least(F.greatest(F.abs(F.pmod(h + off, F.lit(6.0)) - 3) - 1, F.lit(0.0)), F.lit(1.0))).cast("int")
    on = lambda c: F.when(F.col(label) > 0, c).otherwise(0)
    return df.withColumns({"red": on(ramp(0.0)), "green": on(ramp(4.0)), "blue": on(ramp(2.0))})


def all_in_sequence(x: Column, start: int, stop: int, step: int = 1) -> Column:
    """Aggregate: whether all values are members of start, start + step, … up to stop; true for none."""
    return F.coalesce(F.bool_and(in_sequence(x, start, stop, step)), F.lit(True))


def separator(path: Column) -> Column:
    """The separator a path uses; by its start where it has none; null where both or neither fit."""
    slash, back = F.instr(path, "/") > 0, path.contains("\\")
    alone = F.when((path == "") | (path == "~"), "/").when(path.rlike("^[A-Z]:?$"), "\\")
    return F.when(slash & back, None).when(slash, "/").when(back, "\\").otherwise(alone)


def relocation_roots(old: Column, new: Column) -> Column:
    """Struct old_root, new_root, common: two paths without the trailing components they agree in."""
    cut = lambda p: F.split(F.regexp_replace(p, r"[/\\]+$", ""), r"[/\\]", -1)
    a, b = F.reverse(cut(old)), F.reverse(cut(new))
    most = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(1), most), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.element_at(a, i) == F.element_at(b, i)), i).otherwise(n))
    root = lambda x: F.array_join(F.reverse(F.slice(x, same + 1, F.size(x))), "/")
    return F.struct(root(a).alias("old_root"), root(b).alias("new_root"), F.array_join(F.reverse(F.slice(a, F.lit(1), same)), "/").alias("common"))


def well_token(name: Column) -> Column:
    """Place from 1 of the first well token, a letter and two digits after an underscore; 0 without one."""
    at = F.regexp_instr(name, F.lit(r"_[A-Za-z][0-9]{2}[^0-9]"))
    return F.when(at > 0, at + 1).otherwise(0)


def folders_like(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Distinct folders of the paths whose own name the pattern fits."""
    folder = file_parts(F.col(path))["folder"]
    return df.select(folder.alias("folder")).where(F.regexp_extract("folder", r"([^/\\]*)$", 1).rlike(pattern)).distinct()


def elapsed(planes: DataFrame, wanted: DataFrame, keys: tuple = ("c", "t", "z"), at: str = "seconds") -> DataFrame:
    """``wanted`` planes with the seconds since the earliest plane; null for a plane that is not there."""
    first = planes.agg(F.min(at).alias("_first"))
    got = planes.crossJoin(F.broadcast(first)).select(*keys, (F.col(at) - F.col("_first")).alias("elapsed"))  # one row
    return wanted.join(got, list(keys), "left")


def colour_of(v: Column, low: float, high: float, stops: list[tuple[int, int, int]]) -> dict[str, Column]:
    """red, green, blue (0..255) of a value between evenly spaced colours from ``low`` to ``high``, clipped; null for null or NaN."""
    n = len(stops) - 1
    x = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * n
    k = F.least(F.floor(x), F.lit(n - 1)).cast("int")
    part = lambda i: F.when(v.isNotNull() & ~F.isnan(v), F.round(F.element_at(F.array(*[F.lit(float(s[i])) for s in stops]), k + 1) + (x - k) * F.element_at(F.array(*[F.lit(float(b[i] - a[i])) for a, b in zip(stops, stops[1:])]), k + 1)).cast("int"))
    return {c: part(i) for i, c in enumerate(("red", "green", "blue"))}


def one_hot(df: DataFrame, label: str, classes: list[int], value: str = "n", by: tuple = ()) -> DataFrame:
    """A row for each key with a column class_<c> for each class: the number of its rows, 0 where it has none."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(label) == c).alias(f"class_{c}") for c in classes])


def melted(df: DataFrame, classes: list[int], by: tuple = ()) -> DataFrame:
    """The rows (key, label, n) of :func:`one_hot`, classes without rows left out."""
    return df.unpivot(list(by), [f"class_{c}" for c in classes], "label", "n").where("n > 0").withColumn("label", F.substring("label", 7, 20).cast("int"))


def sampled_tracks(points: DataFrame, track: str, share: float, seed: int = 0) -> DataFrame:
    """All points of about ``share`` of the tracks, chosen by a hash of their id, so that a track is whole or absent."""
    return points.where(F.pmod(F.xxhash64(F.col(track), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def plate(df: DataFrame, name: str) -> DataFrame:
    """``df`` with row_no and col_no, counted from the plate's first row and column, site and channel of file names."""
    w = df.withColumns(well(F.col(name)))
    first = w.agg(F.min("row").alias("_r"), F.min("column").alias("_c"))
    j = w.crossJoin(F.broadcast(first))  # one row
    return j.select(*df.columns, (F.col("row") - F.col("_r")).cast("int").alias("row_no"), (F.col("column") - F.col("_c")).cast("int").alias("col_no"), "site", "channel")
