"""Points coloured from raster cells, joined on computed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_cells(points: DataFrame, cells: DataFrame, origin: tuple[float, float], step: tuple[float, float], area: bool = True) -> DataFrame:
    """points with r, g, b, a of the cell that they lie in (or, of point rasters, whose centre is nearest); null outside."""
    shift = 0.0 if area else 0.5
    at = {"col_": F.floor((F.col("x") - origin[0]) / step[0] + shift).cast("int"), "row_": F.floor((F.col("y") - origin[1]) / step[1] + shift).cast("int")}
    named = cells.select(F.col("col").alias("col_"), F.col("row").alias("row_"), *(F.col(c).alias(f"cell_{c}") for c in "rgba"))
    return points.withColumns(at).join(named, ["col_", "row_"], "left").drop("col_", "row_")


def bilinear_cells(points: DataFrame, cells: DataFrame, ids: list[str], origin: tuple[float, float], step: tuple[float, float], area: bool = True) -> DataFrame:
    """(ids, cell_r, cell_g, cell_b, cell_a): the 2 x 2 cells around a point, weighted by distance and opacity.

    A point is known by ids.  Cells that the raster lacks and transparent ones weigh nothing; without
    any other, colours are null.
    """
    shift = 0.5 if area else 0.0
    u, v = (F.col("x") - origin[0]) / step[0] - shift, (F.col("y") - origin[1]) / step[1] - shift
    at = points.select(*ids, u.alias("u"), v.alias("v")).withColumns({"fu": F.floor("u"), "fv": F.floor("v")})
    corner = F.explode(F.expr("array(struct(0 as i, 0 as j), struct(1 as i, 0 as j), struct(0 as i, 1 as j), struct(1 as i, 1 as j))")).alias("c")
    four = at.select("*", corner)
    weight = F.when(F.col("c.i") == 1, F.col("u") - F.col("fu")).otherwise(1 - F.col("u") + F.col("fu")) * F.when(F.col("c.j") == 1, F.col("v") - F.col("fv")).otherwise(1 - F.col("v") + F.col("fv"))
    four = four.select(*ids, (F.col("fu") + F.col("c.i")).cast("int").alias("col"), (F.col("fv") + F.col("c.j")).cast("int").alias("row"), weight.alias("w"))
    met = four.join(cells, ["col", "row"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    wa = F.sum(F.col("w") * F.col("a"))
    colours = [F.floor(F.try_divide(F.sum(F.col("w") * F.col("a") * F.coalesce(c, F.lit(0))), wa) + 0.5).cast("int").alias(f"cell_{c}") for c in "rgb"]
    return met.groupBy(*ids).agg(*colours, F.floor(wa + 0.5).cast("int").alias("cell_a"))


def coloured(points: DataFrame, min_alpha: int = 1, drop_missing: bool = False) -> DataFrame:
    """Take the cell colours of points that have one opaque enough; the others keep theirs or go."""
    ok = F.coalesce(F.col("cell_a") >= min_alpha, F.lit(False))
    out = points.filter(ok) if drop_missing else points
    return out.withColumns({c: F.when(ok, F.col(f"cell_{c}").cast("short")).otherwise(F.col(c).cast("short")) for c in "rgb"}).drop(*(f"cell_{c}" for c in "rgba"))
