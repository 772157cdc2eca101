"""Global and per-tile statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def bounds_columns(axes: tuple[str, ...] = AXES) -> list[Column]:
    return [f(a).alias(f"{a}{n}") for a in axes for f, n in ((F.min, "min"), (F.max, "max"))]


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """Bounding box and number of points, for all or by group."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *bounds_columns())


def merged_bounds(boxes: DataFrame, *by: str) -> DataFrame:
    """Boxes rolled up to their parents."""
    each = [f(f"{a}{n}").alias(f"{a}{n}") for a in AXES for f, n in ((F.min, "min"), (F.max, "max"))]
    return boxes.groupBy(*by).agg(F.sum("n").alias("n"), *each)


def attribute_ranges(points: DataFrame, names: list[str]) -> DataFrame:
    """(attribute, min, max), a row for each name; NaN doesn't count."""
    aggs = []
    for c in names:
        v = F.col(c)
        v = F.when(~F.isnan(v), v) if dict(points.dtypes)[c] in ("float", "double") else v
        aggs += [F.min(v).cast("double").alias(f"lo_{c}") if dict(points.dtypes)[c] != "boolean" else F.min(v.cast("int")).cast("double").alias(f"lo_{c}")]
        aggs += [F.max(v).cast("double").alias(f"hi_{c}") if dict(points.dtypes)[c] != "boolean" else F.max(v.cast("int")).cast("double").alias(f"hi_{c}")]
    pairs = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max")) for c in names))
    return points.agg(*aggs).select(F.inline(pairs))


def widest(x: Column, y: Column, z: Column) -> Column:
    """The axis of the largest of three numbers: x unless y or z is larger, y unless z is."""
    return F.when((x >= y) & (x >= z), "x").when(y >= z, "y").otherwise("z")


def variances(axes: tuple[str, ...] = AXES) -> list[Column]:
    return [F.var_pop(a).alias(f"var_{a}") for a in axes]


def variance_axis(points: DataFrame, *by: str) -> DataFrame:
    """Population variances and the axis of the largest."""
    out = points.groupBy(*by).agg(*variances())
    return out.withColumn("axis", widest(F.col("var_x"), F.col("var_y"), F.col("var_z")))


def weighted_variance_axis(points: DataFrame, weight: str, *by: str) -> DataFrame:
    """Weighted variances, of rows with a positive finite weight, and the axis of the largest."""
    w = F.col(weight).cast("double")
    ok = points.filter((w > 0) & (w < float("inf")))
    mean = lambda e: F.sum(w * e) / F.sum(w)
    out = ok.groupBy(*by).agg(*((mean(F.col(a) * F.col(a)) - mean(F.col(a)) * mean(F.col(a))).alias(f"var_{a}") for a in AXES))
    return out.withColumn("axis", widest(F.col("var_x"), F.col("var_y"), F.col("var_z")))


def select_rank(df: DataFrame, column: str, rank: int, gathered: int = 1_000_000) -> float | None:
    """The value with ``rank`` (from 0) others before it, exactly.

    Each round brackets the value by approximate quantiles and goes on within; nothing is sorted as a
    whole.  At most ``gathered`` values are sorted in the end.
    """
    inside = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = inside.count()
    if not 0 <= rank < n:
        return None
    while n > gathered:
        near = sorted({max(0.0, (rank - n / 2000) / n), min(1.0, (rank + n / 2000) / n)})
        low, high = inside.agg(F.percentile_approx("v", [near[0], near[-1]], 10000).alias("p")).first()["p"]
        counts = inside.agg(F.count_if(F.col("v") < low).alias("below"), F.count_if((F.col("v") >= low) & (F.col("v") <= high)).alias("within")).first()
        if not counts["below"] <= rank < counts["below"] + counts["within"]:
            # the bracket missed: keep the side that holds the rank
            inside, rank, n = (inside.filter(F.col("v") < low), rank, counts["below"]) if rank < counts["below"] else (inside.filter(F.col("v") > high), rank - counts["below"] - counts["within"], n - counts["below"] - counts["within"])
            continue
        if low == high:
            return low
        inside, rank = inside.filter(F.col("v").between(low, high)), rank - counts["below"]
        if counts["within"] == n:  # few distinct values: count them
            break
        n = counts["within"]
    below = 0
    for r in inside.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toLocalIterator():
        below += r["n"]
        if rank < below:
            return r["v"]
    return None


def upper_median(df: DataFrame, column: str) -> float | None:
    """The value at place n // 2 (from 0) of the sorted values."""
    return select_rank(df, column, df.filter(F.col(column).isNotNull()).count() // 2)


def marks(shares: list[float]) -> list[float]:
    """The quantiles whose approximations bracket the exact ones of ``shares``: a five-thousandth of the rows at each side."""
    return sorted({min(1.0, max(0.0, q + d)) for q in shares for d in (-0.0002, 0.0002)})


def approximated(v: Column, shares: list[float]) -> Column:
    return F.percentile_approx(v, marks(shares), 10000)


def group_ranks(each: DataFrame, shares: list[float], places: Callable[[int], list[int]], known: dict | None = None, gathered: int = 50_000, sizes: dict | None = None) -> dict:
    """By group, the values that have as many others before them as ``places`` of the group's size says.

    each: (g, v); shares: about where these places lie.  A first job counts, and brackets each value by approximate
    quantiles; with known, by group its count and the quantiles ``marks(shares)``, it isn't needed.  A second one counts the values
    within the brackets; only those are put in order, so no group is sorted as a whole.
    """
    each, at = each.filter("v is not null and not isnan(v)"), marks(shares)
    if known is None:
        known = {r["g"]: (r["n"], r["p"]) for r in each.groupBy("g").agg(F.count("*").alias("n"), approximated(F.col("v"), shares).alias("p")).collect()}  # a row for each group
    if sizes is not None:
        sizes.update({g: n for g, (n, _) in known.items()})
    whole = sum(n for n, _ in known.values()) <= gathered
    wanted = {g: [r for r in places(n) if 0 <= r < n] for g, (n, _) in known.items()}
    out: dict = {g: {} for g in known}
    open_ = []
    for g, (n, p) in known.items():
        for r in dict.fromkeys(wanted[g]):
            share = r / max(1, n - 1)
            low = max((i for i, m in enumerate(at) if m <= share - 0.0001), default=None)
            high = min((i for i, m in enumerate(at) if m >= share + 0.0001), default=None)
            open_.append((g, r, -math.inf if whole or low is None else float(p[low]), math.inf if whole or high is None else float(p[high])))
    kind = each.schema["g"].dataType.simpleString()
    while open_:
        brackets = F.broadcast(each.sparkSession.createDataFrame(open_, f"g {kind}, r long, low double, high double"))  # a row for each group and rank
        inside = each.join(brackets, "g").filter("v <= high")
        counts = inside.groupBy("g", "r", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
        run = F.sum("n").over(Window.partitionBy("g", "r").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        first = counts.withColumn("run", run).filter("run > r").groupBy("g", "r").agg(F.min_by("v", "run").alias("v"))
        for row in first.collect():
            if row["v"] is not None:
                out[row["g"]][row["r"]] = row["v"]
        # a bracket that missed its value is opened
        open_ = [(g, r, -math.inf, math.inf) for g, r, *_ in open_ if r not in out[g]]
    return {g: [out[g][r] for r in wanted[g]] for g in known}


def upper_medians(points: DataFrame, by: str, column: dict[str, str], gathered: int = 50_000, known: dict | None = None) -> dict[str, float]:
    """The upper median of each group, of the column that it is given."""
    spark = points.sparkSession
    kind = points.schema[by].dataType.simpleString()
    named = F.broadcast(spark.createDataFrame(list(column.items()), f"{by} {kind}, _axis string"))  # a row for each group
    v = F.when(F.col("_axis") == "x", F.col("x")).when(F.col("_axis") == "y", F.col("y")).otherwise(F.col("z")).cast("double")
    each = points.join(named, by).select(F.col(by).alias("g"), v.alias("v"))
    return {g: v[0] for g, v in group_ranks(each, [0.5], lambda n: [n // 2], known, gathered).items() if v}


def quantiles(points: DataFrame, column: str, shares: list[float], by: str | None = None) -> dict:
    """By group, the exact quantiles, between two neighbours by their distance; points: of one group (None) if by is None."""
    g = F.col(by) if by else F.lit(0)
    v = F.col(column).cast("double")
    each = points.select(g.alias("g"), F.when(F.abs(v) < float("inf"), v).alias("v"))
    sizes: dict = {}
    found = group_ranks(each, shares, lambda n: [p for q in shares for p in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))], sizes=sizes)
    out = {}
    for key, values in found.items():
        n = sizes[key]
        out[key if by else None] = [low + (high - low) * (q * (n - 1) - math.floor(q * (n - 1))) for q, low, high in zip(shares, values[0::2], values[1::2], strict=True)]
    return out


def weighted_medians(points: DataFrame, value: str, weight: str, *by: str, bins: int = 1024) -> DataFrame:
    """By group, the first value, in order of value and weight, at which the running weight reaches half of the total.

    Each round sums the weights in equal bins of what is left of a group's values, and goes on within the bin
    that reaches half; no group is sorted, and a round shuffles ``bins`` numbers of a group from a task.
    """
    spark, w = points.sparkSession, F.col(weight).cast("double")
    each = points.filter((w > 0) & (w < float("inf"))).select(*by, F.col(value).alias("v"), w.alias("w")).filter("v is not null")
    kinds = [(c, points.schema[c].dataType.simpleString()) for c in by]
    kind = each.schema["v"].dataType.simpleString()
    found: list[tuple] = []
    left = {tuple(r[c] for c in by): (float(r["low"]), float(r["high"]), 0.0, r["total"], r["low"] == r["high"], r["low"]) for r in each.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("total")).collect() if r["total"] is not None}  # a row for each group
    while left:
        found += [(*g, x[5]) for g, x in left.items() if x[4]]
        left = {g: x for g, x in left.items() if not x[4]}
        if not left:
            break
        rows = [(*g, low, high) for g, (low, high, *_) in left.items()]
        brackets = F.broadcast(spark.createDataFrame(rows, ", ".join([*(f"{c} {t}" for c, t in kinds), "_low double, _high double"])))
        inside = (each.join(brackets, list(by)) if by else each.crossJoin(brackets)).filter("v >= _low and v <= _high")
        at = F.least(F.floor((F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))
        sums: dict[tuple, list] = {}
        for r in inside.groupBy(*by, at.alias("_bin")).agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high")).collect():  # ``bins`` rows of a group at most
            sums.setdefault(tuple(r[c] for c in by), []).append(r)
        for g, (_, _, below, total, *_) in list(left.items()):
            run = below
            for r in sorted(sums[g], key=lambda r: r["_bin"]):
                if run + r["w"] >= total / 2 or r is max(sums[g], key=lambda r: r["_bin"]):
                    left[g] = (float(r["low"]), float(r["high"]), run, total, r["low"] == r["high"], r["low"])
                    break
                run += r["w"]
    return spark.createDataFrame(found, ", ".join([*(f"{c} {t}" for c, t in kinds), f"weighted_median {kind}"]))


def value_range(points: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> tuple[float, float]:
    """The range that colours stretch over: quantiles, which may only narrow minimum and maximum.

    Under five values, and where quantiles leave no width, minimum and maximum
    count; a single value lies in the middle.
    """
    v = F.col(column).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    r = points.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).first()
    if not r["n"]:
        return 0.0, 1.0
    a, b = r["lo"], r["hi"]
    if r["n"] >= 5 and a < b:
        p = quantiles(points, column, [low, high])[None]
        a, b = max(a, p[0]), min(b, p[1])
    if a >= b:
        a, b = r["lo"], r["hi"]
    return (a - 0.5, b + 0.5) if a == b else (a, b)


def trimmed_spread(points: DataFrame, trim: float = 0.01, by: str | None = None, axes: tuple[str, ...] = AXES) -> DataFrame:
    """By axis, the extent without ``trim`` of the values at each end, scaled back to all of them."""
    g = F.col(by).cast("string") if by else F.lit("")
    each = points.select(g.alias("k"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.col(a).cast("double").alias("v")) for a in axes))).alias("s"))
    each = each.select(F.concat_ws("\x00", "s.a", "k").alias("g"), "s.v")
    found = group_ranks(each, [trim, 1 - trim], lambda n: [int(n * trim), n - 1 - int(n * trim)])
    keys = dict.fromkeys(g.partition("\x00")[2] for g in found)
    rows = [(k, *((found[f"{a}\x00{k}"][1] - found[f"{a}\x00{k}"][0]) / (1 - 2 * trim) if f"{a}\x00{k}" in found else None for a in axes)) for k in keys]
    out = points.sparkSession.createDataFrame(rows, ", ".join([f"{by or '_k'} string", *(f"spread_{a} double" for a in axes)]))
    return out.withColumn(by, F.col(by).cast(points.schema[by].dataType)) if by else out.drop("_k")


def face_area(prefix: str = "") -> Column:
    d = [F.col(f"{prefix}{a}max") - F.col(f"{prefix}{a}min") for a in AXES]
    return d[0] * d[1] + d[0] * d[2] + d[1] * d[2]


def point_error(n: str = "n") -> Column:
    """Geometric error of an inner tile: four times the mean spacing on its faces."""
    return F.when(F.col(n) > 0, 4 * F.sqrt(face_area() / F.col(n))).otherwise(F.lit(0.0))


CHILD_FACTOR = 1.01
SPLAT_CHILD_FACTOR = 1.001


def clamped_errors(nodes: list[dict], factor: float = CHILD_FACTOR) -> dict[str, float]:
    """Errors by path; a node's is at least ``factor`` times each child's.  nodes: path, raw error."""
    least: dict[str, float] = {}  # by path, what its children ask for
    out: dict[str, float] = {}
    for node in sorted(nodes, key=lambda r: -len(r["path"])):
        path = node["path"]
        out[path] = max(node["error"], least.get(path, -math.inf))
        least[path[:-1]] = max(least.get(path[:-1], -math.inf), factor * out[path])
    return out


def root_error(box: dict) -> float:
    """The error that the root should reach: the longest side times the root of 3, over 5."""
    return max(0.0, *(box[f"{a}max"] - box[f"{a}min"] for a in AXES)) * math.sqrt(3) / 5
