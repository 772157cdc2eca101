"""From point sources to a tileset: the library's entry points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .functions import frames
from .job import Workspace
from .operators import sample, stats, transforms
from .plans import kd
from .sinks import tiles, tileset
from .sources import e57, geotiff, las, ply

#: Readers by file ending: (read(spark, path, attributes, eight_bit), crs(path)).
READERS: dict[str, tuple[Callable, Callable]] = {
    "las": (lambda spark, path, attributes, eight_bit: las.read_points(spark, path, attributes, eight_bit), las.crs_of),
    "laz": (lambda spark, path, attributes, eight_bit: las.read_points(spark, path, attributes, eight_bit), las.crs_of),
    "e57": (lambda spark, path, attributes, eight_bit: e57.read_points(spark, path, attributes), lambda path: None),
    "ply": (lambda spark, path, attributes, eight_bit: ply.read_points(spark, path, attributes), lambda path: None),
}


def register_reader(ending: str, read: Callable, crs: Callable) -> None:
    if ending in READERS:
        raise ValueError(f"there is a reader for {ending}")
    READERS[ending] = read, crs


@dataclass
class Options:
    points_per_tile: int = kd.POINTS_PER_TILE
    refine: str = "ADD"
    encoder: str = "glb"
    error_factor: float = 1.0
    root_error: float | None = None
    tiles_per_file: int = 2000
    attributes: list[str] = field(default_factory=lambda: list(model.DEFAULT_ATTRIBUTES))
    eight_bit: bool = False
    z_offset: float = 0.0
    keep_withheld: bool = False
    colouring: str | None = None
    subsample: float = 1.0
    placement: frames.Affine | None = None
    mutators: list[transforms.Mutator] = field(default_factory=list)
    write_mutators: list[transforms.Mutator] = field(default_factory=list)  # run on placed points, and keep each
    orthophoto: str | None = None  # a GeoTIFF
    min_alpha: int = 1
    drop_uncoloured: bool = False
    progress: Callable[[str, dict], None] | None = None
    planner: Callable[[DataFrame, int, list[str]], kd.Plan] = kd.plan  # (points, leaves wanted, ids)
    middleware: list[Callable[[str, bytes], tuple[str, bytes]]] = field(default_factory=list)  # between (path, content) and the folder, in order
    finalizers: list[Callable[[], None]] = field(default_factory=list)  # run last, after a failure too

    def check(self) -> None:
        if not 5_000 <= self.points_per_tile <= 5_000_000:
            raise ValueError("points per tile lie between 5,000 and 5,000,000")
        if self.refine not in ("ADD", "REPLACE"):
            raise ValueError("refine is ADD or REPLACE")
        if self.encoder not in tiles.ENCODERS:
            raise ValueError(f"no encoder {self.encoder!r}")
        if not self.error_factor > 0:
            raise ValueError("the error factor is positive")
        if not 0 < self.subsample <= 1:
            raise ValueError("the subsample lies above 0 and up to 1")
        if self.tiles_per_file < 1:
            raise ValueError("a file holds a tile at least")

    def tell(self, phase: str, **facts) -> None:
        if self.progress:
            self.progress(phase, facts)


def read(spark: SparkSession, files: list[str], attributes: list[str], eight_bit: bool = False) -> tuple[DataFrame, str | None]:
    """Points of all files, in order, and the CRS that they name."""
    found, named = [], []
    for f in files:
        ending = f.rpartition(".")[2].lower()
        if ending not in READERS:
            raise ValueError(f"no reader for {f}")
        get, crs = READERS[ending]
        found.append(get(spark, f, attributes, eight_bit))
        named.append(crs(f))
    return model.union_points(found), model.one_crs(named)


def tile_points(spark: SparkSession, points: DataFrame, crs: str | None, folder: str, options: Options | None = None) -> dict:
    """Write points (file_id, pos, x, y, z, r, g, b and attributes) as 3D Tiles; what was written.

    The finalizers run at the end, whether or not writing failed; all errors are raised together.
    """
    o, errors, done = options or Options(), [], {}
    o.check()
    try:
        done = _tiled(spark, points, crs, folder, o)
    except Exception as e:  # noqa: BLE001
        errors.append(e)
    for last in o.finalizers:
        try:
            last()
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    if len(errors) > 1:
        raise ExceptionGroup("tiling failed", errors)
    if errors:
        raise errors[0]
    return done


def _photographed(spark: SparkSession, points: DataFrame, crs: str | None, o: Options, ids: list[str]) -> DataFrame:
    """points with the image's colours, wherever they lie in its CRS."""
    lies = geotiff.georeference(o.orthophoto)
    if not lies.crs:
        raise ValueError("the image names no CRS")
    same = crs and lies.crs.lower().removeprefix("epsg:").partition("+")[0] == crs.lower().removeprefix("epsg:").partition("+")[0]
    place = ("x", "y")
    if not same:
        if not crs and not o.placement:
            raise ValueError("points without a CRS can't be found in an image")
        own = {a: f"_own_{a}" for a in "xyz"}
        points = points.withColumns({n: F.col(a) for a, n in own.items()})
        earth = _placed(points, o.placement) if o.placement else frames.reprojected(points, crs)
        points, place = frames.projected(earth, lies.crs).withColumns({"_u": F.col("x"), "_v": F.col("y")}).withColumns({a: F.col(n) for a, n in own.items()}).drop(*own.values()), ("_u", "_v")
    return geotiff.colour_points(spark, points, o.orthophoto, ids, min_alpha=o.min_alpha, drop_missing=o.drop_uncoloured, place=place).drop("_u", "_v")


def _placed(points: DataFrame, placement: frames.Affine) -> DataFrame:
    return points.withColumns(dict(zip("xyz", placement.forward(F.col("x"), F.col("y"), F.col("z")), strict=True)))


def _tiled(spark: SparkSession, points: DataFrame, crs: str | None, folder: str, o: Options) -> dict:
    """Reprojection, filters and colours are one projection; the local points are
    written once to the shared folder and read for statistics, routing and levels.
    """
    ids = ["file_id", "pos"]
    ws = Workspace(spark, "tiler")
    if not crs and not o.placement:
        raise ValueError("points without a CRS need one, or a placement")
    # filters first: they then stand below the reprojection and reach the scan
    kept = transforms.pipeline(points, [transforms.finite_positions, *([] if o.keep_withheld else [transforms.drop_withheld])])
    if o.subsample < 1:
        kept = sample.subsample(kept, o.subsample, ids)
    if o.orthophoto:
        kept = _photographed(spark, kept, crs, o, ids)
    if o.placement:
        earth = _placed(kept, o.placement)
    else:
        earth = frames.reprojected(kept, crs)
    anchor = o.placement or frames.anchored(earth, ids)
    local = frames.localised(earth, anchor)
    if o.z_offset:
        local = local.transform(transforms.z_offset(o.z_offset))
    local = ws.keep(transforms.pipeline(local, o.mutators), "local")
    if o.colouring:
        local = transforms.Colouring.parse(o.colouring).apply(local)
    box = stats.bounds(local).first().asDict()
    if not box["n"]:
        raise ValueError("no points are left")
    o.tell("read", **box)
    plan = o.planner(local, kd.leaf_count(box["n"], o.points_per_tile, o.refine), ids)
    routed = plan.routed(local).withColumn("point_id", F.col("file_id").cast("long") * (1 << 40) + F.col("pos"))
    o.tell("planned", leaves=len(plan.leaves))
    placed = ws.keep(kd.bubble_up(spark, routed, o.refine), "placed")
    nodes = kd.node_table(placed)
    root = next(r for r in nodes if r["path"] == kd.ROOT)
    takes = kd.detail_chain(root["n"] or 0, root, o.refine, o.root_error)
    exported = [f.name for f, _ in model.exported(points, tiles.ENCODERS[o.encoder][3]) if f.name in o.attributes]
    if o.write_mutators:
        before, placed = placed.count(), transforms.pipeline(placed, o.write_mutators)
        if placed.count() != before:
            raise ValueError("a write mutator may not add or drop points")
    columns = ["point_id", *"xyz", *"rgb", *exported, "tile"]
    if takes:
        # the chain's tiles stand between the root and its children; the root of all is the last residual
        chained = kd.insert_chain(placed.filter(F.col("tile") == kd.ROOT), takes, o.refine)
        chained = chained.withColumn("tile", F.when(F.col("chain") == 0, F.lit(kd.ROOT)).otherwise(F.concat(F.lit(f"{kd.ROOT}c"), F.col("chain").cast("string")))).drop("chain")
        placed = placed.filter(F.col("tile") != kd.ROOT).unionByName(chained)
    out = tiles.written(tiles.encoded(placed.select(*columns), o.encoder), folder, o.middleware)
    written = out.agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes")).first()
    o.tell("written", **written.asDict())
    _, ending, version, _ = tiles.ENCODERS[o.encoder]
    top = tileset.tree(nodes, ending, o.refine)
    if takes:
        _chain(top, takes, ending, o.refine)
    top.transform = anchor.column_major()
    ranges = [r.asDict() for r in stats.attribute_ranges(local, exported).collect()] if exported else []
    properties, extra = tileset.range_metadata(ranges, version)
    tileset.write_index(folder, tileset.index_files(top, o.tiles_per_file, version, properties, extra, o.error_factor), o.middleware)
    return {"points": box["n"], "tiles": written["tiles"], "bytes": written["bytes"], "leaves": len(plan.leaves), "levels": plan.depth + 1 + len(takes)}


def _chain(top: tileset.Tile, takes: list[int], ending: str, refine: str) -> None:
    """Insert the chain under the root: the last tile made is its only child, the first has the old children."""
    d = [top.box[2 * i + 1] - top.box[2 * i] for i in range(3)]
    area, kids = d[0] * d[1] + d[0] * d[2] + d[1] * d[2], top.children
    for k, n in enumerate(takes, 1):
        error = max([4 * (area / n) ** 0.5 if n else 0.0, *(stats.CHILD_FACTOR * c.error for c in kids)])
        kids = [tileset.Tile(f"{kd.ROOT}c{k}", top.box, error, tiles.content_path(f"{kd.ROOT}c{k}", ending), refine, kids)]
    top.children, top.error = kids, max(top.error, stats.CHILD_FACTOR * kids[0].error)


def process(spark: SparkSession, files: list[str], folder: str, crs: str | None = None, options: Options | None = None) -> dict:
    o = options or Options()
    wanted = list(dict.fromkeys([*o.attributes, *([] if o.keep_withheld else ["withheld"]), *([o.colouring.split(":")[0]] if o.colouring and o.colouring.split(":")[0] not in "xyz" else [])]))
    points, named = read(spark, files, wanted, o.eight_bit)
    return tile_points(spark, points, crs or named, folder, o)
