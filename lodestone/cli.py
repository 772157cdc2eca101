"""Command line: tile point clouds and splat scenes."""

from __future__ import annotations

import argparse
import json

from .functions import frames
from .plans import splats
from .sinks import tileset
from .sources import ply
from .storage import listed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pcloud", help="tile a point cloud or a folder of them")
    p.add_argument("input")
    p.add_argument("--out", required=True)
    p.add_argument("--crs")
    p.add_argument("--points-per-tile", type=int, default=50_000)
    p.add_argument("--refine", choices=("add", "replace"), default="add")
    p.add_argument("--encoder", default="glb")
    p.add_argument("--attributes", default="intensity,classification")
    p.add_argument("--correction", type=float, default=1.0)
    p.add_argument("--root-error", type=float)
    p.add_argument("--eight-bit", action="store_true")
    p.add_argument("--z-offset", type=float, default=0.0)
    p.add_argument("--keep-withheld", action="store_true")
    p.add_argument("--colorize", help="attribute:gradient[:modifier...]")
    p.add_argument("--orthophoto", help="a GeoTIFF")
    p.add_argument("--min-alpha", type=int, default=1)
    p.add_argument("--drop-uncoloured", action="store_true")
    p.add_argument("--tiles-per-file", type=int, default=2000)
    p.add_argument("--subsample", type=float, default=100.0, help="percent")
    s = sub.add_parser("splats", help="tile a Gaussian splat scene")
    s.add_argument("input")
    s.add_argument("--out", required=True)
    s.add_argument("--per-tile", type=int, default=40_000)
    s.add_argument("--sh-degree", type=int, choices=(0, 1, 2, 3), default=0)
    s.add_argument("--min-opacity", type=float, default=0.05)
    for q in (p, s):
        q.add_argument("--archive", help="also package the folder as a 3TZ file")
        for name in ("lon", "lat", "height", "heading", "pitch", "roll"):
            q.add_argument(f"--{name}", type=float)
        q.add_argument("--scale", type=float)
        q.add_argument("--up", choices=("x", "y", "z"))
    return top


def _placement(a: argparse.Namespace) -> frames.Affine | None:
    given = {n: getattr(a, n) for n in ("lon", "lat", "height", "heading", "pitch", "roll", "scale") if getattr(a, n) is not None}
    return frames.placement(**given, up=a.up or "z") if given else None


def main(argv: list[str] | None = None) -> dict:
    from pyspark.sql import SparkSession

    from .tiler import READERS, Options, process

    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    placed = _placement(a)
    if a.command == "pcloud":
        local = (a.crs or "").lower() == "local"
        if placed and not local:
            raise SystemExit("a placement needs --crs local")
        crs = f"EPSG:{a.crs}" if a.crs and a.crs.isdigit() else a.crs
        options = Options(a.points_per_tile, a.refine.upper(), a.encoder, a.correction, a.root_error, attributes=_names(a.attributes), eight_bit=a.eight_bit, z_offset=a.z_offset, keep_withheld=a.keep_withheld, colouring=a.colorize, subsample=a.subsample / 100, tiles_per_file=a.tiles_per_file, orthophoto=a.orthophoto, min_alpha=a.min_alpha, drop_uncoloured=a.drop_uncoloured, placement=(placed or frames.placement()) if local else None)
        out = process(spark, listed(a.input, tuple(READERS)), a.out, None if local else crs, options)
    else:
        transform = placed.column_major() if placed else None
        out = splats.tile_splats(spark, ply.read_splats(spark, a.input), a.out, a.per_tile, a.min_opacity, a.sh_degree, a.up or "z", transform)
    if a.archive:
        out["archived"] = tileset.package(a.out, a.archive)
    print(json.dumps(out))
    return out


def _names(text: str) -> list[str]:
    from .model import requested

    return requested(text)


if __name__ == "__main__":
    main()
