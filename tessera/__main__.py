"""Command line: ``list`` the queries, run one (``query``), or embed many sites (``sites``); see ``--help`` of each."""

from __future__ import annotations

import argparse
import importlib

from tessera.session import build_session, ship_package


def _loader(name: str):
    """``module:function`` -> the function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _sites(a: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from tessera.operators import sites
    from tessera.sources.tiles import catalogue

    spark = build_session("sites")
    ship_package(spark)
    listed = catalogue(spark, a.catalogue)
    keys = listed.select("site_key", F.lit(a.res).cast("string").alias("resolution"), "ord")
    if a.site_key:
        keys = keys.where(F.col("site_key") == a.site_key)
    shard = tuple(int(x) for x in a.shard.split("/")) if a.shard else None
    work = sites.work_list(keys, listed.drop("ord"), spark.read.parquet(a.raster_paths), a.version, shard, a.limit)
    read = spark.read.parquet
    out = sites.run_sites(work, read(a.tiles), read(a.rasters), read(a.pixels), _loader(a.model), a.out_root, not a.no_resume, not a.no_webmap, {"model": a.model, "res": a.res}, a.tile_patches)
    out.orderBy("site_id").show(1000, truncate=False)


def _query(a: argparse.Namespace) -> None:
    from tessera.plans import registry

    spark = build_session(a.name)
    ship_package(spark)
    out = registry.QUERIES[a.name](spark, a.folder)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(a.rows, truncate=False)


def _list(a: argparse.Namespace) -> None:
    from tessera.plans import registry

    print("\n".join(sorted(registry.QUERIES)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    kinds = top.add_subparsers(required=True)
    one = kinds.add_parser("list", help="names of the queries")
    one.set_defaults(run=_list)
    one = kinds.add_parser("query", help="run a query over a folder of tables")
    one.add_argument("name")
    one.add_argument("folder")
    one.add_argument("--out", help="write Parquet there instead of showing rows")
    one.add_argument("--rows", type=int, default=20)
    one.set_defaults(run=_query)
    one = kinds.add_parser("sites", help="embed the sites of a catalogue, in one job")
    which = one.add_mutually_exclusive_group(required=True)
    which.add_argument("--site-key", help="one site of the catalogue")
    which.add_argument("--all-sites", action="store_true")
    for name, text in (("catalogue", "JSON of sites and their resolutions"), ("raster-paths", "Parquet: site_key, resolution, rgb_path"), ("tiles", "Parquet of tile boxes"), ("rasters", "Parquet of affines and sizes"), ("pixels", "Parquet of pixels"), ("model", "module:function that returns the model"), ("out-root", "folder of the results")):
        one.add_argument(f"--{name}", required=True, help=text)
    one.add_argument("--res", help="resolution; by default each site's first")
    one.add_argument("--version", default="", help="last part of the sites' names")
    one.add_argument("--shard", help="i/n: every n-th site from the i-th on")
    one.add_argument("--limit", type=int)
    one.add_argument("--tile-patches", type=int, default=1)
    one.add_argument("--no-resume", action="store_true")
    one.add_argument("--no-webmap", action="store_true")
    one.set_defaults(run=_sites)
    return top


if __name__ == "__main__":
    args = parser().parse_args()
    args.run(args)
