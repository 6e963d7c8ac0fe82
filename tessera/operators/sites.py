"""One job over many sites: tiles to grid cells, embeddings, manifest, meta and colour map, with a status for each site.

Sites are rows, not turns of a loop: every step works on all of them, keyed by ``site_id``, and a site that can't be run or
whose model fails is a status in the result, not the end of the job. Tables in:

* ``tiles``: site_id, tile, xmin, ymin, xmax, ymax
* ``rasters``: site_id, affine (six numbers), height, width; one row a site
* ``pixels``: site_id, row, col, r, g, b

A loader makes the model, once a task; the model turns an image (rows, columns, three bands) into its patch vectors (rows,
columns, numbers) and one vector for the whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numeric, paths
from tessera.functions import vectors as fv
from tessera.operators import geo, raster, runs, vectors
from tessera.session import checkpointed
from tessera.sources import store

Loader = Callable[[], Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]
INFO = ["n_cells_full", "after_tile_filter", "n_cells", "dropped_void"]


def grid_cells(tiles: DataFrame, rasters: DataFrame, pixels: DataFrame, tile_patches: int = 1, patch: int | None = None, least: float = 0.02, high_res: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, info): the cells of every site that meet a tile and hold data, and what became of the others.

    Tiles are cut to the raster; the box of what is left grows to whole patches of ``patch`` pixels (by default that of the
    raster's resolution times ``tile_patches``) on the raster's own grid. cells: site_id, cell_id (from 0, in the order of
    the grid), row, col, box, side, first pixel (r0, c0); info: one row a site that has cells, native resolution and
    counts. A cell's data are the share of its pixels with any band not zero; pixels that are not there count as zero."""
    res = numeric.native_res(F.col("affine"))
    size = F.lit(patch) if patch else numeric.activity_params(res, high_res)["patch_size"] * tile_patches
    known = rasters.select("site_id", "affine", res.alias("native_res_m"), size.cast("int").alias("patch_px"), *[v.alias(n) for n, v in numeric.tile_box(F.col("affine"), F.col("width"), F.col("height")).items()])
    clipped = checkpointed(geo.clip(tiles.select("site_id", *geo.BOX), known.select("site_id", *geo.BOX), by=["site_id"]))
    area = clipped.groupBy("site_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    area = area.join(known.drop(*geo.BOX), "site_id")
    snapped = area.withColumns(geo.snap_box(F.col("affine"), {n: F.col(n) for n in geo.BOX}, F.col("patch_px")))
    side = F.col("native_res_m") * F.col("patch_px")
    c0, r0 = numeric.world_to_pixel(F.col("affine"), F.col("xmin"), F.col("ymax"))
    origin = checkpointed(snapped.withColumns({"_c": F.bround(c0).cast("int"), "_r": F.bround(r0).cast("int"), "side": side}))
    full = checkpointed(geo.grid(origin, F.col("side"), ["site_id", "side", "patch_px", "_c", "_r"]))
    place = lambda at, first: F.floor((F.col(at) - F.col(first)) / F.col("patch_px")).cast("int")
    lit = ((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0)).cast("long")
    data = pixels.join(origin.select("site_id", "patch_px", "_c", "_r"), "site_id").groupBy("site_id", "patch_px", place("row", "_r").alias("row"), place("col", "_c").alias("col"))
    data = data.agg((F.sum(lit) / F.first(F.col("patch_px").cast("double") * F.col("patch_px"))).alias("coverage")).drop("patch_px")
    # cells are joined to tiles on bins of about their own size
    bins = origin.agg(F.max("side")).first()[0] or 1.0
    near = geo.box_semi_join(full, clipped, float(bins), "cell_id", ["site_id"]).join(data, ["site_id", "row", "col"], "left")
    near = checkpointed(near.na.fill(0.0, ["coverage"]))
    kept = near.where(F.col("coverage") >= least)
    order = F.row_number().over(Window.partitionBy("site_id").orderBy("cell_id")) - 1
    cells = kept.withColumn("cell_id", order.cast("long")).select("site_id", "cell_id", "row", "col", *geo.BOX, "side", "patch_px", (F.col("_r") + F.col("row") * F.col("patch_px")).alias("r0"), (F.col("_c") + F.col("col") * F.col("patch_px")).alias("c0"))
    count = lambda df, name: df.groupBy("site_id").agg(F.count("*").alias(name))
    info = origin.select("site_id", F.round("native_res_m", 4).alias("native_res_m"), "patch_px", F.round("side", 1).alias("cell_ground_m"), F.array("patch_px").alias("cell_sizes_px"))
    for df, name in ((full, "n_cells_full"), (near, "after_tile_filter"), (kept, "n_cells")):
        info = info.join(count(df, name), "site_id", "left")
    info = info.na.fill(0, INFO[:3]).withColumn("dropped_void", F.col("after_tile_filter") - F.col("n_cells"))
    return checkpointed(cells), checkpointed(info)


def embed_cells(cells: DataFrame, pixels: DataFrame, loader: Loader, key: tuple[str, str] = ("site_id", "cell_id"), black: float | None = None) -> DataFrame:
    """Every cell (key, r0, c0, patch_px) read from the pixels and embedded: rows key, pr, pc, vec; the vector of the whole
    has pr and pc null. What the model raises becomes one row with ``error``. With ``black``, cells whose share of all-black
    pixels reaches it are holes and left out."""
    site, name = key
    # every cell takes part, pixels or not: what isn't there is zero
    at = cells.select(site, name, "r0", "c0", "patch_px")
    place = lambda at, first: F.floor((F.col(at) - F.col(first)) / F.col("patch_px")).cast("int")
    # one bin of the cell's size holds a pixel; a cell off the common grid meets two of them on an axis
    beside = lambda c: F.explode(F.when(F.pmod(F.col(c), F.col("patch_px")) == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    spots = at.withColumn("_dr", beside("r0")).withColumn("_dc", beside("c0"))
    spots = spots.select(site, name, "r0", "c0", "patch_px", *[(F.floor(F.col(f"{a}0") / F.col("patch_px")) + F.col(f"_d{a}")).cast("long").alias(f"_b{a}") for a in "rc"]).distinct()
    sizes = at.select(site, "patch_px").distinct()
    binned = pixels.join(sizes, site).select(site, "patch_px", "row", "col", "r", "g", "b", *[F.floor(F.col(n) / F.col("patch_px")).cast("long").alias(f"_b{a}") for a, n in (("r", "row"), ("c", "col"))])
    inside = (F.col("row") - F.col("r0")).between(0, F.col("patch_px") - 1) & (F.col("col") - F.col("c0")).between(0, F.col("patch_px") - 1)
    found = spots.join(binned, [site, "patch_px", "_br", "_bc"]).where(inside).select(site, name, (F.col("row") - F.col("r0")).alias("_row"), (F.col("col") - F.col("c0")).alias("_col"), "r", "g", "b")
    rows = at.select(site, name, "patch_px").join(found, [site, name], "left")
    kinds = {c: cells.schema[c].dataType.simpleString() for c in key}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", pr int, pc int, vec array<float>, error string"
    made: dict = {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [pdf[c].iloc[0] for c in key]
        columns = [*key, "pr", "pc", "vec", "error"]
        n = int(pdf["patch_px"].iloc[0])
        image = np.zeros((n, n, 3), np.float32)
        there = pdf[pdf["_row"].notna()]
        image[there["_row"].astype(int), there["_col"].astype(int)] = there[["r", "g", "b"]].to_numpy(np.float32)
        if black is not None and (image == 0).all(axis=2).mean() >= black:
            return pd.DataFrame([], columns=columns)
        try:
            model = made.get("model") or made.setdefault("model", loader())
            patches, whole = model(image)
            patches, whole = np.asarray(patches, np.float32), np.asarray(whole, np.float32)
            out = [(*own, r, c, patches[r, c].tolist(), None) for r in range(patches.shape[0]) for c in range(patches.shape[1])]
            return pd.DataFrame([*out, (*own, None, None, whole.tolist(), None)], columns=columns).astype({"pr": "Int32", "pc": "Int32"})
        except Exception as e:  # a model may raise anything; the site's status tells
            return pd.DataFrame([(*own, None, None, None, f"{type(e).__name__}: {e}")], columns=columns).astype({"pr": "Int32", "pc": "Int32"})

    return rows.groupBy(*key).applyInPandas(run, schema)


def _grams(patches: DataFrame, key: str) -> DataFrame:
    """(key, n, s, g): count, sum and sum of products of every key's vectors, from one partial a batch."""
    kind = patches.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n long, s binary, g binary"

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, some in pdf.groupby(key):
                x = np.stack(some["vec"].to_numpy()).astype(np.float64)
                rows.append((k, len(x), x.sum(0).tobytes(), (x.T @ x).tobytes()))
            yield pd.DataFrame(rows, columns=[key, "n", "s", "g"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: sum(np.frombuffer(b) for b in pdf[c])
        return pd.DataFrame([(pdf[key].iloc[0], int(pdf["n"].sum()), total("s").tobytes(), total("g").tobytes())], columns=[key, "n", "s", "g"])

    # partials of a key are added in a few tasks first, whatever its number of batches
    parts = patches.select(key, "vec").mapInPandas(partial, schema).withColumn("_p", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.groupBy(key, "_p").applyInPandas(lambda pdf: merged(pdf), schema)
    return some.groupBy(key).applyInPandas(merged, schema)


def colour_map(cells: DataFrame, patches: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """site_id, row, col, r, g, b, a of every site's canvas: its patches' three leading components, stretched between two
    percentiles of the site, painted at their place. cells: site_id, cell_id, box, gsd (metres of a patch)."""
    patches = patches.where("pr is not null")

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        total = np.frombuffer(r["s"])
        model = vectors.pca_from_gram(int(r["n"]), total, np.frombuffer(r["g"]).reshape(len(total), -1), min(3, len(total)))
        return pd.DataFrame([(r["site_id"], model.mean.tolist(), model.components.tolist())], columns=["site_id", "mean", "axes"])

    models = _grams(patches, "site_id").groupBy("site_id").applyInPandas(axes, "site_id string, mean array<double>, axes array<array<double>>")
    z = patches.join(models, "site_id")
    axis = lambda i: F.coalesce(fv.project(F.col("vec"), F.col("mean"), F.get("axes", i)), F.lit(0.0))
    z = checkpointed(z.select("site_id", "cell_id", "pr", "pc", *[axis(i).alias(c) for i, c in enumerate("rgb")]))
    ends = _site_percentiles(z, list("rgb"), low, high)
    z = z.join(ends, "site_id").select("site_id", "cell_id", "pr", "pc", *[numeric.stretch(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) for c in "rgb"])
    spots = raster.paint(cells, z, F.col("gsd"), "cell_id", ["site_id"])
    byte = lambda c: F.floor(F.col(c) * 255).cast("int").alias(c)
    return spots.select("site_id", "row", "col", byte("r"), byte("g"), byte("b"), F.lit(255).alias("a"))


def _site_percentiles(z: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """One row a site. A site of more than vectors.FEW rows is narrowed down by itself, the others go together."""
    ends = [(f"{c}_{n}", c, p) for c in columns for n, p in (("lo", low), ("hi", high))]
    counts = z.groupBy("site_id").agg(F.count("*").alias("n"))
    large = [r.site_id for r in counts.where(F.col("n") > vectors.FEW).collect()]  # each has FEW rows and more
    small = z.where(~F.col("site_id").isin(large)) if large else z
    out = small.groupBy("site_id").agg(*[F.percentile(c, F.lit(p)).alias(name) for name, c, p in ends])
    for site in large:
        out = out.union(vectors.percentile_bounds(z.where(F.col("site_id") == site), columns, low, high).select(F.lit(site), *[name for name, _, _ in ends]))
    return out


def site_meta(info: DataFrame, shapes: DataFrame, settings: dict) -> DataFrame:
    """What describes a site's embeddings: one row a site, fifteen columns. ``shapes``: site_id, gh, gw, channels;
    ``settings``: model, high_res, upsample, dtype, commit."""
    s = {k: settings.get(k) for k in ("model", "high_res", "upsample", "dtype", "commit")}
    out = info.join(shapes, "site_id", "left")
    return out.select(
        "site_id",
        F.lit(s["model"]).cast("string").alias("model"),
        F.lit(bool(s["high_res"])).alias("high_res"),
        F.lit(s["upsample"]).cast("int").alias("upsample"),
        F.lit(s["dtype"]).cast("string").alias("dtype"),
        F.col("channels").alias("embed_dim"),
        F.array("gh", "gw").alias("patch_grid"),
        "patch_px",
        "native_res_m",
        "cell_ground_m",
        (F.col("cell_ground_m") / F.col("gw")).alias("patch_ground_m"),
        "n_cells",
        F.lit(s["commit"]).cast("string").alias("commit"),
        F.current_timestamp().alias("created"),
        F.struct("native_res_m", "patch_px", "cell_ground_m", "cell_sizes_px", *INFO).alias("ginfo"),
    )


def _done(spark: SparkSession, path: str) -> DataFrame:
    """site_id of the sites that a manifest holds; none where it isn't there."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.exists(root) and any(s.getPath().getName().startswith("site_id=") for s in fs.listStatus(root))
    return store.read_manifest(spark, path).select(F.col("site_id").cast("string").alias("site_id")).distinct() if found else spark.createDataFrame([], "site_id string")


def run_sites(work: DataFrame, tiles: DataFrame, rasters: DataFrame, pixels: DataFrame, loader: Loader, out_root: str, resume: bool = True, webmap: bool = True, settings: dict | None = None, tile_patches: int = 1, patch: int | None = None, least: float = 0.02) -> DataFrame:
    """Embeds the sites of ``work`` (site_id, message: null, or why a site can't be run) and returns one row for each:
    site_id, status, message, n_tiles and the counts of its grid.

    Status: ``skipped`` (its manifest is there; with ``resume``), ``skip`` (nothing to run on), ``fail`` (the model raised),
    ``ok``. Below ``out_root`` the sites that are ok have their partitions in ``cells`` (manifest), ``patches``, ``meta`` and,
    with ``webmap``, ``map``; a row for the run is added to ``runs``."""
    spark, settings = work.sparkSession, settings or {}
    work = checkpointed(work.select(F.col("site_id").cast("string").alias("site_id"), "message").dropDuplicates(["site_id"]))
    has = lambda df, name: df.select(F.col("site_id").cast("string").alias("site_id")).distinct().withColumn(name, F.lit(True))
    out = work.join(has(_done(spark, f"{out_root}/cells") if resume else _done(spark, f"{out_root}/cells").limit(0), "_done"), "site_id", "left")
    counts = tiles.groupBy(F.col("site_id").cast("string").alias("site_id")).agg(F.count("*").alias("n_tiles"))
    out = out.join(counts, "site_id", "left").join(has(rasters, "_raster"), "site_id", "left").na.fill(0, ["n_tiles"])
    message = F.coalesce("message", F.when(F.col("n_tiles") == 0, "no such tiles"), F.when(F.col("_raster").isNull(), "no such raster"))
    todo = checkpointed(out.withColumn("message", F.when(F.col("_done").isNull(), message)))
    run = F.broadcast(todo.where("_done is null and message is null").select("site_id"))  # a work list of sites
    some = lambda df: df.withColumn("site_id", F.col("site_id").cast("string")).join(run, "site_id", "left_semi")
    rasters, pixels = some(rasters), some(pixels)
    cells, info = grid_cells(some(tiles), rasters, pixels, tile_patches, patch, least, bool(settings.get("high_res")))
    made = checkpointed(embed_cells(cells, pixels, loader))
    failed = made.where("error is not null").groupBy("site_id").agg(F.min("error").alias("_error"))
    good = checkpointed(made.join(F.broadcast(failed), "site_id", "left_anti"))
    patches = good.where("pr is not null").select("site_id", "cell_id", "pr", "pc", "vec")
    whole = good.where("pr is null").select("site_id", "cell_id", F.col("vec").alias("cls"))
    shapes = store.grid_shape(patches).groupBy("site_id").agg(F.max("gh").alias("gh"), F.max("gw").alias("gw"), F.max("channels").alias("channels"))
    store.write_patches(patches, f"{out_root}/patches")
    if webmap:
        gsd = cells.join(shapes, "site_id").withColumn("gsd", F.col("side") / F.col("gw"))
        store.write_sites(colour_map(gsd.select("site_id", "cell_id", *geo.BOX, "gsd"), patches), f"{out_root}/map")
    store.write_sites(site_meta(info.join(shapes.select("site_id"), "site_id", "left_semi"), shapes, settings), f"{out_root}/meta")
    # the manifest comes last: a site that has one is complete
    manifest = store.with_ref(cells.join(whole, ["site_id", "cell_id"]).select("site_id", "cell_id", *geo.BOX, "cls"), f"{out_root}/patches")
    store.write_manifest(manifest, f"{out_root}/cells")
    keys = [r.site_id for r in todo.select("site_id").orderBy("site_id").collect()]  # the work list
    runs.run_record(spark, {**settings, "out_root": out_root, "tile_patches": tile_patches, "least": least}, keys).write.mode("append").parquet(f"{out_root}/runs")
    out = todo.join(failed, "site_id", "left").join(info.select("site_id", *INFO), "site_id", "left")
    error = F.coalesce("message", "_error")
    status = F.when(F.col("_done"), "skipped").when(F.col("_error").isNotNull(), "fail").otherwise(runs.outcome(F.col("message"), F.lit(False)))
    return out.select("site_id", status.alias("status"), F.when(F.col("_done").isNull(), error).alias("message"), F.col("n_tiles").cast("long").alias("n_tiles"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in INFO])


def work_list(keys: DataFrame, catalogue: DataFrame, rasters: DataFrame, version: str, shard: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """site_id and message of the sites to run: keys (site_key, resolution or null, ord), in order, every n-th of them, the
    first ``limit``, resolved against the catalogues (see runs.resolved)."""
    i, n = shard or (0, 1)
    some = runs.sharded(keys, "ord", i, n, limit)
    found = runs.resolved(some.select("site_key", "resolution"), catalogue, rasters)
    name = paths.site_id_from_key(F.col("site_key"), F.coalesce("resolution", F.lit("")), F.lit(version))
    return found.select("site_key", name.alias("site_id"), F.when(F.col("status") != "ok", F.col("status")).alias("message"))


def embed_blob(windows: DataFrame, pixels: DataFrame, loader: Loader, patch_px: Column | int, black: float = 0.98) -> DataFrame:
    """Blobs embedded window by window and blended: holes (windows of at least ``black`` black pixels) are skipped, patches
    of overlapping windows at one place are averaged. uuid, row, col, vec; a blob of nothing but holes has no rows.

    windows: uuid, chunk_id, col_px, row_px, w_px, h_px; pixels: uuid, row, col, r, g, b. Windows are read square, as large
    as their longer side, and patches beyond the window are cut off."""
    side = F.greatest("w_px", "h_px")
    cells = windows.select("uuid", "chunk_id", F.col("row_px").alias("r0"), F.col("col_px").alias("c0"), side.alias("patch_px"))
    made = embed_cells(cells, pixels, loader, ("uuid", "chunk_id"), black)
    bad = made.where("error is not null").select("error").limit(1).collect()
    if bad:
        raise RuntimeError(bad[0].error)
    step = F.lit(patch_px) if isinstance(patch_px, int) else patch_px
    placed = made.where("pr is not null").join(windows, ["uuid", "chunk_id"]).where((F.col("pr") * step < F.col("h_px")) & (F.col("pc") * step < F.col("w_px")))
    at = placed.select("uuid", (F.bround(F.col("row_px") / step) + F.col("pr")).cast("int").alias("row"), (F.bround(F.col("col_px") / step) + F.col("pc")).cast("int").alias("col"), "vec")
    each = at.select("uuid", "row", "col", F.posexplode("vec").alias("i", "x")).groupBy("uuid", "row", "col", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("uuid", "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def tiling_drift(pixels: DataFrame, sizes: list[int], reference: int, loader: Loader, patch_px: int, extent: int, clusters: int | None = None) -> DataFrame:
    """How much features depend on the window: an area of ``extent`` pixels is embedded in windows of each size, and every
    size is compared with ``reference`` patch by patch: size, mean_cosine, n, and with ``clusters`` the share of patches in
    another cluster (centres of the reference)."""
    spark = pixels.sparkSession
    one = pixels.withColumn("uuid", F.lit("area"))
    fields = {}
    for size in sorted({*sizes, reference}):
        n = extent // size
        windows = raster.canvas(spark, n, n).select(F.lit("area").alias("uuid"), F.concat_ws("_", "col", "row").alias("chunk_id"), (F.col("col") * size).alias("col_px"), (F.col("row") * size).alias("row_px"), F.lit(size).alias("w_px"), F.lit(size).alias("h_px"))
        fields[size] = checkpointed(embed_blob(windows, one, loader, patch_px, 2.0))
    centres = vectors.spherical_kmeans(fields[reference].withColumn("key", F.col("row") * extent + F.col("col")), clusters, "vec", "key").tolist() if clusters else None
    out = None
    for size in sizes:
        row = vectors.drift(fields[size], fields[reference], ["row", "col"])
        if centres:
            named = [vectors.assign(fields[s], list(enumerate(centres))) for s in (size, reference)]
            row = row.withColumn("disagreement", F.lit(vectors.disagreement(*named, ["row", "col"]).first().disagreement))
        row = row.withColumn("size", F.lit(size))
        out = row if out is None else out.union(row)
    return out
