"""Resolution policy, affine arithmetic, padding and small numeric helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolution thresholds in metres a pixel, the model's patch in pixels.
HIGH_RES, MED_RES, MODEL_PATCH = 0.07, 0.15, 16
# Mean and standard deviation of satellite RGB, of values 0..1.
RGB_MEAN, RGB_STD = (0.430, 0.411, 0.296), (0.213, 0.156, 0.143)
# A model for graphics memory of this many GB and more, and one below.
LARGE_GB, LARGE_MODEL, SMALL_MODEL = 40.0, "vit7b16", "vitl16"
LARGE_DIM, SMALL_DIM = 4096, 1024


def activity_params(native_res: Column, high_res: Column | bool = False) -> dict[str, Column]:
    """patch_size, upsample and embed_gsd; a resolution equal to a threshold is in the coarser class."""
    high = high_res if isinstance(high_res, Column) else F.lit(high_res)
    patch = F.when(native_res < HIGH_RES, 1024).when(native_res < MED_RES, 512).otherwise(256)
    factor = F.when(native_res < HIGH_RES, 1).when(native_res < MED_RES, 2).otherwise(4)
    upsample = F.when(high, factor * 2).otherwise(factor)
    return {"patch_size": patch, "upsample": upsample, "embed_gsd": native_res * MODEL_PATCH / upsample}


def pixel_to_world(affine: Column, col: Column, row: Column) -> tuple[Column, Column]:
    """x and y of a pixel corner under ``[px, sx, ox, sy, py, oy]``."""
    a = [F.get(affine, i) for i in range(6)]
    return a[2] + col * a[0] + row * a[1], a[5] + col * a[3] + row * a[4]


def world_to_pixel(affine: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse, for affines without shear."""
    return (x - F.get(affine, 2)) / F.get(affine, 0), (y - F.get(affine, 5)) / F.get(affine, 4)


def pixel_box_to_world(affine: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """The axis-parallel world box of a pixel rectangle, from its four corners."""
    corners = [pixel_to_world(affine, c, r) for c, r in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return {"xmin": F.least(*xs), "ymin": F.least(*ys), "xmax": F.greatest(*xs), "ymax": F.greatest(*ys)}


def inset_box(affine: Column, col: Column, row: Column, w: Column, h: Column, inset: float = 0.5) -> dict[str, Column]:
    """The world box of a window, half a pixel in from its edges."""
    x0, y1 = pixel_to_world(affine, col + inset, row + inset)
    x1, y0 = pixel_to_world(affine, col + w - inset, row + h - inset)
    return {"xmin": F.least(x0, x1), "ymin": F.least(y0, y1), "xmax": F.greatest(x0, x1), "ymax": F.greatest(y0, y1)}


def tile_box(affine: Column, w: Column, h: Column) -> dict[str, Column]:
    """(ox, oy + h*py, ox + w*px, oy)"""
    ox, oy, px, py = (F.get(affine, i) for i in (2, 5, 0, 4))
    return {"xmin": ox, "ymin": oy + h * py, "xmax": ox + w * px, "ymax": oy}


def native_res(affine: Column) -> Column:
    return F.greatest(F.abs(F.get(affine, 0)), F.abs(F.get(affine, 4)))


def patch_centre(low: Column, high: Column, index: Column, n: Column | int) -> Column:
    """Centre of the index-th of n equal parts, from the low end."""
    return low + (index + F.lit(0.5)) / n * (high - low)


def patch_centre_from_top(low: Column, high: Column, index: Column, n: Column | int) -> Column:
    """Row 0 is the northernmost."""
    return high - (index + F.lit(0.5)) / n * (high - low)


def padding(size: Column, multiple: Column | int) -> Column:
    return F.pmod(-size, F.lit(multiple) if isinstance(multiple, int) else multiple)


def window_target(width: Column, height: Column, patch: Column) -> Column:
    """The smallest multiple of the patch that covers the longer side."""
    return (F.ceil(F.greatest(width, height) / patch) * patch).cast("int")


def standardise(value: Column, band: int) -> Column:
    return (value / F.lit(255.0) - F.lit(RGB_MEAN[band])) / F.lit(RGB_STD[band])


def human_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.format_string("%.1f GB", n / 1024.0**3)
    for power, unit in ((2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power)).otherwise(out)
    return out


def model_for(vram_gb: Column) -> Column:
    """Null stands for a machine without a graphics card."""
    return F.when(vram_gb >= LARGE_GB, LARGE_MODEL).otherwise(SMALL_MODEL)


def stretch(value: Column, low: Column, high: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low + eps)))
