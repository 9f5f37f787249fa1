"""Arithmetic around page images: sizes, slice grids, placeholders, token bounds. No pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCALE, PATCH, MAX_SLICES = 448, 14, 9
MIN_SIDE, BASE_DPI = 1500, 300


def render_dpi(width: Column, height: Column) -> Column:
    """300, raised where a side is under 1500 pixels."""
    small = (width < MIN_SIDE) | (height < MIN_SIDE)
    return F.when(small, F.floor(F.lit(float(MIN_SIDE * MIN_SIDE)) / (width * height) * BASE_DPI)).otherwise(F.lit(BASE_DPI)).cast("long")


def to_multiple(length: Column, step) -> Column:
    """The nearest positive multiple; halves go to the even one."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.greatest(F.bround(length.cast("double") / step, 0) * step, step.cast("double")).cast("long")


def best_resize(width: Column, height: Column, upscale: bool = False, scale: int = SCALE, patch: int = PATCH) -> Column:
    """(w, h) of about scale x scale pixels in the image's ratio, sides in patches."""
    width, height = width.cast("double"), height.cast("double")
    ratio = width / height
    h = F.floor(F.lit(float(scale)) / F.sqrt(ratio)).cast("double")
    w = F.floor(h * ratio).cast("double")
    change = F.lit(True) if upscale else width * height > scale * scale
    return F.struct(to_multiple(F.when(change, w).otherwise(width), patch).alias("w"), to_multiple(F.when(change, h).otherwise(height), patch).alias("h"))


def refine_size(width: Column, height: Column, grid_x: Column, grid_y: Column, upscale: bool = True, scale: int = SCALE, patch: int = PATCH) -> Column:
    cell = best_resize(to_multiple(width, grid_x) / grid_x, to_multiple(height, grid_y) / grid_y, upscale, scale, patch)
    return F.struct((cell.w * grid_x).alias("w"), (cell.h * grid_y).alias("h"))


def slice_count(width: Column, height: Column, most: int = MAX_SLICES, scale: int = SCALE) -> Column:
    return F.least(F.ceil(width.cast("double") * height / (scale * scale)), F.lit(most)).cast("int")


def slice_grid(width: Column, height: Column, most: int = MAX_SLICES, scale: int = SCALE) -> Column:
    """(x, y) of the slice grid nearest to the image's ratio; null where no slicing is needed.

    Grids have one slice less, as many, or one more than the area asks for; of equal ones the first wins.
    """
    n = slice_count(width, height, most, scale)
    log_ratio = F.ln(width.cast("double") / height)
    # All grids there can be, in the order of count then columns; the wanted counts are picked by row.
    grids = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(k // x).alias("y")) for k in range(2, most + 1) for x in range(1, k + 1) if k % x == 0])
    near = F.filter(grids, lambda g: F.abs(g.k - n) <= 1)
    rated = F.transform(near, lambda g, i: F.struct(F.abs(log_ratio - F.ln(g.x.cast("double") / g.y)).alias("error"), i.alias("i"), g.x.alias("x"), g.y.alias("y")))
    best = F.array_min(rated)
    return F.when(n > 1, F.struct(best.x.alias("x"), best.y.alias("y")))


def patch_boxes(width: Column, height: Column, grid_x: Column, grid_y: Column) -> Column:
    """Boxes (left, top, right, bottom), row by row; a remainder that a side leaves makes boxes of its own."""
    dx, dy = F.floor(width / grid_x).cast("int"), F.floor(height / grid_y).cast("int")
    tops, lefts = F.sequence(F.lit(0), height.cast("int") - 1, dy), F.sequence(F.lit(0), width.cast("int") - 1, dx)
    return F.flatten(F.transform(tops, lambda t: F.transform(lefts, lambda s: F.struct(s.alias("left"), t.alias("top"), (s + dx).alias("right"), (t + dy).alias("bottom")))))


def grid_placeholder(grid_x: Column, grid_y: Column, queries: int = 64, image=("<image>", "</image>"), slices=("<slice>", "</slice>"), unknown: str = "<unk>") -> Column:
    row = F.repeat(F.lit(image[0] + unknown * queries + image[1]), grid_x)
    return F.concat(F.lit(slices[0]), F.array_join(F.array_repeat(row, grid_y), "\n"), F.lit(slices[1]))


def pad_right(ids: Column, length: Column, value: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def attention_mask(ids: Column, length: Column) -> Column:
    return pad_right(F.transform(ids, lambda _: F.lit(1)), length)


def image_bounds(ids: Column, start_id: int, end_id: int, most: int | None = None) -> Column:
    """(start, end) of image tokens: after each start mark, up to its end mark; pairs by order."""
    ids = F.slice(ids, 1, most) if most else ids
    at = lambda value, shift: F.filter(F.transform(ids, lambda x, i: F.when(x == value, i + shift)), lambda x: x.isNotNull())
    starts, ends = at(start_id, 1), at(end_id, 0)
    n = F.greatest(F.size(starts), F.size(ends))
    return F.filter(F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.get(starts, i).alias("start"), F.get(ends, i).alias("end"))), lambda p: p.start.isNotNull() & p.end.isNotNull())


def clean_ids(ids: Column, bos: int, eos: int) -> Column:
    """Zeros gone, then a leading bos and a trailing eos."""
    kept = F.filter(ids, lambda x: x != 0)
    kept = F.when(F.get(kept, F.lit(0)) == bos, F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    return F.when(F.element_at(F.concat(F.array(F.lit(-1)), kept), -1) == eos, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
