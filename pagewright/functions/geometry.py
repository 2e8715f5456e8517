"""Page layout, scaling and orientation as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page size in points, margin, and the caption's band.
LONG_EDGE, SHORT_EDGE, MARGIN, CAPTION_BAND = 792, 612, 24, 22


def page_layout(width: Column, height: Column, has_caption: Column) -> Column:
    """Page size and where the image is drawn: landscape if at least as wide as high, centred above the caption's band.

    Images are scaled to fit, up or down."""
    wide = width >= height
    page_w, page_h = F.when(wide, LONG_EDGE).otherwise(SHORT_EDGE), F.when(wide, SHORT_EDGE).otherwise(LONG_EDGE)
    band = F.when(has_caption, CAPTION_BAND).otherwise(0)
    room_w, room_h = page_w - 2 * MARGIN, page_h - 2 * MARGIN - band
    scale = F.least(room_w / width, room_h / height)
    draw_w, draw_h = width * scale, height * scale
    return F.struct(
        page_w.alias("page_w"), page_h.alias("page_h"), (MARGIN + (room_w - draw_w) / 2).alias("draw_x"),
        (MARGIN + band + (room_h - draw_h) / 2).alias("draw_y"), draw_w.alias("draw_w"), draw_h.alias("draw_h"),
    )


def bounded(width: Column, height: Column, edge: Column) -> Column:
    """Pixel size within edge x edge, kept if it fits already; halves go up, at least 1."""
    factor = F.least(F.lit(1.0), edge / F.greatest(width, height))
    fit = lambda v: F.greatest(F.lit(1), F.floor(v * factor + 0.5)).cast("int")
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def orientation_of_turn(turn: Column) -> Column:
    """The orientation code that a clockwise turn of 0, 90, 180 or 270 degrees is."""
    return F.when(turn == 90, 6).when(turn == 180, 3).when(turn == 270, 8).otherwise(1)


def oriented(x: Column, y: Column, width: Column, height: Column, code: Column) -> Column:
    """Where a stored pixel of a width x height image stands after orientation code 1..8, and the size then."""
    right, low = width - 1 - x, height - 1 - y
    swaps = code.between(5, 8)
    nx = F.when(code.isin(2, 3), right).when(code.isin(5, 8), y).when(code.isin(6, 7), low).otherwise(x)
    ny = F.when(code.isin(3, 4), low).when(code.isin(5, 6), x).when(code.isin(7, 8), right).otherwise(y)
    return F.struct(nx.alias("x"), ny.alias("y"), F.when(swaps, height).otherwise(width).alias("width"), F.when(swaps, width).otherwise(height).alias("height"))


#: The orientation code of a quarter-turn count (0..3, anticlockwise) without and with a mirror axis (0, 1).
TURN_AND_MIRROR = {None: (1, 8, 3, 6), 0: (4, 5, 2, 7), 1: (2, 7, 4, 5)}


def orientation_of_boxes(angle: Column, axis: Column) -> Column:
    """The orientation code of a container's rotation and mirror boxes; a missing box does nothing."""
    turn = F.coalesce(angle, F.lit(0)) + 1
    rows = {k: F.array(*[F.lit(v) for v in codes]) for k, codes in TURN_AND_MIRROR.items()}
    return F.when(axis.isNull(), F.element_at(rows[None], turn)).when(axis == 0, F.element_at(rows[0], turn)).otherwise(F.element_at(rows[1], turn))


def flattened(channel: Column, alpha: Column) -> Column:
    """A channel over white, halves up."""
    return F.floor((channel * alpha + 255 * (255 - alpha)) / 255 + 0.5).cast("int")


def unpremultiplied(channel: Column, alpha: Column) -> Column:
    return F.when(alpha.isin(0, 255), channel).otherwise(F.least(F.lit(255), F.floor(channel * 255 / alpha + 0.5))).cast("int")


def rescaled(sample: Column, most: Column) -> Column:
    """A sample of 0..most as 0..255, halves up."""
    return F.floor(sample * 255 / most + 0.5).cast("int")


def five_to_eight(v: Column) -> Column:
    return F.shiftleft(v, 3).bitwiseOR(F.shiftright(v, 2))
