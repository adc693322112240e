"""Column functions on quadrilaterals: eight DOUBLE columns tl_x ... br_y, normalised, y growing upward."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("tl", "tr", "bl", "br")


def xs(p: str = "") -> list[Column]:
    return [F.col(f"{p}{c}_x") for c in CORNERS]


def ys(p: str = "") -> list[Column]:
    return [F.col(f"{p}{c}_y") for c in CORNERS]


def rotation_angle(p: str = "") -> Column:
    """Of the top edge, in radians."""
    return F.atan2(F.col(f"{p}tr_y") - F.col(f"{p}tl_y"), F.col(f"{p}tr_x") - F.col(f"{p}tl_x"))


def width(p: str = "") -> Column:
    """Length of the top edge."""
    return F.hypot(F.col(f"{p}tr_x") - F.col(f"{p}tl_x"), F.col(f"{p}tr_y") - F.col(f"{p}tl_y"))


def height(p: str = "") -> Column:
    """Length of the left edge."""
    return F.hypot(F.col(f"{p}tl_x") - F.col(f"{p}bl_x"), F.col(f"{p}tl_y") - F.col(f"{p}bl_y"))


def center_y(p: str = "") -> Column:
    tl, tr, bl, br = ys(p)
    return (tl + tr + bl + br) / 4.0


def box(p: str = "") -> tuple[Column, Column, Column, Column]:
    """Least and greatest x and y over the corners."""
    return F.least(*xs(p)), F.greatest(*xs(p)), F.least(*ys(p)), F.greatest(*ys(p))


def iou(a: str, b: str) -> Column:
    """Overlap of two quads' boxes over their union; 0 without positive overlap or union."""
    ax0, ax1, ay0, ay1 = box(a)
    bx0, bx1, by0, by1 = box(b)
    w = F.least(ax1, bx1) - F.greatest(ax0, bx0)
    h = F.least(ay1, by1) - F.greatest(ay0, by0)
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(F.lit(0.0))


def deskewed_x(x: Column, y: Column, skew: Column) -> Column:
    """x after turning by -skew about (0.5, 0.5), in normalised space."""
    return F.lit(0.5) + (x - 0.5) * F.cos(-skew) - (y - 0.5) * F.sin(-skew)


def deskewed_range(skew: Column, p: str = "") -> tuple[Column, Column]:
    turned = [deskewed_x(x, y, skew) for x, y in zip(xs(p), ys(p))]
    return F.least(*turned), F.greatest(*turned)


def deskewed_center(skew: Column, p: str = "") -> Column:
    (a, b, c, d), (e, f, g, h) = xs(p), ys(p)
    return deskewed_x((a + b + c + d) / 4.0, (e + f + g + h) / 4.0, skew)


def fit(canvas_w, canvas_h, pixel_w, pixel_h, scale) -> Column:
    """Geometry of an image set into the middle of a canvas as large as it fits: width, height, scale, draw_x, draw_y, draw_w, draw_h."""
    cw, ch, s = (F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double") for x in (canvas_w, canvas_h, scale))
    iw, ih = pixel_w / s, pixel_h / s
    f = F.least(cw / iw, ch / ih)
    return F.struct(
        cw.alias("width"),
        ch.alias("height"),
        s.alias("scale"),
        ((cw - iw * f) / 2).alias("draw_x"),
        ((ch - ih * f) / 2).alias("draw_y"),
        (iw * f).alias("draw_w"),
        (ih * f).alias("draw_h"),
    )


def identity(page_w: Column, page_h: Column, scale: Column) -> Column:
    """Geometry of a page that fills its canvas."""
    return fit(page_w, page_h, page_w * scale, page_h * scale, scale)


def mapped(x: Column, y: Column, geometry: Column) -> tuple[Column, Column]:
    """A normalised point in page points."""
    g = geometry
    return g["draw_x"] + x * g["draw_w"], g["draw_y"] + y * g["draw_h"]


def mapped_quad(geometry: Column, p: str = "") -> dict[str, Column]:
    out: dict[str, Column] = {}
    for c, x, y in zip(CORNERS, xs(p), ys(p)):
        out[f"{c}_x"], out[f"{c}_y"] = mapped(x, y, geometry)
    return out


def split_scale(page_w: Column, page_h: Column, scale: Column, limit: float = 1.05) -> Column:
    """Scale of a page whose halves, if it lies landscape, fit a canvas of 595 by 842 points."""
    half = F.when(page_w > page_h * limit, page_w / 2).otherwise(page_w)
    return scale * F.least(F.lit(595.0) / half, F.lit(842.0) / page_h)


def canvas(page_w: Column, page_h: Column, rotation: Column, limit: float = 1.05) -> Column:
    """Canvas of an unsplit page: turned dimensions, on 842 by 595 when landscape, else 595 by 842."""
    turned = rotation % 180 != 0
    w = F.when(turned, page_h).otherwise(page_w)
    h = F.when(turned, page_w).otherwise(page_h)
    wide = w > h * limit
    return F.struct(F.when(wide, 842.0).otherwise(595.0).alias("canvas_w"), F.when(wide, 595.0).otherwise(842.0).alias("canvas_h"))


def needs_turn(angle: Column) -> Column:
    """Whether a rotation is large enough to be carried out."""
    return F.abs(angle) > 0.002
