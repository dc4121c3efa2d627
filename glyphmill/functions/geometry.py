"""Boxes: structs of integer corners x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import let


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes without area."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    whole = width(a) * height(a) + width(b) * height(b) - w * h
    return F.when(whole > 0, w * h / whole).otherwise(0.0)


def clamp(b: Column, page_width: Column, page_height: Column, padding: int = 5) -> Column:
    """The box with a margin, inside its page; null where nothing is left."""
    out = box(F.greatest(F.lit(0), b["x1"] - padding), F.greatest(F.lit(0), b["y1"] - padding), F.least(page_width, b["x2"] + padding), F.least(page_height, b["y2"] + padding))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def from_thousandths(b: Column, page_width: Column, page_height: Column) -> Column:
    """Pixels of a box given in thousandths of the page."""
    return box(b["x1"] / 1000 * page_width, b["y1"] / 1000 * page_height, b["x2"] / 1000 * page_width, b["y2"] / 1000 * page_height)


def from_centre(cx: Column, cy: Column, w: Column, h: Column, ratio: Column, pad_x: Column, pad_y: Column, page_width: Column, page_height: Column) -> Column:
    """Corners of a detector's centre box, without its letterbox, inside the page."""
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most, v.cast("int")))
    return box(inside((cx - w / 2 - pad_x) / ratio, page_width), inside((cy - h / 2 - pad_y) / ratio, page_height), inside((cx + w / 2 - pad_x) / ratio, page_width), inside((cy + h / 2 - pad_y) / ratio, page_height))


def from_corner_size(b: Column) -> Column:
    """Corners of [x, y, width, height] arrays."""
    return box(b[0], b[1], b[0] + b[2], b[1] + b[3])


def letterbox(page_width: Column, page_height: Column, target: int = 640, stride: int = 32) -> Column:
    """struct(ratio, width, height, pad_x, pad_y): the scale and margins with which a page fits a square whose padding is the least multiple of the stride."""
    ratio = F.least(target / page_height, target / page_width)
    w, h = F.bround(page_width * ratio).cast("int"), F.bround(page_height * ratio).cast("int")
    return F.struct(ratio.alias("ratio"), w.alias("width"), h.alias("height"), (F.pmod(target - w, F.lit(stride)) / 2).alias("pad_x"), (F.pmod(target - h, F.lit(stride)) / 2).alias("pad_y"))


def stride_padded(size: Column, stride: int = 32) -> Column:
    return (F.ceil(size / stride) * stride).cast("int")


def resolution_scale(page_height: Column, target_height: int | None = None, dpi: Column | None = None, target_dpi: int = 300) -> Column:
    """The factor for low resolutions; 1 where it would change less than a tenth."""
    if target_height is not None:
        scale = target_height / page_height
    else:
        scale = F.when(page_height < 100, target_dpi / 72).when(page_height < 200, 1.5).otherwise(1.0)
        if dpi is not None:
            scale = F.when(dpi.isNotNull(), target_dpi / dpi).otherwise(scale)
    return F.when(F.abs(scale - 1.0) < 0.1, 1.0).otherwise(scale)


def big_enough(b: Column, least_width: float = 5, least_height: float = 5) -> Column:
    return (width(b) > least_width) & (height(b) > least_height)


def detector_label(cls: Column, b: Column, page_width: int, page_height: int) -> Column:
    """A label line: class, centre and size in shares of the page, six decimals."""
    shares = (center_x(b) / page_width, center_y(b) / page_height, width(b) / page_width, height(b) / page_height)
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, *[F.bround(x, 6) for x in shares])  # ties to even, as in C


def scaled_traces(traces: Column, target: int = 256, margin: int = 20) -> Column:
    """struct(traces, width): pen points moved to the margin and scaled so that the writing fits the height."""
    xs = F.flatten(F.transform(traces, lambda t: F.transform(t, lambda p: p["x"])))
    ys = F.flatten(F.transform(traces, lambda t: F.transform(t, lambda p: p["y"])))
    frame = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), ((target - 2 * margin) / F.greatest(F.array_max(ys) - F.array_min(ys), F.lit(1.0))).alias("k"))

    def moved(s: Column) -> Column:
        f = s["f"]
        point = lambda p: F.struct(((p["x"] - f["x"]) * f["k"] + margin).alias("x"), ((p["y"] - f["y"]) * f["k"] + margin).alias("y"))
        return F.struct(F.transform(s["t"], lambda t: F.transform(t, point)).alias("traces"), (f["w"] * f["k"] + 2 * margin).cast("int").alias("width"))

    return let(F.struct(traces.alias("t"), frame.alias("f")), moved)
