"""Boxes, sizes, confidences and dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill.config import DEFAULT, Config


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def valid_bbox(box: Column) -> Column:
    """Four integers with x1 < x2 and y1 < y2."""
    return F.coalesce((F.size(box) == 4) & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3))), F.lit(False))


def parsed_bbox(values: Column) -> Column:
    """array<int> of four integers from strings; integral decimals count, anything else is no box."""
    whole = F.transform(values, lambda v: F.when(v.rlike(r"^-?\d+(\.0+)?$"), F.floor(F.try_to_number(v, F.lit("S9999999.9999"))).cast("int")))
    ok = (F.size(values) == 4) & ~F.exists(whole, lambda v: v.isNull())
    return F.when(ok, whole)


def scale_bbox(box: Column, source: Column, actual: Column) -> Column:
    """A box from source (w, h) to actual (w, h): outwards to whole pixels, inside the image, one pixel at least."""

    def axis(low: int, high: int, k: int) -> tuple[Column, Column]:
        size = actual[k]
        ratio = size / source[k]
        a = F.greatest(F.lit(0), F.least(F.floor(box[low] * ratio), size - 1))
        b = F.greatest(F.lit(1), F.least(F.ceil(box[high] * ratio), size))
        return a.cast("int"), F.when(b <= a, F.least(size, a + 1)).otherwise(b).cast("int")

    x1, x2 = axis(0, 2, 0)
    y1, y2 = axis(1, 3, 1)
    return F.array(x1, y1, x2, y2)


def scale_bbox_cut(box: Column, source: Column, actual: Column) -> Column:
    """Like scale_bbox, but cut to whole pixels; null if nothing is left."""

    def at(k: int, of: int) -> Column:
        return F.greatest(F.lit(0), F.least((box[k] * (actual[of] / F.greatest(F.lit(1), source[of]))).cast("int"), actual[of]))

    x1, y1, x2, y2 = at(0, 0), at(1, 1), at(2, 0), at(3, 1)
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def upscaled(width: Column, height: Column, config: Config = DEFAULT) -> Column:
    """struct(width, height, upscaled): small images grow to the least width and height, halves to even."""
    small = (width < config.min_width) | (height < config.min_height)
    scale = F.greatest(F.lit(config.min_width) / width, F.lit(config.min_height) / height)
    grown = lambda n: F.when(small, F.bround(n * scale).cast("int")).otherwise(n)
    return F.struct(grown(width).alias("width"), grown(height).alias("height"), small.alias("upscaled"))


def crop_fault(c: dict[str, Column], config: Config = DEFAULT) -> Column:
    """The first rule that a crop breaks, null if none. c has bbox, original_w, original_h, crop_w, crop_h, original_sha256, crop_sha256 and ratio (the configured share)."""
    box, w, h, cw, ch = c["bbox"], c["original_w"], c["original_h"], c["crop_w"], c["crop_h"]
    x1, y1, x2, y2 = (F.get(box, F.lit(k)) for k in range(4))
    sha = F.trim(F.coalesce(c["original_sha256"], F.lit("")))
    ratio = F.when(c["ratio"].isNull() | (c["ratio"] <= 0), F.lit(config.max_crop_ratio)).otherwise(F.least(c["ratio"], F.lit(config.max_crop_ratio)))
    rules = [
        (box.isNull(), "missing_bbox"), (F.size(box) != 4, "invalid_bbox"), ((x2 <= x1) | (y2 <= y1), "zero_area"),
        ((w <= 0) | (h <= 0), "invalid_original"), ((cw <= 0) | (ch <= 0), "invalid_crop"),
        (cw != x2 - x1, "width_mismatch"), (ch != y2 - y1, "height_mismatch"), ((cw > w) | (ch > h), "exceeds_original"),
        ((x1 <= 0) & (y1 <= 0) & (x2 >= w) & (y2 >= h), "full_image"),
        (cw.cast("double") * ch / (w.cast("double") * h) >= ratio, "too_large"),
        (sha == "", "missing_hash"), (~sha.rlike("^[0-9a-fA-F]{64}$"), "invalid_hash"), (c["crop_sha256"] == c["original_sha256"], "identical"),
    ]
    fault = F.when(*rules[0])
    for condition, name in rules[1:]:
        fault = fault.when(condition, name)
    return fault


def image_size(data: Column) -> Column:
    """struct(width, height) from the header of PNG or GIF bytes, null for others."""

    def number(start: int, n: int, little: bool) -> Column:
        parts = [F.conv(F.hex(F.substring(data, start + k, 1)), 16, 10).cast("int") for k in range(n)]
        shifts = range(n) if little else range(n - 1, -1, -1)
        total = F.lit(0)
        for part, s in zip(parts, shifts, strict=True):
            total = total + part * (1 << 8 * s)
        return total

    head = F.hex(F.substring(data, 1, 16))
    png = head.startswith("89504E470D0A1A0A") & (F.substring(head, 25, 8) == "49484452") & (F.octet_length(data) >= 24)
    gif = F.substring(head, 1, 12).isin("474946383761", "474946383961") & (F.octet_length(data) >= 10)
    return F.when(png, F.struct(number(17, 4, False).alias("width"), number(21, 4, False).alias("height"))).when(
        gif, F.struct(number(7, 2, True).alias("width"), number(9, 2, True).alias("height"))
    )


def reference_confidence(first: Column, second: Column, usable: Column, config: Config = DEFAULT) -> Column:
    """struct(confidence, margin) from the two best scores; without a second the margin is full if the first is usable."""
    span = config.score_max - config.score_min
    margin = F.when(second.isNotNull(), first - second).when(usable, F.lit(span)).otherwise(F.lit(0.0))
    value = clamp01(0.7 * clamp01((first - config.score_min) / span) + 0.3 * clamp01(margin / span))
    return F.struct(F.when(first.isNull(), 0.0).otherwise(value).alias("confidence"), F.when(first.isNull(), 0.0).otherwise(margin).alias("margin"))


def confidence_band(x: Column) -> Column:
    x = F.coalesce(x, F.lit(0.0))
    return F.when(x >= 0.8, "HIGH").when(x >= 0.5, "MEDIUM").otherwise("LOW")


def clean_confidence(value: Column, text: Column) -> Column:
    """A number from 0 to 1, else null; 0 with an empty text is null too."""
    c = value.cast("string").try_cast("double")
    return F.when(c.between(0.0, 1.0) & ~((c == 0) & (F.coalesce(text, F.lit("")) == "")), c)


def first_finite(*values: Column) -> Column:
    return F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in values])


def month_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def not_expired(created: Column, now: Column, config: Config = DEFAULT) -> Column:
    """Rows younger than the expiry; without a readable date they never expire."""
    return created.isNull() | (created >= now - F.expr(f"interval {config.expiry_days} days"))
