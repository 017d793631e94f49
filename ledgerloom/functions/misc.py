"""Image sizes, the demo clock, identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2026-08-20 14:05 in Pakistan.
DEMO_NOW_S = 1_787_216_700
PATCH = 32


def demo_time(offset_min: Column) -> Column:
    return F.lit(DEMO_NOW_S) + offset_min * 60


def smart_resize(width: Column, height: Column, least: int = 56 * 56, most: int = 1280 * 28 * 28) -> Column:
    """struct(width, height): multiples of 32 (half-even), scaled so that the pixels stay within the bounds."""
    w, h = (F.greatest(F.lit(PATCH), F.bround(x / PATCH, 0).cast("int") * PATCH) for x in (width, height))
    area = width * height
    down, up = F.sqrt(area / float(most)), F.sqrt(F.lit(float(least)) / area)
    small = lambda x: F.greatest(F.lit(PATCH), F.floor(x / down / PATCH).cast("int") * PATCH)
    large = lambda x: F.ceil(x * up / PATCH).cast("int") * PATCH
    pick = lambda own, x: F.when(w * h > most, small(x)).when(w * h < least, large(x)).otherwise(own)
    return F.struct(pick(w, width).alias("width"), pick(h, height).alias("height"))


def image_tokens(size: Column) -> Column:
    return (size["width"] / PATCH * size["height"] / PATCH).cast("int")


def stable_id(name: Column) -> Column:
    """Version 5 UUID in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    at = lambda start, n: F.substring(digest, start, n)
    variant = F.lpad(F.lower(F.hex(F.conv(at(17, 2), 16, 10).cast("long").bitwiseAND(0x3F).bitwiseOR(0x80))), 2, "0")
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(19, 2), F.lit("-"), at(21, 12))


def mask_display(raw: Column, masked: Column) -> Column:
    return F.when(masked, F.concat(raw, F.lit("***"))).otherwise(raw)


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    return F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))
