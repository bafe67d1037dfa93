"""Bounding boxes as location tokens, letterboxing and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 1024


def loc_token(x: Column, bins: int = BINS) -> Column:
    """``<loc0123>`` of a coordinate from 0 to 1, halves to even."""
    return F.concat(F.lit("<loc"), F.lpad(F.bround(x * (bins - 1), 0).cast("int").cast("string"), 4, "0"), F.lit(">"))


def box_tokens(x0: Column, y0: Column, x1: Column, y1: Column, bins: int = BINS) -> Column:
    return F.concat(*[loc_token(c, bins) for c in (y0, x0, y1, x1)])


def token_values(tokens: Column) -> Column:
    """The integers of all location tokens in a text, in order."""
    return F.transform(F.regexp_extract_all(tokens, F.lit(r"<loc(\d{4})>"), 1), lambda x: x.cast("int"))


def rotate_tokens(tokens: Column, bins: int = BINS) -> Column:
    """A box's tokens after the image is turned by 180 degrees; an empty text stays empty."""
    v = token_values(tokens)
    turned = [F.lit(bins - 1) - F.get(v, F.lit(k)) for k in (2, 3, 0, 1)]
    held = [F.least(F.greatest(t, F.lit(0)), F.lit(bins - 1)) for t in turned]
    made = F.concat(*[F.concat(F.lit("<loc"), F.lpad(t.cast("string"), 4, "0"), F.lit(">")) for t in held])
    return F.when(F.length(tokens) == 0, tokens).otherwise(made)


def letterbox(x: Column, y: Column, width: Column, height: Column, to_width: int, to_height: int) -> list[Column]:
    """Where a point of an image lands when the image is fitted into a frame with bars."""
    ratio = F.greatest(width / F.lit(float(to_width)), height / F.lit(float(to_height)))
    out = []
    for v, size, to in ((x, width, to_width), (y, height, to_height)):
        inner = F.floor(size / ratio)
        moved = v * (inner / to) + (F.lit(float(to)) - inner) / 2.0 / to
        out.append(F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0)))
    return out


def direction(x0: Column, y0: Column, x1: Column, y1: Column, slope: float = 2.0, prefix: str = "") -> Column:
    """Where a box's centre lies from the image's centre, one of eight words."""
    x, y = (x0 + x1) / 2.0 - 0.5, 0.5 - (y0 + y1) / 2.0
    diagonal = F.concat(F.when(x < 0, "left").otherwise("right"), F.lit(" and "), F.when(y >= 0, "forward").otherwise("back"))
    word = F.when(y > slope * F.abs(x), "forward").when(y < -slope * F.abs(x), "back")
    word = word.when(x > F.abs(y) / slope, "right").when(x < -F.abs(y) / slope, "left").otherwise(diagonal)
    return F.concat(F.lit(prefix), word) if prefix else word


def rotate_direction(words: Column) -> Column:
    """Left for right and forward for back, and the other way round, in any text of them."""
    for a, b in (("left", "right"), ("forward", "back")):
        words = F.regexp_replace(words, rf"\b{a}\b", "\x01")
        words = F.regexp_replace(words, rf"\b{b}\b", a)
        words = F.regexp_replace(words, "\x01", b)
    return words


def caption(objects: Column) -> Column:
    """``tokens label ; tokens label`` of an array of struct<label, loc>."""
    return F.array_join(F.transform(objects, lambda o: F.concat(o["loc"], F.lit(" "), o["label"])), " ; ")


def prompt_labels(objects: Column) -> Column:
    """The labels once each, in order of first use."""
    return F.array_join(F.array_distinct(F.transform(objects, lambda o: o["label"])), ", ")
