"""Media that no built-in function reads, by Arrow batches: raw images and compressed number columns."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType


@F.pandas_udf(ArrayType(DoubleType()))
def decoded_floats(packed: pd.Series) -> pd.Series:
    """zlib-compressed little-endian 32-bit floats; null for nulls and broken data."""

    def one(raw):
        try:
            return None if raw is None else np.frombuffer(zlib.decompress(raw), dtype="<f4").astype(float)
        except (zlib.error, ValueError):
            return None

    return packed.map(one)


@F.pandas_udf(BinaryType())
def packed_floats(values: pd.Series) -> pd.Series:
    """What ``decoded_floats`` reads: 32-bit floats, little-endian, compressed; null for nulls."""
    return values.map(lambda v: None if v is None else zlib.compress(np.asarray(v, dtype="<f4").tobytes()))


def resized_with_bars(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An HxWxC image fitted into a frame by nearest pixels, centred, with black bars."""
    h, w = image.shape[:2]
    ratio = max(w / width, h / height)
    inner_h, inner_w = max(1, int(h / ratio)), max(1, int(w / ratio))
    rows = np.minimum((np.arange(inner_h) + 0.5) * h / inner_h, h - 1).astype(int)
    cols = np.minimum((np.arange(inner_w) + 0.5) * w / inner_w, w - 1).astype(int)
    out = np.zeros((height, width, image.shape[2]), dtype=image.dtype)
    top, left = (height - inner_h) // 2, (width - inner_w) // 2
    out[top : top + inner_h, left : left + inner_w] = image[rows][:, cols]
    return out


@F.pandas_udf(BinaryType())
def turned_and_resized(raw: pd.Series, shape: pd.Series, turn: pd.Series, to: pd.Series) -> pd.Series:
    """Raw uint8 pixels of shape [h, w, c], turned by 180 degrees where asked, fitted into [h, w]; null for nulls and wrong sizes."""

    def one(r, s, t, size):
        if r is None or s is None or len(r) != int(np.prod(s)):
            return None
        image = np.frombuffer(r, dtype=np.uint8).reshape([int(x) for x in s])
        return resized_with_bars(image[::-1, ::-1] if t else image, int(size[0]), int(size[1])).tobytes()

    return pd.Series([one(*x) for x in zip(raw, shape, turn, to, strict=True)])


@F.pandas_udf(BooleanType())
def has_pixels(raw: pd.Series) -> pd.Series:
    """Whether an image is there and not all black: a camera slot's mask."""
    return raw.map(lambda r: bool(r) and any(r))
