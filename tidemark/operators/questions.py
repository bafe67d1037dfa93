"""Questions and answers about images: captions, plain questions, and points as location tokens.

Every choice is a digest of a seed and the image's key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import hashing

#: Requests for a caption.
CAPTION_PROMPTS = [
    "Caption the image.",
    "Give a short caption.",
    "Provide a brief description.",
    "What is shown?",
    "Summarize the image in a few words.",
    "Describe it concisely.",
    "One-sentence caption, please.",
    "Give a minimal caption.",
    "What's happening?",
    "A short description.",
    "Describe this briefly.",
    "Caption in one phrase.",
    "What is depicted?",
    "Label the image content.",
    "Provide a simple caption.",
    "In a few words, what is this?",
    "Write a concise caption.",
    "What does the picture show?",
    "Give a very short image description.",
    "Provide a compact caption.",
]
#: Location tokens on each axis, and the most points of an answer.
LOCATIONS, MOST_POINTS = 1024, 20


def sample_id(kind: str, *parts: Column) -> Column:
    """``kind_part_part``; null parts count as empty."""
    return F.concat_ws("_", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def caption_sample(image: Column, captions: Column, seed: int) -> tuple[Column, Column]:
    """A request and one of the image's captions; the caption is null where there is none."""
    prompts = F.array(*[F.lit(p) for p in CAPTION_PROMPTS])
    return hashing.choose(f"{seed}prompt", image, prompts), hashing.choose(f"{seed}caption", image, captions)


def point_prompt(image: Column, label: Column, templates: list[tuple[str, str]], seed: int) -> Column:
    """One of the templates (before, after) around the label."""
    whole = F.array(*[F.concat(F.lit(a), label, F.lit(b)) for a, b in templates])
    return hashing.choose(f"{seed}point", image, whole)


def points_text(points: Column, scale: float = 1.0, most: int = MOST_POINTS) -> Column:
    """The first ``most`` points (x, y) as location tokens, y before x, ordered by x and y; "" for none.

    Coordinates up to ``scale`` become hundredths with one decimal, then tokens, rounding halves to even.
    """
    tenth = lambda v: F.rint(v * (100.0 / scale) * 10.0) / 10.0
    scaled = F.transform(F.slice(points, 1, most), lambda p, i: F.struct((tenth(p["x"]) * 10000.0 + tenth(p["y"])).alias("k"), i.alias("i"), tenth(p["x"]).alias("x"), tenth(p["y"]).alias("y")))
    token = lambda v: F.format_string("<loc%04d>", F.rint(v / 100.0 * float(LOCATIONS - 1)).cast("int"))
    return F.array_join(F.transform(F.array_sort(scaled), lambda p: F.concat(token(p["y"]), token(p["x"]))), "")
