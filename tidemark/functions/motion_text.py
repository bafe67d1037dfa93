"""Motion as words and words as motion.

A move is dx, dy, dz in centimetres, roll, pitch, yaw in degrees and a gripper that is open from 0.5 on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for a positive and a negative value of each axis.
WORDS = {"dx": ("forward", "back"), "dy": ("left", "right"), "dz": ("up", "down"), "roll": ("tilt left", "tilt right"), "pitch": ("tilt back", "tilt forward"), "yaw": ("rotate counterclockwise", "rotate clockwise")}
#: Numbers as words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


@dataclass(frozen=True)
class Move:
    dx: Column
    dy: Column
    dz: Column
    gripper: Column
    roll: Column | None = None
    pitch: Column | None = None
    yaw: Column | None = None

    @property
    def turns(self) -> list[str]:
        return ["roll", "pitch", "yaw"] if self.roll is not None else []


def _signed(value: Column, words: tuple[str, str], render, hide: Column) -> Column:
    return F.when((value > 0) & ~hide, render(words[0])).when((value < 0) & ~hide, render(words[1]))


def _listed(parts: list[Column], empty: str, separator: str = ", ") -> Column:
    some = F.array_compact(F.array(*parts))
    return F.when(F.size(some) == 0, F.lit(empty)).otherwise(F.array_join(some, separator))


def nearest(value: Column, step: int) -> Column:
    """The nearest multiple of a step, halves to the even one."""
    return (F.bround(value / step, 0) * step).cast("int")


def gripper_words(g: Column) -> Column:
    return F.when(g >= 0.5, "open gripper").otherwise("close gripper")


def verbose(m: Move, decimals: int = 0, step: int = 10) -> Column:
    """``move forward 3 cm, move up 1 cm, move left 2 cm, open gripper``; zeros after rounding are left out."""
    parts = []
    for axis in ("dx", "dz", "dy"):
        v = getattr(m, axis)
        size = F.bround(F.abs(v), decimals)
        text = F.format_string(f"%.{decimals}f", size)
        parts.append(_signed(v, WORDS[axis], lambda w, t=text: F.concat(F.lit(f"move {w} "), t, F.lit(" cm")), size == 0))
    for axis in m.turns:
        v = getattr(m, axis)
        size = nearest(F.abs(v), step)
        parts.append(_signed(v, WORDS[axis], lambda w, s=size: F.concat(F.lit(f"{w} "), s.cast("string"), F.lit(" degrees")), size == 0))
    return _listed([*parts, gripper_words(m.gripper)], "no movement")


def without_numbers(m: Move) -> Column:
    """``move forward, move left, move up, open gripper``."""
    parts = [_signed(getattr(m, a), WORDS[a], lambda w: F.lit(f"move {w}"), F.bround(F.abs(getattr(m, a)), 0) == 0) for a in ("dx", "dy", "dz")]
    parts += [_signed(getattr(m, a), WORDS[a], F.lit, F.lit(False)) for a in m.turns]
    return _listed([*parts, gripper_words(m.gripper)], "no movement")


def compact(m: Move) -> Column:
    """``<+03 -02 +00 1>``, with turns to the nearest 5 degrees."""
    parts = [F.format_string("%+03d", F.bround(getattr(m, a), 0).cast("int")) for a in ("dx", "dy", "dz")]
    parts += [F.format_string("%+03d", nearest(getattr(m, a), 5)) for a in m.turns]
    return F.concat(F.lit("<"), F.concat_ws(" ", *parts, F.when(m.gripper >= 0.5, "1").otherwise("0")), F.lit(">"))


def bimanual(left: Column, right: Column, is_compact: bool = False) -> Column:
    """Both arms' texts as one."""
    if is_compact:
        inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
        return F.concat(F.lit("<L "), inner(left), F.lit(" R "), inner(right), F.lit(">"))
    return F.concat(F.lit("Left arm: "), left, F.lit(". Right arm: "), right)


def _size_word(v: Column, small: float, large: float, most: str) -> Column:
    return F.when(F.abs(v) < small, "slightly").when(F.abs(v) < large, "moderately").otherwise(most)


def qualitative(m: Move) -> Column:
    """``move slightly forward and moderately left, then open gripper``."""
    moves = []
    for axis, words in (("dx", ("forward", "backward")), ("dy", WORDS["dy"]), ("dz", WORDS["dz"])):
        v = getattr(m, axis)
        moves.append(F.when(F.abs(v) >= 0.5, F.concat_ws(" ", _size_word(v, 1.5, 5, "significantly"), F.when(v > 0, words[0]).otherwise(words[1]))))
    turns = [F.when(F.abs(getattr(m, a)) >= 5, F.concat_ws(" ", _size_word(getattr(m, a), 10, 30, "significantly"), F.when(getattr(m, a) > 0, WORDS[a][0]).otherwise(WORDS[a][1]))) for a in m.turns]
    some_moves, some_turns = F.array_compact(F.array(*moves)), F.array_compact(F.array(*turns)) if turns else F.array().cast("array<string>")
    said = F.when(F.size(some_moves) > 0, F.concat(F.lit("move "), F.array_join(some_moves, " and ")))
    turned = F.when(F.size(some_turns) > 0, F.array_join(some_turns, " and "))
    grip = gripper_words(m.gripper)
    return F.concat_ws(", ", said, turned, F.when(said.isNotNull() | turned.isNotNull(), F.concat(F.lit("then "), grip)).otherwise(grip))


def component(m: Move, decimals: int = 1) -> Column:
    """``translation: (3.0, 2.0, 0.0) cm; gripper: open gripper``."""
    show = lambda *axes: F.concat_ws(", ", *[(F.bround(getattr(m, a), decimals) + F.lit(0.0)).cast("string") for a in axes])
    parts = [F.concat(F.lit("translation: ("), show("dx", "dy", "dz"), F.lit(") cm"))]
    if m.turns:
        parts.append(F.concat(F.lit("rotation: ("), show(*m.turns), F.lit(") deg")))
    return F.concat_ws("; ", *parts, F.concat(F.lit("gripper: "), gripper_words(m.gripper)))


def as_json(m: Move, decimals: int = 1) -> Column:
    fields = [(F.bround(getattr(m, a), decimals) + F.lit(0.0)).alias(f"{a}_cm") for a in ("dx", "dy", "dz")]
    fields += [(F.bround(getattr(m, a), decimals) + F.lit(0.0)).alias(f"d{a}_deg") for a in m.turns]
    return F.to_json(F.struct(*fields, gripper_words(m.gripper).alias("gripper")))


def sentence(m: Move) -> Column:
    """``The robot moved forward by three centimeters and left by one centimeter while opening the gripper.``"""
    names = F.array(*[F.lit(n) for n in NUMBERS])
    parts = []
    for axis, words in (("dx", ("forward", "backward")), ("dy", WORDS["dy"]), ("dz", WORDS["dz"])):
        v = getattr(m, axis)
        n = F.bround(F.abs(v), 0).cast("int")
        word = F.coalesce(F.get(names, n), n.cast("string"))
        text = F.concat(F.when(v > 0, words[0]).otherwise(words[1]), F.lit(" by "), word, F.lit(" centimeter"), F.when(n == 1, "").otherwise("s"))
        parts.append(F.when(n >= 1, text))
    some = F.array_compact(F.array(*parts))
    k = F.size(some)
    head = F.array_join(F.slice(some, 1, F.greatest(k - 1, F.lit(0))), ", ")
    moved = F.when(k == 0, "The robot remained stationary").when(k == 1, F.concat(F.lit("The robot moved "), F.try_element_at(some, F.lit(1))))
    moved = moved.when(k == 2, F.concat(F.lit("The robot moved "), F.array_join(some, " and ")))
    moved = moved.otherwise(F.concat(F.lit("The robot moved "), head, F.lit(", and "), F.try_element_at(some, F.lit(-1))))
    return F.concat(moved, F.when(m.gripper >= 0.5, " while opening the gripper.").otherwise(" while closing the gripper."))


def directions_only(m: Move) -> Column:
    """``forward, left, open gripper``."""
    parts = []
    for axis, words in (("dx", ("forward", "backward")), ("dy", WORDS["dy"]), ("dz", WORDS["dz"])):
        v = getattr(m, axis)
        parts.append(F.when(F.abs(v) >= 0.5, F.when(v > 0, words[0]).otherwise(words[1])))
    parts += [F.when(F.abs(getattr(m, a)) >= 5, F.when(getattr(m, a) > 0, WORDS[a][0]).otherwise(WORDS[a][1])) for a in m.turns]
    return _listed([*parts, gripper_words(m.gripper)], "no movement")


FORMATS = {"verbose": verbose, "no_number": without_numbers, "compact": compact, "qualitative": qualitative, "component": component, "json": as_json, "sentence": sentence, "direction_only": directions_only}


def formatted(style: Column, m: Move) -> Column:
    """The text in the style that a column names; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, fn in FORMATS.items():
        out = F.when(style == name, fn(m)).otherwise(out)
    return out


def dominant_directions(m: Move, least: float = 1.0) -> Column:
    parts = []
    for axis, words in (("dx", ("forward", "backward")), ("dy", WORDS["dy"]), ("dz", WORDS["dz"])):
        v = getattr(m, axis)
        parts.append(F.when(v > least, words[0]).when(v < -least, words[1]))
    return _listed(parts, "stationary", " and ")


def gripper_change(before: Column, after: Column) -> Column:
    return F.when((after > 0.5) & (before <= 0.5), "opened").when((after <= 0.5) & (before > 0.5), "closed").otherwise("unchanged")


def magnitude(m: Move) -> Column:
    n = F.sqrt(m.dx * m.dx + m.dy * m.dy + m.dz * m.dz)
    return F.when(n < 2, "small movement").when(n < 6, "moderate movement").otherwise("large movement")


def is_idle(m: Move, least_cm: float = 1.0, least_deg: float = 10.0) -> Column:
    still = F.sqrt(m.dx * m.dx + m.dy * m.dy + m.dz * m.dz) < least_cm
    return still & (F.sqrt(m.roll * m.roll + m.pitch * m.pitch + m.yaw * m.yaw) < least_deg) if m.turns else still


def _sum_of(text: Column, pattern: str) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.aggregate(F.transform(numbers, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def parse_verbose(text: Column) -> Column:
    """struct<dx, dy, dz (m), roll, pitch, yaw (rad), gripper> from a text of moves; gripper is null if it isn't named."""
    low = F.lower(text)
    for word, cm in (("slightly", "1.5 cm"), ("moderately", "5 cm"), ("a lot", "10 cm")):
        low = F.replace(low, F.lit(word), F.lit(cm))
    cm = lambda word: _sum_of(low, rf"move\s+{word}\s+([-\d.]+)\s*cm")
    deg = lambda word: _sum_of(low, rf"{word}\s+([\d.]+)\s*degrees")
    dx = cm("forward") - cm("(?:backward|back)")
    roll, pitch, yaw = deg("tilt left") - deg("tilt right"), deg("tilt (?:down|back)") - deg("tilt (?:up|forward)"), deg("rotate counterclockwise") - deg("rotate clockwise")
    set_to = F.regexp_extract(low, r"set\s+gripper\s+to\s+([-+]?\d+\.?\d*)", 1).try_cast("double")
    grip = F.when(F.contains(low, F.lit("open gripper")), 1.0).when(F.contains(low, F.lit("close gripper")), 0.0).otherwise(set_to)
    rad = lambda c: c * F.pi() / 180
    return F.struct(
        (dx / 100).alias("dx"), ((cm("left") - cm("right")) / 100).alias("dy"), ((cm("up") - cm("down")) / 100).alias("dz"),
        rad(roll).alias("roll"), rad(pitch).alias("pitch"), rad(yaw).alias("yaw"), grip.alias("gripper"),
    )


def parse_compact(text: Column) -> Column:
    """struct<dx, dy, dz (m), gripper> of ``<+03 -02 +00 1>``; nulls if the text isn't one."""
    part = lambda k: F.regexp_extract(text, r"<([+-]\d+)\s+([+-]\d+)\s+([+-]\d+)\s+(\d)>", k).try_cast("int")
    return F.struct(*[(part(k + 1) / 100.0).alias(n) for k, n in enumerate(("dx", "dy", "dz"))], part(4).cast("double").alias("gripper"))


def to_integers(values: Column, bins: int = 1000) -> Column:
    """Values in [-1, 1] as integers 0 to ``bins`` in a text."""
    held = F.transform(values, lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))
    return F.array_join(F.transform(held, lambda x: F.bround((x + 1.0) / 2.0 * bins, 0).cast("int").cast("string")), " ")


def from_integers(text: Column, length: int, bins: int = 1000) -> Column:
    """The values back, filled up with zeros or cut to ``length``; all zeros if the text holds anything but integers."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 0)
    good = (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(r"^-?\d+$"))
    values = F.transform(words, lambda w: w.try_cast("int") / F.lit(float(bins)) * 2.0 - 1.0)
    zeros = F.array_repeat(F.lit(0.0), length)
    return F.when(good, F.slice(F.concat(values, zeros), 1, length)).otherwise(zeros)


def scale_words(text: Column) -> Column:
    """Numbers of a verbose text replaced by slightly, moderately or a lot."""
    words = F.split(text, ", ")

    def one(part: Column) -> Column:
        moved = F.regexp_extract(part, r"^(move\s+\w+)\s+([-+]?\d+(?:\.\d+)?)\s*cm$", 0)
        n = F.regexp_extract(part, r"([-+]?\d+(?:\.\d+)?)\s*(?:cm|degrees)$", 1).try_cast("double")
        head = F.regexp_replace(part, r"\s+[-+]?\d+(?:\.\d+)?\s*(?:cm|degrees)$", "")
        cm = F.when(n <= 3, "slightly").when(n < 8, "moderately").otherwise("a lot")
        deg = F.when(n < 10, "slightly").when(n < 30, "moderately").otherwise("a lot")
        return F.when(n.isNull(), part).otherwise(F.concat(head, F.lit(" "), F.when(moved != "", cm).otherwise(deg)))

    return F.array_join(F.transform(words, one), ", ")
