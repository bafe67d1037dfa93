"""Questions about an object's place in an image, from boxes with a category each: location tokens or a direction as the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import boxes, hashing

#: Requests for a box, around the category's name.
BOX_PROMPTS = [
    ("Show me where the robot should move its end-effector to reach the ", " in the image."),
    ("Describe the location the robot should align its gripper with to reach the ", " in the image."),
    ("Locate the region where the robot should position its wrist to interact with the ", " in the image."),
    ("Mark the location the robot should target with its gripper to reach the ", "."),
    ("Identify the spot the robot should move its arm toward to approach the ", "."),
    ("Find the region the robot should align its end-effector with to reach the ", " in the image."),
    ("Highlight the area the robot should approach with its manipulator to reach the ", " in the image."),
    ("Show me where the robot would position its gripper to approach the ", " in the image."),
    ("Indicate where the robot should move its arm to reach the ", "."),
    ("Mark the location the robot should target to interact with the ", "."),
    ("Highlight the region the robot should move toward to grasp the ", "."),
    ("Identify where the robot should position its wrist relative to the ", "."),
    ("Point out the spot the robot would navigate its arm to in order to reach the ", "."),
    ("Locate where the robot would need to move its end-effector to get closer to the ", " in the image."),
    ("Pinpoint the position the robot should move its gripper toward to access the ", "."),
    ("Show the area the robot should aim its arm toward when approaching the ", "."),
    ("Outline the region that would guide the robot's end-effector toward the ", "."),
    ("Indicate the exact region a robot should target with its gripper when reaching for the ", "."),
    ("Highlight the bounding region the robot should aim its wrist toward to reach the ", "."),
    ("Mark the precise location where the robot should position its end-effector to approach the ", "."),
    ("Identify the spatial region where the robot would place its gripper to interact with the ", "."),
    ("Show the area the robot should move its arm into to reach the ", "."),
    ("Locate the target region the robot should align its manipulator with to access the ", "."),
    ("Point out the position the robot would need to occupy with its wrist to manipulate the ", "."),
    ("Outline the region that represents the robot's goal location for reaching the ", "."),
    ("Find the area in the image that the robot should move its end-effector toward to reach the ", "."),
    ("Mark the destination region a robot should select with its gripper to successfully approach the ", "."),
]
#: What comes before and after the category in the other requests for a box, by the frame that they speak of.
ACTIONS = ["Pick up the ", "Grasp the ", "Move near to the ", "Navigate to the "]
IN_IMAGE = [", predict where it is in the image.", ", show where it is in the image.", ", locate it in the image.", ", find it in the image."]
AT_BASE = [", predict where it is in the robot base frame.", ", relative to the robot base.", ", with respect to the robot base.", ", looking from the external camera."]
AT_HAND = [", predict where it is in the end-effector frame.", ", with respect to the robot gripper.", ", relative to the end-effector.", ", in the wrist camera.", ", looking from the wrist camera."]
#: Requests for a direction.
DIRECTION_PROMPTS = [
    ("From the image center, imagine the robot moving its end-effector toward the ", " and predict the direction."),
    ("Relative to the center of the image, imagine the robot aligning its arm toward the ", " and describe the movement direction."),
    ("If the robot's base were at the center of the image, which way would the arm extend to reach the ", "."),
    ("Looking from the center of the frame, imagine the robot orienting its gripper toward the ", " and state the direction."),
    ("Which direction from the center would the robot move its end-effector to reach the ", " in this image."),
    ("Imagine the robot must reposition its arm to interact with the ", " and describe its direction."),
    ("Describe which direction the robot would move its gripper to approach the ", " in the image."),
    ("Describe the direction the robot's arm should sweep to align with the ", " in the image."),
    ("Point out the direction the robot should move its end-effector to reach the ", "."),
    ("Show me where the robot should aim its arm to reach the ", "."),
    ("Describe where the robot would move its wrist to reach the ", " relative to the center of the image."),
    ("Show me the direction the robot should move its arm toward the ", " relative to the center of the image."),
    ("Imagine the robot needs to extend its arm toward the ", " and predict the direction."),
    ("Imagine the robot needs to reposition its manipulator to the ", " and predict the direction."),
    ("If the robot needs to grasp the ", ", predict the direction it would move its arm."),
    ("From the image center, predict the direction the robot should move its end-effector to make contact with the ", "."),
    ("Assuming the robot starts with its gripper at the image center, describe the direction it should move toward the ", "."),
    ("If the robot had to plan a straight-line reach from the center to the ", ", which direction would the arm move."),
    ("Imagine the robot is positioned at the center and must align its gripper with the ", "; indicate the direction."),
    ("From the center of the image, in which direction should the robot move its wrist to approach the ", "."),
    ("If the robot were planning a pre-grasp motion from the center, describe the direction toward the ", "."),
    ("Predict the initial arm movement direction a robot would take from the center to reach the ", "."),
    ("Considering a robot at the center, which direction would it orient its gripper to approach the ", "."),
    ("From a manipulation standpoint, which direction should the robot move its arm from the center to reach the ", "."),
    ("If the robot plans a direct reach from the center to the ", ", what direction would the end-effector move."),
]


def box_prompts(places: list[str]) -> list[tuple[str, str]]:
    """Every action with every place, then the general requests."""
    return [(a, p) for a in ACTIONS for p in places] + BOX_PROMPTS


def around(image: Column, category: Column, templates: list[tuple[str, str]], salt: str) -> Column:
    """One of the templates around the category, by the image's digest; a null category leaves the words around it."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in templates])
    chosen = hashing.choose(salt, image, pairs)
    return F.concat(chosen["a"], F.coalesce(category, F.lit("")), chosen["b"])


def box_sample(image: Column, category: Column, corners: list[Column], seed: int, direction_share: float = 0.0, slope: float = 2.0) -> tuple[Column, Column]:
    """``(prompt, caption)`` of a box (x0, y0, x1, y1): its location tokens, or for a share of the images ``move`` and its direction from the centre."""
    prompt = around(image, category, box_prompts(IN_IMAGE + AT_BASE), f"{seed}box")
    told = F.when(hashing.uniform(f"{seed + 7919}direction", image) < direction_share, boxes.direction(*corners, slope=slope, prefix="move ")).otherwise(boxes.box_tokens(*corners))
    return prompt, told


def direction_sample(image: Column, category: Column, corners: list[Column], seed: int, slope: float = 2.0) -> tuple[Column, Column]:
    """``(prompt, caption)`` that ask for and tell a box's direction from the centre."""
    return around(image, category, DIRECTION_PROMPTS, f"{seed}turn"), boxes.direction(*corners, slope=slope, prefix="move ")


def box_id(kind: str, image: Column, category: Column, corners: list[Column]) -> Column:
    """A sample's id that tells several boxes of one image and category apart."""
    told = F.concat_ws("_", image.cast("string"), category, *[c.cast("string") for c in corners])
    return F.concat_ws("_", F.lit(kind), image.cast("string"), hashing.bucket("", told, 2147483647).cast("string"))
