"""Questions and answers about the motion between two frames: seven kinds, each drawn by weight from the digest of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import hashing, motion_text
from tidemark.functions.motion_text import Move

#: Requests by kind; {frame_ref} and {action} are filled in.
PROMPTS = {
    "delta_motion": [
        "Describe the robot's motion between these two frames{frame_ref}",
        "What movement did the robot make from the first image to the second{frame_ref}?",
        "Predict the change in robot position shown in these images{frame_ref}",
        "Given these before and after images, what action was taken{frame_ref}?",
        "Analyze the visual difference and describe the robot's movement{frame_ref}",
        "What is the delta motion between these two images{frame_ref}?",
        "Describe how the robot end-effector moved between frames{frame_ref}",
        "What movement occurred between these two observations{frame_ref}?",
        "Characterize the robot motion from the image pair{frame_ref}",
        "From image 1 to image 2, describe the robot's action{frame_ref}",
    ],
    "task_prediction": [
        "What task is the robot performing given this motion: {action}?",
        "Based on the action '{action}', what is the robot trying to accomplish?",
        "Given the robot moved as follows: {action}, what is the task?",
        "Identify the task from this robot motion: {action}",
        "The robot performed: {action}. What task does this correspond to?",
        "What goal is the robot working towards with this action: {action}?",
    ],
    "direction_classification": [
        "What is the dominant motion direction shown in these images?",
        "In which direction(s) did the robot primarily move?",
        "Classify the main movement direction between these frames",
        "What are the primary motion axes in this image pair?",
        "Describe the dominant direction of robot movement",
    ],
    "gripper_prediction": [
        "Did the gripper open, close, or stay the same between these images?",
        "What happened to the gripper state?",
        "Predict the gripper state change from image 1 to image 2",
        "How did the gripper position change?",
        "Was there a gripper action between these frames?",
    ],
    "magnitude_estimation": [
        "How much did the robot move between these images?",
        "Estimate the magnitude of the robot's motion",
        "Is the movement between these frames small, moderate, or large?",
        "Characterize the distance traveled by the robot",
        "What is the scale of the robot's displacement?",
    ],
    "temporal_ordering": [
        "Given the robot action '{action}', which image shows the earlier state - the first or second image?",
        "The robot performed: {action}. In what order do these images appear in the trajectory?",
        "Between these frames the robot did: {action}. Which frame came first chronologically?",
        "Given the motion '{action}', determine the temporal order of these two observations",
        "The robot moved as follows: {action}. Is image 1 before or after image 2 in the sequence?",
    ],
    "embodiment_identification": [
        "What robot or dataset is this image from?",
        "Identify the robot embodiment shown in this image",
        "What type of robot is performing this task?",
        "Which dataset does this observation come from?",
        "Classify the robot platform shown here",
    ],
}
#: Parts of dataset names, the first that fits counts, and the robots that they mean.
ROBOTS = {
    "droid": "DROID (Franka Panda)", "bridge": "Bridge (WidowX)", "bridge_dataset": "Bridge (WidowX)", "fractal": "Fractal (Google Robot)", "rt_1_x": "RT-1 (Google Robot)",
    "kuka": "KUKA Robot", "fmb": "FMB (Franka Manipulation Benchmark)", "taco_play": "TACO Play", "jaco_play": "Jaco Play (Kinova Jaco)", "berkeley_autolab_ur5": "Berkeley Autolab (UR5)",
    "furniture_bench": "Furniture Bench (Franka)", "austin_buds": "Austin BUDS (Franka)", "austin_sirius": "Austin Sirius (Franka)", "austin_sailor": "Austin Sailor (Franka)",
    "utaustin_mutex": "UT Austin MUTEX (Franka)", "viola": "VIOLA (Franka)", "cmu_stretch": "CMU Stretch (Hello Robot)", "dobbe": "DOBBE (Hello Robot)", "iamlab_cmu_pickup_insert": "CMU IAM Lab (Franka)",
}
#: Shares of the kinds, and of the styles of a motion's answer.
KINDS = [("delta_motion", 0.55), ("task_prediction", 0.15), ("direction_classification", 0.15), ("gripper_prediction", 0.05), ("magnitude_estimation", 0.05), ("temporal_ordering", 0.05)]
STYLES = [("verbose", 0.35), ("verbose_with_rotation", 0.15), ("qualitative", 0.2), ("compact", 0.0), ("compact_with_rotation", 0.05), ("component", 0.08), ("json", 0.05), ("sentence", 0.05), ("direction_only", 0.02)]


def robot_name(dataset: Column) -> Column:
    """The robot of a dataset by the first known part of its name, else the name."""
    out = F.lit(None).cast("string")
    for part, name in reversed(ROBOTS.items()):
        out = F.when(F.contains(F.lower(dataset), F.lit(part)), name).otherwise(out)
    return F.coalesce(out, dataset)


def question(
    key: Column,
    move: Move,
    before: Column,
    task: Column,
    dataset: Column,
    images: Column,
    frame: Column | None = None,
    kinds: list[tuple[str, float]] | None = None,
    styles: list[tuple[str, float]] | None = None,
    salt: str = "qa",
) -> Column:
    """struct(kind, prompt, answer, images) for each row.

    ``move``: the motion of the window with its turns; ``before``: the gripper at its begin; ``images``: an array, of which
    a question of order shows the first two swapped in half of the cases (then the earlier one is the second).  Draws depend on ``salt`` and ``key``
    only.  A row without a motion (any null part) has a null prompt and answer in the kinds that tell of it.
    """
    flat = Move(move.dx, move.dy, move.dz, move.gripper)
    kind = hashing.weighted_choice(f"{salt}-kind", key, kinds or KINDS)
    style = hashing.weighted_choice(f"{salt}-style", key, [s for s in styles or STYLES if s[1] > 0])
    turns = (F.abs(move.roll) >= 5) | (F.abs(move.pitch) >= 5) | (F.abs(move.yaw) >= 5)
    turned = F.endswith(style, F.lit("_with_rotation")) | (style.isin("component", "json", "qualitative") & turns)
    plain = F.regexp_replace(style, "_with_rotation$", "")
    told = F.when(turned, motion_text.formatted(plain, move)).otherwise(motion_text.formatted(plain, flat))
    action = motion_text.verbose(flat)
    swapped = hashing.uniform(f"{salt}-swap", key) < 0.5
    prompt = F.lit(None).cast("string")
    for name, texts in PROMPTS.items():
        prompt = F.when(kind == name, hashing.choose(f"{salt}-prompt", key, F.array(*map(F.lit, texts)))).otherwise(prompt)
    reference = F.lit("") if frame is None else F.when(F.length(frame) > 0, F.concat(F.lit(" (in "), frame, F.lit(")"))).otherwise("")
    prompt = F.replace(F.replace(prompt, F.lit("{frame_ref}"), reference), F.lit("{action}"), action)
    answer = (
        F.when(kind == "delta_motion", told)
        .when(kind == "task_prediction", task)
        .when(kind == "direction_classification", motion_text.dominant_directions(flat))
        .when(kind == "gripper_prediction", motion_text.gripper_change(F.coalesce(before, F.lit(0.5)), move.gripper))
        .when(kind == "magnitude_estimation", motion_text.magnitude(flat))
        .when(kind == "temporal_ordering", F.when(swapped, "second").otherwise("first"))
        .when(kind == "embodiment_identification", robot_name(dataset))
    )
    turned_round = (kind == "temporal_ordering") & swapped & (F.size(images) >= 2)
    shown = F.when(turned_round, F.concat(F.array(images[1], images[0]), F.slice(images, 3, F.greatest(F.size(images) - 2, F.lit(0))))).otherwise(images)
    return F.struct(kind.alias("kind"), prompt.alias("prompt"), answer.alias("answer"), shown.alias("images"))
