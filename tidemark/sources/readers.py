"""Readers of episode data: all through Spark's own sources, so any store that Spark reaches works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashing
from tidemark.sources import json_document

STEP = T.StructType([T.StructField(n, T.StringType()) for n in ("task", "plan", "subtask", "subtask_reason")])
EPISODE = T.StructType([T.StructField("metadata", T.StructType([T.StructField("n_steps", T.IntegerType())])), T.StructField("reasoning", T.MapType(T.StringType(), STEP))])
REASONING = T.MapType(T.StringType(), T.MapType(T.StringType(), EPISODE))
#: White space as Python strips it.
_BLANK = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def episodes(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Episode tables in Parquet, also in folders below; ``version`` names a subfolder."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{version}" if version else path)


def sharded(rows: DataFrame, key: str, seed: int, shards: int, index: int) -> DataFrame:
    """One host's part of a table: rows whose key's digest falls on its shard, the same rows in any run and file layout."""
    return rows.where(hashing.bucket(f"{seed}shard", F.col(key), shards) == index)


def reasoning_steps(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(file, episode, n_steps, step, task, plan, subtask, subtask_reason)`` of JSON lines ``{file: {episode: ...}}``.

    An episode with a step key that isn't a whole number is left out whole, as are lines that aren't JSON.
    """
    files = lines.select(F.from_json(value, REASONING).alias("m")).where("m is not null").select(F.explode("m").alias("file", "episodes"))
    return _steps(files.select("file", F.explode("episodes").alias("episode", "e")))


def reasoning_document(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of ``reasoning_steps`` from documents of one JSON object each, of any size, read by many tasks."""
    found = json_document.members(spark, path)
    return _steps(found.select("file", "episode", F.from_json("value", EPISODE).alias("e")))


def _steps(found: DataFrame) -> DataFrame:
    good = F.forall(F.map_keys("e.reasoning"), lambda k: k.try_cast("int").isNotNull())
    steps = found.where(good).select("file", "episode", F.col("e.metadata.n_steps").alias("n_steps"), F.explode("e.reasoning").alias("k", "s"))
    return steps.select("file", "episode", "n_steps", F.col("k").cast("int").alias("step"), "s.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines by schema; malformed lines are left out."""
    marked = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    read = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    return read.where("__bad is null").drop("__bad")


def csv_whitelist(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path).select(key).distinct()


def numbered_files(files: DataFrame, path: str = "path", most: int | None = None) -> DataFrame:
    """``(number, path)`` of file names like episode12.hdf5, by number."""
    found = files.select(F.regexp_extract(path, r"episode_?(\d+)", 1).try_cast("int").alias("number"), F.col(path).alias("path")).where("number is not null")
    return found.orderBy("number").limit(most) if most else found.orderBy("number")


def file_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times of files below a folder, without their contents."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return read.select("path", "length", "modificationTime")


def path_parts(path: Column, names: list[str]) -> list[Column]:
    """The last folders of a path by name, the last name for the last folder."""
    parts = F.split(path, "/")
    return [F.element_at(parts, -(len(names) - k)).alias(n) for k, n in enumerate(names)]


def validity(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, null if all hold: splits rows into a good and a quarantined table."""
    reason = F.lit(None).cast("string")
    for name, good in reversed(checks):
        reason = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(reason)
    return reason


def hint_sections(text: Column) -> Column:
    """map<string, string> of ``## key`` sections of a Markdown text; sections that are still placeholders are left out.

    A key is the heading's first word; of sections with one key the last counts.
    """
    lines = F.concat(F.lit("\n"), F.regexp_replace(text, r"\R|[\x1c-\x1e]", "\n"))
    parts = F.split(lines, r"(?U)\n##[^\S\n]+(?=\S)")
    body = lambda s: F.btrim(F.regexp_replace(s, r"^[^\n]*\n?", ""), F.lit(_BLANK))
    found = F.transform(parts, lambda s, i: F.struct(F.regexp_extract(s, r"(?U)^\S*", 0).alias("k"), (-i).alias("i"), body(s).alias("v")))
    # By key and from the last; the text before the first heading has no key.
    by_key = F.array(F.array_sort(F.filter(found, lambda s: s["i"] < 0)))
    last = F.get(F.transform(by_key, lambda a: F.filter(a, lambda s, i: (i == 0) | (F.get(a, i - 1)["k"] != s["k"]))), F.lit(0))
    kept = F.filter(last, lambda s: (F.length(s["v"]) > 0) & ~F.startswith(s["v"], F.lit("<replace with")))
    return F.map_from_entries(F.transform(kept, lambda s: F.struct(s["k"], s["v"])))


def chosen_instruction(*columns: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, F.trim(c)) for c in columns])


def video_frame(from_seconds: Column, step: Column, fps: float) -> Column:
    """The frame of a shared video file at which an episode's step is found."""
    return (F.bround(from_seconds * fps, 0) + step).cast("bigint")


def synthetic_episode(spark: SparkSession, n: int = 200) -> DataFrame:
    """A gripper that closes twice while the tool moves along x, then y."""
    t = F.col("t")
    closed = t.between(40, 49) | t.between(60, 149)
    x = F.least(F.greatest(t - 70, F.lit(0)), F.lit(40)) * 0.01
    y = F.least(F.greatest(t - 110, F.lit(0)), F.lit(40)) * 0.01
    return spark.range(n).select(F.lit("synthetic").alias("episode_id"), F.col("id").alias("t")).select("episode_id", "t", F.when(closed, 1.0).otherwise(0.0).alias("g"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))


PILOT = "episode_id string, task_instruction string, fps double, gripper_width array<double>, ee_pos array<array<double>>, image_dir string"


def pilot_episodes(spark: SparkSession, manifest: str, images_root: str) -> DataFrame:
    """Episodes of a JSON-lines manifest and a folder of images: ``(episode_id, task_instruction, fps, n_frames, gripper_width, ee_pos, folder, has_wrist)``.

    Each line is one episode; malformed lines are left out, and so are those without a gripper.  Instructions are stripped, 15 frames a second are taken where none are given.  Images are named ``primary_0000.jpg`` and, where the
    folder has a first one, ``wrist_0000.jpg``; only the names of first wrist images are listed, none is opened.
    """
    rows = json_lines(spark, manifest, T._parse_datatype_string(PILOT)).where("gripper_width is not null")
    listed = file_listing(spark, images_root, "wrist_0000.jpg").select(F.regexp_replace("path", r"/[^/]*$", "").alias("place"))
    wrists = listed.select(F.regexp_extract("place", r"([^/]+)$", 1).alias("last"), "place").distinct()
    told = rows.withColumn("last", F.regexp_extract(F.rtrim("image_dir", F.lit("/")), r"([^/]+)$", 1))
    found = told.join(wrists, (told["last"] == wrists["last"]) & F.endswith(wrists["place"], F.concat(F.lit("/"), F.rtrim("image_dir", F.lit("/")))), "left")
    return found.select(
        "episode_id", F.btrim(F.coalesce("task_instruction", F.lit("")), F.lit(_BLANK)).alias("task_instruction"), F.coalesce("fps", F.lit(15.0)).alias("fps"), F.size("gripper_width").alias("n_frames"),
        "gripper_width", "ee_pos", F.concat(F.lit(images_root + "/"), F.col("image_dir")).alias("folder"), wrists["place"].isNotNull().alias("has_wrist"),
    )


def pilot_frames(episodes: DataFrame) -> DataFrame:
    """``(episode_id, frame, gripper, primary, wrist)``: a row for each frame with its images' paths, the wrist's null where there are none."""
    each = episodes.select("episode_id", "folder", "has_wrist", F.posexplode("gripper_width").alias("frame", "gripper"))
    name = lambda camera: F.concat(F.col("folder"), F.format_string(f"/{camera}_%04d.jpg", F.col("frame")))
    return each.select("episode_id", F.col("frame").cast("bigint").alias("frame"), "gripper", name("primary").alias("primary"), F.when(F.col("has_wrist"), name("wrist")).alias("wrist"))
