"""Items and their annotations: captions, objects, options, prompts and file paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col, md5_draw, md5_key, zero_padded
from .order import keep_first, ordered_position, position_by_value

# Splits, file patterns, prompts and option lists.
SPLITS = ("train2017", "val2017", "train2014", "val2014")
IMAGE_DIRS = SPLITS + ("images/train2017", "images/val2017")
ITEM_FILE_FORMATS = ("nsd{:05d}.png", "nsd-{:05d}.png", "stimuli_{:05d}.png", "{}.png")
COLOR_OPTIONS = ("red", "green", "blue", "yellow", "white", "black", "gray", "brown")
OBJECT_PROMPT = "What is the main object in this image? Answer with a single word or short phrase."
OPTION_PROMPT = ("Which of these best describes the main object? Choices: ", ". Answer with one of the choices.")
CAPTION_PROMPT = "Describe this image in one sentence."
DETAIL_PROMPT = "Describe this image in detail."
CHAT_FORMAT = ("USER: ", "\nASSISTANT:")
DEFAULT_COLOR_PROMPT = "What color is the main object?"
TASK_PROMPTS = {
    "visual_recognition": ("What is the main object in this image? Answer with a single word or short phrase.",
                           "Identify the primary object visible in this image.",
                           "What type of object is shown in the center of this image?"),
    "cross_modal_binding": ("What color is the largest object in this image?",
                            "Describe the spatial relationship between the objects in this image.",
                            "What is the color and position of each distinct object?"),
    "language_generation": ("Describe this image in detail.",
                            "Write a comprehensive caption for this image.",
                            "Provide a thorough description of what you see in this image."),
}


def shared_items(info: DataFrame, design: DataFrame | None = None) -> DataFrame:
    """Items shared by all subjects (F1): the design's list, else the flag, else seen by every subject."""
    if design is not None:
        return design.select("item_id").distinct()
    if "shared" in info.columns:
        return info.where(F.col("shared")).select("item_id").distinct()
    subjects = [c for c in info.columns if c.startswith("subject")]
    if not subjects:
        raise ValueError("no way to tell shared items")
    seen = F.forall(F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in subjects]), lambda v: v > 0)
    return info.where(seen).select("item_id").distinct()


def seen_by_all(views: DataFrame, subject: str, item: str) -> DataFrame:
    """Items every subject has seen, from a long table (F1)."""
    need = views.agg(F.count_distinct(subject))
    return (views.groupBy(item).agg(F.count_distinct(subject).alias("__s"))
            .where(F.col("__s") == need.scalar()).select(item))


def external_id(items: DataFrame, mapping: DataFrame, item: str, ext: str) -> DataFrame:
    """External id of each item, -1 if there is none."""
    return items.join(mapping.select(item, ext), item, "left").withColumn(ext, F.coalesce(F.col(ext), F.lit(-1)))


def captions_in_order(annotations: DataFrame, image: str, order: Sequence[str], text: str) -> DataFrame:
    """(image, pos, caption): trimmed captions numbered in file order."""
    rows = annotations.select(image, *order, F.trim(text).alias("caption"))
    return ordered_position(rows, [image], list(order), "pos", "n_captions").select(
        image, "pos", "caption", "n_captions")


def first_caption(annotations: DataFrame, image: str, order: Sequence[str], text: str) -> DataFrame:
    """First caption per image, as an aggregate."""
    return keep_first(annotations.withColumn("caption", F.trim(text)), [image], [F.col(c) for c in order], ["caption"])


def caption_lists(annotations: DataFrame, image: str, order: Sequence[str], text: str) -> DataFrame:
    """(image, caption, all_captions): the trimmed captions of an image in file order, and the first of them."""
    entry = F.struct(*order, F.trim(text).alias("caption"))
    out = annotations.groupBy(image).agg(F.sort_array(F.collect_list(entry)).getField("caption").alias("all_captions"))
    return out.select(image, F.element_at("all_captions", 1).alias("caption"), "all_captions")


def largest_object(annotations: DataFrame, image: str, area: str, position: str, columns: Sequence[str]) -> DataFrame:
    """The object of largest area per image, first on ties."""
    best = F.max_by(F.struct(*columns), F.struct(F.coalesce(F.col(area), F.lit(0.0)), -F.col(position)))
    return annotations.groupBy(image).agg(best.alias("b")).select(image, *[F.col(f"b.{c}") for c in columns])


def multi_object_scenes(annotations: DataFrame, image: str, category: str, minimum: int = 3) -> DataFrame:
    """Images with at least ``minimum`` distinct categories (F9); ids of 0 or less are left out."""
    return (annotations.where(F.col(image) > 0).groupBy(image)
            .agg(F.count(F.lit(1)).alias("n_objects"), F.count_distinct(category).alias("n_categories"),
                 F.sort_array(F.collect_set(category)).alias("categories"))
            .where(F.col("n_categories") >= minimum))


def category_list(categories: DataFrame, category: str) -> Column:
    """The sorted distinct categories as one scalar: a dimension of a few dozen names."""
    return categories.agg(F.sort_array(F.collect_set(category))).scalar()


def drawn_places(n: Column, k: int, seed: int, *parts: str | Column) -> Column:
    """k distinct places of 0..n-1, or all n if there are fewer, each set equally likely.

    Floyd's way: step s draws from 0..n-k+s and takes the last of these where the draw is taken already. k hashes
    whatever n is, nothing is sorted, and SQL draws the same.
    """
    steps = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: n - k + s >= 0)
    draws = F.transform(steps, lambda s: F.struct((n - k + s).cast("long").alias("last"), md5_draw(seed, n - k + s + 1, *parts, s).alias("r")))
    return F.aggregate(draws, F.array().cast("array<bigint>"), lambda taken, d: F.array_append(
        taken, F.when(F.array_contains(taken, d["r"]), d["last"]).otherwise(d["r"])))


def with_options(df: DataFrame, truth: str, names: Column, item: str, distractors: int = 3, seed: int = 42) -> DataFrame:
    """Add ``options`` and ``correct_idx``: truth and distinct distractors in md5 order.

    Distractors are drawn as places in ``names`` (sorted, distinct) without the truth's own; a truth that is no name
    leaves all of them. Too few names: all of them. A null truth has null options.
    """
    own = F.coalesce(F.array_position("__names", F.col(truth)), F.lit(0)).cast("int")
    at = F.col("__at")
    others = F.size("__names") - F.when(at > 0, 1).otherwise(0)

    def shuffled(values: Column) -> Column:
        return F.sort_array(F.transform(values, lambda c: F.struct(md5_key(seed + 1, item, c).alias("h"), c.alias("c")))).getField("c")

    def name_at(p: Column) -> Column:
        return F.element_at("__names", (p + F.when((at > 0) & (p >= at - 1), 2).otherwise(1)).cast("int"))

    picked = F.transform(drawn_places(others, distractors, seed, item), name_at)
    return (df.withColumn("__names", names).withColumn("__at", own).withColumn("__picked", picked)
            .withColumn("options", F.when(F.col(truth).isNotNull(), shuffled(F.concat(F.array(truth), F.col("__picked")))))
            .withColumn("correct_idx", (F.array_position("options", F.col(truth)) - 1).cast("int"))
            .drop("__names", "__at", "__picked"))


def color_options(true_color: str | Column) -> tuple[Column, Column]:
    """The fixed colour list and the index of the true colour, 0 if unknown."""
    options = F.array(*[F.lit(c) for c in COLOR_OPTIONS])
    at = F.greatest(F.coalesce(F.array_position(options, col(true_color)), F.lit(0)) - 1, F.lit(0))
    return options, at.cast("int")


def resolve_path(candidates: DataFrame, files: DataFrame, item: str) -> DataFrame:
    """First existing file per item (P6): ``candidates(item, priority, path)`` against ``files(path)``."""
    found = candidates.join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy(item).agg(F.min_by("path", "priority").alias("path"))


def named_file(pattern: str, number: str | Column) -> Column:
    """A pattern with one '{}' or '{:05d}' filled in by column functions; a null number gives null."""
    before, rest = pattern.split("{", 1)
    width, after = rest.split("}", 1)
    digits = int(width.strip(":d") or 0)
    return F.concat(F.lit(before), zero_padded(number, digits), F.lit(after))


def candidate_paths(items: DataFrame, item: str, ext: str) -> DataFrame:
    """All places an image may be, best first: local file names, then the external folders."""
    local = [F.struct(F.lit(p).alias("priority"), named_file(pattern, item).alias("path")) for p, pattern in enumerate(ITEM_FILE_FORMATS)]
    outside = [F.struct(F.lit(len(local) + p).alias("priority"), F.concat(F.lit(f"{d}/"), zero_padded(ext, 12), F.lit(".jpg")).alias("path"))
               for p, d in enumerate(IMAGE_DIRS)]
    usable = F.when(F.col(ext) > 0, F.array(*local, *outside)).otherwise(F.array(*local))
    return items.select(item, F.explode(usable).alias("c")).select(item, "c.priority", "c.path")


def stimulus_pairs(items: DataFrame, images: DataFrame, captions: DataFrame | None, item: str, ext: str,
                   prompt: str = DETAIL_PROMPT) -> DataFrame:
    """(item, ext, path, text) for items with an image; the prompt stands in for a missing caption."""
    out = items.join(images, item)
    if captions is None:
        return out.select(item, ext, "path", F.lit(prompt).alias("text"))
    return (out.join(captions.select(F.col("image_id").alias(ext), "caption"), ext, "left")
            .select(item, ext, "path", F.coalesce("caption", F.lit(prompt)).alias("text")))


def item_metadata(items: DataFrame, objects: DataFrame, captions: DataFrame, counts: DataFrame, names: Column,
                  item: str, ext: str, seed: int = 42) -> DataFrame:
    """One record per item with defaults for what is missing, and options.

    ``objects(ext, category, category_id, area)`` holds the main object, ``captions(ext, caption, all_captions)`` the
    captions, ``counts(ext, n_objects)`` all objects. Missing: category 'object' of id -1 and area 0, an empty
    caption and list, no objects.
    """
    rows = (items.join(objects, ext, "left").join(captions, ext, "left").join(counts, ext, "left")
            .withColumn("no_objects", F.col("category").isNull()).withColumn("no_caption", F.col("caption").isNull())
            .withColumn("category", F.coalesce("category", F.lit("object")))
            .withColumn("category_id", F.coalesce("category_id", F.lit(-1)))
            .withColumn("caption", F.coalesce("caption", F.lit("")))
            .withColumn("all_captions", F.coalesce("all_captions", F.array().cast("array<string>")))
            .withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))
            .withColumn("main_object_area", F.coalesce("area", F.lit(0.0))).drop("area"))
    return with_options(rows, "category", names, item, seed=seed)


def task_prompts(meta: DataFrame, item: str) -> DataFrame:
    """(item, task, prompt, ground_truth, options, correct_idx, all_captions): the object, option and caption tasks.

    Options belong to the option task and all captions to the caption task; elsewhere they are null.
    """
    listing = F.concat(F.lit(OPTION_PROMPT[0]), F.array_join("options", ", "), F.lit(OPTION_PROMPT[1]))
    no_names = F.lit(None).cast("array<string>")

    def task(name: str, prompt: Column, gt: str, options: Column = no_names, captions: Column = no_names) -> Column:
        index = F.col("correct_idx") if name == "category_mc" else F.lit(None).cast("int")
        return F.struct(F.lit(name).alias("task"), prompt.alias("prompt"), F.col(gt).alias("ground_truth"), options.alias("options"),
                        index.alias("correct_idx"), captions.alias("all_captions"))

    tasks = F.array(task("object", F.lit(OBJECT_PROMPT), "category"),
                    task("category_mc", listing, "category", options=F.col("options")),
                    task("caption", F.lit(CAPTION_PROMPT), "caption", captions=F.col("all_captions")))
    return meta.select(item, F.explode(tasks).alias("t")).select(item, "t.*")


def chat_prompt(question: str | Column) -> Column:
    """A question in the chat frame of the answer model."""
    q = F.coalesce(col(question), F.lit(DEFAULT_COLOR_PROMPT))
    return F.concat(F.lit(CHAT_FORMAT[0]), q, F.lit(CHAT_FORMAT[1]))


def rotating_prompts(items: DataFrame, item: str) -> DataFrame:
    """Equal consecutive slices of all sorted items, one per task, with prompts in rotation."""
    placed = position_by_value(items.select(item), [], item, (), "__p", "__n")
    per_task = F.ceil(F.col("__n") / len(TASK_PROMPTS))
    names = F.array(*[F.lit(t) for t in TASK_PROMPTS])
    lists = F.array(*[F.array(*[F.lit(p) for p in ps]) for ps in TASK_PROMPTS.values()])
    at = F.floor(F.col("__p") / per_task).cast("int")
    inside = F.pmod(F.col("__p"), per_task)
    return placed.select(item, F.element_at(names, at + 1).alias("task"),
                         F.element_at(F.element_at(lists, at + 1), (F.pmod(inside, F.lit(3)) + 1).cast("int")).alias("prompt"))


def first_per_task(tasks: DataFrame, task: str, position: str, n: int) -> DataFrame:
    """The first n entries of each task."""
    return tasks.where(F.col(position) < n)


def most_common(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """The n most frequent values (A10), by name on ties."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)
