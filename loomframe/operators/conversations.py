"""Conversation samples from labelled frames: five tasks, questions chosen by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import choose, choose_weighted
from ..functions.text import blank_to, is_filled, sample_id, starts_yes, strip, without_root

# Task weights, questions and answer texts of the dataset's format.
TASK_WEIGHTS = {"classify": 25, "layout": 15, "describe_teacher": 20, "coupled": 35, "refuse": 5}
CLASSIFY = [
    "Is this sludge content?",
    "Does this image show two or more unrelated visual scenes displayed at the same time (split-screen, picture-in-picture, or collage)?",
    "Is this a sludge content layout?",
    "Does this frame contain more than one unrelated visual stream?",
    "Is this frame from a sludge-style video?",
    "Does the image simultaneously display unrelated videos side-by-side or stacked?",
    "Would you classify this as sludge content?",
    "Are there multiple panes showing different, unrelated content in this frame?",
    "Is the layout here sludge?",
    "Does this frame visually combine multiple unrelated clips?",
]
LAYOUT = [
    "What layout type is shown?",
    "Identify the visual composition.",
    "How is this frame composed?",
    "What is the layout category?",
    "Classify the image layout.",
    "Which layout best describes this frame?",
]
DESCRIBE = [
    "Describe this frame.",
    "What is visible in this frame?",
    "Describe the visual content.",
    "Describe the layout and content of this frame.",
    "What does this frame show?",
]
EXPLAIN = ["Explain why.", "Justify your answer.", "Why?", "Explain briefly.", "What's your reasoning?"]
REFUSE = [
    "What specific TV show is on the top pane?",
    "What game is being played in this frame?",
    "Who is the person in this video?",
    "Name the specific movie/show/game featured here.",
    "What is the channel or creator behind this video?",
]
REFUSAL = "I cannot reliably identify the specific show, game, or creator from this single frame. "
GROUNDED = {True: "The frame shows a sludge layout.", False: "The frame shows a single continuous scene."}
ANSWER = {True: "Yes.", False: "No."}
PREFIX = {True: "Yes, this is sludge. ", False: "No, this is not sludge. "}


def _by_truth(flag: Column, texts: dict[bool, str]) -> Column:
    return F.when(flag, texts[True]).otherwise(texts[False])


def eligible(rows: DataFrame, splits: tuple[str, ...] = ("train", "validate")) -> DataFrame:
    """Rows with a description (white space counts) in one of the splits."""
    return rows.where(is_filled(F.col("teacher.description")) & F.col("split").isin(*splits))


def with_task(rows: DataFrame, weights: dict[str, int] = TASK_WEIGHTS, key: str = "frame_path") -> DataFrame:
    return rows.withColumn("task", choose_weighted(weights, F.col(key), "task"))


def build_conversations(rows: DataFrame, key: str = "frame_path") -> DataFrame:
    """rows(frame_path, video_id, time_s, split, teacher, task) to (id, image, conversations, _meta)."""
    said = lambda f: strip(F.coalesce(F.col(f"teacher.{f}"), F.lit("")))
    yes, layout = starts_yes(F.col("teacher.sludge")), blank_to(said("layout"), "other")
    text, why = said("description"), said("explanation")
    ask = lambda bank, salt: choose(bank, F.col(key), salt)
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    seen = lambda q, a: F.array(turn("human", F.concat(F.lit("<image>\n"), q)), turn("gpt", a))
    coupled = F.concat(
        seen(ask(CLASSIFY, "q"), _by_truth(yes, ANSWER)),
        F.array(turn("human", ask(EXPLAIN, "why")), turn("gpt", F.concat(_by_truth(yes, PREFIX), F.coalesce(F.nullif(why, F.lit("")), text)))),
    )
    task = F.col("task")
    conversations = (
        F.when(task == "classify", seen(ask(CLASSIFY, "q"), _by_truth(yes, ANSWER)))
        .when(task == "layout", seen(ask(LAYOUT, "q"), layout))
        .when(task == "describe_teacher", seen(ask(DESCRIBE, "q"), text))
        .when(task == "coupled", coupled)
        .when(task == "refuse", seen(ask(REFUSE, "q"), F.concat(F.lit(REFUSAL), F.coalesce(F.nullif(text, F.lit("")), _by_truth(yes, GROUNDED)))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown task "), task)))
    )
    meta = F.struct(F.col("split").alias("split"), task.alias("task"), layout.alias("layout"), yes.alias("is_sludge"))
    return rows.select(sample_id(F.col("video_id"), F.col("time_s"), task).alias("id"), without_root(F.col("frame_path")).alias("image"), conversations.alias("conversations"), meta.alias("_meta"))


def flat_turns(samples: DataFrame) -> DataFrame:
    """One row a turn: id, image, turn, from, value."""
    return samples.select("id", "image", F.posexplode("conversations").alias("turn", "t")).select("id", "image", "turn", F.col("t.from").alias("from"), F.col("t.value").alias("value"))


def prompt_for(gt: Column, yes_prompt: str, no_prompt: str) -> Column:
    """The prompt that the label selects; a missing label is no."""
    return F.when(gt, yes_prompt).otherwise(no_prompt)
