"""Scalar expressions over strings and token arrays; all of them run inside the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_ID, IGNORED_LABEL = 0, -100


def source_of_path(path: Column) -> Column:
    """Name of a file's parent directory, which names its source."""
    return F.element_at(F.split(path, "/"), -2)


def source_of_top(path: Column, prefix: str = "") -> Column:
    """First part of a path, after prefix if it begins with that."""
    rest = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if prefix else path
    return F.substring_index(rest, "/", 1)


def pad_to(ids: Column, width: Column) -> Column:
    """ids, padded on the right with PAD_ID to width."""
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("long"), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def attention_mask(length: Column, width: Column) -> Column:
    """1 for each of the first length places, then 0 up to width; by length, so a genuine id 0 keeps its 1."""
    return F.concat(
        F.array_repeat(F.lit(1).cast("long"), length.cast("int")),
        F.array_repeat(F.lit(0).cast("long"), F.greatest(width - length, F.lit(0)).cast("int")),
    )


def label_mask(ids: Column, mask: Column) -> Column:
    """ids where mask is 1, else IGNORED_LABEL."""
    return F.zip_with(ids, mask, lambda x, m: F.when(m == 0, F.lit(IGNORED_LABEL).cast("long")).otherwise(x))


def tokens_checksum(ids: Column) -> Column:
    """Sum of id times place (from 1): a digest of a token array that any SQL engine can repeat."""
    return F.aggregate(F.transform(ids, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)


def checkpoint_name(step: Column, loss: Column) -> Column:
    return F.format_string("checkpoint-step%d-loss%.4f", step, loss)


def eval_file_name(task: Column, step: Column) -> Column:
    return F.format_string("%s_step%d.json", task, step)


def run_name(now: datetime) -> str:
    """Date, hour and minute without leading zeros; the clock is the caller's, so that runs can be repeated."""
    return f"{now.date()}-{now.hour}-{now.minute}"


def python_round(value: float | None, digits: int) -> float | None:
    """Rounding as the JSON reports use it: correct on the binary value, ties to even."""
    return None if value is None else round(value, digits)
