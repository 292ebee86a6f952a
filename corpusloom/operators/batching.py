"""The ordered, resumable batch view: batches by place, skip, shard, truncate, pad and mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import attention_mask, label_mask, pad_to
from corpusloom.operators.prefix import free_names, global_row_number, key_bucket


def assign_batches(df: DataFrame, size: int, order: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """df with batch_id and pos; the last batch may be short, none is dropped."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    (rn,) = free_names(df, "_rn")
    placed = global_row_number(df, order, key_bucket(order[0]) if bucket is None else bucket, rn)
    return placed.withColumn("batch_id", F.floor(F.col(rn) / size)).withColumn("pos", F.col(rn) % size).drop(rn)


def skip_batches(df: DataFrame, n: int) -> DataFrame:
    """What is left after n consumed batches."""
    return df.where(F.col("batch_id") >= n) if n else df


def _consumed_before(index: Column, taken: Sequence[int]) -> Column:
    """How many of the batches before index its session took: rank r of len(taken) has had its first taken[r] ones."""
    turn, place = F.floor(index / len(taken)), index % len(taken)
    had = F.transform(F.lit([int(x) for x in taken]).cast("array<long>"), lambda n, r: F.least(n, turn + F.when(r < place, 1).otherwise(0)))
    return F.aggregate(had, F.lit(0).cast("long"), lambda a, x: a + x)


def resume_sharded(df: DataFrame, sessions: Sequence[Sequence[int]], world_size: int) -> DataFrame:
    """df with session, rank and turn: which session, and which of its ranks at which step, takes a row's batch.

    sessions has, for every earlier session, how many batches each of its ranks took; their lengths are the world sizes. What a
    session leaves is numbered anew, in order, and dealt to the next session's ranks; the last one, len(sessions), has
    world_size ranks and takes all that is left. A batch's new number is its old one less those taken before it, which
    follows from the ranks' counts alone: nothing is shuffled, and every batch is taken once.
    """
    if world_size < 1 or any(not s or min(s) < 0 for s in sessions):
        raise ValueError("a session needs a rank at least, and ranks can't take less than nothing")
    index, session, rank, turn = free_names(df, "_index", "session", "rank", "turn")
    got = df.withColumns({index: F.col("batch_id").cast("long"), session: F.lit(None).cast("int"), rank: F.lit(None).cast("long"), turn: F.lit(None).cast("long")})
    for k, taken in enumerate([*sessions, None]):
        n = world_size if taken is None else len(taken)
        place, step = F.col(index) % n, F.floor(F.col(index) / n)
        mine = F.col(session).isNull() & (F.lit(True) if taken is None else step < F.element_at(F.lit([int(x) for x in taken]), (place + 1).cast("int")))
        left = F.col(index) if taken is None else F.col(index) - _consumed_before(F.col(index), taken)
        got = got.select(
            *df.columns,
            left.alias(index),
            F.when(mine, k).otherwise(F.col(session)).alias(session),
            F.when(mine, place).otherwise(F.col(rank)).alias(rank),
            F.when(mine, step).otherwise(F.col(turn)).alias(turn),
        )
    return got.drop(index)


def shard_batches(df: DataFrame, rank: int, world_size: int) -> DataFrame:
    """The batches of one rank: batch_id modulo world_size."""
    if not 0 <= rank < world_size:
        raise ValueError("rank must be in [0, world_size)")
    return df.where(F.col("batch_id") % world_size == rank)


def _padded(df: DataFrame, length: int, width: Column) -> DataFrame:
    """df with input_ids cut to length and padded to width, attention_mask and labels (ignored where the mask is 0)."""
    n, w = free_names(df, "_n", "_w")
    cut = df.withColumn("input_ids", F.slice("input_ids", 1, length)).withColumn(n, F.size("input_ids")).withColumn(w, width)
    wide = cut.withColumn("attention_mask", attention_mask(F.col(n), F.col(w))).withColumn("input_ids", pad_to(F.col("input_ids"), F.col(w)))
    return wide.withColumn("labels", label_mask(F.col("input_ids"), F.col("attention_mask"))).drop(n, w)


def collate(df: DataFrame, length: int, pad_to_max: bool = False) -> DataFrame:
    """Rows with batch_id, truncated to length and padded on the right to the longest of their batch, or to length.

    For rows that have a batch already; their token arrays are shuffled by it. Stored tables: see collate_stored().
    """
    if pad_to_max:
        return _padded(df, length, F.lit(length))
    n, w = free_names(df, "_size", "_width")
    sized = df.withColumn(n, F.least(F.size("input_ids"), F.lit(length)))
    return _padded(sized.withColumn(w, F.max(n).over(Window.partitionBy("batch_id"))), length, F.col(w)).drop(n, w)


def collate_stored(tokens: DataFrame, size: int, length: int, key: str, bucket: Column | None = None, pad_to_max: bool = False, count: str = "num_tokens") -> DataFrame:
    """assign_batches() and collate() of a table that storage.bucketed() has stored by key, with each row's number of tokens.

    Places and widths come from key and count alone, a scan of two narrow columns. They are dealt to the table's buckets and
    meet the token arrays where these lie: no array is shuffled. Keys are unique and not null.
    """
    narrow = assign_batches(tokens.select(key, F.least(F.col(count), F.lit(length)).cast("int").alias("_width")), size, [key], bucket)
    width = F.lit(length) if pad_to_max else F.max("_width").over(Window.partitionBy("batch_id"))
    placed = narrow.withColumn("_width", width)
    return _padded(tokens.join(placed, key), length, F.col("_width")).drop("_width")
