"""Best-fit packing of token pieces, with certified bin counts.

Documents become token ids plus an end id; only documents longer than a sequence are cut, from the end, into pieces of
its length, so that the first piece may be shorter. Pieces are dealt to partitions of bounded size and each partition
is packed by best-fit decreasing. Dual-feasible functions give a lower bound on a partition's bins: where it is reached,
the partition is certified optimal and done. Partitions with a gap release the documents of their emptiest bins; the
released documents meet in fewer partitions and are packed anew, for some rounds. A repacked pool takes effect if it
needs fewer bins.

Memory: a task holds PIECES rows of a few integers; the driver gets one row of sums per round and a histogram of lengths.

Defined results: null text is empty text, one end id; an empty table gives no rows; repeated rows are packed as often as
they come, and so are rows without an id; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.worker import frugal, prepare
from corpusloom.operators.byte_level import Encoder, encoder_of  # noqa: F401
from corpusloom.schemas import require
from corpusloom.storage import materialize

SEQUENCE, END_ID = 1024, 2
#: Rows of a packing partition, on average; exchange rounds at most.
PIECES, ROUNDS = 100_000, 3
PIECE_COLUMNS = "piece int, start long, length long, ids_crc32 long"


# ---- token ids


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones at the end, the rest first."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document; ids are little-endian unsigned 32-bit."""
    require(docs, key, text)
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(definition)  # a vocabulary: its size does not follow the data
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(sent.value)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            keys = b.column(0)
            for i in range(b.num_rows):
                ids = np.array([*encoder.encode(b.column(1)[i].as_py() or ""), end_id], "<u4")
                for p, (s, n) in enumerate(cut(len(ids), size)):
                    raw = ids[s : s + n].tobytes()
                    for column, x in zip(rows, (i, p, s, n, zlib.crc32(raw), raw if keep_ids else None), strict=True):
                        column.append(x)
            taken = keys.take(pa.array(rows[0], pa.int64()))
            out = [taken, pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(key, text).mapInArrow(frugal(encode), f"`{key}` {kind}, {PIECE_COLUMNS}" + ", ids binary" * keep_ids)


# ---- bins


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (in descending order), and the bins' fill.

    Open bins are listed by free space, and a bit set of the spaces that have bins finds the tightest in one step.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    fill: list[int] = []
    spaces = 0
    for i, n in enumerate(lengths.tolist()):
        fits = spaces >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
        else:
            b, space = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := space - n:
            by_space[left].append(b)
            spaces |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that pieces with these counts by length (0..size) need at least, by two families of dual-feasible functions.

    For a threshold e up to size/2: lengths over size-e count as a whole bin, those under e as nothing, the rest as they
    are. For k: a length x counts as floor((k+1)x/size)/k, or as x/size where (k+1)x/size is whole.
    """
    x, n = np.arange(size + 1), counts.astype(np.int64)
    total = int((x * n).sum())
    best = -(-total // size)
    large, mass = np.cumsum(n[::-1])[::-1], np.cumsum(x * n)
    for e in range(1, size // 2 + 1):
        whole = int(large[size - e + 1])
        rest = int(mass[size - e] - mass[e - 1])
        best = max(best, whole - (-rest // size))
    for k in range(1, 21):
        q, r = np.divmod((k + 1) * x, size)
        scaled = np.where(r == 0, x * k, q * size)  # in units of 1/(k*size)
        best = max(best, -(-int((scaled * n).sum()) // (k * size)))
    return best


def _pack_group(rows: pa.Table, size: int, order: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """rows in the order of packing, and each one's bin, offset and whether it is released."""
    rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in order)])
    lengths = rows["length"].to_numpy()
    bins, offsets, fill = best_fit_decreasing(lengths, size)
    gap = len(fill) - lower_bound(np.bincount(lengths, minlength=size + 1), size)
    # the emptiest bins take part in the exchange: as many as would hold the gap's missing bins many times over
    open_bins = np.argsort(fill, kind="stable")[: 16 * gap + 1] if gap > 0 else np.empty(0, np.int64)
    return rows, bins, offsets, np.isin(bins, open_bins[fill[open_bins] < size])


def _packed(pieces: DataFrame, parts: int, size: int, number: int, key: str) -> DataFrame:
    """pieces with sequence_id, offset and released, packed inside parts partitions; a written table."""
    prepare(pieces.sparkSession)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "released")]
    by = F.when(F.col(key).isNull(), F.xxhash64("ids_crc32", "piece", F.lit(number))).otherwise(F.xxhash64(key, "piece", F.lit(number)))
    dealt = pieces.select(*columns, F.pmod(by, F.lit(parts)).cast("int").alias("_part"))
    order = [key, "piece", "start"]

    def pack(rows: pa.Table) -> pa.Table:
        first = (number << 56) + (rows["_part"][0].as_py() << 32)
        out, bins, offsets, released = _pack_group(rows, size, order)
        made = {"sequence_id": first + bins, "offset": offsets, "released": released}
        return pa.table([*(out[c] for c in columns), *map(pa.array, made.values())], [*columns, *made])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*columns).schema.fields)
    return materialize(dealt.groupBy("_part").applyInArrow(pack, f"{schema}, sequence_id long, offset long, released boolean"), "packed")


def _bins(df: DataFrame) -> int:
    """Sequences of a packing: each has one piece at its beginning."""
    return df.where("offset = 0").count()


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, key: str = "doc_id", per_part: int = PIECES, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """pieces with sequence_id and offset, and {sequences, lower_bound, rounds}.

    pieces must be a written table or cheap to make again. lower_bound holds for the whole corpus.
    """
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # size rows at most
        counts[r[0]] = r[1]
    done, pool, made = None, pieces, 0
    for number in range(rounds + 1):
        n = int(counts.sum()) if not number else pool.count()
        if not n:
            break
        now = _packed(pool, max(1, -(-n // per_part)), size, number, key)
        made = number
        if number and _bins(now) >= _bins(pool):
            break  # no better than before
        kept = now.where("NOT released")
        done = kept if done is None else done.unionByName(kept)
        pool = now.where("released")
    if done is None:
        done = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).withColumn("released", F.lit(False)).limit(0)
    elif pool is not pieces:
        done = done.unionByName(pool.select(done.columns))
    done = done.drop("released")
    return done, {"sequences": _bins(done), "lower_bound": lower_bound(counts, size), "rounds": made}


def sequences(packed: DataFrame, with_ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed ids themselves; a group has one sequence's ids at most."""
    rows = packed.select(key, "piece", "sequence_id", "offset").join(with_ids.select(key, "piece", "ids"), [key, "piece"])
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.aggregate(joined, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.count(F.lit(1)).alias("n_pieces"))

