"""Vector code compression: product codes by filtering Lloyd.

Vectors of integers are cut into equal parts; each part position has a codebook of its own. In a round, every partition builds
kd-trees over its parts, block by block, whose nodes hold a box, the sum and the count of what lies below. Codebook entries go
down the trees: an entry that is farther than another from all of a node's box is dropped, and a node that one entry is left
for goes to it whole, by its cached sum and count. Only the points of leaves that several entries are left for are compared one
by one. The driver gets one row per entry: sums and counts that tasks have combined.

Ties go to the lower index: an entry is dropped at equal distance only if its index is the higher one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import skew_join
from corpusloom.llm.worker import frugal, prepare
from corpusloom.storage import materialize

#: Parts of a vector, entries of a codebook, rounds of Lloyd, and what components are multiplied by before they are floored.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors under one set of trees, and points of a leaf at most.
BLOCK, LEAF = 32_768, 16


def largest(width: int) -> int:
    """Integer components of a vector of width must be smaller in size than this, so that its error is a long."""
    return math.isqrt((1 << 59) // max(width, 1))


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, place]: integers; width is the vectors' length, of which each part has an equal share."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite. Runs in the JVM."""
    double = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _fits(vector: Column, width: int, scale: int) -> Column:
    """Whether a usable vector has the codebooks' length and components that are not too large for an exact error."""
    return (F.size(vector) == width) & F.forall(vector, lambda x: F.abs(x.cast("double")) < largest(width) / scale)


def _integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, width)


class Tree:
    """A kd-tree over points, built level by level: node i of a level covers a run of the sorted points."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        order, starts = np.arange(n), np.array([0])
        self.levels: list[np.ndarray] = [starts]
        while (sizes := np.diff(np.r_[starts, n])).max(initial=0) > LEAF:
            inside = points[order]
            wide = (np.maximum.reduceat(inside, starts) - np.minimum.reduceat(inside, starts)).argmax(1)
            node = np.repeat(np.arange(len(starts)), sizes)
            key = inside[np.arange(n), wide[node]]
            order = order[np.lexsort((key, node))]
            # every node is halved: sizes of a level differ by one, so none is empty before leaves are small
            starts = np.stack([starts, starts + (sizes + 1) // 2], 1).ravel()
            self.levels.append(starts)
        self.order, self.points = order, points[order]
        self.boxes = [(np.minimum.reduceat(self.points, s), np.maximum.reduceat(self.points, s)) for s in self.levels]
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), self.points.cumsum(0)])

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry of every point, sums and counts of what each entry gets)."""
        n, k = len(self.points), len(entries)
        own, sums, counts = np.full(n, -1), np.zeros_like(entries), np.zeros(k, np.int64)
        node, left = np.array([0]), np.ones((1, k), bool)
        for depth, starts in enumerate(self.levels):
            ends = np.r_[starts[1:], n]
            a, b = starts[node], ends[node]
            low, high = self.boxes[depth]
            left = left & ~self._farther(entries, low[node], high[node], left)
            alone = left.sum(1) == 1
            whole = left[alone].argmax(1)
            np.add.at(sums, whole, self.sums[b[alone]] - self.sums[a[alone]])
            np.add.at(counts, whole, b[alone] - a[alone])
            _fill(own, a[alone], b[alone], whole)
            node, left, a, b = node[~alone], left[~alone], a[~alone], b[~alone]
            if not len(node):
                break
            if depth + 1 < len(self.levels):
                node, left = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(left, 2, 0)
            else:
                at = np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)])
                best = _nearest(self.points[at], entries, np.repeat(left, b - a, 0))
                own[at] = best
                np.add.at(sums, best, self.points[at])
                np.add.at(counts, best, 1)
        out = np.empty(n, np.int64)
        out[self.order] = own
        return out, sums, counts

    @staticmethod
    def _farther(entries: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each node, the entries that one entry beats everywhere in the node's box."""
        middle = low + high
        off = 2 * entries[None] - middle[:, None]
        near = np.where(left, (off * off).sum(2), np.iinfo(np.int64).max).argmin(1)
        best = entries[near][:, None]
        # the corner of the box that lies farthest towards an entry, seen from the best one
        corner = np.where(entries[None] > best, high[:, None], low[:, None])
        mine, its = entries[None] - corner, best - corner
        gap = (mine * mine).sum(2) - (its * its).sum(2)
        return left & ((gap > 0) | ((gap == 0) & (np.arange(len(entries))[None] > near[:, None])))


def _fill(own: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
    for x, y, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True):
        own[x:y] = v


def _nearest(points: np.ndarray, entries: np.ndarray, left: np.ndarray, rows: int = 8192) -> np.ndarray:
    """The nearest of each point's entries, the lowest index of equally near ones."""
    out = np.empty(len(points), np.int64)
    most = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    small = 4 * most * most * points.shape[1] < 1 << 53  # then doubles are exact, and fast
    kind = np.float64 if small else np.int64
    turned, squares = -2 * entries.T.astype(kind), (entries * entries).sum(1).astype(kind)
    for i in range(0, len(points), rows):
        far = points[i : i + rows].astype(kind) @ turned + squares
        far[~left[i : i + rows]] = np.inf if small else np.iinfo(np.int64).max
        out[i : i + rows] = far.argmin(1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], at: int, width: int, scale: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Batches of about BLOCK rows together, and their vectors as integers."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield held, np.concatenate([_integers(b.column(at), width, scale) for b in held])
            held, rows = [], 0
    if rows:
        yield held, np.concatenate([_integers(b.column(at), width, scale) for b in held])


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of rows' usable vectors; None if there are none.

    They start as the parts of the vectors with the smallest keys (of equal keys, the smaller vector; rows without a key can't
    be first). Fewer vectors than entries give fewer entries. Entries that nothing is nearest to stay as they are. Vectors of
    another length than the first, and such with components of largest() and more, take no part. A length that parts doesn't
    divide raises ValueError. The driver gets parts * entries rows a round.
    """
    spark = rows.sparkSession
    prepare(spark)
    kept = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where(usable(F.col("v")))
    first = kept.where("k IS NOT NULL").orderBy("k", "v").limit(1).collect()
    if not first or not len(first[0]["v"]):
        return None
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    kept = kept.where(_fits(F.col("v"), width, scale))
    starts = [r["v"] for r in kept.where("k IS NOT NULL").orderBy("k", "v").limit(entries).collect()]
    if not starts:
        return None
    book = np.floor(np.array(starts, np.float64) * scale).astype(np.int64).reshape(len(starts), parts, -1).transpose(1, 0, 2)

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], book: np.ndarray = book) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
            for _, points in _blocks(batches, 0, width, scale):
                for p, part in enumerate(np.split(points, parts, 1)):
                    _, s, c = Tree(part).assign(book[p])
                    sums[p] += s
                    counts[p] += c
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

        got = kept.select("v").mapInArrow(frugal(run), "p int, e int, n long, s array<long>")
        places = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width // parts)]
        book = book.copy()
        for r in got.groupBy("p", "e").agg(F.sum("n").alias("n"), *places).collect():  # parts * entries rows at most
            book[r["p"], r["e"]] = [r[f"s{i}"] // r["n"] for i in range(width // parts)]
    return Codebooks(book, scale)


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """rows with a usable vector, with code (two hex digits a part) and error (long): the squared distance to what it stands for.

    A vector of another length than the codebooks', or with components of largest() and more, has neither. Columns of rows that
    are named code or error are replaced.
    """
    prepare(rows.sparkSession)
    rows = rows.drop("code", "error")
    book, parts, width, scale = books.entries, len(books.entries), books.width, books.scale
    if book.shape[1] > 256:
        raise ValueError("two hex digits hold 256 entries")
    kept = rows.where(usable(F.col(vector)))
    fits = kept.withColumn(vector, F.when(_fits(F.col(vector), width, scale), F.col(vector)))
    at = rows.columns.index(vector)
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, points in _blocks(batches, at, width, scale):
            codes, error = np.empty((len(points), parts), np.int64), np.zeros(len(points), np.int64)
            for p, part in enumerate(np.split(points, parts, 1)):
                codes[:, p] = Tree(part).assign(book[p])[0]
                off = part - book[p][codes[:, p]]
                error += (off * off).sum(1)
            done = 0
            for b in held:
                n = b.num_rows
                told = pa.array(["".join(x) for x in digits[codes[done : done + n]].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, told, pa.array(error[done : done + n])], names=[*b.schema.names, "code", "error"])
                done += n

    out = T.StructType([*rows.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = fits.where(F.col(vector).isNotNull()).mapInArrow(frugal(run), out)
    odd = kept.where(~_fits(F.col(vector), width, scale)).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
    return coded.unionByName(odd)


def decode(coded: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """coded with approximation (array<double>): the components that a code stands for."""
    book, scale = books.entries, books.scale
    entries = F.lit([[[x / scale for x in e] for e in part] for part in book.tolist()])
    part = F.sequence(F.lit(0), F.lit(len(book) - 1))
    number = lambda i: F.conv(F.substring(F.col(code), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return coded.withColumn("approximation", F.when(F.col(code).isNotNull(), F.flatten(F.transform(part, lambda i: F.get(F.get(entries, i), number(i))))))


def code_digest(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row with a usable vector.

    Errors of a label are summed in the tasks that have them first; rows without a label belong together.
    """
    table = rows.select("vec_id", "embedding", "label")
    books = fit(table)
    if books is None:
        return table.where(usable(F.col("embedding"))).selectExpr("vec_id", "CAST(NULL AS STRING) AS code", "CAST(NULL AS LONG) AS error", "CAST(NULL AS LONG) AS label_error", "sha2('', 256) AS codebooks_sha256")
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("group")
    coded = materialize(encode(table, books).select("vec_id", "code", "error", group), "codes")
    labels = materialize(coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    return skew_join(coded, labels, "group", "n").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
