"""Benchmark decontamination by suffix arrays of the training texts.

Words are runs of letters, digits and non-ASCII characters, lower-cased in ASCII. The training texts are processed in
shards of bounded size. A shard's suffix array holds, sorted, the suffixes that can begin a match (those that begin with
a word pair that begins some benchmark window; no other one can hold a window); each is compared by its first DEPTH words.
Every benchmark suffix that is long enough is looked up by two binary searches, which give all places of its first window
in the shard. Runs of matches along an item give the longest verbatim matches and where they are. An array serves one
shard and is then dropped.

A window is 10 consecutive words of an item, or all words of a shorter item. The benchmark is the query set. It is cut into
blocks of BLOCK_BYTES of text at most (one item at least) by running sums over its rows. The driver reads a block, makes its
arrays and sends them to the executors' disks, one block at a time. The texts are scanned once, where they lie: each shard is
looked up block by block, and a worker holds one block of several. Nothing is shuffled or written.

Defined results: null text has no words, and an item without words has no window; an empty table gives no rows; an empty
benchmark hits nothing; repeated rows have equal results, also without an id; an item without an id is named by the empty
string; items of one id count once; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.worker import frugal, prepare
from corpusloom.operators.prefix import prefix_sum
from corpusloom.schemas import require
from corpusloom.storage import materialize

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW, DEPTH = 10, 16
#: Bytes of text in a shard, and in a benchmark block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _key(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Queries:
    """A block of benchmark items: their words' numbers (from 1), their distinct windows, and whose they are."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.numbers: dict[bytes, int] = {}
        sizes = np.array([len(w) for _, w in items], np.int64)
        ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for _, words in items for w in words), np.int64, int(sizes.sum()))
        self.depth = max(DEPTH, window)
        each = np.where(sizes > window, sizes - window + 1, np.minimum(sizes, 1))  # windows of each item
        item = np.repeat(np.arange(len(items)), each)
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        long = np.minimum(sizes, window)[item]
        padded = np.concatenate([ids, np.zeros(self.depth, np.int64)])
        rows = padded[((np.cumsum(sizes) - sizes)[item] + place)[:, None] + np.arange(self.depth)]
        rows[np.arange(self.depth) >= long[:, None]] = 0
        low, one, of = np.unique(_key(rows), return_index=True, return_inverse=True)
        self.length = long[one]
        rows = rows[one]
        self.low = low
        self.high = _key(np.where(np.arange(self.depth) < self.length[:, None], rows, 2**32 - 1))
        #: Owners (item, place in it) of window w are owners[first[w]:first[w + 1]].
        order = np.argsort(of.ravel(), kind="stable")
        self.first = np.r_[0, np.cumsum(np.bincount(of.ravel(), minlength=len(low)))]
        self.owners = np.stack([item, place], 1)[order].astype(np.int32)
        self.base = len(self.numbers) + 1
        self.pairs = np.unique(rows[self.length > 1][:, 0] * self.base + rows[self.length > 1][:, 1])
        self.singles = np.unique(rows[self.length == 1][:, 0])


class Hits:
    """What a block finds in a shard: covered words, (document, item) pairs, and longest matches by document."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, q: Queries):
        n = len(ids)
        padded = np.concatenate([ids, np.zeros(q.depth, np.int64)])
        pair = ids * q.base + padded[1 : n + 1]
        able = np.isin(pair, q.pairs) & (ids > 0)
        if len(q.singles):
            able |= np.isin(ids, q.singles)
        places = np.flatnonzero(able)
        rows = padded[places[:, None] + np.arange(q.depth)]
        keys = _key(rows) if len(places) else np.empty(0, f"S{4 * q.depth}")
        order = np.argsort(keys, kind="stable")  # the shard's suffix array: places[order]
        array, keys = places[order], keys[order]
        left, right = np.searchsorted(keys, q.low, "left"), np.searchsorted(keys, q.high, "right")
        self.cover = np.zeros(n + 1, np.int64)
        found = np.flatnonzero(right > left)
        count = (right - left)[found]
        which = np.repeat(found, count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = array[np.repeat(left[found], count) + step]
        np.add.at(self.cover, start, 1)
        np.add.at(self.cover, start + q.length[which], -1)
        self.covered = np.cumsum(self.cover)[:n] > 0
        doc = np.searchsorted(ends, start, "right")
        each = q.first[which + 1] - q.first[which]  # a window may stand in several items
        owner = q.owners[np.repeat(q.first[which], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
        self.doc, self.item = np.repeat(doc, each), owner[:, 0]
        self.longest, self.where = self._runs(np.repeat(start, each), owner, np.repeat(q.length[which], each), len(ends))

    def _runs(self, start: np.ndarray, owner: np.ndarray, length: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of each document in words, and its first word's place in the shard."""
        longest, where = np.zeros(docs, np.int64), np.full(docs, -1, np.int64)
        if not len(start):
            return longest, where
        along = start - owner[:, 1]
        o = np.lexsort((start, along, owner[:, 0]))
        s, a, i, n, d = start[o], along[o], owner[o, 0], length[o], self.doc[o]
        fresh = np.r_[True, (i[1:] != i[:-1]) | (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1) | (d[1:] != d[:-1])]
        head = np.flatnonzero(fresh)
        tail = np.r_[head[1:], len(s)] - 1
        size = s[tail] + n[tail] - s[head]
        best = np.lexsort((s[head], -size, d[head]))
        docs_at, one = np.unique(d[head][best], return_index=True)
        longest[docs_at], where[docs_at] = size[best][one], s[head][best][one]
        return longest, where


Found = tuple[int, list[tuple[int, int]], list[str], int, int]


def scan_shard(words: list[list[bytes]], q: Queries) -> list[Found]:
    """(n_words, hit ranges of words, item names, longest match, its first word) of each text's words."""
    counts = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(counts + 1)  # a 0 after each document keeps matches inside it
    begins = ends - counts - 1
    get = q.numbers.get
    ids = np.fromiter((x for w in words for x in (*[get(v, 0) for v in w], 0)), np.int64, int(ends[-1]) if len(ends) else 0)
    h = Hits(ids, ends, q)
    items: list[set[str]] = [set() for _ in words]
    for d, i in set(zip(h.doc.tolist(), h.item.tolist(), strict=True)):
        items[d].add(q.names[i])
    edge = np.flatnonzero(np.diff(np.r_[0, h.covered.astype(np.int8), 0]))
    first, after = edge[::2], edge[1::2]  # no run crosses the 0 after a document
    ranges: list[list[tuple[int, int]]] = [[] for _ in words]
    for d, a, b in zip(np.searchsorted(ends, first, "right").tolist(), first.tolist(), after.tolist(), strict=True):
        ranges[d].append((a - int(begins[d]), b - int(begins[d])))
    place = np.where(h.where >= 0, h.where - begins, -1)
    return [(int(c), r, sorted(s), int(n), int(p)) for c, r, s, n, p in zip(counts, ranges, items, h.longest, place, strict=True)]


def _both(a: Found, b: Found) -> Found:
    """What two blocks find in one text."""
    best = min((-a[3], a[4]), (-b[3], b[4]))
    return a[0], sorted({*a[1], *b[1]}), sorted({*a[2], *b[2]}), -best[0], best[1]


def scan_blocks(texts: list[str | None], blocks: list[Broadcast]) -> list[Found]:
    """scan_shard() of every block, one after the other: a worker holds one of several, the rest lie on its disk."""
    words = [words_of(t) for t in texts]
    found: list[Found] | None = None
    for block in blocks:
        now = scan_shard(words, block.value)
        found = now if found is None else [_both(a, b) for a, b in zip(found, now, strict=True)]
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)  # read from disk again for the next shard
    return found or []


def shards(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about SHARD_BYTES, of one row at least."""
    rows = max(1, int(batch.num_rows * SHARD_BYTES / max(batch.nbytes, SHARD_BYTES)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def query_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The benchmark in blocks, made one after the other."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t"))
    size = F.octet_length(F.coalesce("t", F.lit("")))
    if (items.agg(F.sum(size + 64)).first()[0] or 0) <= block_bytes:
        blocks = [items]
    else:
        dealt = items.withColumn("k", F.xxhash64("item", "t"))
        placed = materialize(prefix_sum(dealt, size + 64, ["k", "item", "t"], F.shiftright("k", 52), "at").withColumn("block", F.floor(F.col("at") / block_bytes)), "benchmark")
        blocks = [placed.where(F.col("block") == r[0]).select("item", "t") for r in placed.select("block").distinct().orderBy("block").collect()]  # numbers of blocks
    for block in blocks:
        yield Queries([(r[0] or "", words_of(r[1])) for r in block.collect()])  # block_bytes and one item at most


RESULTS = "n_words long, ranges array<struct<a:int,b:int>>, items array<string>, longest_match long, match_start long"


def _sent(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> list[Broadcast]:
    """The benchmark's blocks, each sent to the executors' disks; the driver makes one at a time."""
    return [docs.sparkSession.sparkContext.broadcast(q) for q in query_blocks(benchmark, block_bytes=block_bytes)]  # block_bytes and one item at most


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_hit, items, longest_match, match_start) of each row of docs; places and lengths in words."""
    require(docs, key, text)
    prepare(docs.sparkSession)
    blocks = _sent(docs, benchmark, block_bytes)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "ranges", "items", "longest_match", "match_start"]
    types = (pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string()), pa.int64(), pa.int64())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in shards(b):
                n, ranges, items, longest, place = zip(*scan_blocks(part.column(1).to_pylist(), blocks), strict=True)
                spans = [[{"a": x, "b": y} for x, y in r] for r in ranges]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, t) for x, t in zip((n, spans, items, longest, place), types, strict=True)]], names)

    got = docs.select(key, text).mapInArrow(frugal(scan), f"`{key}` {kind}, {RESULTS}")
    fold = F.aggregate(
        F.array_sort("ranges"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, r: F.struct(F.greatest(s["end"], r["b"]).alias("end"), (s["hit"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["end"], r["a"]))).alias("hit")),
        lambda s: s["hit"],
    )
    return got.select(key, "n_words", fold.alias("n_hit"), "items", "longest_match", "match_start")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without those that hold a benchmark window."""
    prepare(docs.sparkSession)
    blocks = _sent(docs, benchmark, block_bytes)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in shards(b):
                yield part.filter(pa.array([not x[1] for x in scan_blocks(part.column(at).to_pylist(), blocks)], pa.bool_()))

    return docs.mapInArrow(frugal(keep), docs.schema)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = contamination(docs, benchmark)
    told = F.array_join(F.array_sort("items"), ",")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(told, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest_match", "match_start")
