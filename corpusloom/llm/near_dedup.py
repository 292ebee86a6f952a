"""MinHash near-deduplication by fast similarity sketches, bands and exact verification.

1. Texts become sets of word shingles. Equal sets form a class, whatever ids its rows have; one row stands for it.
2. A sketch has a number of places. In round i every element is hashed to a place with a value in [i, i+1), and a place
   keeps its smallest value; rounds end when every place is filled. Rounds from that number on send all elements to one
   place each, so that twice the number of places in rounds always suffices. Two sets agree in a place with the
   probability of their Jaccard similarity, and agreements are concentrated about it.
3. BANDS groups of ROWS places are the buckets. A pair at similarity 0.8 shares no bucket with a probability of 3e-7.
   In each bucket every class is paired with one leader: the class that stands in the fullest buckets, which in a family
   of copies is the one nearest to all others. A group of n makes n-1 pairs, not n*n.
4. Pairs whose sizes rule the similarity out go, and those whose sketches agree in so few places that the similarity
   has a probability of 3e-6 at most (fewest_agreements(), on a larger sketch of the classes that share a bucket). The
   others are confirmed on the full sets, which are made again from the texts of candidates alone.
5. Links are joined to components by smallest-label steps with pointer jumping. Buckets that still hold several
   components get a second leader, chosen by hash. What then is still mixed is compared between components, sketch by
   sketch, in blocks of BLOCK classes inside a task; only pairs that the sketches allow leave it, once each, and are
   confirmed. So no candidate pair of different components is left out, and no group's pairs are all emitted. A bucket of
   c classes that is still mixed sends each class to c/BLOCK tasks: the rows dealt grow with c*c/BLOCK there.

Buckets, nodes and labels with very many rows are joined by broadcast where their rows lie (skew_join()).

Defined results: null and empty texts have the empty set, are linked with nothing and kept; a row is known by its id and
its text, so that different texts under one id are linked each for itself, and rows that repeat both have equal results;
rows without an id are linked as any others, take the smallest id that their links reach and go, or else have a null
component and stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_IDS, skew_join
from corpusloom.llm.hashing import BASE, mix, shingle_sets, slices
from corpusloom.llm.worker import frugal, prepare, trim
from corpusloom.schemas import require
from corpusloom.storage import drop_tables, materialize

#: Words of a shingle and the similarity in percent, unless the caller says otherwise.
WORDS, PERCENT = 5, 80
BANDS, ROWS = 21, 3
#: Places of the sketch that makes the buckets, and of the sketch that estimates similarities; pairs are looked at by the
#: latter's first GLANCE places first.
COORDINATES, ESTIMATE, GLANCE = BANDS * ROWS, 1008, 126
#: Classes of a block that a task compares.
BLOCK = 4096
#: Classes of a block after which a worker gives freed memory back.
TRIMMED = 256
#: Sets of at most so many elements run all rounds at once.
SMALL_SET = 64
SEEDS = mix(np.arange(1, 2 * ESTIMATE + 1, dtype=np.uint64) * np.uint64(BASE))
EMPTY = np.uint64(2**64 - 1)
LOW = np.uint64(0xFFFFFFFF)


def sketch(u: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes: round << 32 | value of each place."""
    places = np.full(size, EMPTY, np.uint64)
    t, half = np.uint64(size), np.uint64(32)
    if len(u) <= SMALL_SET:
        v = mix(u[:, None] ^ SEEDS[None, : 2 * size])
        value = (np.arange(2 * size, dtype=np.uint64) << half) | (v & LOW)
        place = ((v[:, :size] >> half) * t >> half).astype(np.int64)
        np.minimum.at(places, place.ravel(), value[:, :size].ravel())
        return np.minimum(places, value[:, size:].min(axis=0))
    for i in range(2 * size):
        v = mix(u ^ SEEDS[i])
        value = np.uint64(i << 32) | (v & LOW)
        if i < size:
            np.minimum.at(places, ((v >> half) * t >> half).astype(np.int64), value)
        else:
            places[i - size] = min(places[i - size], value.min())
        if places.max() != EMPTY:
            break
    return places


def band_keys(places: np.ndarray) -> np.ndarray:
    rows = places.reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(ROWS):
        key = mix(key * np.uint64(BASE) + rows[:, j])
    return key.view(np.int64)


def fewest_agreements(percent: int, places: int) -> int:
    """Places of so many in which two sets of that similarity agree at least, but for 4.75 standard deviations."""
    p = percent / 100
    return math.floor(places * p - 4.75 * math.sqrt(places * p * (1 - p)))


def agree(one: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of others have sketches that allow the similarity to one (a row, or a row each)."""
    ok = np.count_nonzero(others[:, :GLANCE] == one[..., :GLANCE], axis=1) >= fewest_agreements(percent, GLANCE)
    left = np.flatnonzero(ok)
    rest = one[left] if one.ndim == 2 else one
    ok[left] = np.count_nonzero(others[left] == rest, axis=1) >= fewest_agreements(percent, ESTIMATE)
    return ok


def sketches(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, id, h, n, digest, bands, text_sha256): a number for the row, its id, hash of its text, set size, digest of the
    set, bucket keys; a written table."""
    require(docs, key, text)
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "h", "n", "digest", "bands", "text_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, digest, bands = [], [], []
                texts = part.column(2).to_pylist()
                for u in shingle_sets(texts, words):
                    n.append(len(u))
                    digest.append(_digest(u))
                    bands.append(band_keys(sketch(u)) if len(u) else None)
                sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sha)], names)

    made = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), text).mapInArrow(frugal(run), f"id {kind}, h long, n long, digest binary, bands array<long>, text_sha256 string")
    return materialize(made.withColumn("rid", F.monotonically_increasing_id()), "sketches")


def _digest(u: np.ndarray) -> bytes | None:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None


def _of_classes(docs: DataFrame, who: DataFrame, words: int, key: str, text: str, make: Callable[[np.ndarray], bytes], name: str) -> DataFrame:
    """(c, u): what make gives for the set of each class in who (written: c, id, h, digest); a written table.

    The texts are found by id and hash, and their sets hold the digest; who is broadcast only behind a count.
    """
    few = who.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = docs[key].eqNullSafe(who["id"]) & (F.xxhash64(docs[text]) == who["h"])
    found = docs.join(F.broadcast(who) if few else who, same).select(who["c"], who["digest"], docs[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                c, made = [], []
                for number, digest, u in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2).to_pylist(), words), strict=True):
                    if digest == _digest(u):
                        c.append(number)
                        made.append(make(u))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(made, pa.binary())], ["c", "u"])

    made = materialize(found.mapInArrow(frugal(run), "c long, u binary"), name)
    if made.count() == who.count():
        return made
    return materialize(made.dropDuplicates(["c"]), name)  # rows that repeat id and text


def _with_both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, ua, ub) of pairs of a member a and its leader b (written), and values (c, u, written).

    Members' values travel to the leaders'. Both joins are by shuffle at every size; a leader of many pairs brings many
    bytes, by which adaptive execution splits its partition.
    """
    members = pairs.join(values.select(F.col("c").alias("a"), F.col("u").alias("ua")), "a")
    return members.join(values.select(F.col("c").alias("b"), F.col("u").alias("ub")), "b").select("a", "b", "ua", "ub")


def _likely(pairs: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity; a written table."""
    pairs = materialize(pairs, "pairs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                a, b = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(-1, ESTIMATE) for i in (2, 3))
                yield x.select(["a", "b"]).filter(pa.array(agree(a, b, percent)))

    likely = materialize(_with_both(pairs, places).mapInArrow(frugal(keep), "a long, b long"), "likely-pairs")
    drop_tables(pairs)
    return likely


def _confirmed(docs: DataFrame, likely: DataFrame, who: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of likely (written) with 100 * intersection >= percent * union on their full sets; a written table."""
    ids = likely.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    some = materialize(who.join(ids, "c", "left_semi"), "candidates")
    full = _of_classes(docs, some, words, key, text, lambda u: u.tobytes(), "sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                u, v = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([u, v]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(u) + len(v) - inter))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = materialize(_with_both(likely, full).mapInArrow(frugal(confirm), "a long, b long").distinct(), "links")
    drop_tables(some, full)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links lead to, for every id in links (a, b); a written table.

    Each step takes the smallest label among neighbours and then the label of the label, until none changes. A node with
    many links, and a label with many nodes, is joined by broadcast.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l"), F.count(F.lit(1)).alias("n")).toDF("id", "l", "n"), "labels")
    while True:
        near = skew_join(edges, labels.select(F.col("id").alias("b"), "l", "n"), "b", "n").groupBy("a").agg(F.min("l").alias("m")).toDF("id", "m")
        lower = materialize(labels.join(near, "id").select("id", "n", F.col("l").alias("old"), F.least("l", "m").alias("l")), "labels")
        tops = lower.groupBy("l").agg(F.count(F.lit(1)).alias("nodes")).join(lower.select(F.col("id").alias("l"), F.col("l").alias("top")), "l")
        step = materialize(skew_join(lower, materialize(tops, "tops"), "l", "nodes").select("id", "n", "old", F.least("l", "top").alias("l")), "labels")
        drop_tables(lower)
        labels = step.select("id", "l", "n")
        if not step.where("l < old").head(1):
            return labels.select("id", F.col("l").alias("component"))


def _sized(percent: int) -> str:
    """The sizes allow the similarity: the smaller set is at least percent of the larger."""
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb)"


def _mixed(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, id, n, component, c) of buckets that hold several components; a written table. c: the bucket's rows."""
    member = materialize(shared.select("bucket", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    sizes = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("bucket", "c")
    mixed = materialize(skew_join(member, materialize(sizes, "mixed"), "bucket", "c").select("bucket", "id", "n", "component", "c"), "mixed-buckets")
    drop_tables(member)
    return mixed


def _with_leaders(rows: DataFrame, rank: Column, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each class and its bucket's leader, the one of the largest rank."""
    rows = rows.withColumn("rank", rank)
    best = rows.groupBy("bucket").agg(F.max_by("id", "rank").alias("leader"), F.max_by("n", "rank").alias("nb"), F.max_by("component", "rank").alias("cb"), F.count(F.lit(1)).alias("rows"))
    led = skew_join(rows, materialize(best, "leaders"), "bucket", "rows").withColumn("na", F.col("n")).where(f"component <> cb AND {_sized(percent)}")
    return led.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()


def cross_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of one block: other components, sizes and sketches that allow the similarity, and this bucket their first."""
    ids, n, comp = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["component"].to_numpy()
    places = np.frombuffer(b"".join(rows["places"]), np.uint8).reshape(-1, ESTIMATE)
    bands = np.stack(rows["bands"].to_numpy())
    side, bucket = rows["side"].to_numpy(), int(rows["bucket"].iloc[0])
    this = int(np.flatnonzero(bands[0] == bucket)[0])
    a, b = [], []
    for i in np.flatnonzero(side != 1):  # side 0: the block with itself; 1 and 2: two blocks
        j = np.flatnonzero(side == (1 if side[i] else 0))
        j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if side[i] == 0:
            j = j[ids[j] > ids[i]]
        j = j[~(bands[j, :this] == bands[i, :this]).any(axis=1)]
        j = j[agree(places[i], places[j], percent)]
        a.append(np.minimum(ids[j], ids[i]))
        b.append(np.maximum(ids[j], ids[i]))
    whole = lambda x: np.concatenate(x) if x else ids[:0]
    return pd.DataFrame({"a": whole(a), "b": whole(b)})


def _across(rest: DataFrame, reps: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """The pairs between components of mixed buckets that sketches allow; a written table.

    A bucket of c classes is cut into c/BLOCK blocks, and a task gets two blocks at most.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = rest.withColumn("nb", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    whose = materialize(own.groupBy("id").agg(F.sum("nb").alias("copies")).join(reps.select(F.col("c").alias("id"), "bands"), "id").join(places.select(F.col("c").alias("id"), F.col("u").alias("places")), "id"), "mixed-classes")
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    task = dealt.select(
        "bucket", "id", "n", "component",
        F.least("mine", "other").alias("x"),
        F.greatest("mine", "other").alias("y"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    full = task.join(whose.drop("copies"), "id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return cross_pairs(rows, percent)
        finally:
            if len(rows) >= TRIMMED:
                trim()

    return materialize(full.groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long").distinct(), "likely-pairs")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept, text_sha256), one row per row of docs."""
    sk = sketches(docs, words, key, text)
    classes = materialize(sk.where("n > 0").groupBy("digest").agg(F.min("rid").alias("c"), F.min("id").alias("cid")), "class-ids")
    reps = materialize(sk.join(classes.select(F.col("c").alias("rid")), "rid", "left_semi").withColumnRenamed("rid", "c"), "classes")
    who = reps.select("c", "id", "h", "digest")
    rows = reps.select(F.col("c").alias("id"), "n", F.explode("bands").alias("bucket"))
    buckets = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "bucket-sizes")
    shared = materialize(skew_join(rows, buckets, "bucket", "c"), "buckets")

    central = materialize(shared.groupBy("id").agg(F.least(F.sum("c"), F.lit(1 << 30)).alias("score")), "central")
    near = materialize(who.join(central.select(F.col("id").alias("c")), "c", "left_semi"), "sketched")
    places = _of_classes(docs, near, words, key, text, lambda u: (mix(sketch(u, ESTIMATE)) & np.uint64(0xFF)).astype(np.uint8).tobytes(), "estimates")
    scored = shared.join(central, "id").withColumn("component", F.col("id"))
    rank = F.shiftleft("score", 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    links = _confirmed(docs, _likely(_with_leaders(scored, rank, percent), places, percent), who, words, percent, key, text)
    label = components(links)

    rest = _mixed(shared, label)
    second = _with_leaders(rest, F.xxhash64("id", "bucket"), percent)
    links = links.union(_confirmed(docs, _likely(second, places, percent), who, words, percent, key, text))
    label = components(links)

    more = _confirmed(docs, _across(_mixed(rest, label), reps, places, percent), who, words, percent, key, text)
    if more.head(1):
        label = components(links.union(more))

    member = classes.join(label, classes["c"] == label["id"], "left").select("digest", "cid", F.coalesce("component", "c").alias("component"))
    least = member.groupBy("component").agg(F.min("cid").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    of_class = materialize(skew_join(member, materialize(least, "components"), "component", "nodes").join(sk.where("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "digest").select("digest", "component_id", "rows"), "component-ids")
    drop_tables(buckets, shared, central, near, places, rest)
    columns = [F.col("id").alias(key), F.col("n").alias("n_shingles")]
    found = skew_join(sk.where("n > 0").select("id", "n", "digest", "text_sha256"), of_class, "digest", "rows").select(*columns, "component_id", "text_sha256")
    none = sk.where("n = 0").select(*columns, F.col("id").alias("component_id"), "text_sha256")
    return found.unionByName(none).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
