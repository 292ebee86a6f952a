"""Substring deduplication by hashed units: normalised sentences of lines are hashed, their digests grouped over the
corpus, and passages of repeated units removed; the earliest occurrence stays.

1. A text is cut after every line feed and every sentence end. A unit is normalised (lower case, white space to one blank,
   trimmed); empty units have no part, and equal units in a row are one unit, whose words count once.
2. Two adjacent units are hashed together, and a unit of MIN_WORDS words and more also alone. Hashes are grouped over all
   documents; each keeps its smallest id. An entry is repeated where its document has a larger id, or where it stands in
   its own document a second time.
3. Units whose adjacent pairs are all repeated are a run. Runs of MIN_WORDS words and more go, and so do repeated units
   of that length. Short units that repeat by chance don't, as their neighbours differ; and the earliest occurrence of a
   passage stays whole, even where one of its units is found earlier, as then its pairs are not. A passage that begins
   inside a sentence loses its whole units.
4. Spans are of the original text, in code points: from the first unit's start to the last one's end with its line feed
   or blank. What is left is joined as it stands.

Words are counted by blanks; a unit with fewer, as in scripts without blanks, counts one for each CHARS_A_WORD characters.

Each task combines a digest's entries before the shuffle, and a digest leaves a document once. The entries of very common
digests are found by a broadcast of these, all others by a shuffle join (skew_join()). Units are cut again only in the
documents that hold a repeated entry.

Defined results: null text counts as empty and has no unit; an empty table gives no rows; rows that repeat a doc_id,
whether with the same text or another one, are no earlier than each other: a passage that only they share stays in all
of them; rows without an id have no place in the order, so they lose only what they repeat themselves, and nothing goes
because of them; further columns are kept, those named as a result with an underscore after the name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import LEAST_HOT, skew_join
from corpusloom.llm.hashing import slices
from corpusloom.llm.worker import frugal, prepare
from corpusloom.schemas import require
from corpusloom.storage import drop_tables, materialize

#: Words of a removed run at least, and characters that count as a word where a unit has few blanks.
MIN_WORDS, CHARS_A_WORD = 25, 8
# What ends a unit (a sentence end takes the blank after it), and white space.
ENDS = r"[\n。！？]|[.!?][ \t\r\f]"
END = re.compile(ENDS)
RESULTS = ("removed_spans", "clean_text")


class Units:
    """A text's units: their normalised texts, starts, ends and words."""

    def __init__(self, text: str):
        self.norms: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.words: list[int] = []
        at = 0
        for end in (*(m.end() for m in END.finditer(text)), len(text)):
            norm = " ".join(text[at:end].lower().split())
            if norm:
                if self.norms and self.norms[-1] == norm:
                    self.ends[-1] = end
                else:
                    self.norms.append(norm)
                    self.starts.append(at)
                    self.ends.append(end)
                    self.words.append(max(norm.count(" ") + 1, len(norm) // CHARS_A_WORD))
            at = end

    def entries(self, least: int) -> Iterator[tuple[int, int, bytes]]:
        """(first unit, last unit, digest) of every adjacent pair and every unit of least words."""
        for i, norm in enumerate(self.norms):
            if self.words[i] >= least:
                yield i, i, xxhash.xxh3_128_digest(norm)
            if i:
                yield i - 1, i, xxhash.xxh3_128_digest(f"{self.norms[i - 1]}\n{norm}")

    def removed(self, repeated: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
        """Spans of the runs that go, of the repeated entries in order."""
        gone = [False] * len(self.norms)
        run: list[int] = []  # units of the open run

        def close() -> None:
            if sum(self.words[i] for i in run) >= least:
                for i in run:
                    gone[i] = True

        for i, j in repeated:
            if i == j:
                gone[i] = True
            elif run and run[-1] == i:
                run.append(j)
            else:
                close()
                run = [i, j]
        close()
        spans: list[tuple[int, int]] = []
        for i, g in enumerate(gone):
            if g and i and gone[i - 1]:
                spans[-1] = (spans[-1][0], self.ends[i])
            elif g:
                spans.append((self.starts[i], self.ends[i]))
        return spans


def unused(columns: list[str], name: str) -> str:
    """name, or name with underscores after it, that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _entries(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(id, h, own, places, digests): each row's distinct entries by place; own: an entry occurs twice."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "h", "own", "places", "digests"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own, places, digests = [], [], []
                for t in part.column(2).to_pylist():
                    first: dict[bytes, int] = {}
                    n = 0
                    for n, (_, _, d) in enumerate(Units(t or "").entries(least), 1):
                        first.setdefault(d, n - 1)
                    own.append(len(first) < n)
                    places.append(list(first.values()))
                    digests.append(list(first))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.bool_()), pa.array(places, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))], names)

    return docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), text).mapInArrow(frugal(run), f"id {kind}, h long, own boolean, places array<int>, digests array<binary>")


def repeated_entries(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, least_hot: int = LEAST_HOT) -> DataFrame:
    """(id, h, places): the repeated entries of each text (h: its hash) that has some; a written table.

    places lacks the entries that a text repeats itself; a text with such entries alone has no place here.
    """
    require(docs, key, text)
    prepare(docs.sparkSession)
    found = materialize(_entries(docs, key, text, min_words).where("id IS NOT NULL OR own"), "entries")
    each = found.where("id IS NOT NULL").select("id", "h", F.explode(F.arrays_zip("places", "digests")).alias("e")).select("id", "h", F.col("e.places").alias("place"), F.col("e.digests").alias("digest"))
    groups = materialize(each.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-digests")
    late = skew_join(each, groups, "digest", "n", least=least_hot).where("id > first").select("id", "h", "place")
    own = found.where("own").select("id", "h", F.lit(None).cast("int").alias("place"))
    places = late.unionByName(own).groupBy("id", "h").agg(F.sort_array(F.collect_set("place")).alias("places"))
    out = materialize(places, "repeated-entries")
    drop_tables(found, groups)
    return out


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with removed_spans (original offsets) and clean_text."""
    repeated = repeated_entries(docs, key, text, min_words)
    for name in RESULTS:
        while name.lower() in (taken := {c.lower(): c for c in docs.columns}):
            name = taken[name.lower()]
            other = unused(docs.columns, name)
            docs, text = docs.withColumnRenamed(name, other), other if text == name else text
    marks = unused(docs.columns, "places")
    joined = docs.alias("d").join(repeated.alias("r"), F.col(f"d.`{key}`").eqNullSafe(F.col("r.id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("r.h")), "left").select("d.*", F.col("r.places").alias(marks))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans, clean = [], []
                for t, places in zip(part.column(at).to_pylist(), part.column(len(part.schema) - 1).to_pylist(), strict=True):
                    t = t or ""
                    spans.append(_spans(t, places, min_words) if places is not None else [])
                    bounds = [0, *(x for s in spans[-1] for x in s), len(t)]
                    clean.append("".join(t[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if spans[-1] else t)
                told = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], told, pa.array(clean, pa.string())], [*part.schema.names[:-1], *RESULTS])

    out = T.StructType([*docs.schema.fields, T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("clean_text", T.StringType())])
    return joined.mapInArrow(frugal(run), out)


def _spans(text: str, places: list[int], least: int) -> list[tuple[int, int]]:
    """The spans that go: entries at places and their equals are repeated, and so is each that stands here before."""
    units = Units(text)
    entries = list(units.entries(least))
    late = {entries[p][2] for p in places if p < len(entries)}
    seen: set[bytes] = set()
    repeated = []
    for i, j, d in entries:
        if d in late or d in seen:
            repeated.append((i, j))
        seen.add(d)
    return units.removed(repeated, least)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_removed, removed_chars, spans, clean_sha256."""
    got = dedup_lines(docs.select("doc_id", "text"))
    s = F.col("removed_spans")
    told = F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return got.select(
        "doc_id",
        F.size(s).cast("long").alias("n_removed"),
        F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("removed_chars"),
        told.alias("spans"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )
