"""Tokenizers behind one interface: a native expression, and byte-pair encoding in Arrow batches."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.byte_level import encoder_of, ranks_suffice

WHITESPACE = "[ \\t\\n\\r\\f]+"
EOS = "<eos>"
#: Special tokens that end a text in public tokenizers.
END_TOKENS = ("<|endoftext|>", "<|end_of_text|>", "</s>", "<eos>", "<|eos|>", "<|im_end|>", "[EOS]")


class Tokenizer(Protocol):
    def tokenize(self, df: DataFrame) -> DataFrame:
        """df with input_ids and num_tokens."""


def append_eos(df: DataFrame, eos: str) -> DataFrame:
    """text with eos at its end, without a separator; a null text raises when it runs."""
    return df.withColumn("text", F.concat(F.coalesce("text", F.raise_error(F.lit("null text"))), F.lit(eos)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def native_ids(text: Column) -> Column:
    """White-space words plus one end token; a word's id is the first 32 bits of its md5. Runs in the JVM alone."""
    return F.transform(_words(F.concat(text, F.lit(f" {EOS}"))), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))


def native_count(text: Column) -> Column:
    """size(native_ids(text)) without hashing a word."""
    return F.size(_words(F.concat(text, F.lit(f" {EOS}")))).cast("long")


class NativeTokenizer:
    def tokenize(self, df: DataFrame) -> DataFrame:
        return df.withColumn("input_ids", native_ids(F.col("text"))).withColumn("num_tokens", native_count(F.col("text")))


#: Bytes of text that are encoded at once.
ENCODE_BYTES = 4 << 20


def by_bytes(batch: pa.RecordBatch, size: int = ENCODE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about size bytes, of one row at least."""
    rows = max(1, int(batch.num_rows * size / max(batch.nbytes, size)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


class BpeTokenizer:
    """A tokenizers JSON definition, sent to the workers once as a string and encoded in Arrow batches.

    Where the order of its tokens tells the ids, plain texts are encoded from that alone (see byte_level.py).
    """

    named_eos: str | None = None

    def __init__(self, definition: str):
        self.definition = definition

    @classmethod
    def from_file(cls, path: str) -> BpeTokenizer:
        """The definition at a path of the driver; a tokenizer_config.json beside it may name the end token."""
        with open(path, encoding="utf-8") as f:
            made = cls(f.read())
        beside = os.path.join(os.path.dirname(path), "tokenizer_config.json")
        if os.path.exists(beside):
            with open(beside, encoding="utf-8") as f:
                named = json.load(f).get("eos_token")
            made.named_eos = named.get("content") if isinstance(named, dict) else named
        return made

    @property
    def _added(self) -> dict[str, int]:
        """The definition's special tokens and their ids."""
        return {t["content"]: t["id"] for t in json.loads(self.definition).get("added_tokens", []) if t.get("special")}

    @property
    def eos(self) -> str:
        """The end token: the one that the configuration names, else the only special token that is known to be one."""
        if self.named_eos:
            return self.named_eos
        known = [t for t in END_TOKENS if t in self._added]
        if len(known) != 1:
            raise ValueError(f"the definition tells no end token; its special tokens are {sorted(self._added)}")
        return known[0]

    @property
    def eos_id(self) -> int:
        """The end token's id, special or in the vocabulary."""
        vocabulary = json.loads(self.definition)["model"]["vocab"]
        found = self._added.get(self.eos, vocabulary.get(self.eos) if isinstance(vocabulary, dict) else None)
        if found is None:
            raise ValueError(f"the vocabulary has no {self.eos}")
        return found

    @property
    def vocabulary_size(self) -> int:
        """Ids from 0 to the largest, added tokens included."""
        d = json.loads(self.definition)
        vocabulary = d["model"]["vocab"]
        ids = vocabulary.values() if isinstance(vocabulary, dict) else range(len(vocabulary))
        return max([-1, *ids, *(t["id"] for t in d.get("added_tokens", []))]) + 1

    def tokenize(self, df: DataFrame) -> DataFrame:
        # a vocabulary: its size does not follow the data
        sent = df.sparkSession.sparkContext.broadcast((self.definition, ranks_suffice(self.definition)))
        at = df.columns.index("text")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = encoder_of(*sent.value)
            for batch in batches:
                for b in by_bytes(batch):
                    ids = [encoder.array(t) for t in b.column(at).to_pylist()]
                    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                    flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sizes)], [*b.schema.names, "input_ids", "num_tokens"])

        checked = df.withColumn("text", F.coalesce("text", F.raise_error(F.lit("null text"))))
        out = T.StructType([*checked.schema.fields, T.StructField("input_ids", T.ArrayType(T.LongType())), T.StructField("num_tokens", T.LongType())])
        return checked.mapInArrow(encode, out)
