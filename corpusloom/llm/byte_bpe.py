"""Byte-level BPE encoding and decoding in linear time, without running merges over a text.

A text's bytes are read as Latin-1 characters, so that an Aho-Corasick automaton of the vocabulary finds at every place the
longest token that begins there. The encoder takes longest matches and goes back to the next shorter token where two
neighbours don't fit: tokens a and b fit if merging the bytes of both gives a and b again, which is remembered for each pair
and told by undoing both tokens' last merges, the latest first, and looking for a merge across the border that would have come earlier.
A sequence in which all neighbours fit is what the merges make of its bytes: a merge across a border would also happen between
the two tokens alone. So a place that is reached is reached by one sequence only, a place that leads nowhere is marked and never
tried again, and the work for a piece is at most its length times the tokens that are prefixes of one another.

Tokens that their own merges don't make are left out of the automaton; a whole piece that is such a token has its id, as in
tiktoken. Ids can be decoded to the same bytes.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.hashing import slices
from corpusloom.llm.worker import frugal, prepare

#: Remembered pieces and pairs at most, and characters of a remembered piece: a worker's memory doesn't follow the corpus.
PIECES, PAIRS, PIECE_CHARS = 800_000, 1_000_000, 64
#: Characters of a text whose pieces are listed at once; those of longer texts are taken one by one.
LISTED = 4 << 20
#: A rank that no token has.
NONE = 1 << 40


def read_ranks(content: bytes) -> dict[bytes, int]:
    """token -> rank, of lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def newer_characters() -> dict[str, str]:
    r"""Characters, as ranges of a set, that the regex library holds to be \p{L} or \p{N} and tiktoken does not.

    The two libraries follow different versions of Unicode; what each thinks is asked of it.
    """
    import regex
    import tiktoken

    bytes_alone, out = {bytes([i]): i for i in range(256)}, {}
    blocks = ["".join(map(chr, (c for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000))) for a in range(0, 0x110000, 4096)]
    for name in (r"\p{L}", r"\p{N}"):
        asked = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=bytes_alone, special_tokens={})
        ours = regex.compile(name)
        odd = [ord(c) for block in blocks for c in set(ours.findall(block)) - set(asked.decode_bytes(asked.encode_ordinary(block)).decode())]
        runs: list[list[int]] = []
        for c in sorted(odd):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        out[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    return out


class Pieces(dict):
    """piece -> its ids as 32-bit integers; made when asked for, the oldest half is forgotten when there are too many."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                for old in list(islice(self, PIECES // 2)):
                    del self[old]
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of a vocabulary; pattern's matches are encoded one by one, what lies between them is dropped."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: dict[str, str] | None = None):
        import ahocorasick
        import regex

        self.ranks, self.bytes_of, self.length = ranks, {r: t for t, r in ranks.items()}, {r: len(t) for t, r in ranks.items()}
        self.plain = regex.compile(pattern)
        strict, newer = pattern, {k: v for k, v in (newer or {}).items() if v}
        for name, ranges in newer.items():
            strict = strict.replace(name, f"[{name}--[{ranges}]]")  # inside a set it is a set of that set
        self.strict = regex.compile(strict, regex.V1) if newer else self.plain
        #: Code point -> whether the libraries differ on it; None if there is no such character.
        self.newer = np.zeros(0x110000, bool) if newer else None
        for a, b in regex.findall(r"\\U(\w{8})-\\U(\w{8})", "".join(newer.values())):
            self.newer[int(a, 16) : int(b, 16) + 1] = True
        self.fitting: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self.encode_piece)
        #: Place -> the token of that rank, null if there is none.
        self.tokens = pa.array(map(self.bytes_of.get, range(max(self.bytes_of, default=-1) + 1)), pa.large_binary())
        self.automaton = ahocorasick.Automaton()
        #: The two parts whose merge makes a token, for the tokens that their own merges make; single bytes are their own part.
        halves = {t: x for t in ranks if 0 < len(x := self.merged(t, 2)) < 3}
        own = {t: ranks[t] for t in halves}
        self.left, self.right = ({own[t]: ranks.get(x[k]) for t, x in halves.items() if len(x) == 2} for k in (0, 1))
        #: Whether tokens come after their parts, so that merges come in the order of ranks; else pairs are merged to tell if they fit.
        self.ordered = all(p is not None and p < r for side in (self.left, self.right) for r, p in side.items())
        for token, rank in own.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        #: rank -> the longest token that is a proper prefix of it.
        self.shorter = {r: next((own[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in own), None) for t, r in own.items()}

    def merged(self, data: bytes, least_parts: int = 1) -> list[bytes]:
        """What the merges make of a few bytes: the pair of lowest rank first, of equal ones the leftmost. Stops at least_parts."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        pairs = [rank(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while len(parts) > least_parts and (least := min(pairs)) != NONE:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NONE)
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NONE)
        return parts

    def fits(self, first: int, second: int) -> bool:
        a, b = self.bytes_of[first], self.bytes_of[second]
        if len(self.fitting) >= PAIRS:
            self.fitting.clear()
        known = self.fitting[first, second] = self.apart(first, second) if self.ordered else self.merged(a + b) == [a, b]
        return known

    def apart(self, first: int, second: int) -> bool:
        """Whether no merge crosses the border of two tokens that their merges make, where merges come in the order of ranks."""
        rank, data, left, right, limit = self.ranks.get, self.bytes_of, self.left, self.right, NONE
        while rank(data[first] + data[second], NONE) >= limit:
            # undo the later of the two merges beside the border: of equal ranks, the right one
            if first in right and (first > second or second not in left):
                limit, first = first, right[first]
            elif second in left:
                limit, second = second + 1, left[second]
            else:
                return True
        return False

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        latin, size, fitting, length = data.decode("latin-1"), len(data), self.fitting, self.length
        last, greedy = None, []
        for _, (_, token) in self.automaton.iter_long(latin):  # longest matches, one after the other
            if last is not None:
                fit = fitting.get((last, token))
                if not (self.fits(last, token) if fit is None else fit):
                    break
            greedy.append(token)
            last = token
        else:
            if sum(map(length.__getitem__, greedy)) == size:
                return greedy
        longest: list[int | None] = [None] * size
        for end, (n, token) in self.automaton.iter(latin):
            longest[end - n + 1] = token  # of one start, longer tokens end later
        path: list[int] = []
        nowhere, at, last = bytearray(size + 1), 0, None
        token = longest[0] if size else None
        while at < size:
            if token is None:  # nothing that begins here fits what lies before
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                nowhere[at] = 1
                token = path.pop()
                at -= length[token]
                last = path[-1] if path else None
            else:
                end = at + length[token]
                if not nowhere[end]:
                    fit = last is None or fitting.get((last, token))
                    if fit is None:
                        fit = self.fits(last, token)
                    if fit:
                        path.append(token)
                        at, last = end, token
                        token = longest[at] if at < size else None
                        continue
            token = self.shorter[token]
        return path

    def has_newer(self, text: str) -> bool:
        if self.newer is None or text.isascii():
            return False
        parts = (text[i : i + LISTED].encode("utf-32-le", "surrogatepass") for i in range(0, len(text), LISTED))
        return any(self.newer[np.frombuffer(part, np.uint32)].any() for part in parts)

    def encode(self, text: str) -> np.ndarray:
        rx = self.strict if self.has_newer(text) else self.plain
        pieces = rx.findall(text) if len(text) <= LISTED else (m.group() for m in rx.finditer(text))
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_rows(self, rows: pa.Array) -> pa.Array:
        """The bytes of each row's ids, of null none; all rows' tokens are put together at once."""
        taken = self.tokens.take(rows.flatten())
        if taken.null_count:
            raise KeyError("an id that is no token")
        ends = np.r_[0, np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        if not len(taken):
            return pa.array([b""] * len(rows), pa.binary())
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64)[taken.offset :][ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), data])


_CODECS: dict[int, Codec] = {}


def _codec(content: bytes, pattern: str, newer: dict[str, str]) -> Codec:
    """Made once per worker process."""
    key = hash((content, pattern, *newer.items()))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(content), pattern, newer)
        gc.freeze()  # the collector need not walk the vocabulary
    return _CODECS[key]


class ByteBpe:
    """A vocabulary of ranks, sent to the workers once; content is a rank file's, pattern cuts texts into pieces."""

    def __init__(self, content: bytes, pattern: str):
        self.content, self.pattern, self.newer = content, pattern, newer_characters()

    def _sent(self, df: DataFrame):
        prepare(df.sparkSession)
        return df.sparkSession.sparkContext.broadcast((self.content, self.pattern, self.newer))  # a vocabulary: its size does not follow the data

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, ids array<int>) of every row of docs; a null text counts as empty and has no ids. Other columns are not read."""
        sent = self._sent(docs)
        kind = docs.schema[key].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(*sent.value)
            for batch in chain.from_iterable(map(slices, batches)):
                ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

        out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
        return docs.select(key, F.coalesce(text, F.lit(""))).mapInArrow(frugal(run), out)

    def decode(self, coded: DataFrame, ids: str = "ids") -> DataFrame:
        """coded with decoded (binary): the bytes of ids; null ids decode to nothing, an id that is no token raises."""
        sent = self._sent(coded)
        at = coded.columns.index(ids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(*sent.value)
            for batch in chain.from_iterable(map(slices, batches)):
                yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode_rows(batch.column(at))], names=[*batch.schema.names, "decoded"])

        return coded.mapInArrow(frugal(run), T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def encoded_digest(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    got = bpe.decode(bpe.encode(docs))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
