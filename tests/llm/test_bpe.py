import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from corpusloom.llm import byte_bpe

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def content():
    with open(public_tokenizers.path(NAME), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(content):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(content), special_tokens={})


@pytest.fixture(scope="module")
def codec(content):
    return byte_bpe.Codec(byte_bpe.read_ranks(content), public_tokenizers.PATTERN, byte_bpe.newer_characters())


def texts(rng, n):
    parts = ["th", "er", "in", "ing", "tion", "'s", "'LL", "  ", "\n", "\r\n\t", "1", "é", "ß", "λόγος", "日本", "　", "\x85", "\x1c", "🙂", "_", "--"]
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            yield "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        elif kind == 1:  # any characters, some of them unassigned or newer than tiktoken's tables
            yield "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), 0x3FB27, 0x558, 0x11DE0, rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(25)))
        elif kind == 2:
            yield rng.choice("a-= \n0x") * rng.randrange(300)
        else:
            yield "".join(rng.choice("abcde") for _ in range(rng.randrange(200)))


def test_ids_are_the_library_s(codec, library):
    for t in texts(random.Random(1), 4000):
        ids = codec.encode(t).tolist()
        assert ids == library.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_long_pieces(codec, library):
    rng = random.Random(2)
    for t in ("a" * 100_000, "".join(rng.choice("thein") for _ in range(100_000)), " " * 50_000 + "x"):
        assert codec.encode(t).tolist() == library.encode_ordinary(t)


def test_pieces_are_forgotten(content, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 50)
    monkeypatch.setattr(byte_bpe, "PAIRS", 50)
    monkeypatch.setattr(byte_bpe, "LISTED", 10)
    small = byte_bpe.Codec(byte_bpe.read_ranks(content), public_tokenizers.PATTERN)
    for t in ("".join(random.Random(i).choice("abc e\n") for _ in range(80)) for i in range(100)):
        assert small.encode(t).tolist() == library.encode_ordinary(t)
        assert len(small.pieces) <= 50 and len(small.fitting) <= 50


def test_a_token_that_merges_do_not_make():
    """'abc' can't be made, as 'bc' merges first and 'abc' has no part 'bc'... yet a piece that is one token has its id."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"cd": 257, b"ab": 258, b"abcd": 259}
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks, r"\S+")
    rng = random.Random(3)
    for t in ["abcd", "abcdx", "ab", *("".join(rng.choice("abcd ") for _ in range(rng.randrange(14))) for _ in range(2000))]:
        assert codec.encode(t).tolist() == library.encode_ordinary(t)


def test_neighbours_fit_without_merging(codec, monkeypatch):
    """Told from the tokens' parts, without running merges: what the merges say."""
    rng = random.Random(4)
    own = [*codec.shorter]
    starts = {}
    for r in own:
        starts.setdefault(codec.bytes_of[r][:1], []).append(r)
    pairs = {(rng.choice(own), rng.choice(own)) for _ in range(3000)} | {(rng.choice(own), rng.choice(starts[bytes([c])])) for c in b"aeint s" for _ in range(1500)}
    pairs |= {(codec.left[r], codec.right[r]) for r in rng.sample([*codec.left], 500)}
    want = {(a, b): codec.merged(codec.bytes_of[a] + codec.bytes_of[b]) == [codec.bytes_of[a], codec.bytes_of[b]] for a, b in pairs}
    assert codec.ordered and 1000 < sum(want.values()) < len(want) - 1000
    monkeypatch.setattr(codec, "merged", None)
    codec.fitting.clear()
    assert {p: codec.fits(*p) for p in pairs} == want


def test_small_vocabularies():
    """Overlapping tokens of two letters, also where tokens come before their parts."""
    rng, ordered = random.Random(5), set()
    for k in range(60):
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(3, 14))}
        tokens = sorted(tokens, key=lambda t: (len(t), t)) if k % 2 else rng.sample(sorted(tokens), len(tokens))
        ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
        library = tiktoken.Encoding("small", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        codec = byte_bpe.Codec(ranks, r"\S+")
        ordered.add(codec.ordered)
        for _ in range(60):
            t = "".join(rng.choice("ab") for _ in range(rng.randrange(30)))
            assert codec.encode(t).tolist() == library.encode_ordinary(t), (tokens, t)
    assert ordered == {True, False}


def test_rows_are_decoded_at_once(codec, library):
    texts_ = ["the cat's", "", "日本 long"]
    ids = [library.encode_ordinary(t) for t in texts_]
    rows = pa.array([ids[0], None, ids[1], ids[2], ids[0]], pa.list_(pa.int32()))
    want = [texts_[0].encode(), b"", b"", texts_[2].encode(), texts_[0].encode()]
    assert codec.decode_rows(rows).to_pylist() == want and codec.decode_rows(rows[1:4]).to_pylist() == want[1:4]
    assert codec.decode_rows(rows[1:3]).to_pylist() == [b"", b""] and codec.decode_rows(rows[:0]).to_pylist() == []
    for odd in (-1, 1 << 30, None):
        with pytest.raises((KeyError, pa.ArrowIndexError)):
            codec.decode_rows(pa.array([[1, odd]], pa.list_(pa.int32())))


def test_rows(spark, content, library):
    rows = [(1, "the cat's", 9, "x"), (None, None, 9, "x"), (2, "", 9, "x"), (2, "long " * 20_000, 9, "x"), (2, "", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = sorted(map(tuple, byte_bpe.encoded_digest(docs, byte_bpe.ByteBpe(content, public_tokenizers.PATTERN)).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for key, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((key, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert byte_bpe.encoded_digest(docs.limit(0), byte_bpe.ByteBpe(content, public_tokenizers.PATTERN)).count() == 0
