"""Ids of byte-level tokenizers definitions, several times faster where tiktoken gives the same ones."""

from __future__ import annotations

import json
import zlib

import numpy as np
import regex

#: Texts of these characters alone are encoded from the ranks; the two libraries agree on their classes.
PLAIN = regex.compile(r"[\t\n\r -~¡-ɏ]*")
#: Bytes without white space, or of white space alone, from which on tokenizers' merging is the faster one.
RUN = 2000


def _longest_run(text: str) -> int:
    """Bytes of a plain text's longest run without white space, or of it alone."""
    space = np.frombuffer(text.encode(), np.uint8) <= 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    return int(np.diff(np.r_[-1, edges, len(space) - 1]).max())


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level tokenizers definition, as encode(text, add_special_tokens=False) gives them.

    Plain texts without a special token's string are encoded by tiktoken from the same vocabulary, which gives the same
    ids several times faster; all others by tokenizers itself.
    """

    #: How such definitions split texts before merging.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, definition: str, ranks: bool = True):
        self.definition, self._exact = definition, None
        d = json.loads(definition)
        self.special = [t["content"] for t in d.get("added_tokens", [])]
        self.fast = None
        pre = d.get("pre_tokenizer") or {}
        if ranks and d["model"]["type"] == "BPE" and not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            import tiktoken

            byte, special = _byte_of_char(), set(self.special)
            ranks = {bytes(byte[c] for c in t): i for t, i in d["model"]["vocab"].items() if t not in special}
            merges = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
            ids = [d["model"]["vocab"][a + b] for a, b in merges]
            if ids == sorted(ids):  # else ranks don't order the merges
                self.fast = tiktoken.Encoding("ranks", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        """The definition's own encoder, made when a text first needs it."""
        if self._exact is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_str(self.definition)
        return self._exact

    def plain(self, text: str) -> bool:
        """Whether the ranks tell a text's ids, and soon."""
        return self.fast is not None and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special) and _longest_run(text) < RUN

    def encode(self, text: str) -> list[int]:
        if self.plain(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def array(self, text: str) -> np.ndarray:
        """encode(), as unsigned 32-bit integers."""
        if self.plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def ranks_suffice(definition: str) -> bool:
    """Whether the order of a definition's tokens alone tells its ids: every token is what the merges make of its own bytes."""
    d = json.loads(definition)
    model = d["model"]
    if model["type"] != "BPE" or d.get("truncation") or d.get("padding") or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    encoder = Encoder(definition)
    tokens = set(model["vocab"]) - set(encoder.special)
    made = {"".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]}
    if encoder.fast is None or not set(_byte_of_char()) <= tokens or len(made) != len(model["merges"]):
        return False
    return all(len(encoder.exact.model.tokenize(t)) == 1 for t in tokens)


_ENCODERS: dict[tuple[int, bool], Encoder] = {}


def encoder_of(definition: str, ranks: bool = True) -> Encoder:
    """One encoder per worker process and definition."""
    key = (zlib.crc32(definition.encode()), ranks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition, ranks)
    return _ENCODERS[key]
