"""Secret scans: pattern kinds, and sliding-window Shannon entropy over candidate strings. Native: DataFrame functions alone.

Entropy: a window of WINDOW characters slides over each candidate. Counts per character are kept as the window moves
(the entering character is added, the leaving one taken away), and with them the sum of c*log2(c), in millionths, as an
integer: the same on every machine. A window whose entropy reaches its character class's threshold is flagged;
overlapping or touching flagged windows become one span. Candidates on the allow-list are left out.

Defined results: null text counts as empty; an empty table gives no rows; each row of a repeated document has its own
result; whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import match_spans

# The base kinds' patterns, in their order, with the characters that the group needs.
BASE = (
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
ORDER = ("assign", "access", "hex", "entropy")

CANDIDATE, WINDOW = r"([A-Za-z0-9+/_-]{20,})", 20
#: Character classes in the order in which a candidate is tried, and the entropy in bits that flags a window.
CLASSES = (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), ("alnum", "^[A-Za-z0-9]+$", 3.8), ("base64", "^[A-Za-z0-9+/_-]+$", 3.9))
#: A part of an identifier or path that is a word with a short number, or a number as in dates: it holds no key.
_LOWER, _UPPER, _ANY = (f"(?:{x}+[0-9]{{0,4}}|[0-9]{{1,8}})" for x in ("[a-z]", "[A-Z]", "[A-Za-z]"))
#: Candidates that are no secrets: without a digit or without a letter; identifiers in one case and paths all of whose parts
#: are such words and numbers; examples; dashed identifiers of records.
ALLOW = ("^[^0-9]*$", "^[^A-Za-z]*$", f"^{_LOWER}(?:[_-]{_LOWER})+$", f"^{_UPPER}(?:[_-]{_UPPER})+$", f"^/?(?:{_ANY}(?:[_-]{_ANY})*/)+(?:{_ANY}(?:[_-]{_ANY})*)?$", "EXAMPLE", "^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
SCALE = 1_000_000
#: c*log2(c) in millionths, by count.
TERMS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]


def limit(bits: float) -> int:
    """The largest sum of c*log2(c), in millionths, of a window with that entropy."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)


def high_entropy(found: Column, most: Column) -> Column:
    """array<struct<start,end>> of the flagged stretches of a candidate; most: its class's limit()."""
    terms, lowest, slots = F.array(*map(F.lit, TERMS)), ord("+"), ord("z") - ord("+") + 1
    codes = F.transform(F.split(found, ""), lambda c: F.ascii(c) - lowest)
    spans = "array<struct<start:int,end:int>>"

    def step(s: Column, i: Column, code: Column) -> Column:
        into, out = F.get(code, i), F.coalesce(F.get(code, i - WINDOW), F.lit(-1))
        a, b = F.get(s["n"], into), F.coalesce(F.get(s["n"], out), F.lit(1))
        moved = F.when(into == out, s["sum"]).otherwise(
            s["sum"] + F.get(terms, a + 1) - F.get(terms, a) + F.when(out >= 0, F.get(terms, b - 1) - F.get(terms, b)).otherwise(0)
        )
        n = F.transform(s["n"], lambda x, j: x + F.when(j == into, 1).otherwise(0) - F.when(j == out, 1).otherwise(0))
        first = i - (WINDOW - 1)
        hit = (i >= WINDOW - 1) & (moved <= most)
        joins = hit & (s["end"] >= first)
        return F.struct(
            n.alias("n"),
            moved.alias("sum"),
            F.when(hit & ~joins, first).otherwise(s["start"]).alias("start"),
            F.when(hit, i + 1).otherwise(s["end"]).alias("end"),
            F.when(hit & ~joins & (s["start"] >= 0), F.array_append(s["out"], F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(s["out"]).alias("out"),
        )

    first = F.struct(
        F.array_repeat(F.lit(0), slots).alias("n"), F.lit(0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(spans).alias("out")
    )
    last = lambda s: F.when(s["start"] >= 0, F.array_append(s["out"], F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(s["out"])
    fold = lambda code: F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), first, lambda s, i: step(s, i, code), last)
    return F.flatten(F.transform(F.array(codes), fold))


def _entropy_spans(text: Column) -> Column:
    seen = F.filter(match_spans(text, CANDIDATE, 1), lambda m: ~m["found"].rlike("|".join(ALLOW)))
    most = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(limit(bits))) for _, p, bits in CLASSES])
    inner = lambda m: F.transform(high_entropy(m["found"], most(m["found"])), lambda h: F.struct((m["start"] + h["start"]).alias("start"), F.lit(ORDER.index("entropy")).alias("k"), (m["start"] + h["end"]).alias("end")))
    return F.flatten(F.transform(seen, inner))


def _base_spans(text: Column, k: int, pattern: str, group: int, least: int) -> Column:
    kept = F.filter(match_spans(text, pattern, group), lambda m: F.length(m["found"]) >= least)
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_entropy, base_spans, all_spans): spans are (start, k, end), k by ORDER, in code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(key, t.alias("t"))
    for k, (kind, pattern, group, least) in enumerate(BASE):
        found = found.withColumn(kind, _base_spans(F.col("t"), k, pattern, group, least))
    found = found.withColumn("entropy", _entropy_spans(F.col("t"))).drop("t")
    base = F.array_sort(F.concat(*[F.col(k) for k, *_ in BASE]))
    return found.select(
        key,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ORDER],
        base.alias("base_spans"),
        F.array_sort(F.concat(*ORDER)).alias("all_spans"),
    )


def scan_digest(docs: DataFrame) -> DataFrame:
    """The columns of the contract, from scan_secrets()."""
    s = scan_secrets(docs)
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_told(F.col("base_spans")), 256).alias("base_sha256"), _told(F.col("all_spans")).alias("spans"))
