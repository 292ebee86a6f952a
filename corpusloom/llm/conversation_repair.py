"""Conversation structure repair by composing weighted finite-state machines.

A conversation is an acceptor of its rows, in order. The edit transducer reads a row and writes a role or nothing (keep,
re-role, delete), or writes a role that no row has (insert), at a cost. The role grammar accepts the roles that come out. The
three are composed lazily: a state is a place between rows together with a grammar state and the number of insertions made
there, and only states that can be reached are made. A shortest path over weights (cost, string of edit labels), compared in
that order, is found in reverse topological order. Arcs that leave one state have labels of their own, so that of equally cheap
paths the least string is the one with the least first label, and no strings are compared.

A role grammar has one role at most that an insertion can add in a state, and more insertions in one place than it has states
would only come back to a state at a higher cost, so the composition has no cycles.

Conversations of over SEGMENT rows are cut into segments by turn. Each segment gives, for every grammar state that it can be entered in and
left in, the weight between them; segments of one conversation are then composed in order, and each gets the states that its
cheapest path goes through. No task gets more than a segment's rows, but for rows that share one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.worker import frugal, prepare
from corpusloom.storage import materialize

#: Rows of a conversation that one task handles whole; longer ones go in segments of about as many.
SEGMENT = 2048
#: Long conversations that are broadcast at most, of 40 bytes each.
BROADCAST_LONG = 250_000
#: Faults of a row, the first that holds.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs: of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_CUT = 1, 2, 5, 5
#: Roles by their initial, as re-roled and inserted rows have them.
ROLES = {"u": "user", "a": "assistant"}
#: Role grammar (s?(ua)+)?: state -> {initial: next state}; a conversation begins in START and may end in FINAL.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
START, FINAL = 0, (0, 3)
#: Insertions in one place that can lie on a cheapest path.
MOST_INSERTED = 2
_VISIBLE, _ENDS = re.compile(r"[^\x20\x09-\x0D]"), ".!?"
_WHITE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str, int]  # cost, labels, state at the end

_ARCS: dict[tuple[str, int, int], list[tuple[str, int, int]]] = {}


def arcs(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(label, cost, next state) of the composed machine's arcs that read a row of this kind; made when first asked for."""
    key = (initial, fault, state)
    if key not in _ARCS:
        late, out = STAYS_CUT * (fault == TRUNCATED), [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            if initial in GRAMMAR[state]:
                out.append(("K", late, GRAMMAR[state][initial]))
            out += [("R", REROLE + late, GRAMMAR[state][r]) for r in ROLES if r in GRAMMAR[state]]
        _ARCS[key] = out
    return _ARCS[key]


def _inserted(state: int) -> int:
    return next(GRAMMAR[state][r] for r in ROLES if r in GRAMMAR[state])


def _chain(state: int) -> list[int]:
    """state, and the states that one, two ... insertions lead to."""
    out = [state]
    for _ in range(MOST_INSERTED):
        out.append(_inserted(out[-1]))
    return out


def _relaxed(states: Iterable[int], read: dict[int, Weight]) -> dict[int, Weight]:
    """Of each state, the least weight of insertions followed by what read has for the state that they lead to."""
    out = {}
    for state in states:
        options = [(read[q][0] + INSERT * n, "I" * n + read[q][1], read[q][2]) for n, q in enumerate(_chain(state)) if q in read]
        if options:
            out[state] = min(options)
    return out


def compose(kinds: Sequence[tuple[str, int]], entries: Sequence[int], exits: dict[int, int], last: bool) -> dict[int, Weight]:
    """For each entry state, the least weight of a path over the rows to a state of exits (state -> cost beyond it).

    kinds are the rows' initials and faults. Insertions come before a row; behind the last row they come only if the
    conversation ends there, so that paths over neighbouring segments are made in one way only.
    """
    reached = [set(entries)]  # the states at every place, made by going forward
    for initial, fault in kinds:
        reached[-1] = {q for state in reached[-1] for q in _chain(state)}
        reached.append({q for state in reached[-1] for _, _, q in arcs(initial, fault, state)})
    ends = {s: (c, "", s) for s, c in exits.items()}
    best = ends = _relaxed(reached[-1], ends) if last else {s: x for s, x in ends.items() if s in reached[-1]}
    steps = []  # going back: of every place, the edits up to behind the next row, and the state there
    for (initial, fault), states in zip(reversed(kinds), reversed(reached[:-1]), strict=True):
        read = {}
        for state in states:
            options = [(cost + best[q][0], label, q) for label, cost, q in arcs(initial, fault, state) if q in best]
            if options:
                read[state] = min(options)
        best = _relaxed(states, read)
        steps.append(best)
    out = {}
    for entry in entries:
        if entry in best:
            state, labels = entry, []
            for step in reversed(steps):
                _, label, state = step[state]
                labels.append(label)
            _, label, end = ends[state]
            out[entry] = (best[entry][0], "".join(labels) + label, end)
    return out


def fault_of(role: str, text: str, seen: set, before: bool = False) -> int:
    """The first fault of a row; seen gets a digest of what it says, unless it is blank. before: an earlier segment has it."""
    if not _VISIBLE.search(text):
        return BLANK
    said = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
    if before or said in seen:
        return DUPLICATE
    seen.add(said)
    return CLEAN if text.rstrip(_WHITE)[-1] in _ENDS else TRUNCATED


def apply_edits(rows: Sequence[tuple[str, str]], labels: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that labels make of rows, entered in a grammar state."""
    at = 0
    for label in labels:
        if label == "D":
            at += 1
            continue
        if label == "K":
            role, text = rows[at]
            initial = role[:1]
        else:
            initial = next(r for r in ROLES if r in GRAMMAR[state])
            role, text = ROLES[initial], "" if label == "I" else rows[at][1]
        at += label != "I"
        state = GRAMMAR[state][initial]
        yield role, text


_TURN = "array<struct<role:string,text:string>>"
#: What a segment tells: counts of faults, its turns, the roles at its ends, and the weights between grammar states.
_SEGMENT = (
    "segment long, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string,"
    f" weights array<struct<entry:int,exit:int,cost:long,labels:string>>, repaired {_TURN}"
)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _segment(rows: list[tuple], whole: bool) -> dict:
    """One segment's summary; rows are (turn, role, text, said before). whole: the conversation has no other segment."""
    seen: set = set()
    faults = [fault_of(role, text, seen, before) for _, role, text, before in rows]
    kinds = [(role[:1], f) for (_, role, _, _), f in zip(rows, faults, strict=True)]
    turns = {t for t, *_ in rows if t is not None}
    out = {
        "n": len(rows),
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "turns": len(turns),
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(not _legal(a[0], b[0]) for a, b in zip(kinds, kinds[1:], strict=False)),
        "first": kinds[0][0],
        "last": kinds[-1][0],
        "repaired": None,
    }
    if whole:
        cost, labels, end = compose(kinds, [START], dict.fromkeys(FINAL, 0), True)[START]
        out["weights"] = [{"entry": START, "exit": end, "cost": cost, "labels": labels}]
        out["repaired"] = [{"role": r, "text": t} for r, t in apply_edits([x[1:3] for x in rows], labels)]
        return out
    ways = []
    for end in GRAMMAR:
        ways += [{"entry": s, "exit": end, "cost": c, "labels": x} for s, (c, x, _) in compose(kinds, list(GRAMMAR), {end: 0}, False).items()]
    out["weights"] = ways
    return out


def _segments(rows: DataFrame) -> DataFrame:
    """A row per segment of every conversation; rows has conv_id, segment, whole, before, turn, role and text."""
    kind = rows.schema["conv_id"].dataType
    out = _with_key(kind, _SEGMENT)
    order = ["conv_id", "segment", "turn", "role", "text"]
    dealt = rows.select(*order, "whole", "before").repartition("conv_id", "segment").sortWithinPartitions(*order)
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, done, size = [], None, [], 0
        for batch in batches:
            for conv, segment, turn, role, text, whole, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv, segment, whole):
                    if held:
                        done.append({"conv_id": now[0], "segment": now[1], **_segment(held, now[2])})
                    held, now = [], (conv, segment, whole)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(done, schema=arrow)
                        done, size = [], 0
                held.append((turn, role, text, before))
                size += len(text) + 64
        if held:
            done.append({"conv_id": now[0], "segment": now[1], **_segment(held, now[2])})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    return dealt.mapInArrow(frugal(run), out)


def _with_key(kind: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(ddl).fields])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _joined(segments: DataFrame) -> DataFrame:
    """(conv_id, segment, entry, labels, cost): the way that a conversation's cheapest path takes through each of its segments.

    Runs on summaries: up to 16 strings of labels a segment, streamed by conversation; what is held grows with a
    conversation's number of edits, like its audit, which is one string.
    """
    kind = segments.schema["conv_id"].dataType
    out = _with_key(kind, "segment long, entry int, labels string, cost long")
    dealt = segments.select("conv_id", "segment", "weights").repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def solve(conv, parts: list) -> dict:
        best = {s: (c, s, "") for s, (c, _, _) in compose([], list(GRAMMAR), dict.fromkeys(FINAL, 0), True).items()}
        tails = {s: compose([], [s], dict.fromkeys(FINAL, 0), True)[s][1] for s in best}
        chosen = []
        for k, (_, weights) in enumerate(reversed(parts)):
            now: dict[int, tuple[int, int, str]] = {}
            for w in weights:
                if w["exit"] in best:
                    option = (w["cost"] + best[w["exit"]][0], w["labels"] + (tails[w["exit"]] if k == 0 else ""), w["exit"])
                    if w["entry"] not in now or option[:2] < (now[w["entry"]][0], now[w["entry"]][2]):
                        now[w["entry"]] = (option[0], option[2], option[1])
            best = now
            chosen.append(now)
        state, rows = START, {"conv_id": [], "segment": [], "entry": [], "labels": [], "cost": []}
        total = best[START][0]
        for (segment, _), step in zip(parts, reversed(chosen), strict=True):
            for name, value in zip(rows, (conv, segment, state, step[state][2], total), strict=True):
                rows[name].append(value)
            state = step[state][1]
        return rows

    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, now, any_row = [], None, False
        for batch in batches:
            for conv, segment, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if any_row and conv != now:
                    yield pa.RecordBatch.from_pydict(solve(now, parts), schema=arrow)
                    parts = []
                now, any_row = conv, True
                parts.append((segment, weights))
        if any_row:
            yield pa.RecordBatch.from_pydict(solve(now, parts), schema=arrow)

    return dealt.mapInArrow(frugal(run), out)


def _with_segments(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with segment, whole and before: whether an earlier segment has the same role and text."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    long = materialize(sizes.where(F.col("n") > SEGMENT).withColumnRenamed("conv_id", "conv"), "long-conversations")
    one = rows.select("*", F.lit(0).cast("long").alias("segment"), F.lit(True).alias("whole"), F.lit(False).alias("before"))
    if not long.head(1):
        return one
    few = long.limit(BROADCAST_LONG + 1).count() <= BROADCAST_LONG
    long = F.broadcast(long) if few else long
    same = rows["conv_id"].eqNullSafe(long["conv"])
    share = (F.col("turn") - F.col("low")).cast("double") / (F.col("high") - F.col("low") + 1).cast("double")
    place = F.coalesce(F.floor(share * F.ceil(F.col("n") / SEGMENT)), F.lit(-1))  # rows without a turn come first
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    cut = materialize(rows.join(long, same).select("conv_id", "turn", "role", "text", place.alias("segment"), said.alias("said")), "long-rows")
    first = cut.groupBy("conv_id", "said").agg(F.min("segment").alias("_first"), F.max("segment").alias("_last"))
    first = first.where("_first < _last").select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "_first")
    again = cut.join(first, cut["conv_id"].eqNullSafe(F.col("_conv")) & (cut["said"] == F.col("_said")), "left")
    cut = again.select("conv_id", "turn", "role", "text", "segment", F.lit(False).alias("whole"), F.coalesce(F.col("segment") > F.col("_first"), F.lit(False)).alias("before"))
    return one.join(long, one["conv_id"].eqNullSafe(long["conv"]), "left_anti").unionByName(cut)


def _long_turns(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(conv_id, segment, repaired) of segments, by the way that their conversation's path takes through them."""
    kind = rows.schema["conv_id"].dataType
    order = ["segment", "turn", "role", "text"]
    w = ways.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "entry", "labels")
    told = rows.join(w, rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["segment"] == F.col("_segment")))
    dealt = told.select("conv_id", *order, "entry", "labels").repartition("conv_id", "segment").sortWithinPartitions("conv_id", *order)
    out = _with_key(kind, f"segment long, repaired {_TURN}")
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def made(now: tuple, held: list) -> pa.RecordBatch:
        turns = [{"role": r, "text": t} for r, t in apply_edits(held, now[3], now[2])]
        return pa.RecordBatch.from_pylist([{"conv_id": now[0], "segment": now[1], "repaired": turns}], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for conv, segment, _, role, text, entry, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[:2] != (conv, segment):
                    if held:
                        yield made(now, held)
                    held, now = [], (conv, segment, entry, labels)
                held.append((role, text))
        if held:
            yield made(now, held)

    return dealt.mapInArrow(frugal(run), out)


def _long_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations whose segments' turns are given: a digest runs over them in order."""
    kind = turns.schema["conv_id"].dataType
    out = _with_key(kind, "repaired_sha256 string")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, now, between = None, None, b""
        for batch in batches:
            for conv, repaired in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest is not None and conv != now:
                    yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema=arrow)
                    digest = None
                if digest is None:
                    digest, now, between = hashlib.sha256(), conv, b""
                for turn in repaired:
                    digest.update(between + f"{turn['role']}:{turn['text']}".encode("utf-8", "surrogatepass"))
                    between = b"\n"
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema=arrow)

    return dealt.mapInArrow(frugal(run), out)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, audits) of rows with conv_id, turn, role and text.

    turns is (conv_id, segment, repaired): the repaired rows, an array per segment in order. audits has a row per conversation:
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows come by turn, those without one first; rows that share a turn, by role and text. A null role or text counts as one
    space, a null conv_id as a conversation. A role that is empty has no initial: such a row can't be kept as it is. Other
    columns are not read.
    """
    prepare(rows.sparkSession)
    spoken = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    cut = _with_segments(spoken)
    segments = materialize(_segments(cut), "segments")
    whole, parts = segments.where("repaired IS NOT NULL"), segments.where("repaired IS NULL")
    counts = ("n", "turns", "blank", "duplicate", "truncated", "illegal")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    way = F.col("weights")[0]
    audits = whole.select("conv_id", "low", "high", *counts, way["cost"].alias("cost"), way["labels"].alias("audit"), F.sha2(text, 256).alias("repaired_sha256"))
    turns = whole.select("conv_id", "segment", "repaired")
    if parts.head(1):
        ways = materialize(_joined(parts), "ways")
        long_turns = materialize(_long_turns(cut.where("NOT whole"), ways), "long-turns")
        border = F.lag("last").over(Window.partitionBy("conv_id").orderBy("segment"))  # over segments, not rows
        legal = F.concat(border, "first").isin("su", "ua", "au")
        told = parts.withColumn("illegal", F.col("illegal") + F.when(border.isNotNull() & ~legal, 1).otherwise(0))
        summed = told.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in counts])
        path = ways.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "labels"))), lambda x: x["labels"]), "").alias("audit"))
        key = lambda df, other: df["conv_id"].eqNullSafe(other["conv_id"])
        digests = _long_digests(long_turns)
        joined = summed.join(path, key(summed, path), "left").join(digests, key(summed, digests), "left")
        audits = audits.unionByName(joined.select(summed["conv_id"], "low", "high", *counts, "cost", "audit", "repaired_sha256"))
        turns = turns.unionByName(long_turns)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return turns, audits.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """rows with faults of known places: by crc32 of conv_id:turn modulo 20, a row is dropped (0), emptied (1), loses its sentence
    ends (2), comes twice (3) or is the user's (4). Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    kept = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = kept.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def repair_digest(rows: DataFrame) -> DataFrame:
    """Every conv_id of rows, with the audit of what damage() leaves of it; zeros, no edits and nothing's digest if it leaves nothing."""
    _, audits = repair(damage(rows))
    every = rows.select("conv_id").distinct()
    audits = audits.withColumnRenamed("conv_id", "conv")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(audits, every["conv_id"].eqNullSafe(audits["conv"]), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
