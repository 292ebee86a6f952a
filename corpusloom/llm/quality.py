"""Quality classification by co-training two views: text content and page metadata.

The text view sees hashed words and punctuation runs (present or not) and binned shape measures; the metadata view sees
source, language and length. Both are logistic regressions that begin with a bounded sample of labelled rows. In each
round, both views score all unlabelled rows where these lie, and the rows that one view is sure of join the other view's
training rows: each task sums counts and gradients by feature over its rows, and the driver gets the sums. On one half of
the held-out labelled rows each view's score is calibrated and the calibrated views are combined. On the other half the
threshold is set: 0.5, or less where that is needed to keep KEEP of the good rows, but no less than rejects CATCH of the
others and of the toxic ones. All documents are then scored whole, in one pass next to their text, without a shuffle.

Sample: MAX_LABELLED labelled rows, those with the smallest hashes of their ids; the driver gets their feature numbers
alone. Everything else covers all rows. Feature numbers of the unlabelled rows are written once and read by each pass.
Sums are of integers (residuals in units of 1/UNIT), so they don't depend on how rows are dealt to tasks.

Defined results: null text counts as empty; null metadata is a value of its own; repeated rows have equal scores; an
empty table gives no rows; without labels of both kinds, every document scores 1 and is accepted; rows without an id are
scored, and are unlabelled ones; of labelled rows that repeat an id one is fitted on, unlabelled rows count each for
itself; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import without_ids
from corpusloom.llm.hashing import run_hashes, slices
from corpusloom.llm.worker import frugal, prepare, trim
from corpusloom.schemas import require
from corpusloom.storage import drop_tables, materialize

#: Labelled rows that fitting reads at most.
MAX_LABELLED = 20_000
#: Of the labelled rows, those kept for calibration; rounds of exchange; how sure a view must be to label a row.
HELD_OUT, ROUNDS, SURE = 0.2, 3, 0.97
#: Gradient steps over labelled and unlabelled rows in each round; parts of one in which residuals are summed.
PASSES, UNIT = 4, 1 << 24
#: Rows that a feature needs to be used, and the least log ratio of its shares in both kinds.
MIN_ROWS, MIN_RATIO = 3, 0.3
#: Shares of held-out rows by which the threshold is set, see threshold_of(): of good rows to keep, of either bad kind to
#: reject, and of good rows to keep at least where both can't be had.
KEEP, CATCH, LEAST_KEPT = 0.99, 0.8, 0.96
#: Features of the text view (two to this power) and of the metadata view.
TEXT_BITS, META_BITS = 18, 12
#: Labels of rows: of good quality and not toxic, of low quality and not toxic, toxic.
GOOD, LOW, TOXIC = 1, 0, -1
SHAPES, BINS = 8, 16

#: 0: white space; 1: letters, digits and non-ASCII; 2: punctuation and controls.
KINDS = np.full(256, 2, np.uint8)
KINDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
KINDS[[0x20, *range(0x09, 0x0E)]] = 0
UPPER = np.zeros(256, np.int64)
UPPER[0x41:0x5B] = 1
DIGIT = np.zeros(256, np.int64)
DIGIT[0x30:0x3A] = 1


def _binned(x: np.ndarray, shape: int) -> np.ndarray:
    """Feature numbers of measures in [0, 1]; each measure has its own range of numbers."""
    return (shape * BINS + np.clip(np.ceil(x * (BINS - 1)), 0, BINS - 1)).astype(np.int64)


def text_features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted numbers of each text's features; the first SHAPES*BINS are shape measures."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    data = b"\n".join(raw) + b"\n"
    starts, lengths, hashes = run_hashes(data.lower(), KINDS)
    bounds = np.searchsorted(starts, offsets)
    own = SHAPES * BINS
    numbers = (own + (hashes >> np.uint64(64 - TEXT_BITS)).astype(np.int64)) % (1 << TEXT_BITS)
    numbers = np.where(numbers < own, numbers + own, numbers)
    letters = np.frombuffer(data, np.uint8)
    first = letters[starts] if len(starts) else letters[:0]
    word = KINDS[first] == 1
    for i, r in enumerate(raw):
        a, b = bounds[i], bounds[i + 1]
        n = b - a
        if not n:
            yield np.array([_binned(np.zeros(1), 0)[0]])
            continue
        seen = np.unique(numbers[a:b])
        w, size = word[a:b], lengths[a:b]
        words = max(1, int(w.sum()))
        lines = [x for x in r.split(b"\n") if x]
        bytes_of = letters[offsets[i] : offsets[i + 1]]
        measures = (
            min(1.0, np.log1p(n) / 12),
            UPPER[bytes_of].sum() / max(1, len(r)),
            (n - words) / n,
            int((~w & (size > 1)).sum()) / n,
            len(seen) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, float(size[w].sum()) / words / 24),
            DIGIT[bytes_of].sum() / max(1, len(r)),
        )
        yield np.concatenate([[_binned(np.array(m), k).item() for k, m in enumerate(measures)], seen])


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    size = -1 if n_chars is None else int(n_chars).bit_length()
    values = (f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}", f"l{lang}n{size}")
    return [xxhash.xxh3_64_intdigest(v) >> (64 - META_BITS) for v in values]


@dataclass
class Rows:
    """Sparse rows of present features."""

    row: np.ndarray
    feature: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        sizes = np.array([len(x) for x in lists], np.int64)
        whole = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
        return cls(np.repeat(np.arange(len(lists), dtype=np.int32), sizes), whole, len(lists))

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], self.n) + bias


@dataclass
class Sums:
    """By feature, over rows outside the driver: rows and good rows, or residuals in units; the last element is of all rows."""

    a: np.ndarray
    b: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """A logistic regression of rows on the driver and of others of which only sums by feature are known.

    Features of fewer than MIN_ROWS rows, and those about as frequent in both kinds, are left out. Each other one is scaled
    by the log ratio of its shares in good and other rows, so that a rare word that stands in one kind alone counts from
    the first step. The bias starts at the log odds. Steps are adaptive gradient steps.
    """

    def __init__(self, x: Rows, y: np.ndarray, size: int, others: Sums | None = None):
        seen = np.bincount(x.feature, minlength=size)
        good = np.bincount(x.feature, y[x.row], size)
        n, n_good = len(y), y.sum()
        if others:
            seen, good, n, n_good = seen + others.a[:-1], good + others.b[:-1], n + others.a[-1], n_good + others.b[-1]
        ratio = np.log((good + 0.5) / (n_good + 1)) - np.log((seen - good + 0.5) / (n - n_good + 1))
        self.used = np.flatnonzero((seen >= MIN_ROWS) & (np.abs(ratio) >= MIN_RATIO))
        number = np.full(size, -1, np.int32)
        number[self.used] = np.arange(len(self.used), dtype=np.int32)
        has = number[x.feature] >= 0
        self.row, self.feature, self.scale = x.row[has].astype(np.int64), number[x.feature[has]].astype(np.int64), ratio[self.used]
        self.y, self.size = y, size
        self.w, self.g2 = np.zeros(len(self.used)), np.full(len(self.used), 1e-12)
        share = np.clip(n_good / n, 1e-3, 1 - 1e-3)
        self.bias, self.b2 = float(np.log(share / (1 - share))), 1e-12

    def step(self, others: Sums | None = None, n_others: int = 0, rate: float = 0.2, decay: float = 1e-5) -> None:
        """One step down the mean loss of the own rows and, by the sums of their residuals, n_others other ones."""
        n = len(self.y) + n_others
        r = _sigmoid(np.bincount(self.row, (self.w * self.scale)[self.feature], len(self.y)) + self.bias) - self.y
        g, b = np.bincount(self.feature, r[self.row], len(self.used)), r.sum()
        if others:
            g, b = g + others.a[self.used] / UNIT, b + others.a[-1] / UNIT
        g, b = g * self.scale / n + decay * self.w, b / n
        self.g2 += g * g
        self.w -= rate * g / np.sqrt(self.g2)
        self.b2 += b * b
        self.bias -= rate * b / np.sqrt(self.b2)

    def fitted(self) -> tuple[np.ndarray, float]:
        whole = np.zeros(self.size)
        whole[self.used] = self.w * self.scale
        return whole, float(self.bias)


def fit_logistic(x: Rows, y: np.ndarray, size: int, steps: int = 120, others: Sums | None = None) -> Logistic:
    """The regression after full-batch steps on the rows x; others: counts of further rows, for what steps follow."""
    model = Logistic(x, y, size, others)
    for _ in range(steps):
        model.step()
    return model


def _calibrate(z: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Coefficients of a logistic regression of y on the columns of z, and a constant (Newton steps, slightly damped)."""
    x = np.column_stack([z, np.ones(len(z))])
    c = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = _sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(c))
        c -= np.linalg.solve(h, x.T @ (p - y) + 1e-3 * c)
    return c


@dataclass
class Model:
    """Both views' weights, their calibration (slope, constant) and the combination of their calibrated scores."""

    text: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    calibrated: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray
    known: bool = True
    #: The least score of an accepted document.
    threshold: float = 0.5

    def views(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Calibrated log odds of both views."""
        a, b = self.calibrated
        return np.column_stack([a[0] * text + a[1], b[0] * meta + b[1]])

    def score(self, texts: list, sources: list, langs: list, sizes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        if not self.known:
            return np.ones(n), np.ones(n), np.ones(n)
        wt, bt = self.text
        wm, bm = self.meta
        text = np.array([wt[f].sum() + bt for f in text_features(texts)])
        meta = np.array([wm[meta_features(*m)].sum() + bm for m in zip(sources, langs, sizes, strict=True)])
        z = self.views(text, meta)
        return _sigmoid(z[:, 0]), _sigmoid(z[:, 1]), _sigmoid(np.column_stack([z, np.ones(n)]) @ self.combined)


UNKNOWN = Model((np.zeros(1), 0.0), (np.zeros(1), 0.0), (np.zeros(2), np.zeros(2)), np.zeros(3), known=False)
METADATA = ("source", "lang", "n_chars")


def _featured(docs: DataFrame) -> DataFrame:
    """(h, t, m, y): the id's hash, text features, metadata features and _good of every row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                key, texts, source, lang, size, y = (part.column(i).to_pylist() for i in range(6))
                t = pa.array([f.astype(np.int32) for f in text_features(texts)], pa.list_(pa.int32()))
                m = pa.array([meta_features(*x) for x in zip(source, lang, size, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), t, m, pa.array(y, pa.int32())], ["h", "t", "m", "y"])

    return docs.select(F.xxhash64("doc_id").alias("h"), "text", *METADATA, F.col("_good").cast("int")).mapInArrow(frugal(run), "h long, t array<int>, m array<int>, y int")


def _sampled(docs: DataFrame) -> list[tuple[np.ndarray, list[int], int]]:
    """(text features, metadata features, _good) of a bounded sample, in the order of the ids' hashes."""
    table = _featured(docs).toArrow().sort_by([("h", "ascending")])
    t, m, y = table["t"].combine_chunks(), table["m"].to_pylist(), table["y"].to_pylist()
    at, values = t.offsets.to_numpy(), t.values.to_numpy()
    return [(values[at[i] : at[i + 1]], m[i], y[i]) for i in range(table.num_rows)]


#: Sizes of both views; a judge is, for each view, its weights, bias and calibration in one round.
SIZES = (1 << TEXT_BITS, 1 << META_BITS)
Judge = tuple[tuple[np.ndarray, float, np.ndarray], ...]


def told(judges: list[Judge], views: list[Rows]) -> list[np.ndarray]:
    """For each view, what the other view says of each row: 1 good, -1 not, 0 unsure.

    The first judge of which one view is sure of a row decides; what that judge leaves open stays open.
    """
    said = [np.zeros(views[0].n, np.int64) for _ in views]
    free = np.ones(views[0].n, bool)
    for judge in judges:
        sure = []
        for x, (w, bias, c) in zip(views, judge, strict=True):
            p = _sigmoid(x.scores(w, bias) * c[0] + c[1])
            sure.append((p >= SURE).astype(np.int64) - (p <= 1 - SURE))
        for v in (0, 1):
            said[v] = np.where(free, sure[1 - v], said[v])
        free &= (sure[0] == 0) & (sure[1] == 0)
    return said


def _add(sums: list[Sums], views: list[Rows], judges: list[Judge], at: list[tuple[np.ndarray, float]] | None) -> None:
    """Adds to each view's sums those of its told rows: counts, or residuals at the weights and biases at."""
    for v, said in enumerate(told(judges, views)):
        x, s = views[v], sums[v]
        mine = said != 0
        a, b = mine.astype(float), (said > 0).astype(float)
        if at:
            a, b = np.rint((_sigmoid(x.scores(*at[v])) - b) * UNIT) * mine, np.zeros(x.n)
        for total, value in ((s.a, a), (s.b, b)):
            if value.any():
                total[:-1] += np.bincount(x.feature, value[x.row], SIZES[v]).astype(np.int64)
                total[-1] += int(value.sum())


def _lists(column: pa.Array) -> Rows:
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    return Rows(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), values, len(sizes))


def _pass(rows: DataFrame, judges: list[Judge], at: list[tuple[np.ndarray, float]] | None = None) -> list[Sums]:
    """Both views' sums over all rows (t, m): one pass; each task leaves one row a feature."""
    sent = rows.sparkSession.sparkContext.broadcast((judges, at))  # vectors of fixed size
    first = (0, SIZES[0] + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Sums(np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)) for n in SIZES]
        for batch in batches:
            for part in slices(batch):
                _add(sums, [_lists(part.column(0)), _lists(part.column(1))], *sent.value)
        for s, begin in zip(sums, first, strict=True):
            k = np.flatnonzero((s.a != 0) | (s.b != 0))
            yield pa.RecordBatch.from_arrays([pa.array((k + begin).astype(np.int32)), pa.array(s.a[k]), pa.array(s.b[k])], ["k", "a", "b"])

    got = rows.select("t", "m").mapInArrow(frugal(run), "k int, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    sent.destroy()
    a, b = (np.zeros(sum(SIZES) + 2, np.int64) for _ in "ab")
    k = got["k"].to_numpy()
    a[k], b[k] = got["a"].to_numpy(), got["b"].to_numpy()
    return [Sums(a[i : i + n + 1], b[i : i + n + 1]) for i, n in zip(first, SIZES, strict=True)]


def threshold_of(p: np.ndarray, label: np.ndarray) -> float:
    """The threshold by scores of labelled rows: 0.5, or less if that keeps less than KEEP of the good ones.

    Each kind of the others, low-quality and toxic, raises it until CATCH of them are rejected; above 0.5 only as far as
    LEAST_KEPT of the good rows are kept. With few labels, fewer than CATCH of a kind may be rejected then.
    """
    good = p[label == GOOD]
    t = min(0.5, float(np.quantile(good, 1 - KEEP)))
    most = max(0.5, float(np.quantile(good, 1 - LEAST_KEPT, method="lower")))
    for kind in (label == LOW, label == TOXIC):
        if kind.any():
            t = max(t, min(most, float(np.nextafter(np.quantile(p[kind], CATCH, method="higher"), 1))))
    return t


def co_train(labelled: list, sums: Callable[[list[Judge], list | None], list[Sums]] | None, rounds: int = ROUNDS) -> Model:
    """The model of rows (text features, metadata features, label), and of unlabelled ones by a pass over all of them.

    labelled is emptied as soon as its rows are held in another form: the driver has them once.
    """
    label = np.array([r[2] for r in labelled])
    y = (label == GOOD).astype(float)
    held = np.arange(len(y)) % round(1 / HELD_OUT) == 0  # rows come in the order of hashes
    if len(y) < 10 or min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return UNKNOWN
    train, test = ([Rows.of([np.asarray(r[v]) for r, h in zip(labelled, held, strict=True) if h == which]) for v in (0, 1)] for which in (False, True))
    label_held = label[held]
    labelled.clear()
    trim()
    models: list[Logistic | None] = [fit_logistic(train[v], y[~held], SIZES[v]) for v in (0, 1)]
    judges: list[Judge] = []
    before = 0
    for _ in range(rounds if sums else 0):
        fitted = [m.fitted() for m in models]
        judges.append(tuple((*f, _calibrate(x.scores(*f)[:, None], y[held])) for f, x in zip(fitted, test, strict=True)))
        counts = sums(judges, None)
        now = sum(int(c.a[-1]) for c in counts)
        if now == before:
            break
        before = now
        for v in (0, 1):
            if counts[v].a[-1]:
                models[v] = None  # its rows go before the next one's are made
                models[v] = fit_logistic(train[v], y[~held], SIZES[v], others=counts[v])
        for _ in range(PASSES):
            others = sums(judges, [m.fitted() for m in models])
            for v in (0, 1):
                if counts[v].a[-1]:
                    models[v].step(others[v], int(counts[v].a[-1]))
    fitted = [m.fitted() for m in models]
    scores = [x.scores(*f) for x, f in zip(test, fitted, strict=True)]
    half = np.arange(int(held.sum())) % 2 == 0
    known = y[held]
    if min(known[half].sum(), (1 - known[half]).sum(), known[~half].sum(), (1 - known[~half]).sum()) < 1:
        half = np.ones(len(known), bool)  # too few for halves
    calibrated = tuple(_calibrate(s[half, None], known[half]) for s in scores)
    z = np.column_stack([c[0] * s + c[1] for c, s in zip(calibrated, scores, strict=True)])
    combined = _calibrate(z[half], known[half])
    rest = ~half if half.sum() < len(half) else half
    p = _sigmoid(np.column_stack([z, np.ones(len(z))]) @ combined)[rest]
    return Model(fitted[0], fitted[1], calibrated, combined, True, threshold_of(p, label_held[rest]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """The model of docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality, toxic).

    A row is good if its quality is 1 and it is not toxic. max_labelled bounds the labelled rows that fitting reads; the
    unlabelled ones are all read.
    """
    require(docs, "doc_id", "text", *METADATA)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.expr(f"CASE WHEN coalesce(toxic, 0) <> 0 THEN {TOXIC} WHEN quality = 1 THEN {GOOD} ELSE {LOW} END").alias("_good"))
    some = known.groupBy("doc_id").agg(F.min("_good").alias("_good")).orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    base = docs.select("doc_id", "text", *METADATA)
    labelled = _sampled(base.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]))  # max_labelled rows at most
    if len({r[2] == GOOD for r in labelled}) < 2:
        return UNKNOWN
    ids = materialize(known.select("doc_id").distinct(), "labelled-ids")
    rows = materialize(_featured(without_ids(base, ids).withColumn("_good", F.lit(0))).select("t", "m"), "unlabelled")
    model = co_train(labelled, lambda judges, at: _pass(rows, judges, at), rounds)
    drop_tables(rows, ids)
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p_text, p_meta, p_good, accepted) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # two vectors of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch):
                t, v, p = m.score(*(part.column(i).to_pylist() for i in range(1, 5)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(t), pa.array(v), pa.array(p), pa.array(p >= m.threshold)], ["doc_id", "p_text", "p_meta", "p_good", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *METADATA).mapInArrow(frugal(run), f"doc_id {kind}, p_text double, p_meta double, p_good double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts; scored and filtered in place."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", *METADATA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(m.score(*(part.column(i).to_pylist() for i in at))[2] >= m.threshold))

    return docs.mapInArrow(frugal(run), docs.schema)
