"""Quality rules (operator 6): fixed measures of a text and a trained, calibrated verdict.

The verdict is a logistic regression over hashed frequencies of words and pairs of words, and of character
trigrams, fitted on a bounded sample of labelled documents (``per_class`` of each label, chosen by a hash of
the id) and Platt-scaled on a held-out fifth of it. Scoring runs in Arrow batches with one weight vector of
2 * ``DIM`` floats, whatever the size of the corpus. One task fits sparse rows of at most 2 * ``DIM``
numbers for each of 2 * ``per_class`` documents; the driver gets the weights only.

Edge cases: null or empty text has no words, all measures 0, and fails the base rules; a document
row that occurs twice is measured twice; labels that are null, or of unknown documents, are not
used; ids with both labels count as low quality; of several texts of one id the one of least hash is learned from; with labels of one class only, or none, the
verdict is to keep; a text of any length is measured whole, and takes some 26 times its size. Columns other than doc_id and text are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .hashing import place
from .scratch import small_batches

DIM = 1 << 16
#: Rules on fixed measures: fewer words than this, or a larger percentage of words in repeated 5-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Kept from this probability of good quality on.
KEEP_FROM = 0.5
#: Frequencies are small numbers; scaled to about 1 for the fit.
SCALE = 30.0

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    """weights: words, then trigrams; slope and offset: Platt scaling. None keeps everything."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def measures(t: w.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The five base measures of each text."""
    n, size = len(t.counts), len(t.data)
    points = w.per_doc(t.inside & ((t.data & 0xC0) != 0x80), t.offsets)
    # lines: ends at each newline and at each text's end
    is_end = np.zeros(size + 1, bool)
    is_end[1:] = t.data == 10
    is_end[t.offsets[1:]] = True
    ends = np.flatnonzero(is_end[1:]) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    stops = ends - (t.data[ends - 1] == 10)
    has_word = np.searchsorted(t.starts, stops) > np.searchsorted(t.starts, starts)
    starts, stops = starts[has_word], stops[has_word]
    of = np.searchsorted(t.offsets, starts, side="right") - 1
    keys = w.mix(t.spans(starts, stops) ^ w.mix(of.astype(w.U) + w.U(1)))
    dup = np.bincount(of[w.repeated(keys)[1]], minlength=n)
    begin, hashed = t.windows(hashes, 5)
    doc = np.searchsorted(t.first, begin, side="right") - 1
    more, _ = w.repeated(w.mix(hashed ^ w.mix(doc.astype(w.U) + w.U(1))))
    in_repeats = w.covered(len(hashes), begin[more], 5)
    return {
        "n_words": t.counts.astype(np.int64), "word_chars": points, "n_symbols": w.per_doc(_SYMBOLS[t.data], t.offsets),
        "n_dup_lines": dup.astype(np.int64), "n_repeat_words": w.per_doc(in_repeats, t.first),
    }


def _hashed(codes: np.ndarray) -> np.ndarray:
    m = np.uint32(0x9E3779B1)
    return (((codes[:-2] * m) ^ codes[1:-1]) * m ^ codes[2:]) * m >> np.uint32(16)


def _codes(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype="<u4")


def _trigrams(t: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams in [0, DIM), and each text's bounds among them."""
    codes, offsets = _codes(t.data), t.offsets
    if len(codes) < len(t.data):  # bytes that begin a character
        offsets = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])[offsets]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(len(t.counts) + 1, np.int64)
    h = _hashed(codes)
    inside = np.ones(len(h), bool)
    edges = offsets[1:-1]
    for back in (1, 2):
        e = edges - back
        inside[e[(e >= 0) & (e < len(h))]] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return h[inside].astype(np.int64), kept[np.clip(offsets, 0, len(h))]


def _trigram_counts(data: np.ndarray) -> np.ndarray:
    """Of one long text, a piece at a time: how often each hashed trigram occurs."""
    out, left = np.zeros(DIM, np.int64), np.zeros(0, "<u4")
    starts = np.append(np.arange(0, len(data), w.CHUNK), len(data))
    for i, at in enumerate(starts):  # pieces begin where a character does
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        starts[i] = at
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        codes = np.concatenate([left, _codes(data[a:b])])
        out += np.bincount(_hashed(codes), minlength=DIM)
        left = codes[-2:]
    return out


def _words(t: w.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of words in [0, DIM), text by text, and each text's bounds among them."""
    pair = np.maximum(t.counts - 1, 0)
    bounds = np.concatenate([[0], np.cumsum(t.counts + pair)])
    out = np.empty(bounds[-1], dtype=np.int64)
    of = t.doc()
    out[np.arange(len(hashes)) - t.first[of] + bounds[of]] = (hashes & w.U(DIM - 1)).astype(np.int64)
    begin, both = t.windows(hashes, 2)
    of = of[begin]
    out[begin - t.first[of] + bounds[of] + t.counts[of]] = (both & w.U(DIM - 1)).astype(np.int64)
    return out, bounds


def _logits(t: w.Words, hashes: np.ndarray, model: Model) -> np.ndarray:
    words, at = _words(t, hashes)
    a = w.per_doc(model.weights[words], at) / np.maximum(np.diff(at), 1)
    if len(t.counts) == 1 and len(t.data) > 2 * w.CHUNK:
        n = _trigram_counts(t.data)
        return SCALE * (a + (n @ model.weights[DIM:].astype(float)) / max(n.sum(), 1)) + model.bias
    grams, bounds = _trigrams(t)
    b = w.per_doc(model.weights[DIM:][grams], bounds) / np.maximum(np.diff(bounds), 1)
    return SCALE * (a + b) + model.bias


def scored(batch: pa.RecordBatch, model: Model) -> dict[str, np.ndarray]:
    """Measures and probability of good quality of each row."""
    parts: list[dict] = []
    for _, _, data, offsets in w.texts(batch.column("text")):
        t = w.Words(data, offsets, w.SPACED, lower=False)
        hashes = t.hashes()
        one = measures(t, hashes)
        z = np.full(len(t.counts), 50.0) if model.weights is None else model.slope * _logits(t, hashes, model) + model.offset
        parts.append(one | {"p_good": 1 / (1 + np.exp(-np.clip(z, -50, 50)))})
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (*MEASURES, "p_good")}


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return failed, ~failed & (m["p_good"] >= KEEP_FROM)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Model:
    """Fit on at most ``per_class`` documents of each label, in one task: their features take more than a driver should hold."""
    small_batches(docs.sparkSession)
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen, sizes = [], {}
    for q, test in ((0, F.col("quality") <= 0), (1, F.col("quality") > 0)):
        ranked = labels.where(test).select("doc_id", F.lit(q).alias("good"), place(F.col("doc_id")).alias("place")).orderBy("place", "doc_id").limit(per_class).toArrow()
        chosen.append(ranked)
        sizes[q] = ranked.num_rows
    if not all(sizes.values()):
        return Model(None)
    total = {bool(r["good"]): r["n"] for r in labels.groupBy((F.col("quality") > 0).alias("good")).agg(F.count("*").alias("n")).collect()}
    sample = docs.sparkSession.createDataFrame(pa.concat_tables(chosen), "doc_id bigint, good int, place double")
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * per_class rows
        .groupBy("doc_id").agg(F.min_by(F.struct("good", "place", "text"), F.xxhash64("text")).alias("one")).select("one.*").mapInArrow(_features, "good int, place double, idx array<int>, val array<float>")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [batch for batch in batches if batch.num_rows]
        if own:
            model = _train(pa.Table.from_batches(own), total)
            del own
            w.give_back()
            yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "offset": model.offset}])

    fitted = rows.repartition(1).mapInArrow(run, "weights binary, bias double, slope double, offset double").collect()
    return Model(np.frombuffer(bytes(fitted[0]["weights"]), np.float32), *fitted[0][1:]) if fitted else Model(None)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in w.texts(batch.column("text")):
            t = w.Words(data, offsets, w.SPACED, lower=False)
            (idx, at), (grams, bounds) = _words(t, t.hashes()), _trigrams(t)
            ids, vals = [], []
            for i in range(len(t.counts)):
                u, c = np.unique(idx[at[i] : at[i + 1]], return_counts=True)
                v, k = np.unique(grams[bounds[i] : bounds[i + 1]] + DIM, return_counts=True)
                ids.append(np.concatenate([u, v]).astype(np.int32))
                vals.append(np.concatenate([c / max(c.sum(), 1), k / max(k.sum(), 1)]).astype(np.float32))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("good"), part.column("place"), pa.array(ids, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], names=["good", "place", "idx", "val"])


def _train(rows: pa.Table, total: dict[bool, int], epochs: int = 200, rate: float = 0.5, decay: float = 1e-6, least: float = 1e-3) -> Model:
    """Full-batch Adagrad on four fifths, Platt scaling on the rest, both weighted to the labels' true shares.

    Ends when ten epochs have lowered the loss by less than a share of ``least``, after ``epochs`` at most."""
    rows = rows.sort_by("place")
    y = rows["good"].to_numpy().astype(float)
    held = (rows["place"].to_numpy() * (1 << 40)).astype(np.int64) % 5 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    lists = rows["idx"].combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    cols, vals = lists.flatten().to_numpy(), rows["val"].combine_chunks().flatten().to_numpy()
    bounds = bounds - bounds[0]
    share = {c: max(1, int((y == c).sum())) for c in (0.0, 1.0)}
    weight = np.where(y > 0, total.get(True, 1) / share[1.0], total.get(False, 1) / share[0.0])

    theta, bias, g2, gb = np.zeros(2 * DIM), 0.0, np.full(2 * DIM, 1e-8), 1e-8
    use = ~held
    even = np.where(y > 0, 1 / share[1.0], 1 / share[0.0]) * use
    parts = [(i, min(i + 256, len(y))) for i in range(0, len(y), 256)]  # few numbers at a time beside the sample itself

    def logits() -> np.ndarray:
        return SCALE * np.concatenate([w.per_doc(vals[bounds[a] : bounds[b]] * theta[cols[bounds[a] : bounds[b]]], bounds[a : b + 1] - bounds[a]) for a, b in parts]) + bias

    losses: list[float] = []
    for _ in range(epochs):
        z = logits()
        losses.append(float((np.logaddexp(0, np.clip(z, -50, 50)) - y * np.clip(z, -50, 50)) @ even))
        if len(losses) > 10 and losses[-1] > (1 - least) * losses[-11]:
            break
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * even
        g = decay * theta
        for a, b in parts:
            g += SCALE * np.bincount(cols[bounds[a] : bounds[b]], weights=vals[bounds[a] : bounds[b]] * np.repeat(err[a:b], np.diff(bounds[a : b + 1])), minlength=2 * DIM)
        g2 += g * g
        gb += err.sum() ** 2
        theta -= rate * g / np.sqrt(g2)
        bias -= rate * err.sum() / np.sqrt(gb)
    z = logits()
    del lists, rows, cols, vals
    w.give_back()
    on = held if held.any() else use
    slope, offset = _platt(z[on], y[on], weight[on])
    return Model(theta.astype(np.float32), bias, slope, offset)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with step halving; a small ridge keeps the slope near 1."""
    weight = weight / weight.mean()
    ridge = np.array([1.0, 0.1])

    def loss(v: np.ndarray) -> float:
        u = np.clip(v[0] * z + v[1], -50, 50)
        return float((weight * (np.logaddexp(0, u) - y * u)).sum() + 0.5 * (ridge * (v - [1, 0]) ** 2).sum())

    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -50, 50)))
        r, s = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(r * z).sum(), r.sum()]) + ridge * (at - [1, 0])
        cross = (s * z).sum()
        step = np.linalg.solve(np.array([[(s * z * z).sum() + ridge[0], cross], [cross, s.sum() + ridge[1]]]), grad)
        size = 1.0
        while size > 1e-4 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 0.01), float(at[1])


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, the measures, p_good, base_failed, kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = scored(batch, shared.value)
            failed, kept = verdict(m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m[k], pa.int64()) for k in MEASURES), pa.array(m["p_good"], pa.float64()), pa.array(failed), pa.array(kept)], names=["doc_id", *MEASURES, "p_good", "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in MEASURES) + ", p_good double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the rules and the model keep."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdict(scored(batch, shared.value))[1]))

    return docs.mapInArrow(run, docs.schema)
