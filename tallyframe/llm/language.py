"""Language identification (operator 1): multinomial naive Bayes over hashed character n-grams.

Features are the character bigrams and trigrams of the lower-cased text with all non-letters folded
to one blank, hashed to ``BUCKETS``. Counts are taken on about ``per_language`` training documents
of a language (each by a hash of its id) and summed by Spark; the log-probability matrix has
BUCKETS floats for each language. It is broadcast in blocks of ``BLOCK`` languages at most: of more languages, the
documents are gone through once for each block, and are written in between with the best language so far. Whole
texts are scored in sparse batches in numpy.

Edge cases: a text that is null, empty or has no letter is ``und`` with score 0; so is every text
when there is nothing to learn from. Rows of a null language, or a null id, are not learned from.
Languages with fewer than one letter n-gram are never predicted; every other label is learned. Between equal
languages the first by name is predicted. Rows that repeat each get a row; a long text is scored whole, a piece at
a time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import place
from .scratch import small_batches, staged
from .words import give_back

BUCKETS = 1 << 17
UND = "und"
#: Languages in one broadcast matrix: 64 MB.
BLOCK = 128
#: Characters handled at a time.
CHUNK = 1 << 20
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _mixed(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 17)).astype(np.int64)


def _hashed(text: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of the bigrams and the trigrams from each character on: the bucket, and whether there is a letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letter_table()[codes]
    c = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    h2 = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h3 = h2[:-1] + c[2:] * np.uint64(0x165667B19E3779F9)
    ok2 = letter[:-1] | letter[1:]
    return (_mixed(h2), ok2), (_mixed(h3), ok2[:-1] | letter[2:])


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams with a letter of all texts, and the texts' bounds among them."""
    folded = [f" {(t or '').lower()} " for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in folded])])
    (h2, ok2), (h3, ok3) = _hashed("".join(folded))
    edge = offsets[1:-1]
    ok2[edge - 1] = False
    ok3[edge - 1] = False
    ok3[edge - 2] = False
    # bigrams and trigrams of a text stand together: the place of the first character orders them
    (a, ba), (b, bb) = ((h[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(offsets, len(ok))]) for h, ok in ((h2, ok2), (h3, ok3)))
    grams = np.empty(len(a) + len(b), dtype=np.int64)
    of_a = np.repeat(np.arange(len(texts)), np.diff(ba))
    of_b = np.repeat(np.arange(len(texts)), np.diff(bb))
    grams[np.arange(len(a)) + bb[of_a]] = a
    grams[np.arange(len(b)) + ba[of_b + 1]] = b
    return grams, ba + bb


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_grams`` of the texts; one long text in pieces, whose n-grams are those of the whole."""
    if len(texts) > 1 or len(texts[0] or "") <= 2 * CHUNK:
        yield _grams(texts)
        return
    whole = f" {texts[0].lower()} "
    for a in range(0, len(whole) - 1, CHUNK):
        (h2, ok2), (h3, ok3) = _hashed(whole[a : a + CHUNK + 2])
        grams = np.concatenate([h2[:CHUNK][ok2[:CHUNK]], h3[ok3]])
        yield grams, np.array([0, len(grams)])


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of CHUNK characters at most, or one longer text."""
    texts = column.to_pylist()
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t or "") > CHUNK:
            yield a, i, texts[a:i]
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts), texts[a:]
    give_back()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, texts in _chunks(batch.column("text")):
            of = np.array(langs[a:b], dtype=object)
            for grams, bounds in _pieces(texts):
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                for lang in set(langs[a:b]):
                    mine = np.bincount(grams[(of == lang)[row]], minlength=BUCKETS)
                    held[lang] = held[lang] + mine if lang in held else mine
    for lang, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """names of the languages; matrix: log-probabilities, one row a language; prior. A block of them, or all."""

    def __init__(self, names: list[str], matrix: np.ndarray, prior: np.ndarray):
        self.names, self.matrix, self.prior = names, matrix, prior

    def blocks(self, size: int) -> list[Model]:
        return [Model(self.names[i : i + size], self.matrix[i : i + size], self.prior[i : i + size]) for i in range(0, len(self.names), size)]

    def weigh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its n-grams, the best language, its log weight, and the logarithm of the sum of all weights."""
        z, n = np.repeat(self.prior[:, None], len(texts), axis=1), np.zeros(len(texts), np.int64)
        for grams, bounds in _pieces(texts):
            n += np.diff(bounds)
            for i, row in enumerate(self.matrix):
                sums = np.concatenate([[0.0], np.cumsum(row[grams], dtype=np.float64)])
                z[i] += sums[bounds[1:]] - sums[bounds[:-1]]
        best = z.argmax(0)
        top = z[best, np.arange(len(texts))]
        return n, best, top, top + np.log(np.exp(np.minimum(z - top, 0)).sum(0))


def fit(docs: DataFrame, per_language: int = 5000) -> Model:
    """``docs``: the training documents (doc_id, text, lang). The driver gets at most BUCKETS numbers of each language."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null")
    total = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    shares = F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, min(1.0, per_language / n))))
    counts = docs.where(place(F.col("doc_id")) < F.element_at(shares, F.col("lang"))).select("lang", "text").mapInArrow(_count, "lang string, bucket int, n bigint")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    of, buckets, n = table["lang"].to_pylist(), table["bucket"].to_numpy(), table["n"].to_numpy()
    names = sorted(set(of))
    number = {x: i for i, x in enumerate(names)}
    matrix = np.full((len(names), BUCKETS), 0.5, dtype=np.float32)
    np.add.at(matrix, (np.fromiter(map(number.__getitem__, of), np.int64, len(of)), buckets), n)
    matrix = np.log(matrix / matrix.sum(1, keepdims=True, dtype=np.float64)).astype(np.float32)
    prior = np.array([total[x] for x in names], dtype=float)
    return Model(names, matrix, np.log(prior / prior.sum()) if len(names) else prior)


def predict(docs: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """doc_id, lang_pred and score of every row; the text alone decides."""
    spark = docs.sparkSession
    small_batches(spark)
    state = "n_grams bigint, best string, top double, all double"

    def weighed(part: Model, first: bool, more: bool):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, texts in _chunks(batch.column("text")):
                    own, one = shared.value, batch.slice(a, b - a)
                    n, best, top, total = own.weigh(texts)
                    names = np.array(own.names, dtype=object)[best]
                    if not first:
                        was, sums = (one.column(c).to_numpy() for c in ("top", "all"))
                        names = np.where(top > was, names, np.array(one.column("best").to_pylist(), dtype=object))
                        top, total = np.maximum(top, was), np.logaddexp(total, sums)
                    cols = [one.column("doc_id"), *([one.column("text")] * more), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(top), pa.array(total)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(["text"] * more), *(x.split()[0] for x in state.split(", "))])

        return run

    out, parts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model.blocks(block)
    if not parts:
        return out.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    for i, part in enumerate(parts):
        first, more = i == 0, i < len(parts) - 1
        out = out.mapInArrow(weighed(part, first, more), "doc_id bigint, " + "text string, " * more + state)
        out = staged(out) if more else out
    known = F.col("n_grams") > 0
    return out.select("doc_id", F.when(known, F.col("best")).otherwise(UND).alias("lang_pred"), F.when(known, F.least(F.lit(1.0), F.exp(F.col("top") - F.col("all")))).otherwise(0.0).alias("score"))
