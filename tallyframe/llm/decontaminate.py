"""Benchmark decontamination (operator 4): a prefix-filtered set join with item windows.

A window is ``size`` consecutive item words, or the whole of a shorter item. A document word inside
any occurrence of a window is hit. Shingles (runs of up to three words) of the windows are counted
over all documents and ordered by rarity; a document that contains a window must contain the
window's rarest shingle, so only that one shingle of each window (its necessary prefix, as the
containment asked for is 1) is joined. Where a document has it, its place fixes where the window
would start: the length and positional bound drops places that would begin before, or end after,
the document. What is left is verified word by word over the window.

An index of at most ``block`` windows is broadcast. Of more windows only a bitmap of fixed size is, of cells of
their shingles: documents send the shingles in it, to be counted, and then those that are a window's rarest, with the
words around them, to be joined with the windows; hits return to their rows by number. Either way documents
are gone through twice, whatever the size of the benchmark, and the results are the same.

Edge cases: null texts and items have no words; an item without words has no windows; equal items
are all reported; null item ids are reported as nothing but their words are still hit; document
rows that occur twice each get a row; a text of any length is searched whole, and takes some 20 times its size. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as w
from .scratch import small_batches, staged

SHINGLE = 3
#: Windows in one broadcast: 128 bytes each at most at 13 words.
BLOCK = 200_000


def _item_windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"item_id": [], "words": []}
            for a, _, data, offsets in w.texts(batch.column("text")):
                t = w.Words(data, offsets, w.ALNUM, lower=True)
                h = t.hashes().view(np.int64)
                ids = batch.column("item_id").slice(a, len(t.counts)).to_pylist()
                for i, n in enumerate(t.counts):
                    own = h[t.first[i] : t.first[i + 1]]
                    for j in range(max(1, n - size + 1) if n else 0):
                        rows["item_id"].append(ids[i])
                        rows["words"].append(own[j : j + size])
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else str(x) for x in rows["item_id"]], pa.string()), pa.array(rows["words"], pa.list_(pa.int64()))], names=["item_id", "words"])

    return run


def _shingles(hashes: np.ndarray, t: w.Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each length up to SHINGLE: length, first words, hashes."""
    return [(k, *t.windows(hashes, k)) for k in range(1, SHINGLE + 1)]


def _window_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the window's shingles of SHINGLE words, or of the whole of a shorter one, in order."""
    k = min(SHINGLE, len(words))
    u = words.view(w.U)
    at = np.arange(len(u) - k + 1)
    return w.ranges(u, at, at + k, w._Q)


def _count(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each of the sorted shingle hashes occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in w.texts(batch.column("text")):
                t = w.Words(data, offsets, w.ALNUM, lower=True)
                for _, _, h in _shingles(t.hashes(), t)[-1:]:
                    at = np.searchsorted(known, h)
                    at[at == len(known)] = 0
                    total += np.bincount(at[known[at] == h], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["i", "n"])

    out = np.zeros(len(wanted), dtype=np.int64)
    rows = docs.select("text").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out[rows["i"].to_numpy().astype(np.int64)] = rows["n"].to_numpy()
    shared.unpersist()
    return out


class Index:
    """Windows by the hash of their rarest shingle."""

    def __init__(self, windows: list, wanted: np.ndarray, counts: np.ndarray):
        self.items = [x for _, x in windows]
        self.lengths = np.array([len(x) for x, _ in windows])
        self.words = np.zeros((len(windows), int(self.lengths.max())), dtype=w.U)
        keys, self.shift = np.zeros(len(windows), dtype=w.U), np.zeros(len(windows), dtype=np.int64)
        for i, (words, _) in enumerate(windows):
            self.words[i, : len(words)] = words.view(w.U)
            s = _window_shingles(words)
            rarest = min(range(len(s)), key=lambda j: (counts[np.searchsorted(wanted, s[j])], s[j]))
            keys[i], self.shift[i] = s[rarest], rarest
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.sizes = np.unique(np.minimum(self.lengths, SHINGLE))

    def hits(self, t: w.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document word and window number of every occurrence."""
        starts, found = [], []
        for k, begin, h in _shingles(hashes, t):
            if k not in self.sizes:
                continue
            lo = np.searchsorted(self.keys, h, side="left")
            lo[lo == len(self.keys)] = 0
            some = np.flatnonzero(self.keys[lo] == h)
            n = np.searchsorted(self.keys, h[some], side="right") - lo[some]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = self.order[np.repeat(lo[some], n) + within]
            at = np.repeat(begin[some], n)
            doc = np.searchsorted(t.first, at, side="right") - 1
            start = at - self.shift[window]
            room = (start >= t.first[doc]) & (start + self.lengths[window] <= t.first[doc + 1]) & (np.minimum(self.lengths[window], SHINGLE) == k)
            start, window = start[room], window[room]
            same = np.ones(len(start), bool)
            for j in range(self.words.shape[1]):
                live = np.flatnonzero(same & (self.lengths[window] > j))
                same[live] = hashes[start[live] + j] == self.words[window[live], j]
            starts.append(start[same])
            found.append(window[same])
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _search(shared, names: list[str]):
    """Adds to rows the hits of the index, sorted by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value if shared else None
        for batch in batches:
            for a, b, data, offsets in w.texts(batch.column("text")):
                t = w.Words(data, offsets, w.ALNUM, lower=True)
                part = batch.slice(a, b - a)
                cols = {n: part.column(n) for n in names} | {"n_words": pa.array(t.counts, pa.int64())}
                if index is None:
                    start, window = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    start, window = index.hits(t, t.hashes())
                doc = np.searchsorted(t.first, start, side="right") - 1
                order = np.lexsort((start, doc))
                start, window, doc = start[order], window[order], doc[order]
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                local = (start - t.first[doc]).astype(np.int32)
                lists = {"starts": [], "lengths": [], "items": []}
                for i in range(b - a):
                    s = slice(cut[i], cut[i + 1])
                    lists["starts"].append(local[s])
                    lists["lengths"].append(index.lengths[window[s]].astype(np.int32) if s.stop > s.start else local[s])
                    lists["items"].append(sorted({x for j in np.unique(window[s]) for x in index.items[j]}) if s.stop > s.start else [])
                for n, kind in (("starts", pa.int32()), ("lengths", pa.int32()), ("items", pa.string())):
                    cols[n] = pa.array(lists[n], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


#: Bits of the bitmap of a large benchmark's shingles, and of a part of it, as powers of 2.
CELL_BITS, PART_BITS = 27, 18


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Which cells the shingles (column ``shingle``) fall into. 2**CELL_BITS / 8 bytes, brought together part by part."""
    cells = shingles.select(F.shiftrightunsigned("shingle", 64 - CELL_BITS).cast("int").alias("cell")).distinct()
    out = np.zeros(1 << CELL_BITS, dtype=bool)
    for row in cells.groupBy(F.shiftright("cell", PART_BITS)).agg(F.collect_list("cell").alias("cells")).toLocalIterator():
        out[np.array(row["cells"])] = True
    return np.packbits(out, bitorder="little")


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = (hashes >> w.U(64 - CELL_BITS)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _sent(shared, count: bool, size: int):
    """Of rows (row, text) the shingles in the bitmap. count: how often each; else each place with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for a, _, data, offsets in w.texts(batch.column("text")):
                t = w.Words(data, offsets, w.ALNUM, lower=True)
                hashes = t.hashes()
                for k, begin, h in _shingles(hashes, t):
                    some = _in(bits, h)
                    begin, h = begin[some], h[some]
                    if count:
                        u, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(n)], names=["k", "shingle", "n"])
                        continue
                    doc = np.searchsorted(t.first, begin, side="right") - 1
                    lo, hi = np.maximum(begin - size + 1, t.first[doc]), np.minimum(begin + size, t.first[doc + 1])
                    around = [hashes[x:y].view(np.int64) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    cols = [pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), batch.column("row").take(pa.array(doc + a)), pa.array(begin - t.first[doc]), pa.array(begin - lo), pa.array(around, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["k", "shingle", "row", "at", "before", "around"])

    return run


def _same_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places joined with windows (words, shift), those where the whole window stands: row, start, length, items."""
    for batch in batches:
        first = batch.column("before").to_numpy() - batch.column("shift").to_numpy()
        length = np.diff(batch.column("words").offsets.to_numpy())
        room = np.diff(batch.column("around").offsets.to_numpy())
        ok = (first >= 0) & (first + length <= room)
        words, around = batch.column("words"), batch.column("around")
        for i in np.flatnonzero(ok):
            ok[i] = np.array_equal(around[i].values.to_numpy()[first[i] : first[i] + length[i]], words[i].values.to_numpy())
        start = batch.column("at").to_numpy() - batch.column("shift").to_numpy()
        found = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), batch.column("items")], names=["row", "start", "length", "items"])
        yield found.filter(pa.array(ok))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to windows (number, words) a row for each shingle: number, k, shift, shingle."""
    for batch in batches:
        rows = [(n, min(SHINGLE, len(x)), i, h) for n, x in zip(batch.column("number").to_pylist(), batch.column("words"), strict=True) for i, h in enumerate(_window_shingles(x.values.to_numpy()).view(np.int64).tolist())]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["number", "k", "shift", "shingle"])


def _joined(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """``occurrences`` for windows (number, words, items) of any number: nothing that follows their number is broadcast."""
    spark = docs.sparkSession
    names = docs.columns
    rows = staged(docs.select(F.struct("*").alias("of"), "text").withColumn("row", F.monotonically_increasing_id()))
    each = staged(windows.select("number", "words").mapInArrow(_window_rows, "number bigint, k int, shift int, shingle bigint"))
    shared = spark.sparkContext.broadcast(_bitmap(each))
    counts = rows.select("row", "text").mapInArrow(_sent(shared, True, size), "k int, shingle bigint, n bigint").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
    rarest = each.join(counts, ["k", "shingle"], "left").groupBy("number").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "shift", "k")).alias("r"))
    # a window whose rarest shingle is in no document is in none
    keyed = staged(windows.join(rarest.where("r.n > 0"), "number").select(F.col("r.k").alias("k"), F.col("r.shingle").alias("shingle"), F.col("r.shift").alias("shift"), "words", "items"))
    shared = spark.sparkContext.broadcast(_bitmap(keyed))
    places = rows.select("row", "text").mapInArrow(_sent(shared, False, size), "k int, shingle bigint, row bigint, at bigint, before bigint, around array<bigint>")
    hits = places.join(keyed, ["k", "shingle"]).select("row", "at", "before", "around", "shift", "words", "items").mapInArrow(_same_words, "row bigint, start int, length int, items array<string>")
    hit = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "items"))).alias("h"))
    found = rows.join(hit, "row", "left").select(*rows.columns, "h").mapInArrow(_counted, T.StructType([*rows.schema.fields, T.StructField("h", hit.schema["h"].dataType), T.StructField("n_words", T.LongType())]))
    h = F.coalesce("h", F.array())
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(h, lambda x: x["items"]))))
    return found.select(*(F.col(f"of.`{n}`").alias(n) for n in names), "n_words", F.transform(h, lambda x: x["start"]).alias("starts"), F.transform(h, lambda x: x["length"]).alias("lengths"), items.alias("items"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words."""
    for batch in batches:
        n = [w.Words(data, offsets, w.ALNUM, lower=True).counts for _, _, data, offsets in w.texts(batch.column("text"))]
        yield batch.append_column("n_words", pa.array(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64)))


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = 13, block: int = BLOCK) -> DataFrame:
    """docs' rows with n_words, and the windows that occur in them: starts and lengths (in words), items.

    An existing column of one of these names is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    windows = benchmark.select("item_id", "text").mapInArrow(_item_windows(size), "item_id string, words array<bigint>")
    windows = staged(windows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("number", F.monotonically_increasing_id()))
    docs = docs.drop("n_words", "starts", "lengths", "items")
    names, n = docs.columns, windows.count()
    if n > block:
        return _joined(docs, windows, size)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType())])
    schema = schema.add("starts", T.ArrayType(T.IntegerType())).add("lengths", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))
    if not n:
        return docs.mapInArrow(_search(None, names), schema)
    held = [(np.array(r["words"], dtype=np.int64), r["items"]) for r in windows.collect()]  # ``block`` windows at most
    wanted = np.unique(np.concatenate([_window_shingles(x) for x, _ in held]))
    return docs.mapInArrow(_search(spark.sparkContext.broadcast(Index(held, wanted, _count(docs, wanted))), names), schema)


def digest(found: DataFrame, percent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit at least ``percent`` of the words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, items, digests = [], [], []
            n_words = batch.column("n_words").to_numpy()
            for n, s, m, x in zip(n_words, batch.column("starts"), batch.column("lengths"), batch.column("items"), strict=True):
                s = s.values.to_numpy() if len(s) else []
                hit.append(int(w.covered(int(n), s, m.values.to_numpy()).sum()) if len(s) else 0)
                x = sorted(set(x.as_py()))
                items.append(len(x))
                digests.append(hashlib.sha256(",".join(x).encode()).hexdigest())
            h = np.array(hit, dtype=np.int64)
            bad = (h > 0) & (100 * h >= percent * n_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(h), pa.array(items, pa.int64()), pa.array(digests, pa.string()), pa.array(bad)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "starts", "lengths", "items").mapInArrow(run, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, percent: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that are not contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for n, s, m in zip(batch.column("n_words").to_pylist(), batch.column("starts"), batch.column("lengths"), strict=True):
                hit = int(w.covered(n, s.values.to_numpy(), m.values.to_numpy()).sum()) if len(s) else 0
                bad.append(hit > 0 and 100 * hit >= percent * n)
            if bad:
                yield batch.select(["row"]).filter(pa.array([not x for x in bad]))

    rows = docs.select(F.struct("*").alias("row"), "text")
    found = occurrences(rows, benchmark, size).select("row", "n_words", "starts", "lengths")
    return found.mapInArrow(run, T.StructType([f for f in rows.schema.fields if f.name == "row"])).select("row.*")
