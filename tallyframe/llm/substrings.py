"""Substring dedup (operator 5): a count-min prefilter, then exact grouping of what may repeat.

Texts become blocks of about ``BLOCK_BYTES``: the block's distinct words, and its texts as their numbers. Pass 1
sketches window counts: each block has a sketch of its windows, cells of a hash of each window's words with how many
windows fell into them, of which only non-empty cells are held and sent. The sketches are merged by adding cells up, each
range of cells in a shard of its own, so that the sketch has as many cells as the corpus needs (a thousand for each
window) and is in no one place. A cell's sum is never less than the count of a window in it, so no repeated window is lost.
Each block gets back which of its cells hold two or more. Pass 2 groups the windows of these cells exactly (80
hash bits; a block sends one row for each of its distinct windows, and marks what repeats inside it by itself). Marks
go back to their blocks as places.

Edge cases: null or empty text has no words and keeps an empty digest; rows that occur twice are
repeats of each other; texts shorter than a window lose nothing; rows are told apart by their places, so
null and equal ids are of no matter; a text of any length is in one block, and takes some 14 times its size; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as k
from . import words as w
from .scratch import small_batches, staged, sweep

#: Bytes of text in a block, and cells asked for in a shard.
BLOCK_BYTES, SHARD_KEYS = 8 << 20, 1 << 21
#: Cells for each window, as a power of 2.
ROOM = 10
_Q2 = 0xA0761D6478BD642F
#: Bits of a window's second hash, and of a word's number in its block (a string of 2 GB has no more words).
_MORE, _POS = 16, 30
_NOWHERE = (1 << _POS) - 1

_BLOCK = "block bigint, doc_id array<bigint>, n_words array<bigint>, n_vocab bigint, vocab binary, lengths binary, stream binary, windows bigint"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _encode(size: int, block_bytes: int):
    """Rows (doc_id, text) as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, hashes, words, size_now, made = [], [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            n = np.concatenate(counts)
            vocab, stream, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # commonest first
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            # the bytes of each word, from a chunk that has it
            known, lengths = (np.concatenate([x[i] for x in words]) for i in (0, 1))
            ends = np.cumsum(lengths)
            _, at = np.unique(known, return_index=True)
            at = at[order]
            data = k.gathered(np.concatenate([x[2] for x in words]), (ends - lengths)[at], lengths[at])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            cols = [
                pa.array([part << 32 | made]), one(pa.concat_arrays(ids)), one(pa.array(n, pa.int64())), pa.array([len(vocab)]), pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary()),
                pa.array([k.pack(lengths[at])], pa.binary()), pa.array([k.pack(number[stream])], pa.binary()), pa.array([int(np.maximum(n - size + 1, 0).sum())]),
            ]
            return pa.RecordBatch.from_arrays(cols, names=_names(_BLOCK))

        for batch in batches:
            for a, b, data, offsets in w.texts(batch.column("text")):
                t = w.Words(data, offsets, w.SPACED, lower=False)
                h = t.hashes()
                distinct, at = np.unique(h, return_index=True)
                length = t.ends[at] - t.starts[at]
                ids.append(batch.column("doc_id").slice(a, b - a))
                counts.append(t.counts.astype(np.int64))
                hashes.append(h)
                words.append((distinct, length, k.gathered(t.data, t.starts[at], length)))
                size_now += len(data) + 64 * (b - a)
                if size_now >= block_bytes:
                    yield block()
                    ids, counts, hashes, words, size_now, made = [], [], [], [], 0, made + 1
        if ids:
            yield block()
        w.give_back()

    return run


class Block:
    """A block's texts as numbers of words. counts, first: of the texts, as in ``Words``."""

    def __init__(self, row: dict):
        self.doc_id, self.counts = row["doc_id"], np.array(row["n_words"], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        lengths = k.unpack(row["lengths"], row["n_vocab"]).astype(np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(pa.decompress(row["vocab"], decompressed_size=int(lengths.sum()), codec="zstd", asbytes=True), dtype=np.uint8)
        self.stream = k.unpack(row["stream"], int(self.first[-1])).astype(np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, hashes and second hashes of all windows."""
        hashes = w.ranges(self.data, self.starts, self.ends, w._R)[self.stream]
        room = np.maximum(self.counts - size + 1, 0)
        begin = np.repeat(self.first[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
        one, two = (w.ranges(hashes, begin, begin + size, base) for base in (w._Q, _Q2))
        return begin, one, two & w.U((1 << _MORE) - 1)

    def words(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


_ASKED = "shard int, block bigint, n bigint, cells binary, counts binary"
_ANSWER = "block bigint, shard int, n bigint, repeated binary"


def _ask(size: int, bits: int, shard_bits: int):
    """The sketches: each block's cells and their counts (1, or 2 for more), to the shard of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells, n = np.unique(Block(row).windows(size)[1] >> w.U(64 - bits), return_counts=True)
                rows = [(s, row["block"], *x) for s, x in enumerate(k.dealt(cells, np.minimum(n, 2), bits, shard_bits)) if x[0]]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=_names(_ASKED))
        w.give_back()

    return run


def _merge(asked: pa.Table) -> pa.Table:
    """Adds up one shard's cells; of each block's, which hold two windows or more, as bits."""
    n = asked.column("n").to_pylist()
    _, place = np.unique(np.concatenate([k.sums(x, m) for x, m in zip(asked.column("cells").to_pylist(), n, strict=True)]), return_inverse=True)
    own = np.concatenate([k.unpack(x, m) for x, m in zip(asked.column("counts").to_pylist(), n, strict=True)])
    more = (np.bincount(place, weights=own) > 1)[place]
    cut = np.concatenate([[0], np.cumsum(n)]).tolist()
    bits = [np.packbits(more[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    w.give_back()
    return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "n": asked.column("n"), "repeated": pa.array(bits, pa.binary())})


_FOUND = "w1 bigint, packed bigint, block bigint"


def _candidates(size: int, bits: int):
    """Windows whose cells hold two or more. packed: mark bit, the window's second hash, place in the block.

    Without the mark, a window (w1 and the second hash) to be grouped; at no place if this block has marked
    it. With the mark, w1 windows from the place on that repeat inside the block."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        told = sorted(answers.to_pylist(), key=lambda r: r["shard"])
        for row in blocks.to_pylist():
            t = Block(row)
            begin, w1, w2 = t.windows(size)
            cells, place = np.unique(w1 >> w.U(64 - bits), return_inverse=True)
            more = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool) for r in told)])
            some = np.flatnonzero(more[place]) if len(cells) else np.zeros(0, np.int64)
            begin, w1, w2 = begin[some], w1[some], w2[some].astype(np.int64)
            more, later = w.repeated(w1 ^ w.mix(w2.astype(w.U)))
            # runs of marked windows, each in one text
            m = np.flatnonzero(more)
            doc = np.searchsorted(t.first, begin[m], side="right")
            head = np.ones(len(m), bool)
            head[1:] = (begin[m[1:]] != begin[m[:-1]] + 1) | (doc[1:] != doc[:-1])
            run_at, one = m[head], np.flatnonzero(~later)
            n = np.diff(np.append(np.flatnonzero(head), len(m)))
            first = np.concatenate([n, w1[one].view(np.int64)])
            high = np.concatenate([np.full(len(n), 1 << _MORE), w2[one]])
            where = np.concatenate([begin[run_at], np.where(more[one], _NOWHERE, begin[one])])
            parts.append(pa.table({"w1": pa.array(first, pa.int64()), "packed": pa.array(high << _POS | where, pa.int64()), "block": pa.array(np.full(len(first), row["block"]), pa.int64())}))
        w.give_back()
        return pa.concat_tables(parts)

    return run


def _removed(size: int, with_text: bool):
    def run(blocks: pa.Table, spans: pa.Table) -> pa.Table:
        places, n = spans.column("place").to_numpy(), spans.column("run").to_numpy()
        ids, total, gone, digests, kept = [], [], [], [], []
        for row in blocks.to_pylist():
            t = Block(row)
            cover = w.covered(len(t.stream), places, n + size - 1)
            words, stays = t.words(), np.flatnonzero(~cover)
            cut = np.searchsorted(stays, t.first)
            stays = t.stream[stays]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                rest = b" ".join([words[i] for i in stays[a:b].tolist()])
                digests.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode())
            ids += t.doc_id
            total += t.counts.tolist()
            gone += w.per_doc(cover, t.first).tolist()
        w.give_back()
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    return run


def dedup(docs: DataFrame, size: int = 35, with_text: bool = False, block_bytes: int = BLOCK_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text); ``with_text`` adds what is kept."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = staged(docs.mapInArrow(_encode(size, block_bytes), _BLOCK))
    windows = blocks.agg(F.sum("windows")).first()[0] or 0
    bits = min(64, max(24, windows.bit_length() + ROOM))
    asked = blocks.mapInArrow(_ask(size, bits, k.shard_bits(windows, shard_keys)), _ASKED)
    answers = staged(asked.groupBy("shard").applyInArrow(_merge, _ANSWER))
    del asked
    sweep(spark)
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_candidates(size, bits), _FOUND)
    high = F.shiftright("packed", _POS)
    grouped = found.withColumn("in_all", F.count("*").over(Window.partitionBy("w1", high)))
    marked, place = high >= 1 << _MORE, F.col("packed").bitwiseAND(_NOWHERE)
    grouped = grouped.where(marked | ((F.col("in_all") > 1) & (place != _NOWHERE)))
    spans = staged(grouped.select("block", place.alias("place"), F.when(marked, F.col("w1")).otherwise(F.lit(1).cast("bigint")).alias("run")))
    del found, grouped
    sweep(spark)
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_removed(size, with_text), schema)
