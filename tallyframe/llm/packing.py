"""Best-fit packing (operator 10) planned on the histogram of lengths.

Documents become token ids with one id 0 after each; longer ones than ``size`` are cut into pieces
of ``size``. The number of pieces of each length (at most ``size`` numbers) goes to the driver,
which packs *counts*: lengths in falling order, each into the sequences with the least room that
still fits it, whole runs of equal sequences at a time. The plan's rows say which ranks within a
length go to which run of sequences; their number follows ``size``, not the number of documents.
Pieces get a rank within their length (counted in salted buckets, so that no length is one task)
and take their slots by a join on length and rank.

Edge cases: a null or empty text is one piece, the id 0; equal rows are separate pieces; an empty
table gives an empty plan and no rows; a text of any length is tokenized whole, and takes some 12 times its
size. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as w
from .scratch import int_conf, small_batches, staged
from .wordbpe import encoder

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Token pieces of all rows; ``with_ids`` adds the ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for a, b, data, offsets in w.texts(batch.column("text")):
                ids, bounds = bpe.encode(data, offsets)
                ids = ids.astype("<u4")
                length = np.diff(bounds)
                count = -(-length // size)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                n = np.minimum(length[row] - start, size)
                at = bounds[row] + start
                crc = [zlib.crc32(ids[i : i + k]) for i, k in zip(at.tolist(), n.tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[i : i + k].astype(np.int32) for i, k in zip(at, n, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts. Rows: length, first rank, end rank, first sequence, pieces to a sequence, offset."""
    room: dict[int, list[list[int]]] = {}  # free tokens -> runs of sequences (first, count)
    free = np.zeros(size + 1, bool)
    rows, opened = [], 0

    def add(left: int, first: int, count: int) -> None:
        if left and count:
            room.setdefault(left, []).append([first, count])
            free[left] = True

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            fit = np.flatnonzero(free[length:])[:1]
            left = int(fit[0]) + length if len(fit) else size
            each = left // length
            if not len(fit):
                count = -(-todo // each)
                run, opened = [opened, count], opened + count
            else:
                run = room[left].pop()
                free[left] = bool(room[left])
            first, count = run
            full = min(count, todo // each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, size - left))
                add(left - each * length, first, full)
                rank, todo, first, count = rank + full * each, todo - full * each, first + full, count - full
            if todo and count and todo < each:
                rows.append((length, rank, rank + todo, first, todo, size - left))
                add(left - todo * length, first, 1)
                rank, todo, first, count = rank + todo, 0, first + 1, count - 1
            add(left, first, count) if left < size else None
    return rows


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """``cut``: pieces with doc_id, piece, length and any evenly spread ``turn`` (written: it is read three times). Adds sequence_id and offset, without turn."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    slots = spark.createDataFrame(plan(histogram, size), "slot_length bigint, from_rank bigint, to_rank bigint, first_sequence bigint, each bigint, first_offset bigint")
    salts = max(32, min(1024, int_conf(spark, "spark.sql.shuffle.partitions", 200)))
    # not of what the piece is: however many equal ones there are, they are dealt out
    salted = cut.withColumn("salt", F.pmod("turn", F.lit(salts)).cast("int"))
    out = [c for c in cut.columns if c != "turn"]
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))
    at = F.col("rank") - F.col("from_rank")
    placed = ranked.join(
        F.broadcast(slots),  # its rows follow size, not the documents
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")),
    )
    return placed.select(
        *out, (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer, size).withColumn("turn", F.monotonically_increasing_id())), size)
