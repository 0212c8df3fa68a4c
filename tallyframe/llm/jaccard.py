"""N-gram Jaccard join (operator 2) on a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets are one
node. Similar documents are partitioned into groups (equal least shingle by hash, equal size class), and each
group's union of prefix tokens is stored as rows (token, group): the sparse token-group matrix. Two
sets that link share at least L tokens among the first n - ceil(t * n) + L of each in one fixed
order, so groups whose stored unions share fewer cannot hold a link; that bound, and the sizes,
choose the pairs of groups. In a pair, each query set is bounded again by its overlap with the whole
union of the other group's block, and only blocks that reach the needed overlap are opened: all
their members' overlaps with the query come from one inverted lookup. A block emits a spanning
forest of its links, not all of them. Where blocks face many others, each block is opened by itself and
against its group's first one before: a family of near copies is one component by then, and blocks whose sets are all of one
component are not compared. Tokens of more than ``HELD`` groups are dealt into places where blocks of groups face each other.

The order puts tokens that many documents hold last (those in at least one of four thousand documents,
counted over all documents; a table of at most 4000 * mean set size, so it may be broadcast) and is
by hash otherwise; any fixed order gives the same result. Groups of any size are handled in blocks of
at most ``BLOCK_SETS`` sets or ``BLOCK_TOKENS`` tokens (or one larger set).

Edge cases: null or empty texts have no set and link with nothing (not even with each other); rows
that occur twice are one node; a null id takes part, but is never a component's name unless all its
members are null; a text of any length is handled whole, and takes some 17 times its size; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .components import components
from .scratch import small_batches, staged

BLOCK_SETS, BLOCK_TOKENS = 64, 1 << 16
#: Rows that go are broadcast up to this number, and shuffled with the documents beyond it.
BROADCAST_ROWS = 200_000
#: Sizes of a class are within this factor; a group's number has its class above its hash.
CLASS, _HASH = 1.25, 56
#: A token in one of so many documents (and in 64 at least) is ordered last.
COMMON = 4000
#: Blocks that a block has to face on the average, from which on families are looked for first.
CROWDED = 8
#: Groups with a token that face each other in one place.
HELD = 1024
#: Tokens a partition counts at a time before it forgets the rarest.
COUNTED = 1 << 20


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Runs of rows: first row, and each row's sorted distinct shingle hashes."""
    for a, b, data, offsets in w.texts(batch.column("text")):
        t = w.Words(data, offsets, w.SPACED, lower=True)
        hashes = t.hashes()
        begin, shingles = t.windows(hashes, k)
        cut = np.searchsorted(begin, t.first)
        out = []
        for i, n in enumerate(t.counts.tolist()):
            if 0 < n < k:
                out.append(w.ranges(hashes[t.first[i] : t.first[i + 1]], np.array([0]), np.array([n]), w._Q))
            else:
                out.append(np.unique(shingles[cut[i] : cut[i + 1]]))
        yield a, out


def _common(docs: DataFrame, k: int, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that many documents hold, sorted, and (lower bounds of) how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, w.U), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate([tokens, *held])
            n = np.concatenate([counts, np.ones(len(both) - len(tokens), np.int64)])
            order = np.argsort(both, kind="stable")
            both, n = both[order], n[order]
            head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            both, n = both[head], np.add.reduceat(n, head) if len(head) else n
            least = 1
            while len(both) > COUNTED:
                both, n = both[n > least], n[n > least]
                least *= 2
            return both, n

        for batch in batches:
            for _, sets in _sets(batch, k):
                held += sets
            if sum(map(len, held)) >= COUNTED:
                tokens, counts = merged()
                held = []
        tokens, counts = merged()
        tokens, counts = tokens[counts > 2], counts[counts > 2]
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    total = docs.count()
    least = max(64, total // share)
    rows = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    tokens = rows["token"].to_numpy().astype(np.int64).view(w.U)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy().astype(np.int64)[order]


def _fingerprint(m: np.ndarray) -> int:
    """Of a set's mixed hashes, in any order."""
    return int((m.sum() ^ (w.mix(m ^ w.U(0x51ED270B)).sum() << w.U(1))).view(np.int64))


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _level(n: int) -> int:
    """How many common prefix tokens a link of a set of n must have."""
    return 1 + n // 20


def _signatures(shared, k: int, percent: int):
    """doc_id, h, n, f (the set's fingerprint), family (least token by hash alone, so that near copies share it), prefix (once for each set of a partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for a, sets in _sets(batch, k):
                n, prints, family, prefix = [], [], [], []
                for s in sets:
                    n.append(len(s))
                    if not len(s):
                        prints.append(None)
                        family.append(None)
                        prefix.append(None)
                        continue
                    m = w.mix(s)
                    one = _fingerprint(m)
                    prints.append(one)
                    at = np.searchsorted(common, s) if len(common) else np.zeros(len(s), np.int64)
                    at[at == len(common)] = 0
                    often = np.where(common[at] == s, counts[at], 0) if len(common) else at
                    order = np.lexsort((m, often))
                    family.append(int(m.min().view(np.int64)))
                    if one in seen:
                        prefix.append(None)
                        continue
                    seen.add(one)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    prefix.append(s[order[: len(s) - _needed(len(s), percent) + _level(len(s))]].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(sets)), batch.column("h").slice(a, len(sets)), pa.array(n, pa.int64()), pa.array(prints, pa.int64()), pa.array(family, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                    names=["doc_id", "h", "n", "f", "family", "prefix"],
                )

    return run


def _apart(percent: int) -> int:
    """By how many size classes two sets that link can be apart."""
    return math.ceil(math.log(100 / percent) / math.log(CLASS) - 1e-9)


def _shared_tokens(apart: int):
    """From rows (token, g) sorted by both: one row (ga, gb) for every token that both hold, if their size classes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs_of_runs(batches, apart)

    return run


def _shared_of_many(matrix: DataFrame, apart: int) -> DataFrame:
    """The same for tokens of more than HELD groups: the groups are dealt into blocks, and each two blocks face each other in a place of their own."""
    dealt = matrix.withColumn("blocks", F.ceil(F.col("held") / HELD).cast("int")).withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    met = dealt.select("token", "g", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "g")
    a, b = (met.select("token", "low", "high", F.col("block").alias(f"block_{s}"), F.col("g").alias(f"g{s}")) for s in "ab")
    here = (F.col("ga") < F.col("gb")) & (F.least("block_a", "block_b") == F.col("low")) & (F.greatest("block_a", "block_b") == F.col("high"))
    near = F.shiftright("gb", _HASH) - F.shiftright("ga", _HASH) <= apart
    return a.join(b, ["token", "low", "high"]).where(here & near).select("ga", "gb")


def _pairs_of_runs(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    left_t, left_g = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(token: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(token)))
        for n in np.unique(size[size > 1]).tolist():
            runs = g[head[size == n][:, None] + np.arange(n)]
            for i in range(n - 1):  # the i-th of each run with all after it
                step = max(1, (1 << 20) // n)
                for c in range(0, len(runs), step):
                    b = runs[c : c + step, i + 1 :]
                    a = np.broadcast_to(runs[c : c + step, i : i + 1], b.shape)
                    near = (b >> _HASH) - (a >> _HASH) <= apart  # g is sorted, and so are the classes
                    if near.any():
                        yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["ga", "gb"])

    for batch in batches:
        token = np.concatenate([left_t, batch.column("token").to_numpy()])
        g = np.concatenate([left_g, batch.column("g").to_numpy()])
        if not len(token):
            continue
        cut = int(np.searchsorted(token, token[-1]))  # the last token may go on in the next batch
        left_t, left_g = token[cut:], g[cut:]
        yield from pairs(token[:cut], g[:cut])
    yield from pairs(left_t, left_g)


def _open(percent: int):
    """Of rows (own, left, right): lists of (f, tokens); own: both are one block. A spanning forest of the links."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges_a, edges_b = [], []
            for own, left, right in zip(batch.column("own").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                fa, ta, ca = _members(left)
                fb, tb, cb = _members(right)
                order = np.argsort(tb, kind="stable")
                sorted_b, owner = tb[order], np.repeat(np.arange(len(fb)), np.diff(cb))[order]
                size_b, root = np.diff(cb), {}

                def find(x, root=root):
                    while (y := root.get(x, x)) != x:
                        x = y
                    return x

                for i, f in enumerate(fa.tolist()):
                    q = ta[ca[i] : ca[i + 1]]
                    lo, hi = np.searchsorted(sorted_b, q, "left"), np.searchsorted(sorted_b, q, "right")
                    n = hi - lo
                    if np.count_nonzero(n) < _needed(len(q), percent):  # the union's bound: no member can link
                        continue
                    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(fb))
                    for j in np.flatnonzero(100 * both >= percent * (len(q) + size_b - both)).tolist():
                        g = int(fb[j])
                        if (own and j <= i) or f == g:
                            continue
                        x, y = find(f), find(g)
                        if x != y:
                            root[x] = y
                            edges_a.append(f)
                            edges_b.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(edges_a, pa.int64()), pa.array(edges_b, pa.int64())], names=["a", "b"])

    return links


def _members(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, all tokens, and each member's bounds among them."""
    rows = cell.values
    tokens = rows.field("tokens")
    bounds = tokens.offsets.to_numpy().astype(np.int64)
    return rows.field("f").to_numpy(), tokens.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, sets in _sets(batch, k):
                part = batch.slice(a, len(sets))
                new = np.ones(len(sets), bool)
                for i, (f, s) in enumerate(zip(part.column("f").to_pylist(), sets, strict=True)):
                    new[i] = f not in seen
                    seen.add(f)
                part = pa.RecordBatch.from_arrays([part.column("f"), part.column("g"), part.column("block"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["f", "g", "block", "tokens"])
                yield part.filter(pa.array(new))

    return run


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links: 100 * intersection >= percent * union."""
    return grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without those of a component that has an earlier id (or text hash).

    Rows without words stay. Of rows equal in id and text one stays."""
    found = grouped(docs, k, percent).where("n_shingles > 0").groupBy("root", "doc_id", "h").agg(F.count("*").alias("copies"))
    order = F.struct(F.isnull("doc_id"), "doc_id", "h")
    firsts = found.groupBy("root").agg(F.min(order).alias("first"))
    told = staged(found.join(firsts, "root").select("doc_id", "h", "copies", order.eqNullSafe(F.col("first")).alias("stays")))
    go, several = told.where("not stays"), told.where("stays and copies > 1")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("h"), F.col("doc_id").cast("bigint").alias("id"))
    out, again = go.unionByName(several).select("doc_id", F.col("h").alias("of")), several.select("doc_id", F.col("h").alias("of"))
    if out.count() <= BROADCAST_ROWS:
        out, again = F.broadcast(out), F.broadcast(again)
    same = lambda x: F.col("id").eqNullSafe(x["doc_id"]) & (rows["h"] == x["of"])
    # rows without words are in neither
    once = rows.join(out, same(out), "left_anti")
    return once.unionByName(rows.join(again, same(again), "left_semi").dropDuplicates(["id", "h"])).select("row.*")


def _crowded(pairs: DataFrame, left: DataFrame, right: DataFrame, open_: DataFrame, links) -> DataFrame:
    """Components where groups have many blocks.

    First each block by itself, and the first block of each group against its others: a family of near copies is one
    component by then, however large, and blocks whose sets are all of one component need not face each other."""
    firsts = right.where("block_b = 0")
    edges = links(left.join(firsts, F.col("ga") == F.col("gb"))).unionAll(links(left.where("block_a > 0").join(right, (F.col("ga") == F.col("gb")) & (F.col("block_a") == F.col("block_b")))))
    edges = staged(edges)
    roots = components(edges)
    rooted = open_.select("g", "block", "f").join(roots, F.col("f") == F.col("node"), "left").groupBy("g", "block").agg(F.min(F.coalesce("root", "f")).alias("low"), F.max(F.coalesce("root", "f")).alias("high"))
    rooted = staged(rooted)
    whole = rooted.groupBy("g").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("blocks"))
    wa, wb = (whole.select(*(F.col(c).alias(f"{c}_{s}") for c in whole.columns)) for s in "ab")
    open_pairs = pairs.join(wa, F.col("ga") == F.col("g_a")).join(wb, F.col("gb") == F.col("g_b"))
    open_pairs = staged(open_pairs.where("not (low_a = high_a and low_b = high_b and low_a = low_b)").select("ga", "gb"))
    la, rb = (x.join(rooted.select(F.col("g").alias(f"g{s}"), F.col("block").alias(f"block_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")), [f"g{s}", f"block_{s}"]) for x, s in ((left, "a"), (right, "b")))
    facing = open_pairs.join(la, "ga").join(rb, "gb").where("(ga <> gb or 0 < block_a and block_a < block_b) and not (low_a = high_a and low_b = high_b and low_a = low_b)")
    return components(edges.unionAll(links(facing)))


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, h (the text's hash), n_shingles, root (names the component) and component_id of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    shared = spark.sparkContext.broadcast(_common(docs, k, COMMON))
    signed = staged(docs.mapInArrow(_signatures(shared, k, percent), "doc_id bigint, h bigint, n bigint, f bigint, family bigint, prefix array<bigint>"))
    size_class = F.floor(F.log("n") / math.log(CLASS))
    signed = signed.withColumn("g", F.when(F.col("n") > 0, F.shiftleft(size_class, _HASH).bitwiseOR(F.shiftrightunsigned(F.xxhash64("family"), 64 - _HASH))))
    nodes = signed.where("n > 0").groupBy("f").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "h")).alias("of"), F.first("n").alias("n"), F.first("g").alias("g"))
    nodes = staged(nodes.select("f", F.col("of.doc_id").alias("least"), "of.h", "n", "g"))
    groups = nodes.groupBy("g").agg(F.count("*").alias("sets"), F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = staged(signed.where("prefix is not null").select(F.explode("prefix").alias("token"), "g").distinct())
    apart = _apart(percent)
    often = matrix.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > HELD)
    # tokens of HELD groups are at most a share of 1 / HELD of the matrix's rows
    often = staged(often)
    few = matrix.join(often.select("token"), "token", "left_anti") if not often.isEmpty() else matrix
    found = few.repartition("token").sortWithinPartitions("token", "g").mapInArrow(_shared_tokens(apart), "ga bigint, gb bigint")
    if few is not matrix:
        found = found.unionByName(_shared_of_many(matrix.join(often, "token"), apart))
    shared_by = found.groupBy("ga", "gb").agg(F.count("*").alias("tokens"))
    # the least set of the smaller class says how many tokens the unions must share; ga has the smaller class
    smallest = F.floor(F.pow(F.lit(CLASS), F.shiftright("ga", _HASH)) - 1e-6)
    bounded = shared_by.where(F.col("tokens") >= F.floor(smallest / 20) + 1)
    ga, gb = (groups.select(*(F.col(c).alias(f"{c}_{s}") for c in groups.columns)) for s in "ab")
    fits = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    pairs = bounded.join(ga, F.col("ga") == F.col("g_a")).join(gb, F.col("gb") == F.col("g_b")).where(fits).select("ga", "gb")
    pairs = staged(pairs.unionByName(groups.where("sets > 1").select(F.col("g").alias("ga"), F.col("g").alias("gb"))))

    active = pairs.select(F.explode(F.array("ga", "gb")).alias("g")).distinct()
    in_block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_TOKENS) / F.col("high"))))
    open_ = nodes.join(groups.select("g", "sets", "high").join(active, "g"), "g").withColumn("block", F.pmod(F.xxhash64("f"), F.ceil(F.col("sets") / in_block)))
    # one document for each set; the set itself is read off its text again
    of = open_.select("least", F.col("h").alias("of_h"), "f", "g", "block")
    chosen = docs.join(of, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("h") == F.col("of_h")))
    sets = chosen.select("text", "f", "g", "block").mapInArrow(_tokens(k), "f bigint, g bigint, block bigint, tokens array<bigint>")
    blocks = staged(sets.groupBy("g", "block").agg(F.collect_list(F.struct("f", "tokens")).alias("members")))
    left = blocks.select(F.col("g").alias("ga"), F.col("block").alias("block_a"), F.col("members").alias("left"))
    right = blocks.select(F.col("g").alias("gb"), F.col("block").alias("block_b"), F.col("members").alias("right"))
    own = F.expr("ga = gb and block_a = block_b").alias("own")

    def links(facing: DataFrame) -> DataFrame:
        return facing.select(own, "left", "right").mapInArrow(_open(percent), "a bigint, b bigint")

    sides = blocks.groupBy("g").agg(F.count("*").alias("blocks"))
    sa, sb = (sides.select(F.col("g").alias(f"g{s}"), F.col("blocks").alias(f"blocks_{s}")) for s in "ab")
    sums = pairs.join(sa, "ga").join(sb, "gb").agg(F.sum(F.col("blocks_a") * F.col("blocks_b")).alias("faces"), F.sum(F.greatest("blocks_a", "blocks_b")).alias("blocks")).first()
    if (sums["faces"] or 0) <= CROWDED * (sums["blocks"] or 0):
        roots = components(links(pairs.join(left, "ga").join(right, "gb").where("ga <> gb or block_a <= block_b")))
    else:
        roots = _crowded(pairs, left, right, open_, links)

    named = nodes.join(roots, nodes["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(names, "root").select("f", "root", "component_id")
    return signed.join(linked, "f", "left").select("doc_id", "h", "root", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
