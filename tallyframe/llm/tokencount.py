"""Token counts (operator 9) that follow edits.

A document is kept, in a table of trees, as its text, the lengths and token counts of its pre-tokens, and their leaves, over
which stands a segment tree of (characters, tokens) sums. Edits come later, to the kept trees: only the
leaves that they touch are opened. Pre-tokens are found left to right without memory, each looking at most two characters past its
end. So after an edit, counting starts anew at the first pre-token that could see the edit, and
stops where a new pre-token ends at an old boundary behind it; leaves that were touched, and the sums above
them, are updated, and nothing else is tokenized again.

Edge cases: a null or empty text has no tokens, and edits of it insert only; a null list of edits is
none; an edit that reaches past the end is cut there, one with null fields changes nothing; edits apply in the
order given, each to the text as the ones before left it; rows that occur twice are counted twice;
a text of any length is one tree, and takes some 14 times its size. Other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches, staged

#: Pre-tokens in a leaf when built, and from how many on the leaves are dealt anew.
LEAF, FULL = 64, 256
#: How far past its end a pre-token's match can depend on the text.
SIGHT = 2
#: Pre-tokens remembered by a process.
REMEMBER = 500_000


class Counter(dict):
    """Tokens of a pre-token, worked out once."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.encoding._core_bpe.encode_single_piece

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = self[token] = len(self.piece(token.encode()))
        return n


class Leaf:
    """A run of pre-tokens. Until an edit touches it, it is a range of its document's kept arrays and text."""

    __slots__ = ("parts", "counts", "first", "last", "begin", "chars", "tokens")

    def __init__(self, parts: list[str] | None, counts: list[int] | None, first: int, last: int, begin: int, chars: int, tokens: int):
        self.parts, self.counts, self.first, self.last, self.begin, self.chars, self.tokens = parts, counts, first, last, begin, chars, tokens

    @classmethod
    def of(cls, parts: list[str], counts: list[int]) -> Leaf:
        return cls(parts, counts, 0, 0, 0, sum(map(len, parts)), sum(counts))


class TokenTree:
    """One document. ``encoded``: the number of pre-tokens that were tokenized since it was made or read.

    text, lens, counts: of all pre-tokens as kept; sizes: of the leaves, in pre-tokens."""

    def __init__(self, text: str, lens: np.ndarray, counts: np.ndarray, sizes: np.ndarray, counter: Counter):
        self.counter, self.kept, self.lens, self.counts, self.encoded = counter, text, lens, counts, 0
        ends = np.cumsum(sizes)
        chars, tokens = (np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]).tolist() for x in (lens, counts))
        begins = np.concatenate([[0], np.cumsum(chars)]).tolist()
        self.leaves = [Leaf(None, None, e - n, e, x, c, t) for e, n, x, c, t in zip(ends.tolist(), sizes.tolist(), begins, chars, tokens, strict=False)]
        self._grow()

    @classmethod
    def build(cls, text: str, counter: Counter) -> TokenTree:
        """Tokenizes a whole text."""
        found = counter.pattern.findall(text)
        n = len(found)
        lens, counts = np.fromiter(map(len, found), np.int64, n), np.fromiter(map(counter.__getitem__, found), np.int64, n)
        tree = cls(text, lens, counts, np.full(-(-n // LEAF), LEAF) if n % LEAF == 0 else np.append(np.full(n // LEAF, LEAF), n % LEAF), counter)
        tree.encoded = n
        return tree

    def rows(self) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """What is to be kept: text, lens, counts, sizes. Untouched leaves are copied as they are."""
        lens, counts, sizes = [], [], []
        for leaf in self.leaves:
            if leaf.parts is None:
                lens.append(self.lens[leaf.first : leaf.last])
                counts.append(self.counts[leaf.first : leaf.last])
            else:
                lens.append(np.fromiter(map(len, leaf.parts), np.int64, len(leaf.parts)))
                counts.append(np.array(leaf.counts, dtype=np.int64))
            sizes.append(len(lens[-1]))
        none = np.zeros(0, np.int64)
        return self.text(), np.concatenate([none, *lens]), np.concatenate([none, *counts]), np.array(sizes, dtype=np.int64)

    def _grow(self) -> None:
        """The sums over the leaves, of which there is one at least; no pre-token is looked at."""
        if not self.leaves:
            self.leaves = [Leaf.of([], [])]
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        rest = [0] * (self.base - len(self.leaves))
        self.chars = [0] * self.base + [x.chars for x in self.leaves] + rest
        self.sums = [0] * self.base + [x.tokens for x in self.leaves] + rest
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _text(self, leaf: Leaf) -> str:
        return "".join(leaf.parts) if leaf.parts is not None else self.kept[leaf.begin : leaf.begin + leaf.chars]

    def text(self) -> str:
        return "".join(map(self._text, self.leaves))

    def _open(self, i: int) -> tuple[list[str], list[int]]:
        """A leaf's pre-tokens and their counts."""
        leaf = self.leaves[i]
        if leaf.parts is None:
            at, leaf.parts = leaf.begin, []
            for n in self.lens[leaf.first : leaf.last].tolist():
                leaf.parts.append(self.kept[at : at + n])
                at += n
            leaf.counts = self.counts[leaf.first : leaf.last].tolist()
        return leaf.parts, leaf.counts

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf of the character at a place (the last leaf for the end), and where it begins."""
        i, begin = 1, 0
        while i < self.base:
            i *= 2
            if at >= begin + self.chars[i] and self._has(i + 1) and (self.chars[i + 1] or not self.chars[i]):
                begin += self.chars[i]
                i += 1
        return min(i - self.base, len(self.leaves) - 1), begin

    def _has(self, i: int) -> bool:
        while i < self.base:
            i *= 2
        return i - self.base < len(self.leaves)

    def edit(self, start: int, length: int, new: str) -> int:
        """Replace characters; returns how many pre-tokens were tokenized for it."""
        start = max(0, min(start, self.length))
        end = min(start + max(0, length), self.length)
        first, at = self._find(max(0, start - SIGHT))
        own, own_counts = self._open(first)
        head = 0  # of the first leaf, what cannot see the edit
        while head < len(own) and at + len(own[head]) < start - SIGHT + 1:
            at += len(own[head])
            head += 1
        last = max(first, self._find(end)[0])
        while True:
            # the old text from the first affected pre-token to the end of leaf `last`, and its boundaries
            old, counts = own[head:], own_counts[head:]
            for i in range(first + 1, last + 1):
                more, more_counts = self._open(i)
                old, counts = old + more, counts + more_counts
            whole = "".join(old)
            text = whole[: start - at] + new + whole[end - at :]
            ends, shift = {0: 0}, len(new) - (end - start)
            p = 0
            for i, t in enumerate(old):
                p += len(t)
                if p >= end - at:
                    ends[p + shift] = i + 1
            behind = self._behind(last, SIGHT + 1)
            closed = not behind
            fresh, done = [], None
            for m in self.counter.pattern.finditer(text + behind):
                if m.end() > len(text) or (not closed and m.end() + SIGHT > len(text) + len(behind)):
                    break
                fresh.append(m[0])
                if m.end() >= start - at + len(new) and m.end() in ends and m.end() > 0:
                    done = ends[m.end()]
                    break
            else:
                if closed:
                    done = len(old)
            if done is not None:
                break
            # as much again, so that a long run of leaves is not gone through leaf by leaf
            last = min(2 * last - first + 1, len(self.leaves) - 1)
        parts = own[:head] + fresh + old[done:]
        counts = own_counts[:head] + [self.counter[t] for t in fresh] + counts[done:]
        self.encoded += len(fresh)
        self._replace(first, last, parts, counts)
        return len(fresh)

    def _replace(self, first: int, last: int, parts: list[str], counts: list[int]) -> None:
        """Deals pre-tokens over some leaves, and updates the sums above these only; if they would get too full, there are more leaves."""
        each = -(-len(parts) // (last - first + 1))
        if each <= FULL:
            for i in range(first, last + 1):
                a = (i - first) * each
                leaf = self.leaves[i] = Leaf.of(parts[a : a + each], counts[a : a + each])
                self.chars[self.base + i], self.sums[self.base + i] = leaf.chars, leaf.tokens
            a, b = (self.base + first) // 2, (self.base + last) // 2
            while a:
                for i in range(a, b + 1):
                    self._sum(i)
                a, b = a // 2, b // 2
        else:
            self.leaves[first : last + 1] = [Leaf.of(parts[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, len(parts), LEAF)]
            self._grow()

    def _behind(self, leaf: int, need: int) -> str:
        """Text after a leaf, of ``need`` characters if there are as many."""
        out = ""
        for own in self.leaves[leaf + 1 :]:
            if own.chars:
                out += self._text(own)[: need - len(out)]
                if len(out) >= need:
                    break
        return out


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


EDITS = "array<struct<start:bigint,length:bigint,text:string>>"
#: A kept tree: its row, the document's id and text, lens, counts and sizes as numbers of four bytes, and its totals.
TREES = "row bigint, doc_id bigint, text string, lens binary, counts binary, sizes binary, n_chars bigint, n_pretokens bigint, n_tokens bigint"


def _kept(row, doc_id, tree: TokenTree) -> tuple:
    text, lens, counts, sizes = tree.rows()
    return row, doc_id, text, *(x.astype("<u4").tobytes() for x in (lens, counts, sizes)), len(text), len(lens), tree.tokens


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def build(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """TREES of all rows of docs (doc_id, text), to be kept in a table: ``row`` is fixed by writing it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks, pattern)
        for batch in batches:
            rows = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            yield _batch([_kept(row, doc, TokenTree.build(text or "", count)) for row, doc, text in rows], TREES)

    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, TREES)


_CHANGES = "n_tokens_before bigint, n_pretokens_before bigint, n_recounted bigint"


def update(trees: DataFrame, edits: Column | DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The trees after their edits, with n_tokens_before, n_pretokens_before and n_recounted (pre-tokens tokenized for the edits).

    ``edits``: a column of EDITS over the trees' columns; or a table (row, seq, start, length, text) whose edits apply in
    the order of seq, each to the text as the ones before left it."""
    small_batches(trees.sparkSession)
    if isinstance(edits, DataFrame):
        own = edits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("start", "length", "text").alias("e")))).alias("own"))
        trees = trees.join(own, "row", "left")
        edits = F.transform("own", lambda x: x["e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks, pattern)
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                arrays = (np.frombuffer(x[k], dtype="<u4").astype(np.int64) for k in ("lens", "counts", "sizes"))
                tree = TokenTree(x["text"], *arrays, count)
                before, again = tree.tokens, 0
                for e in x["edits"] or []:
                    if e and e["start"] is not None and e["length"] is not None and e["text"] is not None:
                        again += tree.edit(e["start"], e["length"], e["text"])
                rows.append((*_kept(x["row"], x["doc_id"], tree), before, len(x["lens"]) // 4, again))
            yield _batch(rows, f"{TREES}, {_CHANGES}")

    return trees.select("row", "doc_id", "text", "lens", "counts", "sizes", edits.cast(EDITS).alias("edits")).mapInArrow(run, f"{TREES}, {_CHANGES}")


def recount(docs: DataFrame, edits: Column | DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_chars_after, n_pretokens, n_tokens_before, n_tokens_after, n_recounted of each row of docs: trees are built and kept, then updated."""
    out = update(staged(build(docs, ranks, pattern)), edits, ranks, pattern)
    return out.select("doc_id", F.col("n_chars").alias("n_chars_after"), F.col("n_pretokens_before").alias("n_pretokens"), "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"), "n_recounted")
