"""Language-model scoring (operator 7).

Tokens are the words of a text, A-Z lower-cased, and then one end; any word that training has not
seen is one and the same unknown token. The model is a weighted backoff automaton. Its states are the empty
context, the text's begin, and every word and every pair of neighbouring words of the training documents;
its arcs are all their n-grams, however rare. In a state seen n times, an arc of count c has the
probability (c + PRIOR * q) / (n + PRIOR), where q is the token's probability in the next shorter context
(Dirichlet smoothing); a token without an arc takes the failure arc there, of weight PRIOR / (n + PRIOR). The empty
context has (c + 1) / (N + V + 1) for every token, the unknown one too (c is 0), so that the probabilities
of all tokens add up to 1 in every state. A text is one left-to-right traversal, which carries the
state and adds up the arcs' log10 probabilities; all texts of a block go step by step together, longer ones in
stretches that first run over the two tokens before them, since these fix the state.

Nothing of the model is broadcast or gathered in one place. Texts become blocks of about ``BLOCK_BYTES``, held as
word hashes and numbers of words. Each block asks for its distinct words (64 bits), and its pairs and triples (as
many bits as the corpus needs for one collision in a million at most) once: sorted hashes, written as
differences, to the shard of each. A shard adds up the training counts of all blocks and sends each
block the totals in the order it asked. A block then has all states and arcs that its texts can meet.

Edge cases: a null or empty text is just the end token; a null id is a training document; with no
training documents every token is unknown, with probability 1; rows that occur twice are learned and
scored twice; a text of any length is in one block, and takes some 40 times its size; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .blocks import dealt, pack, shard_bits, sums, unpack
from .hashing import remainder
from .scratch import small_batches, staged, sweep

#: Weight of the shorter context in states of one and of two words.
PRIOR = (4.0, 2.0)
#: Bytes of text in a block, and keys asked for in a shard.
BLOCK_BYTES, SHARD_KEYS = 8 << 20, 1 << 21
#: Tokens of a stretch, and those before it that fix its state.
STRETCH, BEFORE = 512, 2
#: The hashes that stand for a text's end and begin.
_END, _BEGIN = w.U(0x5851F42D4C957F2D), w.U(0x14057B7EF767814F)


_BLOCK = "block bigint, doc_id array<bigint>, held_out array<boolean>, n_words array<bigint>, n_vocab bigint, vocab binary, stream binary, tokens bigint, ends bigint"


def _encode(block_bytes: int):
    """Rows (doc_id, text, held_out) as blocks: the distinct word hashes, commonest first, and the words' numbers among them."""
    return lambda batches: _encoded(batches, block_bytes)


def _encoded(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    ids, outs, counts, hashes, size, made = [], [], [], [], 0, 0
    part = TaskContext.get().partitionId()

    def block() -> pa.RecordBatch:
        out, n = pa.concat_arrays(outs), np.concatenate(counts)
        vocab, stream, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        learn = ~out.to_numpy(zero_copy_only=False)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        cols = [
            pa.array([part << 32 | made]), one(pa.concat_arrays(ids)), one(out), one(pa.array(n, pa.int64())), pa.array([len(vocab)]), pa.array([pack(vocab[order])], pa.binary()),
            pa.array([pack(number[stream])], pa.binary()), pa.array([int(n[learn].sum() + learn.sum())]), pa.array([int(learn.sum())]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        for a, b, data, offsets in w.texts(batch.column("text")):
            t = w.Words(data, offsets, w.SPACED, lower=True)
            ids.append(batch.column("doc_id").slice(a, b - a))
            outs.append(batch.column("held_out").slice(a, b - a))
            counts.append(t.counts.astype(np.int64))
            hashes.append(t.hashes())
            size += len(data) + 64 * (b - a)
            if size >= block_bytes:
                yield block()
                ids, outs, counts, hashes, size, made = [], [], [], [], 0, made + 1
    if ids:
        yield block()
    w.give_back()


class Block:
    """A block's tokens (number in the vocabulary; ``end`` for a text's end), and its distinct pairs and triples.

    grams: their sorted keys; pair, triple: of each token, the place there of the pair and of the triple that it ends
    (no triple at a text's first token: -1); bounds: of the texts among the tokens."""

    def __init__(self, row: dict, bits: int):
        self.n = np.array(row["n_words"], dtype=np.int64)
        self.learn = ~np.array(row["held_out"], dtype=bool)
        self.vocab = unpack(row["vocab"], row["n_vocab"])
        self.end = len(self.vocab)
        first = np.concatenate([[0], np.cumsum(self.n)])
        self.token = np.insert(unpack(row["stream"], int(first[-1])).astype(np.int64), first[1:], self.end)
        self.bounds = first + np.arange(len(first))
        self.start = self.bounds[:-1]
        hashed = np.append(self.vocab, _END)[self.token]
        before = np.empty_like(hashed)
        before[1:] = hashed[:-1]
        before[self.start] = _BEGIN
        pair = w.mix(w.mix(before) * w.U(w._Q) + hashed)
        del before
        state = np.zeros_like(pair)
        state[1:] = pair[:-1]
        triple = w.mix(w.mix(state) * w.U(w._R) + hashed + w.U(1))
        del state, hashed
        inner = np.ones(len(pair), bool)
        inner[self.start] = False
        keys = np.concatenate([pair, triple[inner]]) >> w.U(64 - bits)
        self.grams, self.at, place = np.unique(keys, return_index=True, return_inverse=True)
        self.pair, self.triple = place[: len(pair)], np.full(len(pair), -1, dtype=np.int64)
        self.triple[inner] = place[len(pair) :]
        self.inner = np.flatnonzero(inner)
        # vocab in the order of its hashes, as it is asked for
        self.sorted = np.argsort(self.vocab)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts in this block: of the sorted vocabulary and of the grams."""
        learned = np.repeat(self.learn, np.diff(self.bounds))
        in_vocab = np.bincount(self.token[learned], minlength=self.end + 1)[: self.end]
        of = np.bincount(self.pair[learned], minlength=len(self.grams))
        some = self.inner[learned[self.inner]]
        return in_vocab[self.sorted], of + np.bincount(self.triple[some], minlength=len(self.grams))


_ASKED = "shard int, block bigint, n_words bigint, words binary, own_words binary, n_grams bigint, grams binary, own_grams binary"


def _rows(batch: pa.RecordBatch | pa.Table) -> list[dict]:
    return batch.to_pylist()


def _ask(bits: int, in_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, bits)
                in_vocab, of_grams = b.own()
                lists = dealt(b.vocab[b.sorted], in_vocab, 64, in_shards), dealt(b.grams, of_grams, bits, in_shards)
                rows = [(s, row["block"], *x, *y) for s, (x, y) in enumerate(zip(*lists, strict=True))]
                names = [c.split()[0] for c in _ASKED.split(", ")]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        w.give_back()

    return run


_ANSWER = "block bigint, shard int, n_words bigint, words binary, n_grams bigint, grams binary, known bigint"


def _add_up(asked: pa.Table) -> pa.Table:
    """Of one shard: to each block the training counts of what it asked for; known (in one row): distinct words of the training documents."""
    out = {c.split()[0]: [] for c in _ANSWER.split(", ")}
    out["block"], out["shard"] = asked.column("block").to_pylist(), asked.column("shard").to_pylist()
    for name in ("words", "grams"):
        n = asked.column(f"n_{name}").to_pylist()
        out[f"n_{name}"] = n
        keys = [sums(x, k) for x, k in zip(asked.column(name).to_pylist(), n, strict=True)]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        own = np.concatenate([unpack(x, k) for x, k in zip(asked.column(f"own_{name}").to_pylist(), n, strict=True)])
        total = np.bincount(place, weights=own).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        out[name] = [pack(total[place[x:y]]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        if name == "words":
            out["known"] = [int((total > 0).sum()), *[0] * (len(n) - 1)]
    w.give_back()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


class Automaton:
    """The states and arcs that a block's texts can meet.

    States: 0 the empty context, then the words of the vocabulary (the one at ``end`` is the text's begin), then grams that are pairs.
    Arcs: tokens of the empty context, then grams. seen: whether the arc exists; log: its log10 probability. fail, to: the
    log10 weight and the target of a state's failure arc."""

    def __init__(self, b: Block, words: np.ndarray, grams: np.ndarray, total: int, kinds: int, ends: int):
        self.b, self.words, size = b, b.end + 1, len(b.grams)
        count = np.zeros(b.end + 1, dtype=np.int64)
        count[b.sorted] = words
        count[b.end] = ends
        self.count = count
        unigram = (count + 1.0) / (total + kinds + 1.0)
        # a gram's token and contexts are those of its first place
        both = np.concatenate([np.arange(len(b.token)), b.inner])[b.at]
        is_pair = b.pair[both] == np.arange(size)
        is_pair &= b.at < len(b.token)
        first = np.zeros(len(b.token), bool)
        first[b.start] = True
        before = np.where(first[both], b.end, b.token[both - 1])
        p = np.zeros(size)
        i = np.flatnonzero(is_pair)
        n = count[before[i]]
        p[i] = (grams[i] + PRIOR[0] * unigram[b.token[both[i]]]) / (n + PRIOR[0])
        shorter = p.copy()
        i = np.flatnonzero(~is_pair)
        n = grams[b.pair[both[i] - 1]]
        p[i] = (grams[i] + PRIOR[1] * shorter[b.pair[both[i]]]) / (n + PRIOR[1])
        self.log = np.log10(np.concatenate([unigram, np.where(p > 0, p, 1.0)]))
        self.seen = np.concatenate([np.ones(b.end + 1, bool), grams > 0])
        totals = np.concatenate([[0], count, np.where(is_pair, grams, 0)])
        prior = np.concatenate([[1.0], np.full(b.end + 1, PRIOR[0]), np.full(size, PRIOR[1])])
        self.fail = np.log10(prior / (totals + prior))
        # a pair falls back to its last word, a word to the empty context
        self.to = np.concatenate([np.zeros(b.end + 2, np.int64), 1 + b.token[both]])
        self.alive = np.concatenate([[True], count > 0, is_pair & (grams > 0)])

    def target(self, at: np.ndarray) -> np.ndarray:
        """The state behind the token at each place: its longest context that is a state."""
        b = self.b
        pair, word = 1 + self.words + b.pair[at], 1 + b.token[at]
        return np.where(self.alive[pair], pair, np.where(self.alive[word], word, 0))

    def scores(self) -> np.ndarray:
        """log10 probability of each text: all stretches take a step at a time, carrying their states."""
        b = self.b
        length = np.diff(b.bounds)
        pieces = -(-length // STRETCH)
        text = np.repeat(np.arange(len(length)), pieces)
        skip = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        counted = b.start[text] + skip
        at = np.maximum(counted - BEFORE, b.start[text])
        stop = np.minimum(counted + STRETCH, b.bounds[1:][text])
        order = np.argsort(at - stop, kind="stable")  # the longest first: those that go on stand in front
        text, counted, at, stop = text[order], counted[order], at[order], stop[order]
        begin = 1 + b.end if self.alive[1 + b.end] else 0
        state = np.where(at == b.start[text], begin, 0)
        gains = np.zeros(len(text))
        steps = stop - at
        for step in range(int(steps.max(initial=0))):
            live = int(np.searchsorted(-steps, -step))
            here = at[:live] + step
            s = state[:live]
            gained = np.zeros(live)
            todo = np.arange(live)
            arc = np.zeros(live, np.int64)
            while len(todo):
                own, place = s[todo], here[todo]
                one = np.where(own == 0, b.token[place], self.words + np.where(own <= self.words, b.pair[place], b.triple[place]))
                arc[todo] = one
                missing = ~self.seen[one]
                todo, own = todo[missing], own[missing]
                gained[todo] += self.fail[own]
                s[todo] = self.to[own]
                # the shorter context of a pair is a word that has been seen
            gained += self.log[arc]
            gains[:live] += np.where(here >= counted[:live], gained, 0.0)
            state[:live] = self.target(here)
        return np.bincount(text, weights=gains, minlength=len(length))


_SCORED = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _answer(bits: int, total: int, kinds: int, ends: int):
    """Scores a block's texts with the counts that came back for it."""

    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [pa.table({k: pa.array([], v) for k, v in _SCORED.items()})]
        for row in _rows(blocks):
            b = Block(row, bits)
            own = sorted(_rows(counts), key=lambda r: r["shard"])
            words, grams = (np.concatenate([unpack(r[k], r[f"n_{k}"]) for r in own]).astype(np.int64) for k in ("words", "grams"))
            auto = Automaton(b, words, grams, total, kinds, ends)
            c = auto.count[b.token]
            tokens = np.diff(b.bounds)
            base = w.per_doc(np.log10(c + 1.0), b.bounds) - tokens * np.log10(total + kinds + 1.0)
            cols = [row["doc_id"], row["held_out"], tokens, w.per_doc(c > 0, b.bounds), np.full(len(tokens), total), base, auto.scores()]
            parts.append(pa.table({k: pa.array(x, v) for (k, v), x in zip(_SCORED.items(), cols, strict=True)}))
        w.give_back()
        return pa.concat_tables(parts)

    return run


def score(docs: DataFrame, held_out_mod: int = 7, held_out_rest: int = 2, block_bytes: int = BLOCK_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    out = F.coalesce(remainder(F.col("doc_id"), held_out_mod) == held_out_rest, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", out.alias("held_out"))
    blocks = staged(docs.mapInArrow(_encode(block_bytes), _BLOCK))
    totals = blocks.agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ends"), F.sum(F.expr("aggregate(n_words, 0L, (a, n) -> a + n + 1)")).alias("all")).first()
    total, ends, size = totals["tokens"] or 0, totals["ends"] or 0, totals["all"] or 0
    bits = min(64, max(48, size.bit_length() + 20))
    asked = blocks.mapInArrow(_ask(bits, shard_bits(2 * size, shard_keys)), _ASKED)
    answers = staged(asked.groupBy("shard").applyInArrow(_add_up, _ANSWER))
    del asked
    kinds = (answers.agg(F.sum("known")).first()[0] or 0) + (ends > 0)
    sweep(spark)  # what was asked for is the largest shuffle of all
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer(bits, total, kinds, ends), schema)
