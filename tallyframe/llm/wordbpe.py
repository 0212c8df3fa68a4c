"""Token ids of whole texts under a word-level BPE vocabulary file, for millions of distinct words.

White space is dropped by the vocabulary's rules and no piece spans it, so a text's ids are those of
its words one after the other. Each process encodes a distinct word once and looks up the rest in
numpy arrays. Plain words go through a byte-pair core that gets the merges as ranks (a final byte
0xFF stands for the end of a word, and joins the byte before it first); the rest, and anything
with unusual characters or special strings, through the tokenizers library itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from . import words as w

#: Words remembered by a process: above that, it starts anew.
REMEMBER = 500_000
#: Pieces of a word, as in the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words without these need no more than lower case and composition.
_ODD = regex.compile(r"[^\n\x21-\x7E\xA1-\u024F]|<\|")
_END = b"\xff"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: visible ones for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def merge_ranks(spec: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks for the byte-pair core, and the vocabulary's id of each rank (-1: never a result)."""
    letters, vocab = byte_letters(), spec["model"]["vocab"]

    def raw(token: str) -> bytes:
        end = token.endswith("</w>")
        return bytes(letters[c] for c in (token[:-4] if end else token)) + _END * end

    back = {b: c for c, b in letters.items()}
    ranks = {bytes([b]): b for b in range(256)}
    ids = [vocab.get(back[b], -1) for b in range(256)]
    for b in range(255):
        ranks[bytes([b]) + _END] = len(ids)
        ids.append(vocab.get(back[b] + "</w>", -1))
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if (joined := raw(a) + raw(b)) not in ranks:
            ranks[joined] = len(ids)
            ids.append(vocab[a + b])
    return ranks, np.array(ids, dtype=np.int64)


class WordBpe:
    """Encoder with a memory of words. Use :func:`encoder` for one per process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        ranks, self.ids = merge_ranks(spec)
        self.core = tiktoken.Encoding("words", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PIECES)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, dtype=w.U)
        self.slot = np.zeros(0, dtype=np.int32)
        self.start, self.length = np.zeros(1, np.int32), np.ones(1, np.int32)  # slot 0: the id 0 after a text
        self.flat = np.zeros(1, dtype=np.uint32)

    def new_words(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        text = b"\n".join(raw).decode("utf-8", "replace")
        odd: dict[int, list[int]] = {}
        if _ODD.search(text):
            for i, word in enumerate(text.split("\n")):
                if _ODD.search(word):
                    odd[i] = self.library.encode(word, add_special_tokens=False).ids
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        one, find = self.core._core_bpe.encode_single_piece, self.pieces.findall
        got = [one(x.encode() + _END) if x.isalpha() else [r for p in find(x) for r in one(p.encode() + _END)] for x in text.split("\n")]
        lengths = [len(g) for g in got]
        ids = self.ids[np.fromiter((r for g in got for r in g), np.int64, sum(lengths))].tolist()
        ends = np.cumsum(lengths).tolist()
        return [odd[i] if i in odd else ids[e - n : e] for i, (e, n) in enumerate(zip(ends, lengths, strict=True))]

    def slots(self, t: w.Words, hashes: np.ndarray) -> np.ndarray:
        """Of each word, its slot; new words are encoded."""
        if len(self.known) > REMEMBER:
            self.forget()
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            data = t.data.tobytes()
            got = self.new_words([data[a:b] for a, b in zip(t.starts[first[new]].tolist(), t.ends[first[new]].tolist(), strict=True)])
            lengths = np.array([len(g) for g in got], dtype=np.int64)
            slot = (len(self.start) + np.arange(len(new))).astype(np.int32)
            self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)])
            self.length = np.concatenate([self.length, lengths.astype(np.int32)])
            self.flat = np.concatenate([self.flat, np.array([i for g in got for i in g], dtype=np.uint32)])
            keys, slots = np.concatenate([self.known, unique[new]]), np.concatenate([self.slot, slot])
            order = np.argsort(keys, kind="stable")
            self.known, self.slot = keys[order], slots[order]
            at = np.searchsorted(self.known, unique)
        return self.slot[at][inverse] if len(unique) else np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by one 0, and the texts' bounds among them."""
        t = w.Words(data, offsets, w.SPACED, lower=False)
        slots = np.insert(self.slots(t, t.hashes()), t.first[1:], 0)
        lengths = self.length[slots]
        ends = np.cumsum(lengths, dtype=np.int64)
        ids = self.flat[np.repeat(self.start[slots] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        last = t.first[1:] + np.arange(len(t.counts))  # of each text, the place of its 0 among the slots
        return ids, np.concatenate([[0], ends[last]]).astype(np.int64)


_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]
