"""Blocks of texts that ask about their keys, and shards that answer.

A statistic of a key (a word, an n-gram, a window) over the whole corpus is had without gathering it anywhere: each block
sends its distinct keys, sorted, to the shard of each, as differences in a few bytes; a shard adds up what all blocks
hold, and answers each block in the order it asked. What moves is in proportion to the texts, at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import words as w


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    if not len(values):
        return b""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(len(values), 8)[:, :width].T
    return bytes([width]) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, w.U)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : data[0]] = np.frombuffer(pa.decompress(data[1:], decompressed_size=n * data[0], codec="zstd", asbytes=True), dtype=np.uint8).reshape(data[0], n).T
    return out.reshape(-1).view("<u8")


def differences(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=w.U(0)))


def sums(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=w.U)


def dealt(keys: np.ndarray, own: np.ndarray, bits: int, shard_bits: int) -> list[tuple[int, bytes, bytes]]:
    """Of each of 2**shard_bits shards: how many of the sorted keys of ``bits`` bits it has, these without the shard's bits, and their numbers."""
    low = w.U(bits - shard_bits)
    cut = np.searchsorted(keys, np.arange(1, 1 << shard_bits, dtype=w.U) << low) if shard_bits else np.zeros(0, np.int64)
    cut = np.concatenate([[0], cut, [len(keys)]]).astype(np.int64).tolist()
    rest = keys & ((w.U(1) << low) - w.U(1)) if shard_bits else keys
    return [(y - x, differences(rest[x:y]), pack(own[x:y])) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def shard_bits(keys: int, in_a_shard: int) -> int:
    return max(0, (keys // in_a_shard).bit_length())


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranges of bytes, one after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
