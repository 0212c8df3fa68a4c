"""Word scanning and hashing against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from tallyframe.llm import words as w


def texts():
    r = random.Random(5)
    alpha = ["a", "B", " ", "\n", "\t", "\x0b", "é", "日本", "1", ".", "\x00", "\xa0", "  ", "word "]
    return [None, "", " ", "one", *("".join(r.choice(alpha) for _ in range(r.randint(0, 60))) for _ in range(200))]


def test_words_are_those_of_the_patterns():
    for table, pattern, lower in ((w.SPACED, r"[^\x20\x09-\x0D]+", False), (w.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        for chunk in (1, 50, 1 << 20):
            for a, b, data, offsets in w.texts(pa.array(texts()), chunk):
                t = w.Words(data, offsets, table, lower)
                h = t.hashes()
                for i in range(b - a):
                    text = texts()[a + i] or ""
                    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text
                    own = slice(t.first[i], t.first[i + 1])
                    got = [t.data[x:y].tobytes().decode() for x, y in zip(t.starts[own], t.ends[own], strict=True)]
                    assert got == re.findall(pattern, text)
                names = [t.data[x:y].tobytes() for x, y in zip(t.starts, t.ends, strict=True)]
                assert len(set(names)) == len(set(h.tolist())) and len({(n, x) for n, x in zip(names, h.tolist(), strict=True)}) == len(set(names))


def test_windows():
    for _, _, data, offsets in w.texts(pa.array(["a b c d", "b c d", None, "a b", "x a b c d"])):
        t = w.Words(data, offsets, w.SPACED, False)
        begin, h = t.windows(t.hashes(), 3)
        assert begin.tolist() == [0, 1, 4, 9, 10, 11] and h[0] == h[4] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 3


def test_repeated_and_covered():
    more, later = w.repeated(np.array([5, 3, 5, 7, 5, 3], dtype=np.uint64))
    assert more.tolist() == [True, True, True, False, True, True] and later.tolist() == [False, False, True, False, True, True]
    assert w.covered(6, np.array([0, 1, 4]), 2).tolist() == [True, True, True, False, True, True]
