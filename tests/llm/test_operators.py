"""Each operator against a brute-force version, and its edge cases."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from tallyframe.llm import chat, components, decontaminate, jaccard, language, lines, lm, packing, quality, queries, substrings, tokencount, wordbpe

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty texts and repeated rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(120)]
    passage = " ".join(r.choice(vocabulary) for _ in range(55))
    docs = []
    for i in range(n):
        own = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 9, 40, 120, 300]))]
        if i % 7 == 3 and docs:
            own = SPACE.findall(docs[-1][1] or "")
            for _ in range(r.randint(0, 2)):
                if own:
                    own[r.randrange(len(own))] = r.choice(vocabulary)
        if i % 9 == 4:
            own = own + passage.split() + own[:3]
        docs.append((i, "".join(x + r.choice([" ", " ", " ", "\n", "  "]) for x in own)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n "), docs[5], docs[5], (n + 3, docs[5][1]), (None, docs[8][1]), (n + 4, "Word " * 4000)]


def frame(spark, rows):
    """With more columns, some of names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "x") for i, t in rows], EXTRA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, *map(str, r)))


# ------------------------------------------------------------------ very long texts


def test_texts_of_many_megabytes(spark):
    """One text of 12 MB beside short ones goes through every operator that reads whole texts, and its results agree with a plain count."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    own = [r.choice(vocabulary) for _ in range(1_700_000)]
    passage = "zq1 zq2 zq3 zq4 zq5 zq6 zq7 zq8 zq9 zq10 zq11 zq12 zq13".split()
    own[800_000:800_000] = passage
    text = " ".join(own)
    rows = [(1, text), (2, "short text é"), (3, None), (7, "another one of them")]
    df = frame(spark, rows)
    one = lambda out: out.where("doc_id = 1").first()
    model = language.fit(spark.createDataFrame([(1, " ".join(vocabulary), "xx"), (2, "éàü", "yy")], "doc_id long, text string, lang string"))
    assert one(language.predict(df, model))["lang_pred"] == "xx" and [g.tolist() for g, _ in language._pieces(["ab" * 10])] == [language._grams(["ab" * 10])[0].tolist()]
    weights = np.random.default_rng(1).normal(0, 0.1, 2 * quality.DIM).astype(np.float32)
    assert one(quality.assess(df, quality.Model(weights)))["n_words"] == len(own)
    import pyarrow as pa

    from tallyframe.llm import words as w

    for _, _, data, offsets in w.texts(pa.array(["é" + text[:3_000_000]])):
        t = w.Words(data, offsets, w.SPACED, False)
        assert np.array_equal(np.bincount(quality._trigrams(t)[0], minlength=quality.DIM), quality._trigram_counts(t.data))
    assert one(jaccard.join(df, 4, 85))["n_shingles"] == len({tuple(own[i : i + 4]) for i in range(len(own) - 3)})
    assert one(decontaminate.digest(decontaminate.occurrences(df, spark.createDataFrame([("i", " ".join(passage))], "item_id string, text string"))))["n_hit"] == 13
    assert one(substrings.dedup(df))["n_removed"] == 0
    assert one(lm.score(df))["n_tokens"] == len(own) + 1
    assert one(lines.dedup_lines(df))["text"] == text
    assert sum(x["length"] for x in packing.pieces(df, WORD_BPE).where("doc_id = 1").collect()) > len(own)


# ------------------------------------------------------------------ components


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x or any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1 language


def test_language_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["held_out"] for r in got} == {True, False} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_by_hand(spark):
    """Naive Bayes over character bigrams and trigrams with dictionaries; the hash of an n-gram is the operator's own bucket."""
    r = random.Random(2)
    alphabet = {"aa": "abcde", "bb": "cdefg", "cc": "xyzab"}
    train = [(i, " ".join("".join(r.choice(alphabet[k]) for _ in range(r.randint(1, 6))) for _ in range(12)), k) for i, k in enumerate(sorted(alphabet) * 10)]
    tests = [(i, " ".join("".join(r.choice("abcdefgxyz") for _ in range(3)) for _ in range(r.randint(0, 3)))) for i in range(40)]

    def buckets(text):
        grams, bounds = language._grams([text])
        folded = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} "
        own = [folded[i : i + n] for n in (2, 3) for i in range(len(folded) - n + 1)]
        assert len(grams) == bounds[-1] == sum(g.strip() != "" for g in own)
        return grams.tolist()

    count = {k: collections.Counter() for k in alphabet}
    for _, text, k in train:
        count[k].update(buckets(text))
    sums = {k: sum(c.values()) + 0.5 * language.BUCKETS for k, c in count.items()}
    want = {}
    for i, text in tests:
        own = buckets(text)
        z = {k: math.log(1 / 3) + sum(math.log((count[k][g] + 0.5) / sums[k]) for g in own) for k in sorted(alphabet)}
        best = max(z, key=z.get)
        want[i] = (best if own else "und", 1 / sum(math.exp(x - z[best]) for x in z.values()) if own else 0.0)
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict(frame(spark, tests), model).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_language_edges(spark):
    train = spark.createDataFrame([(1, "der die das und", "de"), (2, "the and of", "en"), (3, None, "en"), (None, "x", "en"), (4, "y", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.names == ["de", "en"]
    got = rows_of(language.predict(frame(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "die und das"), (4, "die und das"), (None, "of the")]), model))
    assert [(r[0], r[1]) for r in got] == [(None, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert language.predict(frame(spark, []), model).count() == 0
    # blocks of languages, one after the other, decide as all at once
    many = frame(spark, [(i, "the der und " * (i % 3) + t) for i, t in enumerate(["x yz", "die", "of and", "", "und the", "zz"])])
    for size in (1, 2):
        assert [(r[0], r[1], round(r[2], 9)) for r in rows_of(language.predict(many, model, size))] == [(r[0], r[1], round(r[2], 9)) for r in rows_of(language.predict(many, model))]
    none = language.fit(train.where("false"))
    assert [r[1] for r in rows_of(language.predict(frame(spark, [(1, "the")]), none))] == ["und"]


# ------------------------------------------------------------------ 2 Jaccard


def shingles(text, k):
    own = SPACE.findall(low(text))
    return {tuple(own[j : j + k]) for j in range(max(1, len(own) - k + 1))} if own else set()


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard(spark, k, percent):
    rows = corpus(3)
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    name = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            name[find(i)] = min(doc, name.get(find(i), doc))
    want = sorted(((doc, len(sets[i]), name.get(find(i), doc)) for i, (doc, _) in enumerate(rows)), key=lambda r: (r[0] is not None, *map(str, r)))
    assert rows_of(jaccard.join(frame(spark, rows), k, percent)) == want


def test_jaccard_keeps_one(spark):
    rows = corpus(3)
    docs = frame(spark, rows)
    left = jaccard.keep_one(docs, 5, 80)
    assert left.columns == docs.columns
    groups = {r["component_id"] for r in jaccard.join(docs).where("n_shingles > 0").collect()}
    kept = [r for r in left.collect() if SPACE.search(r["text"] or "")]
    assert len(kept) == len(groups) and sum(not SPACE.search(t or "") for _, t in rows) == left.count() - len(kept)
    assert jaccard.join(frame(spark, [])).count() == 0 and jaccard.keep_one(frame(spark, [(1, None), (1, None)])).count() == 2


@pytest.mark.parametrize(("sets", "crowded", "held"), [(64, 8, 1024), (4, 0, 2), (1, 0, 3), (2, 10**9, 1)])
def test_a_large_group_of_near_copies(spark, monkeypatch, sets, crowded, held):
    """Whatever the size of blocks, with and without looking for families first, and with tokens of few or many groups."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "HELD", held)
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    sets = [shingles(t, 4) for _, t in rows]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.join(frame(spark, rows), 4, 85).collect()}
    assert got == {i: find(i) for i in range(300)}


# ------------------------------------------------------------------ 3 lines


def normal(line):
    return re.sub(r"[^\w]+|_+", " ", re.sub("[1-9]", "0", line.lower())).strip()


def test_lines_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [" ".join(word() for _ in range(r.randint(3, 40))) for _ in range(25)]
    docs = []
    for i in range(30):
        own = []
        for _ in range(r.randint(0, 8)):
            line = r.choice(base)
            if r.random() < 0.4:
                at = r.randrange(len(line))
                line = line[:at] + "z" + line[at + 1 :]
            own.append(line.upper() + " !" if r.random() < 0.2 else line)
        docs.append((i, "\n".join(own)))
    docs += [(30, None), (31, ""), (32, "\n\n"), (33, "too short\ntoo short"), docs[3]]
    df = frame(spark, docs)
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and out.count() == len(docs)
    # hashes of words as Spark has them; SimHashes, stretches and links by brute force
    flat = sorted({normal(x) for _, t in docs for x in (t or "").split("\n") if len(normal(x).split(" ")) >= 5})
    hashes = {x["w"]: x["h"] for x in spark.createDataFrame([(x,) for x in {w for t in flat for w in t.split(" ")}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    sims, cuts = {x: majority([hashes[w] for w in x.split(" ")]) for x in flat}, {x: stretches(x.split(" ")) for x in flat}
    parent = {x: x for x in flat}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(flat):
        for b in flat[:i]:
            if cuts[a] & cuts[b] and bin(sims[a] ^ sims[b]).count("1") <= 18 and levenshtein(a, b) <= max(len(a), len(b)) * 20 // 100:
                parent[find(a)] = find(b)
    first, want = {}, {}
    for doc, text in sorted(set(docs[:-1]), key=lambda x: x[0]):
        kept = []
        for n, x in enumerate((text or "").split("\n")):
            y = normal(x)
            if len(y.split(" ")) < 5 or first.setdefault(find(y), (doc, n)) == (doc, n):
                kept.append(x)
        want[doc] = None if text is None else "\n".join(kept)
    assert {x["doc_id"]: x["text"] for x in out.collect()} == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_lines_empty(spark):
    assert lines.dedup_lines(frame(spark, [])).count() == 0
    one = lines.dedup_lines(frame(spark, [(1, None), (None, "a b c d e f"), (2, "A b, c d e F!")])).collect()
    assert {r["doc_id"]: r["text"] for r in one} == {1: None, None: "a b c d e f", 2: ""}


def test_repeated_short_lines_go_in_the_query(spark, tmp_path):
    """Equal lines of few words, or of a script without blanks; unequal ones of few words stay, and empty ones."""
    frame(spark, [(1, "All rights reserved\n\n天地玄黄宇宙洪荒\nall rights deserved"), (2, "all rights reserved!\n\n天地玄黄宇宙洪荒\nown"), (None, "天地玄黄宇宙洪荒")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["text"] for x in queries.QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {None: "天地玄黄宇宙洪荒", 1: "All rights reserved\n\nall rights deserved", 2: "\nown"}


def majority(hashes):
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def stretches(words):
    """Up to six stretches from each end, of as many words as the greatest power of two that is a sixth of the line at most, and of three to eight."""
    n, size = len(words), 1
    while size * 2 * 6 <= n:
        size *= 2
    size = min(8, max(3, size))
    each = [(k * size, (k + 1) * size) for k in range(6) if (k + 1) * size <= n]
    return {(size, *words[a:b]) for x, y in each for a, b in ((x, y), (n - y, n - x))}


def test_simhashes_of_lines(spark):
    r = random.Random(3)
    own = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)] for n in (1, 2, 5, 300, 70_000)]
    hashes = {x["w"]: x["h"] for x in spark.createDataFrame([(x * n,) for x in "abcdefgh" for n in (1, 2, 3)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = lines.sketched(spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(own)], "k1 long, norm string")).collect()
    assert {x["k1"]: x["sim"] % 2**64 for x in got} == {i: majority([hashes[w] for w in x]) for i, x in enumerate(own)}
    assert all(x["longest"] == max(map(len, own[x["k1"]])) and len(x["code"]) == len(own[x["k1"]]) for x in got)


def test_near_lines_of_many_words(spark):
    """Lines of 30,000 words with a few changes, which no full table of distances could be made of, and one with too many."""
    r = random.Random(12)
    own = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(30_000)]
    rows = [(0, " ".join(own))]
    for i, changes in ((1, 3), (2, 60), (3, 29_000)):
        other = list(own)
        for j in r.sample(range(len(own)), changes):
            other[j] = "zzzzz" + str(i)
        rows.append((i, " ".join(other)))
    got = {x["doc_id"]: x["text"] for x in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: "", 2: "", 3: rows[3][1]}


def test_a_crowd_of_near_lines(spark):
    """More lines with common stretches than meet pair by pair, of two families, each of which has one line left; and 3000 equal ones."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(12)]
    families = [[*common, *(word() for _ in range(60))] for _ in range(2)]
    rows = []
    for i in range(200):
        own = list(families[i % 2])
        for _ in range(3):
            own[r.randrange(12, len(own))] = word()
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, "the very same line of seven words") for i in range(3000)]
    out = {x["doc_id"]: x["text"] for x in lines.dedup_lines(frame(spark, rows)).where("text <> ''").collect()}
    assert out == {0: rows[0][1], 1: rows[1][1], 1000: rows[200][1]}


def test_a_crowd_of_many_families(spark):
    """90 lines have one stretch in common, and each is near one other line only, with which it has no other stretch in common."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common, rows = [word() for _ in range(8)], []
    for _ in range(lines.CROWD + 13):
        own = [*common, *(word() for _ in range(40))]
        other = [w[:-1] + "z" if at % 8 == 3 and at > 8 else w for at, w in enumerate(own)]
        assert stretches(own) & stretches(other) == {(8, *common)}
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(other))]
    out = {x["doc_id"] for x in lines.dedup_lines(frame(spark, rows)).where("text <> ''").collect()}
    assert out == {i for i, _ in rows if i % 2 == 0}


def test_lines_that_agree_in_the_middle_only(spark):
    """A line of 400 words has 50 stretches."""
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    own = [word() for _ in range(400)]
    other = [w[:-1] + "z" if at % 8 == 3 and not 184 <= at < 216 else w for at, w in enumerate(own)]
    assert not stretches(own) & stretches(other)
    rows = list(enumerate(" ".join(x) for x in (own, other)))
    assert {x["doc_id"] for x in lines.dedup_lines(frame(spark, rows)).where("text <> ''").collect()} == {0}


def test_pairs_compared_by_pieces_and_by_letters(spark):
    """The distance in pieces is a bound from above; what it does not find is compared by letters."""
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefé𐐨") for _ in range(r.randint(1, 8)))
    own, near = {}, []
    for i in range(0, 400, 2):
        words = [word() for _ in range(r.randint(5, 30))]
        own[i] = " ".join(words)
        if i % 4:  # words changed, or letters
            own[i + 1] = " ".join(word() if r.random() < 0.25 else w for w in words)
        else:
            own[i + 1] = "".join("z" if x != " " and r.random() < 0.25 else x for x in own[i])
        near.append((i, i + 1))
    texts = spark.createDataFrame(list(own.items()), "k1 long, norm string")
    got = {tuple(x) for x in lines.in_letters(spark.createDataFrame(near, "a long, b long"), texts, 80).collect()}
    letters = {(a, b): levenshtein(own[a], own[b]) for a, b in near}
    most = {(a, b): max(len(own[a]), len(own[b])) * 20 // 100 for a, b in near}
    assert got == {x for x in near if letters[x] <= most[x]} and 20 < len(got) < 180
    cut = {x["k1"]: x["cut"] for x in texts.select("k1", F.expr(lines.pieces("norm")).alias("cut")).collect()}
    found = {(a, b): lines.PIECE * levenshtein(cut[a], cut[b]) for a, b in near}
    assert all(found[x] >= letters[x] for x in near) and any(found[x] <= most[x] for x in near)
    assert all(len(cut[i]) == len(re.findall("[^ ]{1,3} ?", x)) for i, x in own.items())


def test_no_pair_is_compared_by_letters_twice(spark, monkeypatch):
    """Pairs near in words and too far in letters meet in a block of two lines, and others in a crowd; each is compared once."""
    r = random.Random(24)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, common = [], [word() for _ in range(8)]
    for k in range(60):
        own = [*(common if k % 2 else (word() for _ in range(8))), *(word() for _ in range(40))]
        other = [word() if at >= 8 and at % 3 == 0 else w for at, w in enumerate(own)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    seen, compare = [], lines.in_letters
    monkeypatch.setattr(lines, "in_letters", lambda pairs, *a: (seen.extend(tuple(x) for x in pairs.collect()), compare(pairs, *a))[1])
    lines.dedup_lines(frame(spark, rows)).count()
    assert len(seen) > 10 and len(seen) == len(set(seen))


def test_runs_bound_the_distance_from_above(spark):
    """In letters and in words; a passage put into a long line is found by them."""
    r = random.Random(25)
    word = lambda: "".join(r.choice("abcdefoé𐐨") for _ in range(r.randint(1, 8)))
    own = {}
    for i in range(0, 40, 2):
        words = [word() for _ in range(r.randint(150, 400))]
        own[i] = " ".join(words)
        if i % 4:
            own[i + 1] = " ".join(word() if r.random() < 0.15 else w for w in words)
        else:
            at = r.randrange(len(words))
            own[i + 1] = " ".join([*words[:at], *(word() for _ in range(len(words) // 10)), *words[at:]])
    texts = lines.sketched(spark.createDataFrame(list(own.items()), "k1 long, norm string"))
    got = {x["k1"]: x for x in texts.select("k1", "norm", "code", F.expr(lines.runs("norm")).alias("runs"), F.expr(lines.word_runs("code")).alias("word_runs")).collect()}
    found = 0
    for i in range(0, 40, 2):
        a, b = got[i], got[i + 1]
        letters, words = lines.RUN * levenshtein(a["runs"], b["runs"]), lines.RUN_WORDS * levenshtein(a["word_runs"], b["word_runs"])
        assert letters >= levenshtein(a["norm"], b["norm"]) and words >= levenshtein(a["code"], b["code"])
        found += i % 4 == 0 and letters <= max(len(a["norm"]), len(b["norm"])) * 20 // 100 and words <= max(len(a["code"]), len(b["code"])) * lines.MAX_WORDS // 100
    assert found >= 5


# ------------------------------------------------------------------ 4 decontamination


@pytest.mark.parametrize("block", [3, 1000])
def test_decontamination(spark, block):
    r = random.Random(6)
    rows = [(i, (t or "").replace(" ", ", ") if i and i % 2 else t) for i, t in corpus(5)]
    source = [ALNUM.findall(low(t)) for _, t in rows]
    long = [x for x in source if len(x) > 40]
    items = [(str(100 + i), " ".join(r.choice(long)[5 : 5 + n]).upper()) for i, n in enumerate([20, 13, 12, 2, 1, 25, 30, 14])] + [("a", None), ("b", "..."), ("c", "zzz qqq"), ("100", "again zzz qqq")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n_words int")
    windows = collections.defaultdict(set)
    for item, text in items:
        own = ALNUM.findall(low(text))
        for j in range(max(1, len(own) - 12) if own else 0):
            windows[tuple(own[j : j + 13])].add(item)
    want = []
    for (doc, _), own in zip(rows, source, strict=True):
        hit, found = [False] * len(own), set()
        for x, who in windows.items():
            for j in range(len(own) - len(x) + 1):
                if tuple(own[j : j + len(x)]) == x:
                    hit[j : j + len(x)] = [True] * len(x)
                    found |= who
        n = sum(hit)
        want.append((doc, len(own), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(own)))
    docs = frame(spark, rows)
    got = decontaminate.digest(decontaminate.occurrences(docs, bench, block=block))
    assert rows_of(got) == sorted(want, key=lambda x: (x[0] is not None, *map(str, x)))
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not x[-1] for x in want)
    assert decontaminate.digest(decontaminate.occurrences(docs, bench.where("false"))).agg(F.sum("n_hit")).first()[0] == 0


# ------------------------------------------------------------------ 5 substrings


@pytest.mark.parametrize(("size", "block_bytes", "shard_keys"), [(35, 1 << 23, 1 << 21), (20, 3000, 200), (35, 1, 50)])
def test_substrings(spark, size, block_bytes, shard_keys):
    rows = corpus(7)
    source = [[x.encode() for x in SPACE.findall(t or "")] for _, t in rows]
    count = collections.Counter(tuple(x[j : j + size]) for x in source for j in range(len(x) - size + 1))
    want = []
    for (doc, _), own in zip(rows, source, strict=True):
        gone = [False] * len(own)
        for j in range(len(own) - size + 1):
            if count[tuple(own[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        want.append((doc, len(own), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(own, gone, strict=True) if not g)).hexdigest()))
    got = substrings.dedup(frame(spark, rows), size, block_bytes=block_bytes, shard_keys=shard_keys)
    assert rows_of(got) == sorted(want, key=lambda x: (x[0] is not None, *map(str, x)))
    assert substrings.dedup(frame(spark, [])).count() == 0


def test_substrings_of_many_null_ids(spark):
    """Of thousands of texts without an id, only those with the passage lose it."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"{i} {passage}" if i % 2 else f"{i} alone") for i in range(12000)]
    got = substrings.dedup(frame(spark, rows), with_text=True)
    assert {tuple(r) for r in got.select("n_removed", "kept").collect()} == {(40 * (i % 2), f"{i}" if i % 2 else f"{i} alone") for i in range(12000)}


# ------------------------------------------------------------------ 6 quality


def test_quality_measures(spark):
    r = random.Random(8)
    rows = corpus(9) + [(200 + i, "".join(r.choice(["a ", "b ", "c\n", "#x ", "é ", "\n", "<&> "]) for _ in range(40))) for i in range(30)]
    want = []
    for doc, text in rows:
        text = text or ""
        own = SPACE.findall(text)
        windows = collections.Counter(tuple(own[j : j + 5]) for j in range(len(own) - 4))
        inside = set()
        for j in range(len(own) - 4):
            if windows[tuple(own[j : j + 5])] > 1:
                inside |= set(range(j, j + 5))
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACE.search(line):
                dup += line in seen
                seen.add(line)
        want.append((doc, len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(own) < 10 or 100 * len(inside) > 20 * len(own)))
    got = quality.assess(frame(spark, rows), quality.Model(None))
    assert rows_of(got.drop("p_good", "kept")) == sorted(want, key=lambda x: (x[0] is not None, *map(str, x)))
    assert got.where("kept = base_failed").count() == 0 and quality.assess(frame(spark, []), quality.Model(None)).count() == 0


def test_quality_score_by_hand(spark):
    """The calibrated probability of each text from its words, pairs of words and character trigrams, with given weights."""
    import pyarrow as pa

    from tallyframe.llm import words as w

    weights = np.random.default_rng(4).normal(0, 0.2, 2 * quality.DIM).astype(np.float32)
    model = quality.Model(weights, 0.3, 1.7, -0.2)

    def bucket(*own):
        for _, _, data, offsets in w.texts(pa.array([" ".join(own)])):
            t = w.Words(data, offsets, w.SPACED, False)
            return int(t.hashes()[0] if len(own) == 1 else t.windows(t.hashes(), 2)[1][0]) % quality.DIM

    def trigram(a, b, c):
        m, cut = 0x9E3779B1, 2**32 - 1
        return ((((ord(a) * m & cut) ^ ord(b)) * m & cut ^ ord(c)) * m & cut) >> 16

    rows = [(i, t) for i, t in enumerate(["one two three two", "é日本 x", "a", "", None, "ab", "  \n\t", "Zwei Wörter\nund  mehr"])]
    want = {}
    for i, text in rows:
        text = text or ""
        own = SPACE.findall(text)
        words = [bucket(x) for x in own] + [bucket(*x) for x in zip(own, own[1:])]
        grams = [trigram(*x) for x in zip(text, text[1:], text[2:])]
        z = model.bias + quality.SCALE * (sum(weights[x] for x in words) / max(1, len(words)) + sum(weights[quality.DIM + x] for x in grams) / max(1, len(grams)))
        want[i] = 1 / (1 + math.exp(-(model.slope * z + model.offset)))
    got = {x["doc_id"]: x for x in quality.assess(frame(spark, rows), model).collect()}
    assert all(got[i]["p_good"] == pytest.approx(p, rel=1e-4) for i, p in want.items()) and all(x["kept"] == (not x["base_failed"] and x["p_good"] >= 0.5) for x in got.values())


def test_quality_verdict_on_labels_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    model = quality.fit(docs, learn)
    held = quality.assess(docs, model).join(labels.join(learn, "doc_id", "left_anti"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in held if r["quality"]]
    poor = [r["kept"] for r in held if not r["quality"]]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.2 * len(poor)
    left = quality.keep_good(docs, model)
    assert left.columns == docs.columns and left.count() == quality.assess(docs, model).where("kept").count()
    assert quality.fit(docs, labels.where("quality = 1")).weights is None and quality.fit(docs, labels.where("false")).weights is None


def test_quality_is_not_fitted_by_the_driver(spark, monkeypatch):
    """What the driver gets are the weights, not the features of the sample; labels of no document keep all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train, driver = quality._train, os.getpid()

    def elsewhere(*a):
        assert os.getpid() != driver
        return train(*a)

    monkeypatch.setattr(quality, "_train", elsewhere)
    model = quality.fit(docs, labels)
    assert model.weights.shape == (2 * quality.DIM,) and model.weights.any()
    assert quality.fit(docs, labels.withColumn("doc_id", -1 - F.col("doc_id"))).weights is None


# ------------------------------------------------------------------ 7 language model


def test_lm(spark):
    rows = corpus(11)
    tokens = [[x.encode() for x in SPACE.findall(low(t))] + [None] for _, t in rows]
    held = [doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in rows]
    count = collections.Counter(x for own, h in zip(tokens, held, strict=True) if not h for x in own)
    n, v = sum(count.values()), len(count)
    want = sorted((str(doc), h, len(own), sum(count[x] > 0 for x in own), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own), 6)) for (doc, _), own, h in zip(rows, tokens, held, strict=True))
    got = lm.score(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) and all(math.isfinite(r["score"]) for r in got)
    assert lm.score(frame(spark, [])).count() == 0
    alone = lm.score(frame(spark, [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 for r in alone)


class BackoffModel:
    """All words, pairs and triples, by dictionaries."""

    def __init__(self, texts):
        self.after = collections.defaultdict(collections.Counter)
        for own in texts:
            for i in range(1, len(own)):
                for k in range(3):
                    if i >= k:
                        self.after[tuple(own[i - k : i])][own[i]] += 1
        self.n, self.v = sum(self.after[()].values()), len(self.after[()])

    def p(self, history, token):
        """A seen context's own share and the shorter one's; the text begins with <, ends with >."""
        out = (self.after[()][token] + 1) / (self.n + self.v + 1)
        for k, prior in ((1, 4.0), (2, 2.0)):
            state = tuple(history[-k:])
            if len(history) >= k and state in self.after:
                size = sum(self.after[state].values())
                out = (self.after[state][token] + prior * out) / (size + prior)
        return out


@pytest.mark.parametrize("block_bytes, shard_keys", [(2000, 500), (1 << 23, 1 << 21)])
def test_lm_scores(spark, block_bytes, shard_keys):
    """Every n-gram counts, seen once or more, over many words; in blocks and shards of any size; texts longer than a stretch."""
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.choice([r.randrange(20), r.randrange(9000)])}" for _ in range(r.randint(0, 200)))) for i in range(200)] + [(200, None), (None, "w1 w2 once"), (201, "w1 w2 once")]
    rows += [(i, " ".join(f"w{r.randrange(50)}" for _ in range(n))) for i, n in ((300, 511), (301, 512), (302, 513), (303, 3000))]
    held = [doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2 for doc, _ in rows]
    assert any(held[-4:]) or len(set(held)) == 2
    tokens = [["<", *(t or "").split(), ">"] for _, t in rows]
    model = BackoffModel([own for own, h in zip(tokens, held, strict=True) if not h])
    want = sorted((str(doc), round(sum(math.log10(model.p(own[max(0, i - 2) : i], own[i])) for i in range(1, len(own))), 6)) for (doc, _), own in zip(rows, tokens, strict=True))
    got = lm.score(frame(spark, rows), block_bytes=block_bytes, shard_keys=shard_keys).collect()
    assert model.v > 5000 and sorted((str(x["doc_id"]), round(x["score"], 6)) for x in got) == want
    # in every state the probabilities add up to 1
    for history in (["<"], ["<", "w1"], ["w1", "w2"], ["w3", "w8999"], ["unseen", "w1"], ["w1", "unseen"]):
        assert sum(model.p(history, x) for x in [*model.after[()], "unseen"]) == pytest.approx(1)


# ------------------------------------------------------------------ 8 chat


def test_chat_round_trip(spark):
    r = random.Random(10)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "<\\s>", "x", "é", "\n", " "]
    turns = []
    for c in range(12):
        for n in range(r.randint(1, 6)):
            turns.append((c, n, r.choice(["user", "assistant", "system", "tool", None, "</s>"]), r.choice([None, "", "".join(r.choice(parts) for _ in range(12))])))
    turns += [(50, 0, "user", "a"), (50, 1, "assistant", "b"), (51, 0, "assistant", "b"), (None, 0, "user", "z"), (52, 1, "user", "same"), (52, 1, "user", "same"), (53, None, "user", "q")]
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, segment int, valid string").repartition(4)
    want = []
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, (t[2] or "").encode(), t[3] is not None, (t[3] or "").encode()))
        digest = hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own).encode()).hexdigest()
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        want.append((c, len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.read_back(chat.segments(df)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted((tuple(g)[:5] for g in got), key=key) == sorted(want, key=key)
    valid = {g["conv_id"]: g["valid"] for g in got}
    assert valid[50] and not valid[51] and not valid[None] and not valid[52]
    sizes = {x["conv_id"]: x["n"] for x in chat.segments(df).groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert {g["conv_id"]: g["formatted_chars"] for g in got} == sizes
    assert chat.read_back(chat.segments(df.where("false"))).count() == 0


def test_chat_of_the_query(spark):
    """All small conversations and the one that says control strings, by plain counts."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    turns = collections.defaultdict(list)
    for x in rows:
        turns[x["conv_id"]].append((x["turn"], x["role"], x["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {x["conv_id"]: x for x in queries.op8_chat_format(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        own = sorted(own)
        loss = "".join(t for _, role, t in own if role == "assistant")
        x = got[c]
        assert (x["n_turns"], x["loss_chars"], x["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest() and x["formatted_chars"] >= sum(len(t) for _, _, t in own)


def test_chat_escapes():
    t = chat.Template()
    for text in ("", "\\", "</s>", "<\\/s>", "\\</s>\\", "[INST][/INST]<s>", "<</s>s>"):
        made = t.escape(text)
        assert chat.unescape(made) == text and not any(c in made for c in t.controls)


# ------------------------------------------------------------------ 9 token counts


def counter():
    return tokencount.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edits_against_counting_anew():
    """Edits of all sizes, of trees as they are and as they were kept and read; only what is near an edit is tokenized again."""
    r, c = random.Random(3), counter()
    alpha = ["a", "b", "the ", "  ", "\n", "'", "s", "re", "1", "23", "!", "?? ", "é", "日", "\t", "   x", " 's", "'ll", ""]
    again = near = 0
    for _ in range(300):
        text = "".join(r.choice(alpha) for _ in range(r.choice([0, 1, 5, 50, 900, 9000])))
        tree = tokencount.TokenTree.build(text, c)
        for _ in range(5):
            at, n, new = r.randint(0, len(text) + 2), r.choice([0, 1, 3, 10, 200, 3000]), "".join(r.choice(alpha) for _ in range(r.choice([0, 1, 3, 40, 2000])))
            if r.random() < 0.3:
                tree = tokencount.TokenTree(*tree.rows(), c)
            text = text[:at] + new + text[at + n :]
            done = tree.edit(at, n, new)
            again += done
            near += len(c.pattern.findall(new))
            # what is beside the edit is a few pre-tokens, but for a long run of one kind
            assert done <= len(c.pattern.findall(new)) + 80
            assert tree.text() == text and tree.tokens == len(c.encoding.encode_ordinary(text)) and tree.length == len(text)
            kept, lens, counts, sizes = tree.rows()
            assert kept == text and lens.tolist() == [len(x) for x in c.pattern.findall(text)] and counts.sum() == tree.tokens and sizes.sum() == len(lens)
            assert tree.chars[1] == sum(x.chars for x in tree.leaves) and max(sizes, default=0) <= tokencount.FULL
    assert again < 1.2 * near


def test_recount(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (1, "one two three"), (None, "x")]
    edits = F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.array(F.struct(F.lit(3).alias("start"), F.lit(4).alias("length"), F.lit("!").alias("text")), F.struct(F.lit(None).cast("int").alias("start"), F.lit(0).alias("length"), F.lit("y").alias("text"))))
    got = rows_of(tokencount.recount(frame(spark, rows), edits, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    n = lambda t: len(counter().encoding.encode_ordinary(t))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(None, 2, n("x"), n("x!")), (1, 10, n("one two three"), n("one! three")), (1, 10, n("one two three"), n("one! three")), (2, 1, 0, n("!")), (3, 0, 0, 0)]
    # kept trees, with edits from a table
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = tokencount.staged(tokencount.build(frame(spark, rows), *args))
    table = trees.where("doc_id = 1").selectExpr("row", "explode(array(2, 1)) as seq").selectExpr("row", "seq", "if(seq = 1, 0, 3) as start", "if(seq = 1, 4, 1) as length", "if(seq = 1, '', '?!') as text")
    got = rows_of(tokencount.update(trees, table, *args).select("doc_id", "text", "n_tokens"))
    assert got == [(None, "x", n("x")), (1, "two?!three", n("two?!three")), (1, "two?!three", n("two?!three")), (2, "", 0), (3, "", 0)]


def test_token_counts_of_the_query(spark):
    """Over the small tables, every edit by slices of the text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op9_token_counts(spark, SF).collect()}
    n = lambda t: len(counter().encoding.encode_ordinary(t))
    assert len(got) == len(docs)
    for x in docs:
        text = x["text"] or ""
        size, edits = len(text), []
        for key, length, new in (("a", 7, " revised 2024 "), ("b", 0, "'s \n"), ("c", 3, ""), ("d", size // 10, " a new line,\n" * (size // 130))):
            edits.append((zlib.crc32(f"{x['doc_id']}{key}".encode()) % (size + 1), length, new))
        r, before = got[x["doc_id"]], n(text)
        for at, length, new in edits:
            text = text[:at] + new + text[at + length :]
        assert (r["n_tokens_before"], r["n_tokens_after"], r["n_chars_after"]) == (before, n(text), len(text)) and r["n_recounted"] <= len(counter().pattern.findall("".join(e[2] for e in edits))) + 80


# ------------------------------------------------------------------ 10 packing


def test_every_vocabulary_token_comes_from_its_own_merge():
    """With this, merging by ranks of results equals merging by ranks of pairs."""
    import json

    with open(WORD_BPE, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    ranks = {m: i for i, m in enumerate(merges)}
    assert len({a + b for a, b in merges}) == len(merges)
    letters = wordbpe.byte_letters()
    for a, b in merges:
        token = a + b
        end = token.endswith("</w>")
        parts = [c for c in (token[:-4] if end else token)]
        assert all(c in letters for c in parts)
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), len(ranks)), i))
            assert (parts[best], parts[best + 1]) in ranks
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        assert parts == [token]


ODD = ["Hello'S world's <|endoftext|> x", "", None, "café CAFÉ Σίσυφος ΣΑΣ", "naïve   12345 ½ a b \x00\x01 c", "don't I'LL we'Ve", "日本語 テスト", "́abc é", "İstanbul ǅ ß", "a!b?c...d --- __x__", "🤖🤖 ok\x85next\u00a0line"]


def test_ids_are_the_librarys():
    import pyarrow as pa

    from tallyframe.llm import words as w

    e = wordbpe.encoder(WORD_BPE)
    texts = ODD + [t for _, t in corpus(12)]
    for chunk in (10, 1 << 20):
        for a, _, data, offsets in w.texts(pa.array(texts), chunk):
            ids, bounds = e.encode(data, offsets)
            for i in range(len(offsets) - 1):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == [*e.library.encode(texts[a + i] or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("size", [2048, 16])
def test_packing(spark, size):
    rows = corpus(13) + [(300 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack_documents(frame(spark, rows), WORD_BPE, size).collect()
    e = wordbpe.encoder(WORD_BPE)
    want = collections.Counter()
    for doc, text in rows:
        ids = [*e.library.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), size)):
            piece = ids[at : at + size]
            want[doc, p, at, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    least = -(-sum(r["length"] for r in got) // size)
    assert len(sequences) <= least * 1.1 + 2
    assert packing.pack_documents(frame(spark, []), WORD_BPE, size).count() == 0


def test_packing_of_equal_rows(spark):
    """Thousands of pieces that are equal in all columns take a place each, and no salt has most of them."""
    docs = frame(spark, [(None, "")] * 5000 + [(1, "a b c")] * 3000)
    got = packing.pack_documents(docs, WORD_BPE, 16).collect()
    places = {(r["sequence_id"], r["offset"] + i) for r in got for i in range(r["length"])}
    assert len(got) == 8000 and len(places) == sum(r["length"] for r in got) and len({s for s, _ in places}) == -(-len(places) // 16)


def test_plan_is_best_fit_decreasing():
    r = random.Random(5)
    for _ in range(60):
        size = r.choice([10, 50, 100])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 200))]
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fit = [i for i, room in enumerate(rooms) if room >= x]
            if fit:
                rooms[min(fit, key=lambda i: rooms[i])] -= x
            else:
                rooms.append(size - x)
        taken = {}
        for length, lo, hi, first, each, offset in packing.plan(collections.Counter(lengths), size):
            for rank in range(lo, hi):
                taken[length, rank] = (first + (rank - lo) // each, offset + (rank - lo) % each * length)
        assert collections.Counter(x for x, _ in taken) == collections.Counter(lengths)
        assert len({s for s, _ in taken.values()}) == len(rooms)
        places = sorted((s, o, x) for (x, _), (s, o) in taken.items())
        at, last = 0, None
        for s, o, x in places:
            at = 0 if s != last else at
            assert o == at and o + x <= size
            at, last = at + x, s
