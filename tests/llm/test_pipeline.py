"""The pipeline's stages, one after the other, against brute force over the small tables."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.test_operators import ALNUM, WORD_BPE, levenshtein, low, majority, normal, shingles, stretches

import corpus_pipeline
from tallyframe.llm import quality, wordbpe


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def without_repeated_lines(spark, docs):
    flat = sorted({normal(x) for t in docs.values() for x in t.split("\n") if len(normal(x).split(" ")) >= 5})
    hashes = {x["w"]: x["h"] for x in spark.createDataFrame([(x,) for x in {w for t in flat for w in t.split(" ")}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    sims, cuts = {x: majority([hashes[w] for w in x.split(" ")]) for x in flat}, {x: stretches(x.split(" ")) for x in flat}
    parent = {x: x for x in flat}
    for i, a in enumerate(flat):
        for b in flat[:i]:
            if cuts[a] & cuts[b] and (sims[a] ^ sims[b]).bit_count() <= 18 and levenshtein(a, b) <= max(len(a), len(b)) * 20 // 100:
                parent[root_of(parent, a)] = root_of(parent, b)
    first, out = {}, {}
    for doc in sorted(docs):
        kept = []
        for n, x in enumerate(docs[doc].split("\n")):
            y = normal(x)
            if len(y.split(" ")) < 5 or first.setdefault(root_of(parent, y), (doc, n)) == (doc, n):
                kept.append(x)
        out[doc] = "\n".join(kept)
    return out


def one_of_each_group(docs):
    sets = {i: shingles(t, 5) for i, t in docs.items()}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = collections.Counter((a, b) for own in holders.values() for a in own for b in own if a < b)
    parent = {i: i for i in docs}
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root_of(parent, a), root_of(parent, b)
            parent[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if root_of(parent, i) == i}


def clean(docs, items):
    windows = set()
    for text in items:
        own = ALNUM.findall(low(text))
        windows |= {tuple(own[j : j + 13]) for j in range(max(1, len(own) - 12) if own else 0)}
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in docs.items():
        own = ALNUM.findall(low(text))
        hit = [False] * len(own)
        for n in sizes:
            for j in range(len(own) - n + 1):
                if tuple(own[j : j + n]) in windows:
                    hit[j : j + n] = [True] * n
        if not sum(hit) or 20 * sum(hit) < len(own):
            out[i] = text
    return out


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.assess(docs, model).where("kept").collect()}
    want = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    got = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = corpus_pipeline.staged(stage(spark, got, SF))
        if name == "line_dedup":
            want = without_repeated_lines(spark, want)
        elif name == "ngram_jaccard":
            want = one_of_each_group(want)
        elif name == "decontamination":
            want = clean(want, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
        if i < 4:
            assert sorted(got.columns) == sorted(docs.columns)
            assert {r["doc_id"]: r["text"] for r in got.collect()} == want, name
    e = wordbpe.encoder(WORD_BPE)
    pieces = collections.Counter()
    for doc, text in want.items():
        ids = [*e.library.encode(text, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            pieces[doc, p, at, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == pieces


def test_edges(spark, tmp_path):
    """No rows; and nulls, empty and repeated rows, null ids, labels of nothing, and columns of names that the stages use."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, row int, h string, key long, block int, starts string"
    one = "a good many words stand here so that the rules of quality let this pass as it is"
    two = "quite another text with words enough of its own and nothing that it shares with the first one"
    rows = [(1, one), (1, one), (2, None), (None, two), (3, ""), (4, one + " indeed"), (5, "few words")]
    for name, own in (("none", []), ("some", [(i, t, "en", "s", len(t or ""), 1, "h", 2, 3, "s") for i, t in rows])):
        d = tmp_path / name
        spark.createDataFrame(own, kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(99, 1, 0)] if own else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(None, None), ("x", "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.staged(f(spark, docs, str(d)))
            assert docs.columns == [c.split()[0] for c in kind.split(", ")], stage
        left = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in docs.collect())
        # equal lines go but for the first, whose null id sorts before the others; texts that lose all their lines have no words and stay
        assert [x for x in left if x[2]] == ([(False, 0, two), (True, 1, one)] if own else [])
        out = corpus_pipeline.run(spark, str(d)).collect()
        assert len(out) == len(left) and {x["sequence_id"] for x in out} == ({0} if own else set())
