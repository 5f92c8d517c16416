"""Language-model scoring, exact dedup and the n-gram join against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescore.llm import exact_dedup, lm_scoring, ngram_join
from tablescore.llm._exchange import pack, pack_counts, unpack, unpack_counts
from tablescore.llm._text import Words, string_bytes

FOLD = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, score double, held_out string, __key int, kept string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0.5, "x", 7, "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(3)
    vocabulary = [draw.choice("ABCdefghé") + str(k) for k in range(300)]
    return [" ".join(draw.choices(vocabulary, k=draw.randint(1, 80))) for _ in range(150)] + [None, "", " \n\t ", "One", "one"]


def test_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    for some in (keys, keys[:1], keys[:0], np.arange(9, dtype=np.uint64)):
        assert (unpack(pack(some)) == some).all()
    assert unpack_counts(pack_counts(np.array([0, 1, 70000]))).tolist() == [0, 1, 70000]


def test_words_are_those_of_the_pattern(prose):
    import pyarrow as pa

    texts = [*prose, "a b\x0bc\x0cd\re", "x" * 5000, " a", "b "]
    w = Words(*string_bytes(pa.array(texts)))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert [g.translate(FOLD) for g in got] == [x for t in texts for x in words(t)]
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_counts_and_mixture(spark, prose, order):
    params = lm_scoring.LmParams(order=order)
    got = lm_scoring.score_documents(frame(spark, prose), text="text", key="doc_id", held_out=F.col("doc_id") % 7 == 2, part=F.col("doc_id") % 7, params=params, buckets=5)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(prose)
    tokens = {i: [*words(t), None] for i, t in enumerate(prose)}
    train = {i: t for i, t in tokens.items() if i % 7 != 2}
    count = collections.Counter(x for t in train.values() for x in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 7 == 2, len(t), sum(x in count for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t))
    # The mixture, with weights learnt by brute force on exact probabilities of the deleted part.
    grams = lambda t, k: [tuple((["<s>"] * (k - 1) + t)[j : j + k]) for j in range(len(t))]

    def tables(docs):
        c = [collections.Counter(g for t in docs for g in grams(t, k)) for k in range(1, order + 1)]
        h = [collections.Counter(g[:-1] for t in docs for g in grams(t, k)) for k in range(1, order + 1)]
        return c, h

    def estimates(t, c, h):
        for j in range(len(t)):
            p = [1 / (v + 1)]
            for k in range(1, order + 1):
                g = grams(t, k)[j]
                p.append(c[k - 1][g] / max(h[k - 1][g[:-1]], 1))
            seen = h[-1][grams(t, order)[j][:-1]] if order > 1 else 0
            yield min(int(math.log2(seen + 1)) + (seen > 0), params.context_buckets - 1), np.array(p)

    c, h = tables([t for i, t in train.items() if i % 7 != 3])
    held = collections.defaultdict(list)
    for i, t in train.items():
        if i % 7 == 3:
            for b, p in estimates(t, c, h):
                held[b].append(p)
    weights = np.full((params.context_buckets, order + 1), 1 / (order + 1))
    for b in range(params.context_buckets):
        if b in held:
            p, w = np.array(held[b]), weights[b]
            for _ in range(params.em_rounds):
                share = p * w
                w = (share / share.sum(1, keepdims=True)).mean(0)
            weights[b] = np.maximum(w, [1e-6] + [0] * order)
            weights[b] /= weights[b].sum()
        elif b:
            weights[b] = weights[b - 1]
    c, h = tables(list(train.values()))
    for i, t in tokens.items():
        exact = sum(math.log10(weights[b] @ p) for b, p in estimates(t, c, h))
        assert rows[i].score == pytest.approx(exact, rel=1e-4), i


def test_lm_empty_table(spark, prose):
    got = lm_scoring.score_documents(frame(spark, prose).limit(0), text="text", key="doc_id", held_out=F.lit(False), part=F.lit(0))
    assert got.count() == 0


def test_exact_groups(spark, prose):
    texts = [*prose, *prose[:40], "ÀB", "Àb", "àb", prose[0].upper()]
    ids = [*range(len(texts) - 1), 3]  # one id twice
    rows = exact_dedup.duplicate_groups(frame(spark, texts, ids)).collect()
    normal = [(t or "").translate(FOLD) for t in texts]
    groups = collections.defaultdict(list)
    for i, t in zip(ids, normal, strict=True):
        groups[t].append(i)
    want = sorted((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, normal, strict=True))
    assert sorted(tuple(r) for r in rows) == want
    left = exact_dedup.drop_copies(frame(spark, texts, ids))
    assert left.columns == DOCS.replace(" string", "").replace(" double", "").replace(" long", "").replace(" int", "").split(", ")
    assert sorted((r.text or "").translate(FOLD) for r in left.collect()) == sorted(groups)
    assert exact_dedup.duplicate_groups(frame(spark, texts, ids).limit(0)).count() == 0


def test_exact_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs).collect())
    assert rows == [(0, 0, 2, True), (0, 0, 2, True), (0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup.drop_copies(docs).count() == 2


def shingle_set(text, width=5):
    w = words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(texts, percent=75):
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(x) for x in range(len(texts))]


def near_copies(seed):
    """Groups whose members differ from a base, and from each other's copies, by more and more words."""
    draw = random.Random(seed)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    texts, passage = [], fresh(60)
    for _ in range(4):
        base = fresh(150)
        for _ in range(12):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 3, 5, 8])):
                copy[draw.randrange(len(copy))] = fresh(1)[0]
            texts.append(" ".join(copy))
        chain = list(base)
        for _ in range(10):  # each close to the one before, the last far from the first
            at = draw.randrange(120)
            chain[at : at + 12] = fresh(12)
            texts.append(" ".join(chain))
    texts += [" ".join(fresh(40) + passage + fresh(draw.randint(0, 60))) for _ in range(25)]
    texts += [" ".join(passage + fresh(draw.randint(0, 15))) for _ in range(15)]
    texts += ["a b c", "A b  C", "a b", "", None, "a b c d e", "a b c d e f"]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_join_components(spark, seed):
    texts = near_copies(seed)
    docs = frame(spark, texts).withColumnRenamed("__key", "component_id")
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs, blocks=3).collect()}
    sizes, labels = brute_components(texts)
    assert rows == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, labels, strict=True))}


def test_join_edge_rows(spark):
    docs = spark.createDataFrame([(5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "q"), (9, None), (7, "X  y\nz")], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in ngram_join.similar_components(docs).collect()))
    assert rows == [(-1, 1, -1), (-1, 1, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 0, 9)]
    assert ngram_join.similar_components(docs.limit(0)).count() == 0


def test_join_of_rows_that_repeat(spark):
    base = [f"w{k}" for k in range(40)]
    near = base[:-1] + ["other"]
    texts = [" ".join(base), " ".join(near), "quite another text of its own"]
    rows = [(1, texts[0])] * 1000 + [(2, texts[1])] * 1000 + [(2, " ".join(base[:20]))] * 500 + [(3, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.similar_components(docs).groupBy("doc_id", "n_shingles", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 36, 1, 1000), (2, 16, 1, 500), (2, 36, 1, 1000), (3, 2, 3, 1)]
    reps = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "rep long, rows long").withColumn("rows", F.lit(2))
    assert ngram_join._fewer(docs.withColumnRenamed("doc_id", "key"), reps).count() == 4


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_blocks_and_ranges_of_any_number(spark, prose, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = frame(spark, prose[:40])
        scored = lm_scoring.score_documents(docs, text="text", key="doc_id", held_out=F.col("doc_id") % 7 == 2, part=F.col("doc_id") % 7)
        assert scored.count() == 40
        assert ngram_join.similar_components(docs).count() == 40 == exact_dedup.duplicate_groups(docs).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_lm_blocks_of_any_size_and_long_texts(spark, prose):
    texts = [*prose, " ".join(prose[3:90] * 20), "x" * 300_000]
    run = lambda **more: sorted(map(tuple, lm_scoring.score_documents(frame(spark, texts), text="text", key="doc_id", held_out=F.col("doc_id") % 7 == 2, part=F.col("doc_id") % 7, params=lm_scoring.LmParams(**more)).collect()))
    for a, b in zip(run(), run(block_bytes=2000, range_bytes=5000), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_large_groups_are_spread(spark):
    texts = ["same"] * 900 + ["other"] * 70 + [f"t{k // 2}" for k in range(100)]
    rows = exact_dedup.duplicate_groups(frame(spark, texts)).collect()
    sizes = collections.Counter(texts)
    last = {t: i for i, t in enumerate(texts)}
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(i, last[t], sizes[t]) for i, t in enumerate(texts)]
    assert exact_dedup.drop_copies(frame(spark, texts)).count() == len(sizes)


def test_filter_has_all_slots_that_repeat(spark):
    docs = spark.range(0, 70_000).select(F.sha2(F.col("id").cast("string"), 256).alias("__digest"))
    docs = docs.unionByName(docs.limit(5000))
    pages, bits = exact_dedup.repeat_filter(docs)
    slots = docs.select(F.explode(F.array_distinct(F.array(*exact_dedup._slots(bits)))).alias("s")).groupBy("s").count().filter("count > 1")
    want = sorted(r.s for r in slots.collect())
    got = sorted(p.page * exact_dedup._PAGE + int(k) for p in pages.collect() for k in np.flatnonzero(np.unpackbits(np.frombuffer(p.bitmap, np.uint8), bitorder="little")))
    assert got == want
