"""Fitted models: gradients and marginals against enumeration, held-out accuracy, odd rows."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablescore.llm import language_id, quality_crf, toxicity
from tablescore.llm._sample import labelled_ids, labelled_texts
from tablescore.llm._text import string_bytes

SYLLABLES = {"en": ["the", "ing", "er", "on", "an", "re"], "fr": ["é", "que", "eau", "oi", "le", "ai"], "de": ["sch", "ung", "ä", "keit", "ver", "ein"]}


def sentence(draw, lang):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(draw.randint(5, 12))).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(6)
    rows = []
    for k in range(600):
        lang, bad, toxic = draw.choice(list(SYLLABLES)), draw.random() < 0.3, draw.random() < 0.2
        lines = [" ".join(sentence(draw, lang) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(1, 8))]
        if bad:
            lines = [draw.choice(["|".join(x.split()), x.upper().replace(" ", "!! "), x.replace(" ", "### ")]) for x in lines]
        if toxic:
            at = draw.randrange(len(lines))
            lines[at] = lines[at].replace(" ", f" {draw.choice(['vilebad', 'Awfulling', 'awfuller'])} ", 1) if " " in lines[at] else "vilebad"
        rows.append((k, "\n".join(lines), lang, int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame([(k, t, lang, "clash") for k, t, lang, _, _ in corpus], "doc_id long, text string, lang string, score string")
    odd = [(901, None, None, ""), (902, "", "en", ""), (903, " \n\t\n", "en", ""), (904, "123 456 !!", "en", ""), (None, "the ing", "en", ""), (905, "x" * 200_000, "en", ""), (906, "a\n" * 5000, "en", ""), (1, corpus[1][1], "en", "")]
    labels = spark.createDataFrame([(k, q, t) for k, _, _, q, t in corpus] + [(None, 1, 0), (902, None, None), (7, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)), labels


def usable():
    return F.coalesce(F.col("doc_id") % 4, F.lit(0)) != 2



def accuracy(rows, corpus, column, want):
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 4 == 2]
    return np.mean([getattr(r, column) == want(corpus[r.doc_id]) for r in held])


def test_marginals_are_those_of_enumeration():
    draw = np.random.default_rng(1)
    score, at, tie = draw.normal(size=9), np.array([0, 4, 5, 9]), draw.normal(size=(2, 2))
    got, pairs = quality_crf.marginals(score, at, tie)
    for d, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        total, good, joint = 0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] * y[i] for i in range(b - a)) + sum(tie[p, q] for p, q in itertools.pairwise(y)))
            total, good = total + w, good + w * np.array(y)
            for p, q in itertools.pairwise(y):
                joint[p, q] += w
        assert got[a:b] == pytest.approx(good / total) and pairs[d] == pytest.approx(joint / total)


def test_lines_of_texts():
    texts = ["a b\n\nC|d", "", None, "\n", "x", "y\n", "é é é\nz"]
    data, offsets = string_bytes(pa.array(texts))
    x, length, at = quality_crf.line_features(data, offsets)
    assert np.diff(at).tolist() == [2, 1, 1, 1, 1, 1, 2]
    assert length.tolist() == [4, 3, 0, 0, 0, 1, 2, 9, 1]
    assert x.shape == (9, quality_crf.N_FEATURES) and np.isfinite(x).all()


def test_document_quality_is_that_of_enumeration():
    draw = np.random.default_rng(5)
    model = quality_crf.Crf(draw.normal(size=quality_crf.N_FEATURES), draw.uniform(0.5, 2, quality_crf.N_FEATURES), draw.normal(size=quality_crf.N_FEATURES) / 4, draw.normal(size=(2, 2)))
    texts = ["One line here.", "a b\nC | d\n\nLONG LINE OF MANY WORDS!!", "", "x\ny z\n\n\nq", None]
    data, offsets = string_bytes(pa.array(texts))
    got = model.score(data, offsets)
    x, length, at = quality_crf.line_features(data, offsets)
    odds = ((x - model.mean) / model.scale) @ model.weight
    for d, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        total, good = 0.0, 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(odds[a + i] * y[i] for i in range(b - a)) + sum(model.tie[p, q] for p, q in itertools.pairwise(y)))
            total, good = total + w, good + w * sum((length[a + i] + 1) * y[i] for i in range(b - a))
        assert got[d] == pytest.approx(good / total / sum(length[a:b] + 1))


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, "x" * (100 + k % 7)) for k in range(5000)] + [(60, "y" * 90_000), (61, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(62)], "doc_id long, label int")
    ids = labelled_ids(labels, key="doc_id", label="label", usable=F.lit(True), per_class=100)
    texts, y, _ = labelled_texts(docs, ids, key="doc_id", text="text", most_bytes=50_000, total_bytes=10**9)
    assert len(texts) == 50 and y.tolist() == [k % 2 for k in range(50)]
    texts, y, _ = labelled_texts(docs, ids, key="doc_id", text="text", most_bytes=50_000, total_bytes=2000)
    assert 18 <= len(texts) <= 22 and abs(y.sum() * 2 - len(y)) <= 1
    assert sum(len(t.as_py()) for t in texts) <= 2000 + 2 * 106


def test_quality(tables, corpus):
    docs, labels = tables
    model = quality_crf.train(docs, labels, usable=usable())
    scored = quality_crf.score_quality(docs, model)
    assert scored.columns == ["doc_id", "text", "lang", "score"]
    rows = scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int")).collect()
    assert len(rows) == 608 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, corpus, "predicted", lambda c: c[3]) > 0.97
    assert len({r.score for r in rows if r.doc_id in (901, 902, 903)}) == 1
    flat = quality_crf.train(docs, labels.limit(0), usable=usable())
    assert {r.score for r in quality_crf.score_quality(docs, flat).collect()} == {0.5}
    assert quality_crf.score_quality(docs.limit(0), model).count() == 0


def test_toxicity(tables, corpus):
    docs, labels = tables
    model = toxicity.train(docs, labels, usable=usable())
    rows = toxicity.score_toxicity(docs, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int")).collect()
    assert len(rows) == 608 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, corpus, "predicted", lambda c: c[4]) > 0.97
    for r in rows:
        if r.doc_id is not None and r.doc_id < 600 and corpus[r.doc_id][4] and r.predicted:
            said = [r.text.encode()[s.begin : s.end].decode().lower() for s in r.toxic_sentences]
            assert said and all("vilebad" in s or "awfull" in s for s in said)
    clean = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)), usable=usable())
    assert max(r.score for r in toxicity.score_toxicity(docs, clean).collect()) < 1e-9
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_noisy_or_is_the_product_over_distinct_sentences():
    data, offsets = string_bytes(pa.array(["one two. three! one two. one", "", "four"]))
    bag = toxicity.Bag(data, offsets)
    weight = np.random.default_rng(2).normal(size=1 << 20).astype(np.float32)
    odds = bag.log_odds(weight, -1.0)
    p = 1 / (1 + np.exp(-odds))
    assert bag.text.tolist() == [0, 0, 0, 0, 1, 2]
    want = [1 - (1 - p[0]) * (1 - p[1]) * (1 - p[3]), p[4], p[5]]
    assert odds[0] == odds[2] and bag.text_score(odds) == pytest.approx(want)


def test_languages(tables, corpus):
    docs, _ = tables
    model = language_id.train(docs, usable=usable())
    rows = language_id.predict_language(docs, model).collect()
    assert len(rows) == 608 and all(0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, corpus, "lang_pred", lambda c: c[2]) > 0.97
    assert {r.lang_pred for r in rows if r.doc_id in (901, 902, 903, 904)} == {"und"}
    none = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")), usable=usable())
    assert {r.lang_pred for r in language_id.predict_language(docs, none).collect()} == {"und"}
    assert language_id.predict_language(docs.limit(0), model).count() == 0


def test_with_all_landmarks_it_is_dense_kernel_ridge(corpus):
    some, params = corpus[:60], language_id.LangParams(landmarks=1000, ridge=0.03)
    texts, names = [c[1][:300] for c in some], sorted(SYLLABLES)
    y = np.array([names.index(c[2]) for c in some])
    model = language_id.fit(pa.chunked_array([pa.array(texts)]), y, names, params)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    sets = [grams(lower(t)) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    share = 1 / np.bincount(y)[y]
    n = len(y)
    system = np.block([[gram + params.ridge * share.sum() * np.diag(1 / share), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([np.where(y[:, None] == np.arange(3), 1.0, -1.0), np.zeros((1, 3))]))
    new = [c[1][:200] for c in corpus[60:90]]
    known = set().union(*sets)
    rows = []
    for t in new:
        own = grams(lower(t)) & known
        rows.append([len(own & s) / np.sqrt(len(own) * len(s)) for s in sets])
    data, offsets = string_bytes(pa.array(new))
    assert model.outputs(data, offsets) == pytest.approx(np.array(rows) @ solved[:-1] + solved[-1], abs=2e-3)


def test_fit_blames_the_word_that_toxic_texts_share():
    clean = [f"good words here {k}. more of them {k % 3}." for k in range(40)]
    toxic = [f"good words here {k}. vilebad {k % 3}. more of them." for k in range(8)]
    texts, y = pa.chunked_array([pa.array(clean + toxic)]), np.array([0] * 40 + [1] * 8)
    model = toxicity.fit(texts, y, np.ones(48))
    data, offsets = string_bytes(pa.array([*clean[:3], *toxic[:3], "vilebad", "words more good"]))
    bag = toxicity.Bag(data, offsets)
    odds = bag.log_odds(model.weight, model.bias)
    brute = [1 - np.prod([1 - 1 / (1 + np.exp(-o)) for o, t, c in zip(odds, bag.text, bag.counts, strict=True) if t == d and c]) for d in range(8)]
    assert bag.text_score(odds) == pytest.approx(brute)
    assert max(brute[:3]) < 0.1 and min(brute[3:7]) > 0.6 and brute[7] < brute[6]
    assert [int(np.argmax(odds[bag.text == d])) for d in (3, 4, 5)] == [1, 1, 1]


def test_kernel_rows_are_shared_ngrams():
    texts = ["abcab", "the Cat", "é", "cab"]
    column = pa.chunked_array([pa.array(texts)])
    model = language_id.fit(column, np.array([0, 1, 1, 0]), ["x", "y"], language_id.LangParams(landmarks=2))
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in (x.lower().encode() for x in texts)]
    space = grams[0] | grams[1] | grams[2] | grams[3]
    data, offsets = string_bytes(pa.array([*texts, "zzab"]))
    got = model.kernel(data, offsets)[:, :-1]
    marks = [grams[0], grams[3], grams[1], grams[2]]
    for row, g in zip(got, [*grams, {b"a", b"b", b"ab"} & space], strict=True):
        assert row == pytest.approx([len(g & m) / np.sqrt(len(g) * len(m)) for m in marks])


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    texts = [(k, t, lang, "s", len(t)) for k, t, lang, _, _ in corpus] + [(700 + k, corpus[k][1], "en", "s", 1) for k in range(20)]
    item = " ".join(sentence(random.Random(9), "en") for _ in range(4))
    texts += [(800, corpus[3][1] + "\n" + item, "en", "s", 1), (801, None, None, None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q, t) for k, _, _, q, t in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    good = {k for k, _, _, q, _ in corpus if q}
    assert all(r.round_trip for r in rows) and len(kept) == len(rows) and 800 not in kept
    for k in range(20):
        assert k not in kept and (700 + k in kept) == (k in good)
    assert len(good - kept - set(range(20))) <= 0.02 * len(good) and len(kept - good - set(range(700, 802))) <= 5


def test_pipeline_stages_against_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline
    from test_counting import FOLD, brute_components

    from tablescore.llm import decontamination
    from tablescore.llm.queries import PIECE_MODEL, remainder

    draw = random.Random(21)
    items = [" ".join(sentence(draw, "de") for _ in range(3)) for _ in range(4)]
    texts = {k: t for k, t, _, _, _ in corpus[:250]}
    for k in range(12):
        words = texts[k].split(" ")
        words[draw.randrange(len(words))] = "another"
        texts |= {300 + k: texts[k], 400 + k: texts[k].upper(), 500 + k: " ".join(words), 600 + k: f"{texts[100 + k]}\n{items[k % 4].replace('e', 'x', 2)} {texts[130 + k]}"}
    texts |= {700: None, 701: "", 702: " \n"}
    rows = [(k, t, "en", "s", len(t or ""), "clash") for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece_ids string")
    labels = [(k, q) for k, _, _, q, _ in corpus[:250]]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, model = texts, quality_crf.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), usable=remainder(5) != 0)

    def good(some):
        scores = model.score(*string_bytes(pa.array(list(some.values()), pa.string())))
        return {k for k, s in zip(some, scores, strict=True) if s >= 0.3}

    def whole(some):
        last = {}
        for k, t in some.items():
            last[(t or "").translate(FOLD)] = max(k, last.get((t or "").translate(FOLD), k))
        return set(last.values())

    def apart(some):
        ids = sorted(some)
        _, first = brute_components([some[k] for k in ids])
        return {k for n, k in enumerate(ids) if first[n] == n}

    def clean(some):
        plain = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").translate(FOLD)).split())
        hold = lambda t: any(decontamination.best_distance(plain(x), plain(t)) <= int(0.2 * len(plain(x))) for x in items)
        return {k for k, t in some.items() if not hold(t)}

    for n, ((_, stage), brute) in enumerate(zip(corpus_pipeline.STAGES[:4], (good, whole, apart, clean), strict=True)):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids"]
        path = f"{tmp_path}/stage{n}"
        docs.write.parquet(path)
        docs, want = spark.read.parquet(path), brute(left)
        assert len(want) < len(left)
        left = {k: left[k] for k in want}
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(left.items())
    if not os.path.exists(PIECE_MODEL):
        pytest.skip("no vocabulary file here")
    import sentencepiece

    library, coder = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert coder.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "n_pieces", "round_trip"]
    assert sorted((r.doc_id, r.piece_ids, r.n_pieces, r.round_trip) for r in coder.collect()) == sorted((k, library.encode(t or ""), len(library.encode(t or "")), True) for k, t in left.items())
