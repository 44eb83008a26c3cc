"""Toxicity, quality and the pipeline: held-out accuracy, unseen spellings, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spendlens.llm.learning import labelled_sample, logistic, sigmoid
from spendlens.llm.near_duplicates import near_duplicates
from spendlens.llm.quality import ArrayPool, StoredPool, Views, co_train, featured, fit_quality, good_documents, score_quality
from spendlens.llm import toxicity
from spendlens.llm.toxicity import (WINDOW, Scorer, ToxicityModel, all_grams, best_cut, core, fit_toxicity, grams, harmless_documents,
                                    score_toxicity, train, window_starts)

DOCS = "label string, doc_id long, text string, lang string, source string, n_chars long, score string"
BAD = ["idiot", "moron", "pathetic"]


def corpus(n=1500, seed=1):
    """Plain prose, a fifth with a few insults in a long text, another fifth junk."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(30, 220))]
        toxic, junk = i % 5 == 1, i % 5 == 2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        if junk:
            text = [w.upper() + "!!" for w in text] if i % 2 else [text[0]] * len(text)
        joined = " ".join(text)
        rows.append(("l", i, joined, "en", f"s{i % 3}", len(joined), "s"))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def odd_rows():
    return [("l", 9000 + k, t, None, None, None, "s") for k, t in enumerate([None, "", " \n ", "!!! ???", "word " * 30_000])] + [
        ("l", None, "no id", "en", "s0", 5, "s"), ("l", 0, "again", "en", "s0", 5, "s"), ("l", 0, "again", "en", "s0", 5, "s")]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + odd_rows(), DOCS).repartition(3)
    labels = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def apart(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity(spark, tables):
    docs, labels = tables
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id is not null and toxic is not null").collect()}
    held = [r["predicted"] == toxic[r["doc_id"]] for r in got if r["doc_id"] in toxic and r["doc_id"] != 0 and apart(r["doc_id"])]
    assert np.mean(held) >= 0.95
    odd = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] and r["doc_id"] >= 9000}
    assert len(odd) == 5 and not any(odd.values())
    filler = "nothing to see here at all " * 4
    spelt = spark.createDataFrame([(1, f"{filler} moronn {filler}"), (2, filler)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in score_toxicity(spelt, model).collect()}
    assert score[1] > score[2]
    kept = harmless_documents(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r["predicted"] for r in got)


def test_toxicity_without_labels(spark, tables):
    docs, labels = tables
    none = fit_toxicity(docs, labels.limit(0))
    assert {r["score"] for r in score_toxicity(docs, none).collect()} == {0.0}
    assert score_toxicity(docs.limit(0), none).count() == 0
    assert {r["score"] for r in score_toxicity(docs, fit_toxicity(docs, labels.where("toxic = 1"))).collect()} == {1.0}


def test_window_pieces():
    for n in (1, WINDOW - 1, WINDOW, WINDOW + 1, 1000):
        starts = window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + WINDOW))}
        assert covered == set(range(n))
    assert core("((Idiot!!") == "idiot" and core("...") == "" and grams("") == [] and len(grams("ab")) == 3
    assert best_cut(np.array([3.0, 2.0, 1.0, 1.0]), np.array([1, 1, 0, 0]), np.ones(4)) == 1.5
    scorer = Scorer(ToxicityModel(np.zeros(1 << 18, np.float32), -1.0))
    assert scorer.logits([None, "", "a b"]) == [(-1.0, 0)] * 3


def test_scoring_takes_no_step_per_gram(monkeypatch):
    """N-grams of all new words are hashed together, to the buckets that ``grams`` gives word by word."""
    rng = random.Random(6)
    words = ["", "a", "ab", "\U0010ffff"] + ["".join(rng.choice("abz0éßñΣ中文🙂\u0301\x7f\u07ff\u0800") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    flat, owner = all_grams(words)
    order = np.argsort(owner, kind="stable")
    for word, got in zip(words, np.split(flat[order], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]), strict=True):
        assert got.tolist() == grams(word)
    assert len(all_grams([])[0]) == len(all_grams([""])[0]) == 0
    values = np.random.default_rng(6).normal(size=1 << 18).astype(np.float32)
    want = {w: sum(values[g].astype(float) for g in grams(core(w))) / max(1, len(grams(core(w)))) for w in words if w}
    calls = []
    monkeypatch.setattr(toxicity, "crc32", lambda raw: calls.append(raw) or zlib.crc32(raw))
    scorer = Scorer(ToxicityModel(values, -1.0))
    scorer.logits(list(want))
    assert not calls
    assert all(abs(scorer.known[w] - v) < 1e-9 for w, v in want.items() if w in scorer.known) and len(scorer.known) > 2000


def test_training_finds_the_words():
    rows, labels = corpus(400, 3)
    model = train([r[2] for r in rows], np.array([x[2] for x in labels]))
    scorer = Scorer(model)
    insult, plain = scorer.logits(["a moron here", "a person here"])
    assert insult[0] > plain[0]


def test_quality(spark, tables):
    docs, labels = tables
    model = fit_quality(docs, labels)
    got = score_quality(docs, model).collect()
    assert len(got) == docs.count()
    quality = {r["doc_id"]: r["quality"] for r in labels.where("doc_id is not null and quality is not null").collect()}
    held = [r["predicted"] == quality[r["doc_id"]] for r in got if r["doc_id"] in quality and r["doc_id"] != 0 and apart(r["doc_id"])]
    assert np.mean(held) >= 0.95
    kept = good_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    none = fit_quality(docs, labels.limit(0))
    assert {r["score"] for r in score_quality(docs, none).collect()} == {1.0}
    assert score_quality(docs.limit(0), none).count() == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    a, b = (y[:, None] * 2.0 + rng.normal(size=(3000, 3)) for _ in range(2))
    few, pool, scale, test = slice(0, 12), slice(12, 2000), slice(2000, 2200), slice(2200, 3000)
    alone = logistic(a[few], y[few], ridge=0.05)
    before = ((np.hstack([a[test], np.ones((800, 1))]) @ alone > 0) == y[test]).mean()
    model = co_train((a[few], b[few], y[few]), (a[pool], b[pool]), (a[scale], b[scale], y[scale]))
    assert ((model.scores(a[test], b[test])[0] >= 0.5) == y[test]).mean() >= max(before, 0.95)
    assert not Views().content(None).any() and np.isfinite(Views.metadata(None, None, None, None)).all()
    assert abs(sigmoid(np.array([0.0]))[0] - 0.5) < 1e-12


def test_sample_is_bounded_and_held_out_ids_stay_out(spark, tables):
    docs, labels = tables
    got = labelled_sample(docs, labels, "quality", {1: 40, 0: 15}).select("doc_id", "label").collect()
    ids = {r["doc_id"] for r in got}
    assert len(ids) == 55 and not any(apart(i) for i in ids) and sum(r["label"] for r in got if r["doc_id"] != 0) <= 40


def test_pipeline_keeps_what_its_stages_keep(spark, tables, tmp_path):
    docs, labels = tables
    near = docs.where("doc_id % 50 = 3").withColumn("doc_id", F.col("doc_id") + 2000)
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.union(near).select(*plain).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = fit_quality(step, labels)
    bad = {r["doc_id"] for r in score_quality(step, model).where("predicted = 0").collect()}
    step = step.where(~F.coalesce(F.col("doc_id").isin(bad), F.lit(False)))
    harsh = {r["doc_id"] for r in score_toxicity(step, fit_toxicity(step, labels)).where("predicted = 1").collect()}
    step = step.where(~F.coalesce(F.col("doc_id").isin(harsh), F.lit(False)))
    copies = {r["doc_id"] for r in near_duplicates(step, 5).where("not kept").collect()}
    assert {2003, 2053} & copies
    want = {r["doc_id"] for r in step.collect()} - copies - {None}  # rows without id cannot be told apart here
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} - {None} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]


def test_quality_means_the_same_however_many_labels_are_sampled(spark):
    """Documents alike in both classes: their score is the share of good labels, capped samples or not."""
    rng = random.Random(4)
    rows = [("l", i, " ".join(rng.choice(["red", "green", "blue"]) for _ in range(40)), "en", "s", 200, "s") for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    for caps in ({}, {"good_docs": 80, "poor_docs": 80}):
        score = np.mean([r["score"] for r in score_quality(docs, fit_quality(docs, labels, **caps)).collect()])
        assert abs(score - 8 / 9) < 0.08


def test_pool_is_all_unlabelled_documents(spark, tables):
    docs, labels = tables
    known = labelled_sample(docs, labels, "quality", {1: 40, 0: 15})
    ids = {r["doc_id"] for r in known.select("doc_id").collect()}
    rows = featured(docs, ["doc_id"], "text").toPandas().drop_duplicates(subset="doc_id", keep=False)
    rows = rows[rows["doc_id"].notna() & ~rows["doc_id"].isin(ids)].sort_values("doc_id")
    views = tuple(np.array(rows[c].tolist(), dtype=np.float32).astype(float) for c in ("content", "metadata"))
    rng = np.random.default_rng(2)
    weights = [rng.normal(size=views[v].shape[1] + 1) * 20 for v in (0, 1)]
    some = docs.where(F.col("doc_id").isin([int(i) for i in rows["doc_id"]]) | F.col("doc_id").isin(list(ids)))
    plain, one, many = ArrayPool(views), *(StoredPool(some.repartition(n), known, "doc_id", "text") for n in (1, 9))
    for _ in range(2):
        want = plain.surest(weights, 30)
        assert sum(len(w[0]) for w in want) > 60
        for pool in (one, many):
            for w, g in zip(want, pool.surest(weights, 30), strict=True):
                assert all(np.array_equal(a, b) for a, b in zip(w, g, strict=True))


def test_model_does_not_depend_on_how_documents_are_split(spark):
    rng = random.Random(8)
    rows = [("l", i, " ".join(rng.choice(["red", "Green", "b-l", "4", "X1"]) for _ in range(6)), "en", f"s{i % 2}", 20, "s") for i in range(8000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(rows[i][2].count("4") < 2), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    one, many = (fit_quality(docs.repartition(n), labels) for n in (1, 7))
    assert np.array_equal(one.content, many.content) and np.array_equal(one.mix, many.mix)


def test_toxicity_ignores_held_out_labels(spark, monkeypatch):
    """The cut stays where it was when held-out labels change or labels without documents are added."""
    rows, labels = corpus(400, 3)
    seen = []
    monkeypatch.setattr("spendlens.llm.toxicity.best_cut", lambda margins, toxic, weight: seen.append(sum(weight[toxic == 1]) / sum(weight)) or 0.0)
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    for changed in (False, True):
        mine = [(i, q, 1 if changed and apart(i) else t) for i, q, t in labels] + [(None, 1, 1)] * (500 if changed else 0)
        fit_toxicity(docs, spark.createDataFrame(mine, "doc_id long, quality int, toxic int"))
    assert seen[0] == seen[1]


@pytest.mark.parametrize("seed", [0, 2, 4])
def test_toxicity_does_not_hang_on_the_seed(seed):
    rows, labels = corpus()
    toxic = {i: t for i, _, t in labels}
    learnt = [r for r in rows if not apart(r[1]) and r[2].strip()]
    scorer = Scorer(train([r[2] for r in learnt], np.array([toxic[r[1]] for r in learnt]), seed=seed))
    held = [r for r in rows if apart(r[1])]
    margins, labels = np.array([m for m, _ in scorer.logits([r[2] for r in held])]), np.array([toxic[r[1]] for r in held])
    assert max(np.mean((margins >= cut) == labels) for cut in margins) >= 0.95
