import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basisweave.llm.quality_classifier import fit_quality, op5_quality_classifier, score_quality
from basisweave.llm.toxicity import calibrated, estimate_prior, fit_toxicity, nnpu_logistic, op8_toxicity, score_toxicity


def test_nnpu_separates_and_calibrates():
    rng = np.random.default_rng(0)
    p = np.zeros((300, 30), np.float32)
    p[np.arange(300), rng.integers(0, 5, 300)] = 1
    u = (rng.random((2000, 30)) < 0.02).astype(np.float32)
    u[:, :5] = 0
    u[:200] = p[rng.integers(0, 300, 200)]
    w, b = nnpu_logistic(p, u, 0.1, 1)
    scale, shift = calibrated(p @ w + b, u @ w + b, 0.1)
    score = 1 / (1 + np.exp(-(scale * (u @ w + b) + shift)))
    assert (score[:200] >= 0.7).mean() > 0.95 and (score[200:] >= 0.7).mean() < 0.02


@pytest.fixture(scope="module")
def tox(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ma", "so", "ti", "ke", "lu") for b in ("ren", "dal", "mot", "vis", "gon", "per")]
    rows = []
    for k in range(900):
        words = rng.choices(plain, k=rng.randint(3, 50))
        toxic = int(k % 7 == 0)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "grimword", "foulword"]))
        rows.append((k, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_on_held_out(spark, tox, make_docs):
    learn = F.col("doc_id") % 3 != 1
    docs = tox.select("doc_id", "text")
    model = fit_toxicity(docs.where(learn), tox.where(learn & (F.col("doc_id") % 2 == 0)).select("doc_id", "toxic"))
    got = score_toxicity(tox, model).where(~learn).collect()
    assert np.mean([r.score >= 0.7 for r in got if r.toxic]) > 0.9 and np.mean([r.score >= 0.7 for r in got if not r.toxic]) < 0.02
    odd = score_toxicity(make_docs([(1, None), (1, None), (None, ""), (2, "x " * 20000)], features=1), model).collect()
    assert len(odd) == 4 and all(r.score < 0.5 for r in odd)
    assert score_toxicity(make_docs([]), model).count() == 0
    none = fit_toxicity(docs, tox.where("toxic = 9").select("doc_id", "toxic"))
    assert {r.score for r in score_toxicity(docs.limit(5), none).collect()} == {0.0}


def test_quality_on_held_out(spark, make_docs):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ma", "so", "ti", "ke", "lu") for b in ("ren", "dal", "mot", "vis", "gon", "per")]
    bad = [lambda w: w + "%%%", lambda w: w.upper() + "!!", lambda w: w + " |"]
    rows = []
    for k in range(600):
        own, mark = rng.choices(words, k=rng.randint(5, 60)), rng.choice(bad)
        rows.append((k, " ".join(own if k % 4 else [mark(w) for w in own]), int(k % 4 > 0)))
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    learn = F.col("doc_id") % 3 != 1
    docs = all_rows.select("doc_id", "text")
    model = fit_quality(docs, docs.where(learn), all_rows.where(learn).select("doc_id", "quality"))
    got = score_quality(all_rows, model).where(~learn).collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) > 0.97
    odd = score_quality(make_docs([(1, None), (None, ""), (2, "x " * 20000), (2, "x " * 20000)]), model).collect()
    assert len(odd) == 4 and all(0 <= r.score <= 1 for r in odd)
    assert score_quality(make_docs([]), model).count() == 0
    one = fit_quality(docs, docs, all_rows.where("quality = 1").select("doc_id", "quality"))
    assert all(r.score > 0.99 for r in score_quality(docs.limit(3), one).collect())


def test_prior_comes_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(3)
    for share in (0.05, 0.2):
        p = (rng.random((800, 40)) < 0.02).astype(np.float32)
        p[np.arange(800), rng.integers(0, 6, 800)] = 1
        u = (rng.random((6000, 40)) < 0.02).astype(np.float32)
        u[:, :6] = 0
        n = int(share * 6000)
        u[:n] = p[rng.integers(0, 800, n)]
        assert abs(estimate_prior(p, u) / share - 1) < 0.35


def test_clashing_columns_are_replaced(spark, tox):
    learn = tox.select("doc_id", "text")
    model = fit_toxicity(learn, tox.select("doc_id", "toxic"))
    got = score_toxicity(tox.withColumn("score", F.lit("old")).withColumn("id", F.lit(1)), model)
    assert dict(got.dtypes)["score"] == "double" and got.columns == ["doc_id", "text", "toxic", "id", "score"] and got.count() == tox.count()


@pytest.mark.parametrize(("query", "cut"), [(op5_quality_classifier, 0.5), (op8_toxicity, 0.7)])
def test_queries_on_odd_rows(spark, small_tables, query, cut):
    got = query(spark, small_tables)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    got = got.collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r.score for r in got}
    assert abs(by[9005] - by[9006]) < 1e-5 and abs(by[9001] - by[9002]) < 1e-5


@pytest.mark.parametrize(("query", "label", "least"), [(op5_quality_classifier, "quality", 0.95), (op8_toxicity, "toxic", 0.9)])
def test_held_out_ranking(spark, query, label, least):
    """Area under the curve on the rows that no label was learnt from."""
    tables = "/root/testdata/sf0.1"
    rows = query(spark, tables).where("held_out").join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id").select("score", label).collect()
    score, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5
    assert auc >= least


def labelled_tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


TEXTS = [(k, f"plain words number {k} of a row") for k in range(40)]


@pytest.mark.parametrize(
    "docs, labels, known",
    [
        ([], [(k, k % 2, 0) for k in range(30)], None),  # labels of both kinds, no documents
        (TEXTS, [(k, 1, 0) for k in range(20)] + [(1000 + k, 0, 0) for k in range(20)], 1.0),  # only one kind meets a document
        (TEXTS, [(k, 1 + k % 2, 0) for k in range(30)], 1.0),  # a label beyond 0 and 1
        (TEXTS, [(None, 1, 0), (None, None, None)], 0.5),
    ],
)
def test_quality_with_labels_that_meet_no_document(spark, tmp_path, docs, labels, known):
    got = op5_quality_classifier(spark, labelled_tables(spark, tmp_path, docs, labels)).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in docs]
    assert all(r.score == pytest.approx(known, abs=1e-6) and r.predicted == int(known >= 0.5) for r in got)


def test_an_ids_different_texts_are_learnt_alike_in_any_order(spark, tmp_path):
    docs = [(k, f"good words {k}" if k % 2 else "BAD %%% || !!") for k in range(60)] + [(k, f"another text of {k}") for k in range(60)]
    labels = [(k, k % 2, 0) for k in range(60)]
    runs = []
    for n, rows in enumerate((docs, docs[::-1])):
        folder = tmp_path / str(n)
        labelled_tables(spark, folder, rows, labels)
        runs.append({(r.doc_id, round(r.score, 5)) for r in op5_quality_classifier(spark, str(folder)).collect()})
    assert runs[0] == runs[1]


def test_queries_on_held_out_rows(spark, tmp_path):
    """Both whole queries: contract columns, the fold rule, and accuracy on rows whose labels were not learnt."""
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in ("ma", "so", "ti", "ke", "lu") for b in ("ren", "dal", "mot", "vis", "gon", "per")]
    docs, labels = [], []
    for k in range(1500):
        words, toxic, good = rng.choices(plain, k=rng.randint(8, 40)), int(k % 6 == 0), int(k % 4 > 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vileword", "grimword", "foulword"]))
        docs.append((k, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((k, good, toxic))
    folder = labelled_tables(spark, tmp_path, docs, labels)
    held = {k for k, _ in docs if zlib.crc32(str(k).encode()) % 3 == 1}
    for query, column, cut in ((op5_quality_classifier, 1, 0.5), (op8_toxicity, 2, 0.7)):
        got = query(spark, folder).collect()
        assert {r.doc_id for r in got if r.held_out} == held and len(got) == len(docs)
        assert all(r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in got)
        own = [r for r in got if r.held_out]
        assert np.mean([r.predicted == labels[r.doc_id][column] for r in own]) > 0.95


def test_toxic_sample_is_a_byte_a_feature_on_the_driver(spark, tox, monkeypatch):
    """Floats, and copies of them, took the pipeline's driver over its memory."""
    from basisweave.llm import toxicity

    sizes, fit = [], toxicity.nnpu_logistic
    monkeypatch.setattr(toxicity, "nnpu_logistic", lambda xp, xu, *a, **b: sizes.append((xp.nbytes / xp.size, xu.nbytes / xu.size)) or fit(xp, xu, *a, **b))
    model = fit_toxicity(tox.select("doc_id", "text"), tox.select("doc_id", "toxic"))
    assert len(model.features) and set(sizes) == {(1.0, 1.0)}
    x, w = np.random.default_rng(1).random((5000, 40)) < 0.2, np.arange(40.0)
    assert np.allclose(toxicity.logits(x, w, 0.5), x.astype(float) @ w + 0.5) and len(toxicity.logits(x[:0], w, 0.5)) == 0
