import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    plain = [f"{a}{b}{c}" for a in ("ma", "so", "ti") for b in ("ren", "dal", "mot") for c in ("a", "i", "us", "")]
    say = lambda n: " ".join(rng.choices(plain, k=n))
    rows, labels, kind = [], [], {}
    bench = [(k, say(30)) for k in range(4)]
    passage = "This exact line of a licence stands in many of the documents"
    for k in range(300):
        text, what = say(rng.randint(60, 120)), "clean"
        if k % 10 == 0:
            text, what = text + " vileword grimword " + say(20) + " foulword", "toxic"
        elif k % 10 == 1:
            text, what = text + " " + bench[k % 4][1], "leak"
        elif k % 10 == 2 and k > 2:
            text, what = rows[3][1], "copy"
        elif k % 10 == 4:
            text, what = text + "\n" + passage, "line"
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1, int(what == "toxic")))
        kind[k] = what
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r[1] for r in rows}, kind, passage


def test_stages_take_effect(spark, tables):
    d, texts, kind, passage = tables
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
    of = lambda what: {k for k, v in kind.items() if v == what}
    assert len(of("toxic") & set(seen["toxicity"])) <= 2 and of("clean") <= set(seen["toxicity"])
    holders = [k for k in of("line") if passage in seen["line_dedup"][k].text]
    assert holders == [min(of("line"))] and all(seen["line_dedup"][k].text + "\n" + passage == texts[k] for k in of("line") if k not in holders)
    assert of("clean") - {3} <= set(seen["simhash_dedup"]) and len((of("copy") | {3}) & set(seen["simhash_dedup"])) == 1
    assert not of("leak") & set(seen["decontamination"]) and of("clean") - {3} <= set(seen["decontamination"])
    assert set(seen["sentencepiece"]) == set(seen["decontamination"]) and all(r.round_trip for r in seen["sentencepiece"].values())


def test_run_matches_stages(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert out.count() > 150 and "piece_ids" in out.columns


def test_empty_documents(spark, tables, tmp_path):
    d = tables[0]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
