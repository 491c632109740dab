"""The pipeline's stages on odd rows, against what a small table must give."""

import pytest

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, toxic_score double, kept_id long, bad_id long, text_key long, row string, spans string"


def _words(k, n=40):
    return " ".join(f"t{k}w{j}" for j in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, 1, int(100 <= k < 120)) for k in range(80, 160)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, _words(7)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, _words(k), "a/x") for k in range(80, 100)] + [(k, f"vile rotten {_words(k)}", "a/x") for k in range(100, 120)] + [(k, _words(k), "b/y") for k in range(120, 160)]
    rows += [(200, _words(90) + " more", "a/x"), (201, _words(91), None), (201, _words(91), None), (202, None, None), (203, "", "a/x"), (None, None, None)]
    rows += [(204, f"{_words(300)} {_words(7)} {_words(301)}", "a/x"), (205, f"{_words(302)} token=abcdefgh12345678 end", "a/x"), (206, _words(400, 6000), "c/z")]
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 0.5, 1, 2, 3, "r", "s") for i, t, s in rows], KIND)


def test_stages_take_effect_and_keep_the_rest(spark, folder, docs):
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0) for r in d.collect())
    keep = lambda drop: sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect() if r.doc_id not in drop)
    calm = stage["toxicity"](spark, docs, folder)
    assert calm.columns == docs.columns and ids(calm) == keep(set(range(100, 120)))
    alone = stage["jaccard_join"](spark, docs, folder)
    assert alone.columns == docs.columns and ids(alone) == keep({200, 201})  # 90 and 91 stay
    clean = stage["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == keep({204})
    hidden = stage["secrets"](spark, docs, folder)
    assert hidden.columns == docs.columns and ids(hidden) == keep(set())
    changed = {r.doc_id: r.text for r in hidden.join(docs.select("doc_id", docs.text.alias("was")), "doc_id").where("text <> was").collect()}
    assert list(changed) == [205] and "abcdefgh12345678" not in changed[205] and changed[205].endswith(" end")
    packed = stage["packing"](spark, docs, folder).collect()
    assert len({r.doc_id for r in packed}) == len({r.doc_id for r in docs.collect()}) and max(r.offset + r.length for r in packed) <= 2048
    assert sum(r.piece == 0 for r in packed) == docs.count()


def test_run_and_empty_tables(spark, folder, docs):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - set(range(100, 120)) - {200, 201, 204}
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
