from collections import Counter

import corpus_pipeline
import pytest

from claimweave.llm import mil_quality, near_copies, packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
    return out


def test_each_stage_against_its_own_input(spark, stages):
    ids = {k: [r.doc_id for r in v] for k, v in stages.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = mil_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in stages["documents"] if model.score([r.text])[0] >= 0.5}
    assert set(ids["quality"]) == good
    sets = {r.doc_id: near_copies.shingle_set(r.text) for r in stages["quality"]}
    kept = set(ids["near_duplicates"])
    seen: set[int] = set()
    for start in sorted(sets):
        if start not in seen:
            group, todo = set(), [start]
            while todo:
                a = todo.pop()
                if a not in group:
                    group.add(a)
                    todo += [b for b in sets if near_copies.similarity(sets[a], sets[b]) >= 0.8]
            seen |= group
            assert kept & group == {min(group)}
    assert Counter(ids["personal_data"]) == Counter(ids["near_duplicates"])
    assert all(r.n_chars == len(r.text) for r in stages["personal_data"])
    assert set(ids["mixture"]) <= set(ids["personal_data"])
    tokens = {r.doc_id: len(packing.token_ids(r.text)) for r in stages["mixture"]}
    copies = Counter(ids["mixture"])
    lengths = Counter()
    for r in stages["sequences"]:
        lengths[r.doc_id] += r.length
    assert lengths == {k: tokens[k] * n for k, n in copies.items()}


def test_columns_and_run(spark, stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][0].asDict().keys() == set(corpus_pipeline.COLUMNS)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r.doc_id for r in stages["sequences"])


ODD = "doc_id long, text string, lang string, source string, n_chars long, quality_score int, n_email string, mix_copy string, nth_ int, row_key string"


def odd_rows():
    good = "The plain words of a letter to bob@example.com stand here, and then some more words. "
    rows = [(1, good * 3, "en", "a", 1), (1, good * 3, "en", "a", 1), (1, "another text", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n", "", "", 0), (None, good, "en", None, None), (None, None, None, None, None), (5, good * 2000, "en", "c", 9), (6, good * 3, "fr", "b", 2)]
    return [(*r, 1, "clash", "clash", 2, "clash") for r in rows]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([] if empty else odd_rows(), ODD)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out[name] = docs.collect()
        docs = spark.createDataFrame(out[name], docs.schema)
    ran = corpus_pipeline.run(spark, str(tmp_path)).count()
    if empty:
        assert not any(out.values()) and ran == 0
        return
    ids = {k: Counter(r.doc_id for r in v) for k, v in out.items()}
    assert len(out["quality"]) == 10  # without labels all score 0.5
    # of id 1 the text that sorts first stays; 2, 3 and 4 are empty or blank; 5 and 6 have the shingles of 1
    assert ids["near_duplicates"] == Counter([1, 2, None, None])
    assert [r.text for r in out["near_duplicates"] if r.doc_id == 1][0].startswith("The plain")
    assert ids["personal_data"] == ids["near_duplicates"] and not any("bob@example.com" in (r.text or "") for r in out["personal_data"])
    assert set(ids["mixture"]) <= set(ids["personal_data"]) and set(ids["sequences"]) == set(ids["mixture"])
