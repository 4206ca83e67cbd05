"""The pipeline's stages in order, over documents with planted copies, passages, leaks and junk."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hearthpanel.llm.queries import MODEL
from hearthpanel.llm.model_file import read_vocabulary
from hearthpanel.llm.unigram import Codec


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["ta", "no", "ri", "lem", "su", "ka", "do"]) for _ in range(rng.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 11))).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    question, passage = " ".join(word() for _ in range(25)), text(8)
    docs = [(i, text(12)) for i in range(30)]
    docs += [(100, docs[3][1]), (101, docs[4][1] + " " + word()), (102, text(3) + "\n" + passage + "\n" + text(3)),
             (103, text(3) + "\n" + passage + "\n" + text(3)), (104, text(4) + " " + question + " " + text(2)),
             (105, "junk " * 80), (106, "few words"), (107, None), (30, docs[5][1]), (5, docs[5][1])]
    place = tmp_path_factory.mktemp("corpus")
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, question)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{place}/labels.parquet")
    return str(place), dict(docs), passage


def test_stages(spark, folder):
    place, text_of, passage = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, place), "stage")
        seen.append({r.doc_id: r for r in docs.collect()})
    assert all(list(rows.values())[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} for rows in seen[:-1])
    clean = set(range(30))
    assert set(seen[0]) == clean | {30, 100, 101, 102, 103, 104}
    assert set(seen[1]) == clean | {102, 103, 104}
    assert seen[2][102].text == text_of[102] and passage not in seen[2][103].text
    assert seen[2][103].n_chars == len(seen[2][103].text) < len(text_of[103])
    assert all(seen[2][i].text == text_of[i] for i in clean)
    assert set(seen[3]) == clean | {102, 103}
    codec = Codec(read_vocabulary(MODEL))
    assert all(r.ids == list(codec.encode(seen[3][i].text)) and r.round_trip for i, r in seen[4].items())
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, place).collect()}
    assert whole == {i: r.ids for i, r in seen[4].items()}


def test_every_operator_is_registered(spark):
    numbers = sorted(int(k[2:].split("_")[0]) for k in entry.CORPUS_QUERIES if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.CORPUS_QUERIES


def test_empty_documents(spark, folder, tmp_path):
    place, _, _ = folder
    docs = spark.read.parquet(f"{place}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, place)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op5_quality_rules", "op9_url_filter", "op10_license_scan"])
def test_native_plans_have_no_python(spark, small, name):
    plan = entry.CORPUS_QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert not [word for word in ("Python", "Pandas", "Arrow", "CartesianProduct") if word in plan]
