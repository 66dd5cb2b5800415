"""Each stage of the pipeline on a small table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from meshloom.llm import personal_data


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    import random

    draw = random.Random(1)
    words = ["the", "river", "stone", "carries", "lightly", "over", "meadow", "bridge", "winter", "harbour", "lantern", "quiet"]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = [(k, make(80), "en", "s", 0) for k in range(40)]
    base = make(200)
    rows += [(50, base, "en", "s", 0), (51, base + " ", "en", "s", 0), (51, base + " ", "en", "s", 0), (52, base.replace("stone", "pebble", 1), "en", "s", 0)]
    rows += [(60, make(30) + " a@b.co joe [at] example [dot] com", "en", None, None), (61, None, None, None, None), (62, "", "en", "s", 0), (63, "1 2 3", "en", "s", 0), (None, make(60), "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string").coalesce(1).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_stages(spark, small, tmp_path):
    docs, ids = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        ids[name] = sorted((r[0] for r in docs.select("doc_id").distinct().collect()), key=str)
    everything = sorted([*range(40), 50, 51, 52, 60, None], key=str)
    assert ids["language"] == everything
    assert ids["exact_copies"] == [i for i in everything if i != 50]
    assert ids["near_copies"] == [i for i in everything if i not in (50, 52)]
    private = spark.read.parquet(f"file://{tmp_path}/personal_data")
    assert private.count() == spark.read.parquet(f"file://{tmp_path}/near_copies").count() == 43
    row = private.where(F.col("doc_id") == 60).first()
    assert row["text"].endswith("[EMAIL] [EMAIL]") and row["n_chars"] == len(row["text"])
    assert all(not personal_data.find(r["text"]) for r in private.collect())
    assert ids["packing"] == ids["near_copies"]
    assert corpus_pipeline.run(spark, small).count() == docs.count()
