"""SimHash as a step of the pipeline's near-duplicate stage."""

import numpy as np

import corpus_pipeline as pipeline
from cohortlens.llm import overlap


def test_fingerprints_of_the_pipeline_stage_find_near_copies_by_themselves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6):
        words = [f"w{j}" for j in rng.integers(0, 10**6, 2000)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join([*words[:-1], "other"])), (10 * i + 2, " ".join(words).upper())]
    rows += [(100, None), (101, ""), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(overlap, "candidates", lambda classes, entries: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()) == [0, 10, 20, 30, 40, 50, 100]
