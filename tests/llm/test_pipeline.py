"""The stages on small tables: what they must drop goes, what is clean stays, columns stay as they are."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, copies int, own_key string, clean_id long, turn_no int"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 120, 2)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    texts = []
    for i in range(120):
        said = [f"w{x}" for x in rng.integers(0, 400, 40)]
        texts.append(" ".join(["vileword hateword"] * 3 + said if i % 5 == 0 else said))
    return path, texts


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "k", -1, 3) for i, t in rows], DOC)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "bpe"]


def test_toxicity_stage(spark, folder):
    path, texts = folder
    rows = [*enumerate(texts), (None, "no id at all"), (7000, None), (7001, "")]
    out = STAGE["toxicity"](spark, frame(spark, rows), path)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == frame(spark, []).columns
    assert sum(i % 5 == 0 for i in kept if i is not None and i < 120) <= 2
    assert sum(i % 5 > 0 for i in kept if i is not None and i < 120) >= 94 and {None, 7000, 7001} <= set(kept)


def test_dedup_stages(spark, folder):
    path, texts = folder
    text = " ".join(f"u{i}" for i in range(100))
    near = text.replace("u50 ", "other ")
    rows = [(1, text), (2, text.upper()), (3, near), (4, texts[1]), (5, None), (6, ""), (7, texts[2])]
    exact = STAGE["exact_dedup"](spark, frame(spark, rows), path)
    assert sorted(r.doc_id for r in exact.collect()) == [2, 3, 4, 6, 7] and exact.columns == frame(spark, []).columns
    kept = STAGE["jaccard_join"](spark, exact, path)
    ids = sorted(r.doc_id for r in kept.collect())
    assert len(ids) == 4 and {4, 6, 7} < set(ids) and kept.columns == exact.columns


def test_mixing_stage_repeats_and_drops_none(spark, folder):
    path, texts = folder
    out = STAGE["mixing"](spark, frame(spark, [*enumerate(texts), (None, "x"), (7000, None)]), path)
    assert out.columns == frame(spark, []).columns
    assert {r.doc_id for r in out.collect()} == {*range(120), None, 7000}


def test_whole_run_and_empty_tables(spark, folder):
    path, texts = folder
    frame(spark, enumerate(texts)).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} <= set(range(120)) and len({r.doc_id for r in rows}) > 80
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
