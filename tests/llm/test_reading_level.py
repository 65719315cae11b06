import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from massloom.llm import reading_level
from massloom.llm.reading_level import fit, reading_levels, tokens

PLAIN = "The cat sits on the mat. We see the dog. It is a big dog and it can run. "
HARD = "The characterization of the physicochemical heterogeneity, which notwithstanding its considerable multidimensionality is the objective of this investigation, necessitates the systematic recalibration of the instrumentation in which we are interested. "


GERMAN = "Die Probe zeigt ein klares Signal im Labor und die Messung ist gut. "
CODES = "AC[Common Fixed:Carbamidomethyl on C]DEK; PEP[Metal:Sodium on E]TIDER; "
LOG = "INFO scan loaded\nWARN peak missing\nINFO scan closed\n"


def test_prose_is_told_from_other_texts(spark):
    """Languages, listings and logs have no level; the models see them only in the sample of other texts."""
    texts = [(i, (PLAIN if i % 2 else HARD) * (4 + i % 3)) for i in range(60)]
    texts += [(100 + i, t * (9 + i)) for i, t in enumerate([GERMAN, CODES, LOG, "123.4 567.8\n"] * 5)] + [(200, PLAIN), (201, PLAIN * 20 + GERMAN)]
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(20)], "doc_id long, reading_level int")
    found = {r.doc_id for r in reading_levels(spark.createDataFrame(texts, "doc_id long, text string"), labels, "doc_id", "text", "reading_level").collect()}
    assert found == {*range(60), 201}
    assert tokens(None) == tokens("") == ([], [])


def test_levels_are_told_apart(spark):
    texts = [(i, (PLAIN if i % 2 else HARD) * (3 + i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, "x " * 100), (None, PLAIN * 4), (5, PLAIN * 3)]
    labels = [(i, 1 if i % 2 else 5) for i in range(30)] + [(3, 2), (4, None), (6, 9), (999, 3)]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("*", "1 AS level", "'x' AS key", "2 AS text")
    out = [(r.doc_id, r.reading_level) for r in reading_levels(d, spark.createDataFrame(labels, "doc_id long, reading_level int"), "doc_id", "body", "reading_level").collect()]
    assert len(out) == 62 and all(lv == (1 if i is None or i % 2 else 5) for i, lv in out)


def test_no_labels_and_no_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, reading_level int")
    texts = spark.createDataFrame([(1, PLAIN * 4)], "doc_id long, text string")
    assert reading_levels(texts, labels, "doc_id", "text", "reading_level").count() == 0
    assert reading_levels(texts.limit(0), labels, "doc_id", "text", "reading_level").count() == 0
    assert fit([], [], []) is None


def test_held_out_accuracy(spark):
    """Levels of readers that the models weren't fitted on."""
    at = "/root/testdata/sf0.1/"
    pytest.importorskip("pyarrow")
    try:
        docs, labels = pd.read_parquet(at + "documents.parquet", columns=["doc_id", "text"]), pd.read_parquet(at + "reading_labels.parquet")
    except OSError:
        pytest.skip("no test tables")
    labels = labels.dropna(subset=["reading_level"])
    held = labels[labels.doc_id % 3 == 0]
    spark_docs = spark.createDataFrame(docs[docs.doc_id.isin(labels.doc_id)].itertuples(index=False), "doc_id long, text string")
    fitted = labels[labels.doc_id % 3 != 0]
    spark_labels = spark.createDataFrame([(int(a), int(b)) for a, b in zip(fitted.doc_id, fitted.reading_level, strict=True)], "doc_id long, reading_level int")
    found = {r.doc_id: r.reading_level for r in reading_levels(spark_docs, spark_labels, "doc_id", "text", "reading_level").collect()}
    right = [found.get(a) == b for a, b in zip(held.doc_id, held.reading_level, strict=True)]
    assert sum(right) / len(right) > 0.9


def test_every_labelled_text_counts(spark):
    """Hard texts are only among those whose hash comes after the first 2000."""
    ids = [r.id for r in spark.range(2040).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(ids[2000:])
    texts = [(i, (HARD * 2 if i in late else PLAIN * 3)) for i in ids] + [(-i, t * (9 + i)) for i, t in enumerate([GERMAN, CODES, LOG] * 20, 1)]
    labels = spark.createDataFrame([(i, 5 if i in late else 1) for i in ids], "doc_id long, reading_level int")
    found = {r.doc_id: r.reading_level for r in reading_levels(spark.createDataFrame(texts, "doc_id long, text string"), labels, "doc_id", "text", "reading_level").collect()}
    assert found == {i: 5 if i in late else 1 for i in ids}


def test_sums_over_parts_give_the_models_of_lists(spark, monkeypatch):
    monkeypatch.setattr(reading_level, "PIECE", 16)
    texts = [((PLAIN if i % 2 else HARD) * (4 + i % 3) + f"word{i % 5} here.", [3, 0, 0, 0, 1] if i % 2 else [0, 0, 0, 0, 1]) for i in range(30)]
    texts += [(t * (9 + i), [0] * 5) for i, t in enumerate([GERMAN, CODES, LOG, PLAIN] * 5)]
    both = [(reading_level.counted(*tokens(t)), g) for t, g in texts]
    want = fit([c for c, g in both if any(g)], [g for _, g in both if any(g)], [c for (c, _), g in both if not any(g)])
    rows = [(g, list(w), list(w.values()), list(n), list(n.values())) for (w, n), g in both]
    table = spark.createDataFrame(rows, "grades array<bigint>, words array<string>, word_counts array<bigint>, lengths array<int>, length_counts array<bigint>").repartition(3)
    got = reading_level._fit_table(table)
    assert got.index == want.index and got.prior == pytest.approx(want.prior)
    for name in ("prose", "words", "sentences", "joint"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-6), name
