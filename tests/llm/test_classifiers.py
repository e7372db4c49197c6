import zlib

import pyarrow as pa
import pytest

from lodestar.llm import factorisation, toxicity
from lodestar.llm.training import labelled_sample
from tests.llm.cases import odd_rows, prose, table

LABELS = "doc_id long, quality int, toxic int, score double"


def corpus(spark):
    """Toxic texts hold one of two words; texts of low quality are in capitals."""
    rows, labels = [], []
    for i in range(1200):
        text = prose(60, i)
        toxic, good = int(i % 6 == 0), int(i % 5 > 0)
        if toxic:
            text = text.replace(" ", f" {('vile', 'nasty')[i % 4 // 2]} ", 1)
        rows.append((i, text if good else text.upper()))
        labels.append((i, good, toxic, 1.0))
    labels += [(None, 1, 1, 1.0), (5, None, None, 1.0), (99_999, 1, 1, 1.0)]
    return table(spark, rows), spark.createDataFrame(labels, LABELS), labels


def test_held_out_accuracy(spark):
    docs, labels, known = corpus(spark)
    for job, at in ((toxicity.toxicity, 2), (factorisation.quality, 1)):
        out = {r.doc_id: r for r in job(docs, labels).collect()}
        assert len(out) == 1200 and all(0 <= r.score <= 1 for r in out.values())
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
        truth = {row[0]: row[at] for row in known[:1200]}
        held = [r for r in out.values() if r.held_out]
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_sample_leaves_out_the_held_fold_and_keeps_its_bound(spark):
    docs, labels, _ = corpus(spark)
    assert labelled_sample(docs, labels, "toxic", 100).count() == 100
    sample = labelled_sample(docs, labels, "toxic", 10_000)
    assert sample.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1200)) and sample.columns == ["text", "label"]


@pytest.mark.parametrize("job", [toxicity.toxicity, factorisation.quality])
def test_odd_texts_and_no_labels(spark, job):
    docs = table(spark, odd_rows())
    none = spark.createDataFrame([], LABELS)
    out = job(docs, none).collect()
    assert len(out) == len(odd_rows()) and all(abs(r.score - 0.5) < 1e-9 for r in out)
    few = spark.createDataFrame([(5, 1, 0, 1.0), (7, 0, 1, 1.0), (11, 1, 0, 1.0)], LABELS)
    assert all(0 <= r.score <= 1 for r in job(docs, few).collect())
    assert job(table(spark, []), few).count() == 0


def test_interactions_equal_the_sum_over_pairs():
    import numpy as np

    random = np.random.default_rng(3)
    bits = 6
    size = (1 << bits) + factorisation.STATISTICS
    w, v = random.normal(size=size + 1), random.normal(size=(size, 4))
    texts = pa.array(["a b c b", "", "x Y z!"], pa.large_string())
    rows, index, values = factorisation.features(texts, bits)
    got, _ = factorisation.raw_scores(rows, index, values, 3, w, v)
    for t in range(3):
        i, x = index[rows == t], values[rows == t]
        pairs = sum(v[i[a]] @ v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert abs(got[t] - (w[-1] + w[i] @ x + pairs)) < 1e-9
