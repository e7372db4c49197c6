import glob
import os

import pytest

import corpus_pipeline
from tests.llm.cases import odd_rows, prose, table
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_pii import base_spans
from tests.llm.test_repetition import base
from tests.llm.test_spans import brute as spans

PASSAGE = prose(60, 700)


def rows_in():
    rows = odd_rows() + [(100 + i, prose(80 + 9 * i, 900 + i)) for i in range(25)]
    rows += [(200, prose(80, 900)), (201, prose(80, 900) + " more words here"), (202, prose(90, 60) + "\n" + PASSAGE), (203, prose(90, 61) + "\n" + PASSAGE)]
    return [*rows, (204, prose(70, 62) + " Mail a.b@c.example or +1 (212) 555-0100.")]


def test_stages_against_brute_force(spark, tmp_path):
    table(spark, rows_in()).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = rows_in()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near dedup", "substring dedup", "personal data", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        return spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")

    def held(df):
        return sorted((r.doc_id or 0, r.text) for r in df.collect())

    one = step("quality rules", docs)
    kept = [(i, t) for i, t in rows if not base(t)[-1]]
    assert held(one) == sorted((i or 0, t) for i, t in kept) and one.columns == docs.columns
    two = step("near dedup", one)
    first = {(i, t) for (i, t), (_, _, c) in zip(kept, groups(kept, 5), strict=True) if i == c}
    assert held(two) == sorted((i or 0, t) for i, t in first) and two.columns == docs.columns
    three = step("substring dedup", two)
    listed = sorted(first, key=lambda x: x[0] or 0)
    left = [(i, new) for (i, _), (new, n) in zip(listed, spans(listed), strict=True) if not n or new.strip()]
    assert held(three) == sorted((i or 0, t) for i, t in left) and three.columns == docs.columns
    four = step("personal data", three)
    assert four.columns == docs.columns and four.count() == three.count()
    assert not any(base_spans(r.text) for r in four.collect()) and "<EMAIL>" in four.where("doc_id = 204").first().text
    assert four.where("n_chars <> length(text)").count() == 0
    five = step("packing", four).collect()
    assert sorted({r.doc_id or 0 for r in five}) == sorted(r.doc_id or 0 for r in four.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id or 0, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id or 0, r.piece, r.ids_crc32) for r in five)


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.001/*.parquet"), reason="no test tables")
def test_registered_queries_run(spark):
    from lodestar.llm.queries import REGISTRY

    assert sorted(int(name[2:].split("_")[0]) for name in REGISTRY) == list(range(1, 14))
    for name, job in REGISTRY.items():
        df = job(spark, "/root/testdata/sf0.001")
        assert df.count() > 0, name
    assert os.path.exists(corpus_pipeline.__file__)
