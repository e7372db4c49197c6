import json

from pyspark.sql import functions as F

from lodestar.operators import context as cx
from lodestar.operators.corpus import build_corpus, dataset_text_urls, dataset_texts, file_parts
from lodestar.operators.index import build_index
from lodestar.plans.ask import ask
from lodestar.plans.study import file_study, file_texts
from lodestar.sources.catalog import catalog_files, load_catalog


def make_study(tmp_path):
    (tmp_path / "s.txt").write_text("Name\tLink\tValue\nm1\thttp://o.org/1.\t1\nm2\thttp://o.org/1.\t2\n")
    (tmp_path / "i.txt").write_text("TITLE\nabout http://i.org/x, done\n")
    catalog = {
        "S-1": {"organism": "mouse", "assay_types": ["RNA"], "folder": "f", "description": "Gene study (http://d.org/1)",
                "files": {"investigation": str(tmp_path / "i.txt"), "samples": [str(tmp_path / "s.txt")], "assays": [], "gone": str(tmp_path / "no.txt")}},
        "S-2": {"organism": "plant", "description": "Leaves"},
    }
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(catalog))
    return str(path)


CONTEXT = """Description: Gene study (http://d.org/1)
FILE: i.txt (preview unreadable)
FILE PREVIEW: s.txt
Name Link Value
m1 http://o.org/1. 1
m2 http://o.org/1. 2
Column: Name [categorical] count=2 unique=2 top='m1' (50.0%), 'm2' (50.0%)
Column: Link [categorical] count=2 unique=1 top='http://o.org/1.' (100.0%)
Column: Value [numeric] count=2 mean=1.500 median=1.500 std=0.707 top=1.0 (50.0%), 2.0 (50.0%)
FILE:  (preview unreadable)
FILE: gone - (missing)"""


def test_context_of_files(spark, tmp_path):
    catalog = load_catalog(spark, make_study(tmp_path))
    rows = {r.dataset: r for r in cx.dataset_contexts(catalog, file_study(spark, catalog, str(tmp_path))).collect()}
    assert rows["S-1"].context == CONTEXT
    assert rows["S-1"].urls == ["http://d.org/1", "http://i.org/x", "http://o.org/1"]
    assert [c.column for c in rows["S-1"]["columns"]] == ["Name", "Link", "Value"]
    assert rows["S-2"].context == "Description: Leaves" and rows["S-2"].urls == []


def test_dataset_text_with_samples(spark, tmp_path):
    catalog = load_catalog(spark, make_study(tmp_path))
    parts = file_parts(catalog_files(catalog), file_texts(spark, str(tmp_path)))
    texts = {r.dataset: r.text for r in dataset_texts(catalog, parts).collect()}
    assert texts["S-1"] == (
        "DATASET_ID: S-1\nmouse\nRNA\nGene study (http://d.org/1)\nf\nTITLE\nabout http://i.org/x, done\nName Link Value\nm1 http://o.org/1. 1 m2 http://o.org/1. 2"
    )
    assert texts["S-2"] == "DATASET_ID: S-2\nplant\nLeaves"
    urls = {r.dataset: r.urls for r in dataset_text_urls(catalog, parts).collect()}
    assert urls == {"S-1": ["http://d.org/1", "http://i.org/x", "http://o.org/1"], "S-2": []}
    assert file_texts(spark, str(tmp_path), "none") is None
    heads = {r.path.rsplit("/", 1)[1]: r.text for r in file_texts(spark, str(tmp_path), "raw_head").collect()}
    assert heads["s.txt"].startswith("Name\tLink\tValue\nm1")


def test_ask(spark, tmp_path):
    catalog = load_catalog(spark, make_study(tmp_path))
    pubs = spark.createDataFrame([(0, "Gene paper", "http://p.org/0"), (1, "No link gene", "")], "pos LONG, title STRING, link STRING")
    index = build_index(build_corpus(dataset_texts(catalog), pubs))
    asked = spark.createDataFrame([(1, "gene of mouse"), (2, "gene mouse"), (3, "qqq")], "query_id LONG, text STRING")
    answers = spark.createDataFrame(
        [(1, "As an AI language model I err. See\nhttp://a.org/z, http://p.org/0.", "m", 5)],
        "query_id LONG, content STRING, model STRING, usage INT",
    )
    study = file_study(spark, catalog, str(tmp_path))
    rows = {r.query_id: r for r in ask(index, asked, catalog, pubs, answers, lambda wanted: study).collect()}
    first, second, third = rows[1], rows[2], rows[3]
    assert first.answer == "See http://a.org/z, http://p.org/0." and first.meta.fallback is False and first.meta.model == "m"
    assert first.recommended_urls == ["http://d.org/1", "http://i.org/x", "http://o.org/1", "http://p.org/0", "http://a.org/z"]
    assert [d.dataset for d in first.used_datasets] == ["S-1"]
    assert sorted(p.link for p in first.used_publications) == ["", "http://p.org/0"]
    assert first.structured[0].dataset == "S-1"
    assert second.meta.fallback is True
    assert second.recommended_urls == ["http://d.org/1", "http://i.org/x", "http://o.org/1"]
    assert second.answer.startswith("Local fallback summary for: gene mouse\n- Description: Gene study")
    assert "Local dataset URLs:\nhttp://d.org/1\nhttp://i.org/x\nhttp://o.org/1\n" in second.answer
    assert "Related Research Publications:\n- " in second.answer and "- Gene paper\n  http://p.org/0\n" in second.answer
    assert "'NASA gene expression data dataset" in second.answer
    assert third.answer.startswith("Local fallback summary for: qqq\nNo local data available.\n\nSuggested")
    assert third.used_datasets == [] and third.recommended_urls == []
    reverse = ask(index, asked, catalog, pubs, answers, None, datasets_first=False)
    assert reverse.where(F.col("query_id") == 1).first().recommended_urls == ["http://a.org/z", "http://p.org/0", "http://d.org/1"]


def test_context_of_wanted_files_only(spark, tmp_path):
    """A wanted dataset gets the same context as in a full study; the others get none."""
    catalog = load_catalog(spark, make_study(tmp_path))
    wanted = spark.createDataFrame([("S-1",)], "dataset STRING")
    study = file_study(spark, catalog, str(tmp_path), wanted=wanted)
    rows = {r.dataset: r for r in cx.dataset_contexts(catalog.join(wanted, "dataset"), study).collect()}
    assert set(rows) == {"S-1"} and rows["S-1"].context == CONTEXT
    assert {r.dataset for r in study.files.collect()} == {"S-1"}
