import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import MISSING_TOKENS
from lodestar.session import with_ordinals
from lodestar.sources import catalog as ct
from lodestar.sources.delimited import file_headers, preview_rows, raw_heads, read_delimited
from lodestar.sources.export import data_link, export_json, json_text

CATALOG = {
    "S-2": {"organism": "mouse", "assay_types": ["a", "b"], "folder": "f", "description": "d",
            "files": {"one": "p/1.txt", "two": ["p/2 x.txt", "p/3.txt"], "none": [], "four": "p/4.txt", "five": "p/5.txt"}},
    "S-1": {"organism": "yeast"},
}


def test_catalog(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CATALOG))
    rows = ct.load_catalog(spark, str(path)).orderBy("pos").collect()
    assert [(r.pos, r.dataset, r.organism) for r in rows] == [(0, "S-2", "mouse"), (1, "S-1", "yeast")]
    assert rows[0].assay_types == ["a", "b"] and rows[1].files is None
    files = ct.catalog_files(ct.load_catalog(spark, str(path))).orderBy("file_pos").collect()
    assert [(f.name, f.path) for f in files] == [("one", "p/1.txt"), ("two", "p/2 x.txt"), ("none", ""), ("four", "p/4.txt"), ("five", "p/5.txt")]
    assert ct.catalog_files(ct.load_catalog(spark, str(path)), 2).count() == 2


@pytest.mark.parametrize("content", [None, "", "[1, 2]", "{broken"])
def test_missing_or_invalid_catalog_is_empty(spark, tmp_path, content):
    path = tmp_path / "catalog.json"
    if content is not None:
        path.write_text(content)
    assert ct.load_catalog(spark, str(path)).count() == 0
    assert ct.load_publications(spark, str(path)).where("title <> ''").count() == 0


def test_repeated_dataset_keeps_last_entry(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('{"A": {"organism": "x"}, "B": {"organism": "y"}, "A": {"organism": "z"}}')
    rows = ct.load_catalog(spark, str(path)).orderBy("pos").collect()
    assert [(r.dataset, r.organism) for r in rows] == [("A", "z"), ("B", "y")]


def test_publications(spark, tmp_path):
    path = tmp_path / "pubs.json"
    path.write_text(json.dumps([{"Title": "T", "Link": "L"}, {"Link": "M"}, {"Title": "U"}]))
    rows = ct.load_publications(spark, str(path)).orderBy("pos").collect()
    assert [(r.pos, r.title, r.link) for r in rows] == [(0, "T", "L"), (1, "", "M"), (2, "U", "")]


def test_missing_files_are_marked(spark, tmp_path):
    (tmp_path / "has blank+plus.txt").write_text("x")
    files = spark.createDataFrame([("d", 0, str(tmp_path / "has blank+plus.txt")), ("d", 1, "/none"), ("d", 2, "")], "dataset STRING, file_pos INT, path STRING")
    marked = ct.mark_missing(files, ct.existing_paths(spark, str(tmp_path))).orderBy("file_pos").collect()
    assert [r.missing for r in marked] == [False, True, False]


def write_files(folder):
    (folder / "tab.txt").write_text('Name\tUnit\tUnit\tUnit\tNote\n' + "a\t1\tNA\t3\t\"two\nlines\"\n\nb\t2\tx\t\t\"say \"\"hi\"\"\"\n")
    (folder / "quoted.txt").write_text('"A"\t"B, c"\n"1"\t"2"\n')
    (folder / "comma.csv").write_text("p,q\n1,2\n3\n")
    (folder / "text.txt").write_text("just a line\nmore\twith tab\n")
    (folder / "wider.txt").write_text("a\tb\n1\t2\t3\n4\t5\n")
    (folder / "header_only.txt").write_text("a\tb\n")
    (folder / "empty.txt").write_text("")


def test_delimited_as_pandas_reads_it(spark, tmp_path):
    write_files(tmp_path)
    cells = read_delimited(spark, str(tmp_path), analysis_rows=10).collect()
    for name, sep in (("tab.txt", "\t"), ("quoted.txt", "\t"), ("comma.csv", ",")):
        frame = pd.read_csv(tmp_path / name, sep=sep, dtype=str)
        want = {(i, j, c, None if pd.isna(frame.iloc[i, j]) else frame.iloc[i, j]) for i in range(len(frame)) for j, c in enumerate(frame.columns)}
        got = {(c.row_pos, c.col_pos, c.column, c.value) for c in cells if c.path.endswith("/" + name)}
        assert got == want, name
    others = {c.path.rsplit("/", 1)[1] for c in cells} - {"tab.txt", "quoted.txt", "comma.csv"}
    assert others == set()


def test_headers(spark, tmp_path):
    (tmp_path / "h.txt").write_text("x\tx\tx.1\t\tx\n1\t2\t3\t4\t5\n")
    row = file_headers(spark, str(tmp_path)).first()
    assert row.separator == "\t"
    assert row["names"] == list(pd.read_csv(tmp_path / "h.txt", sep="\t").columns)


def test_missing_tokens_in_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a\tb\n" + "".join(f"{t}\tx\n" for t in MISSING_TOKENS))
    values = [r.value for r in read_delimited(spark, str(tmp_path)).where("column = 'a'").collect()]
    assert values == [None] * len(MISSING_TOKENS)


def test_row_order_and_caps(spark, tmp_path):
    (tmp_path / "long.txt").write_text("n\tm\n" + "".join(f"{i}\tx\n" for i in range(3000)))
    first = preview_rows(spark, str(tmp_path)).where("column = 'n'").orderBy("row_pos").collect()
    assert [r.value for r in first] == ["0", "1", "2", "3", "4"]
    whole = read_delimited(spark, str(tmp_path), multi_line=False).where("column = 'n'").orderBy("row_pos").collect()
    assert [r.value for r in whole] == [str(i) for i in range(3000)]


def test_raw_heads(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("first\r\nsecond\n\n".encode() + b"\xff" + b"x\n" * 3000)
    row = raw_heads(spark, str(tmp_path)).first()
    assert row.text == ("first\nsecond\n\n" + "x\n" * 3000)[:2000]


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([("é", None, 1)], "a STRING, b STRING, n INT")
    row = df.select(json_text(F.struct("*")).alias("j"), data_link(F.repeat("a", 100)).alias("link")).first()
    assert json.loads(row.j) == {"a": "é", "b": None, "n": 1} and "é" in row.j
    assert row.link.startswith("data:file/json;base64,") and "\n" not in row.link
    export_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().a == "é"


def test_quoted_line_breaks_read_in_many_blocks(spark, tmp_path):
    """Records with quoted line breaks, commas, doubled quotes, CRLF and a repeated header, split into small blocks."""
    import csv
    import io

    from lodestar.sources.delimited import read_delimited

    rows = [["id", "note", "note", "tail"]]
    for i in range(400):
        note = f'line {i},\nnext "q{i}"\r\nend' if i % 3 == 0 else ("" if i % 7 == 0 else f"plain {i}")
        rows.append([str(i), note, note.upper(), "NA" if i % 11 == 0 else f"t{i}"])
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\r\n").writerows(rows)
    folder = tmp_path / "quoted"
    folder.mkdir()
    (folder / "a.csv").write_text(buffer.getvalue(), newline="")
    (folder / "b.tsv").write_text("x\tx\n1\t\"a\tb\"\n", newline="")
    (folder / "notes.txt").write_text("no separator here\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        cells = read_delimited(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = ["id", "note", "note.1", "tail"]
    missing = {"", "NA"}
    want = sorted(("a.csv", k, names[j], None if v in missing else v) for k, row in enumerate(rows[1:]) for j, v in enumerate(row))
    want += [("b.tsv", 0, "x", "1"), ("b.tsv", 0, "x.1", "a\tb")]
    order = {}
    for c in cells:
        order.setdefault(c.path.rsplit("/", 1)[-1], set()).add(c.row_pos)
    place = {f: {pos: k for k, pos in enumerate(sorted(p))} for f, p in order.items()}
    got = sorted((c.path.rsplit("/", 1)[-1], place[c.path.rsplit("/", 1)[-1]][c.row_pos], c.column, c.value) for c in cells)
    assert got == sorted(want)


def test_lines_of_quoted_records_are_placed_where_they_are_read(spark):
    """Running quotes and record starts of blocks that end within a batch or go on in the next one, in any split."""
    import random

    import pyarrow as pa

    from lodestar.sources.quoted import _placed

    pick = random.Random(5)
    rows = [(f"f{i // 40}", (i // 13) * 100, i, "x", pick.randrange(3)) for i in range(120)]
    names = ["uri", "block", "seq", "line", "quotes"]
    want = []
    for i, (uri, block, seq, _, _) in enumerate(rows):
        mine = [r for r in rows[: i + 1] if r[:2] == (uri, block)]
        passed = [sum(r[4] for r in mine[:k]) for k in range(len(mine))]
        starts = [max((r[2] for r, p in zip(mine, passed, strict=True) if p % 2 == odd), default=None) for odd in (0, 1)]
        want.append((passed[-1], *starts))
    for size in (1, 7, 13, 120):
        parts = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + size]]) for k in range(0, 120, size)]
        got = pa.Table.from_batches(list(_placed(iter(parts)))).to_pylist()
        assert [(r["passed"], r["if_outside"], r["if_inside"]) for r in got] == want


def test_quoted_records_shuffle_no_whole_lines(spark, tmp_path):
    """Lines are read, placed and written without an exchange."""
    from lodestar.sources import quoted

    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"z"\n')
    placed = quoted.physical_lines(spark, str(tmp_path)).mapInArrow(quoted._placed, f"{quoted.LINES_SCHEMA}, passed long, if_outside long, if_inside long")
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.record for r in quoted.quoted_records(spark, str(tmp_path)).collect()) == ['1,"x\ny"', '2,"z"', "a,b"]


def test_ordinals_shuffle_rows_once(spark):
    values = [None, 7, 3, 3, None, 1, 9, 7, 2, 8]
    rows = spark.createDataFrame([(value, f"text {i}") for i, value in enumerate(values)], "key INT, text STRING").repartition(4)
    placed = with_ordinals(rows, ["key"], "pos")
    assert placed.columns == ["key", "text", "pos"] and dict(placed.dtypes)["pos"] == "bigint"
    found = sorted(placed.collect(), key=lambda r: r.pos)
    assert [r.pos for r in found] == list(range(10))
    assert [r.key for r in found] == sorted(values, key=lambda v: (v is not None, v or 0))
    assert sorted(r.text for r in found) == [f"text {i}" for i in range(10)]
    # The written rows are neither sorted by a window nor joined by shuffle again.
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "strategy=broadcast" in plan
    assert with_ordinals(rows.limit(0), ["key"], "pos").count() == 0
