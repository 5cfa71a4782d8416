"""Registry files of both forms, and approval documents stored one file each."""
import json

import pytest
from pyspark.sql import functions as F

from docledger import schemas
from docledger.operators.approval import lines as L
from docledger.sources import sinks as K, tables as S

ITEMS = [{"name": "b", "region": "R1", "enabled": True, "include": ["x"]}, {"name": "a", "enabled": False, "other": 1}, {"name": "c"}]


def test_registry_lines_equal_the_list(spark, tmp_path):
    listed, lines = tmp_path / "s.json", tmp_path / "s.jsonl"
    listed.write_text(json.dumps(ITEMS))
    lines.write_text("\n".join(map(json.dumps, ITEMS)))
    one, two = S.load_sources(spark, str(listed)), S.load_sources(spark, str(lines))
    assert one.schema.simpleString() == two.schema.simpleString()
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_registry_numbers_follow_the_files(spark, tmp_path):
    folder = str(tmp_path / "many.jsonl")
    spark.range(1000).select(F.format_string("n%04d", "id").alias("name")).repartitionByRange(7, "name").sortWithinPartitions("name").write.json(folder)
    got = S.load_sources(spark, folder).select("id", "name", "enabled").collect()
    assert sorted((r.id, r.name, r.enabled) for r in got) == [(i + 1, f"n{i:04d}", 1) for i in range(1000)]


def test_registry_refuses_a_broken_line(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"name": "a"}\n{"name": ')
    with pytest.raises(Exception):
        S.load_sources(spark, str(tmp_path / "s.jsonl")).collect()


def test_approval_files(spark, tmp_path):
    root = str(tmp_path / "docs")
    ids = [f"{i:032x}" for i in range(30)]
    rows = [(i, json.dumps({"id": i, "stage": "s", "metrics": [{"name": "m", "value": "1"}]})) for i in ids] + [("index", '{"id": "index"}'), ("A" * 32, '{"id": "upper"}')]
    df = spark.createDataFrame(rows, "name string, json string").repartition(4)
    assert K.store_json_files(df, root) == 32
    assert K.store_json_files(df, root) == 32  # a repeated write leaves the same files
    got = S.read_approval_docs(spark, root).collect()
    assert sorted(r.id for r in got) == ids and all(r.metrics[0].value == "1" for r in got)
    assert K.store_json_files(df.limit(0), str(tmp_path / "none")) == 0
    with pytest.raises(Exception, match="not a file name"):
        K.store_json_files(spark.createDataFrame([("../x", "{}")], "name string, json string"), root)


def test_approval_files_of_both_layouts_are_read_by_tasks(spark, tmp_path):
    """Files in the folders of the store and files that lie flat; forms of content as Spark's reader of files has them."""
    flat, root, one = tmp_path / "flat", str(tmp_path / "docs"), '{"id": "%s",\n "stage": "s", "revision": %s}'
    contents = {0: one % ("é", 1), 1: "[" + one % ("a", 2) + "," + one % ("b", 3) + "]", 2: "[]", 3: "", 4: " \n", 5: '{"id": "x", ', 6: one % ("bad", '"no"'),
                7: "null", 8: one % ("twice", 4) + one % ("more", 5), 9: "\ufeff" + one % ("bom", 6)}
    flat.mkdir()
    for i, text in contents.items():
        (flat / f"{i:032x}.json").write_text(text)
    (flat / f"{10:032x}.json").write_bytes((one % ("wide", 7)).encode("utf-16-le"))
    (flat / f"{11:032x}.json").write_bytes(b'{"id": "\xff"}')
    for other in ("index.json", f"{12:031x}.json", f"{13:032x}.json.tmp", f"{0xa:032X}.json"):
        (flat / other).write_text(one % ("foreign", 8))
    (flat / "zz").mkdir()
    (flat / "zz" / f"{14:032x}.json").write_text(one % ("nested", 9))
    by_spark = spark.read.schema(schemas.APPROVAL_DOC).option("multiLine", "true").json(str(flat)).where(F.col("_metadata.file_name").rlike(r"^[0-9a-f]{32}\.json$"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(S.read_approval_docs(spark, str(flat))) == rows(by_spark) == rows(S.read_approval_docs(spark, f"{flat}/*.json"))
    K.store_json_files(spark.createDataFrame([(f"{i:032x}", t) for i, t in contents.items()] + [("index", "{}")], "name string, json string"), root)
    stored = S.read_approval_docs(spark, root)
    assert sorted((r.id or "", r.revision or 0) for r in stored.collect()) == sorted([("é", 1), ("a", 2), ("b", 3), ("", 0), ("bad", 0), ("", 0), ("twice", 4), ("bom", 6)])
    assert "FileScan json" not in stored._jdf.queryExecution().toString()  # no file passes through the driver's listing
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_approval_docs(spark, str(tmp_path / "absent")).collect()


def test_placed_lines_equal_the_two_steps(spark):
    """Documents of many pages, ties on a line, watermarks and page numbers; the same lines and offsets as step by step."""
    raw = [(f"d{d}", p, t, [float(x), float(y), 1.0, 1.0], 800.0, "text")
           for d in range(3) for p in range(1, 1 + (5, 49, 260)[d]) for y, x, t in
           [(10, 0, f"—{p}—"), (100, 0, f"一、标题{p}：甲"), (100, 0, f"一、标题{p}：甲"), (101, 5, " 右 侧 "), (300, 0, f"正文{d}-{p}"), (400, 0, "浙江政务服务网"), (790, 0, str(p)), (500, 0, "")]]
    df = spark.createDataFrame(raw, "doc_id string, page int, text string, bbox array<double>, page_height double, method string")
    want, got = L.line_offsets(L.clean_lines(df)), L.placed_lines(df)
    cols = ["doc_id", "page", "n", "id", "text", "start", "end"]
    rows = lambda x: sorted(tuple(r) for r in x.select(*cols).collect())
    assert rows(got) == rows(want) and got.count() == (5 + 49 + 260) * 4
    texts = {r.doc_id: r.text for r in L.document_text(got).collect()}
    for r in L.sections(got).collect():
        whole = texts[r.doc_id]
        assert r.text == whole[r.start:r.end] and whole.startswith(r.heading, r.heading_start)
    assert L.placed_lines(df.limit(0)).count() == 0
