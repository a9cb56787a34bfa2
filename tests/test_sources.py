import json

import pytest
from pyspark.sql import functions as F

from faultline.operators import runs
from faultline.sources import readers, sinks


def records(df):
    return {r.record_id: r for r in df.collect()}


def test_json_lines(spark, tmp_path):
    lines = [{"func": "int f() {\r\n\treturn 1; \n}", "target": "1", "project": " p ", "split": "x", "hash": 5}, None, {"code": "", "func": "g();", "label": "benign"}, {"func": "h();"}, {"func": "k();", "vul": "1.0"}, {"record_id": "own", "before": "m();", "is_vul": True}]
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "part.jsonl").write_text("\n".join("" if x is None else json.dumps(x) for x in lines) + "\n{broken\n[1]\n")
    got = records(readers.read(spark, "json_lines", str(folder / "part.jsonl"), "d"))
    assert set(got) == {"d-part-0", "d-part-2", "own"}
    first = got["d-part-0"]
    assert (first.code, first.label, first.project, first.split, first.hash, first.source_row) == ("int f() {\n    return 1;\n}", 1, "p", "x", 5, 0)
    assert got["d-part-2"].code == "g();" and got["d-part-2"].label == 0 and got["d-part-2"].project == "set" and got["own"].label == 1


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"func": f"f{i}();", "target": 1}) + "\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        rows = readers.json_lines(spark, str(tmp_path / "big.jsonl"))
        assert rows.rdd.getNumPartitions() > 3
        assert {r.record_id: r.code for r in readers.canonical(rows, "d").collect()} == {f"d-big-{i}": f"f{i}();" for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lists_tables_parquet_and_sources(spark, tmp_path):
    root = tmp_path / "all"
    (root / "vulnerable").mkdir(parents=True)
    (root / "a.json").write_text(json.dumps({"records": [{"func": "a();", "target": 1}, 5, {"func": "b();", "target": 0, "split": "test"}]}))
    (root / "bad.json").write_text("{")
    (root / "c.csv").write_text('func_before,vul,"CWE ID"\n"x = ""1"";\ny();",1,CWE-1\n,0,\n"z();",no,\n')
    (root / "t.tsv").write_text("code\tlabel\nq();\t1\n")
    (root / "vulnerable" / "f.CPP").write_bytes(b"int f\xff() {}\n")
    (root / "g_0.c").write_text("int g() {}\n")
    (root / "note.txt").write_text("nothing")
    spark.createDataFrame([("p();", 1, None), ("", 1, None), ("r();", 0, "proj")], "functionSource string, label int, project string").coalesce(1).write.parquet(str(root / "my-validation.parquet"))
    got = records(readers.mixed_tree(spark, str(root), "d"))
    by_code = {r.code: r for r in got.values()}
    assert set(by_code) == {"a();", "b();", 'x = "1";\ny();', "z();", "q();", "int f() {}", "int g() {}", "p();", "r();"}
    assert by_code["b();"].split == "test" and by_code['x = "1";\ny();'].cwe_id == "CWE-1" and by_code["z();"].record_id == "d-c-2" and by_code["int f() {}"].label == 1 and by_code["int g() {}"].label == 0 and by_code["r();"].project == "proj"
    with pytest.raises(ValueError):
        readers.read(spark, "other", str(root), "d")
    table = spark.read.option("header", True).csv(str(root / "t.tsv"), sep="\t")
    assert readers.required(table, ["code"]) is table
    with pytest.raises(ValueError, match="vul"):
        readers.required(table, ["code", "vul"])


def test_splits_of_parquet_files_are_preferred(spark, tmp_path):
    paths = {}
    for n, split in enumerate(("train", "val", "test")):
        paths[split] = str(tmp_path / f"{split}.parquet")
        spark.createDataFrame([(f"{split}{i}();", 1) for i in range(n + 1)], "func_before string, vul int").coalesce(1).write.parquet(paths[split])
    (tmp_path / "t.csv").write_text("func_before,vul\nother();,1\n")
    got = records(readers.preferred(spark, paths, str(tmp_path / "t.csv"), "d"))
    assert {r.split for r in got.values()} == {"train", "val", "test"} and got["d-5"].code == "test2();"
    got = records(readers.preferred(spark, paths | {"more": str(tmp_path / "none")}, str(tmp_path / "t.csv"), "d"))
    assert [r.code for r in got.values()] == ["other();"]


def test_labels_of_paths(spark):
    cases = {"a/bad/good/x.c": 0, "a/vulnerable/b/x.c": 1, "a/x_1.c": 1, "a/x-0.h": 0, "a/x.c": None, "1": 1}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.label for r in df.select("p", readers.label_of_path(F.col("p")).alias("label")).collect()} == cases


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "d", "p", 1, "c", None, "h", "s|é", "train"), ("b", "d", "p", 0, "c", None, "h", "s", None)], ", ".join(f"{n} {'int' if n == 'label' else 'string'}" for n in sinks.INDEX))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and "é" in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    sinks.write_index(df, str(tmp_path / "i"))
    assert spark.read.option("header", True).csv(str(tmp_path / "i")).columns == sinks.INDEX
    sinks.write_by_split(df, str(tmp_path / "s"))
    assert [p.name for p in (tmp_path / "s").glob("split=*")] == ["split=train"]
    for _ in range(2):
        sinks.append_predictions(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    sinks.export_table(df, str(tmp_path / "e"))
    assert next((tmp_path / "e").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert sinks.report(df.select("record_id", "source_path"), str(tmp_path / "r"), "Title").splitlines()[0::4][0] == "# Title" and (tmp_path / "r" / "csv").exists()


def test_chunks_and_runs(spark):
    rows = spark.range(300).selectExpr("if(id % 3 = 0, null, 'd') as dataset", "id * 9000 as row_id")
    got = {(r.dataset, r.row_id): (r.position, r.chunk) for r in runs.chunks(rows, ["dataset"], "row_id", 64).collect()}
    for name, ids in ((None, range(0, 300, 3)), ("d", [i for i in range(300) if i % 3])):
        assert [got[name, i * 9000] for i in ids] == [(n, n // 64) for n in range(len(ids))]
    assert runs.chunk_bounds(100, 1, 64) == (64, 100)
    with pytest.raises(ValueError):
        runs.chunk_bounds(100, -1, 64)
    last = runs.keep_last(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, n int, v string"), "k", "n").collect()
    assert [(r.k, r.v) for r in last] == [("a", "y")]
