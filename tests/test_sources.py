import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import scores, upsert
from corpusloom.sources import keyed, readers, resume, writers


def test_json_lines_skip_empty_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n{"text": "y"}\n')
    (tmp_path / "b.jsonl").write_text("")
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"text": "日本"}\n')
    df = readers.json_lines(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/*.gz"], "text string, n int")
    assert sorted(r["text"] for r in df.collect()) == ["x", "y", "日本"]


def test_json_objects_take_the_model_from_the_path(spark, tmp_path):
    for model in ("m1", "m2"):
        (tmp_path / model).mkdir()
        (tmp_path / model / "score.json").write_text(json.dumps({"AVR": "0.5", "extra": 1}, indent=2))
    df = readers.json_objects(spark, f"{tmp_path}/*/score.json", "AVR string", r"([^/]+)/score\.json")
    assert {tuple(r) for r in df.collect()} == {("0.5", "m1"), ("0.5", "m2")}


def test_json_array_of_strings_and_tasks(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps(["one", "two\nlines"], indent=1))
    rows = readers.json_array(spark, f"{tmp_path}/s").collect()
    assert sorted((r["pos"], r["item"]) for r in rows) == [(0, "one"), (1, "two\nlines")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "tasks.json").write_text(json.dumps([{"type": "b", "user_en": "hi", "user_ja": "", "id": 1}]))
    item = readers.json_array(spark, f"{tmp_path}/t", readers.TASK).first()["item"]
    assert (item["type"], item["user_en"], item["prompt_en"], item["id"]) == ("b", "hi", None, 1)


def test_accuracies(spark):
    log = '"acc": 0.65,\n"acc_norm": 0.5, "acc_stderr": 0.1, "acc": 1, "acc":\n 0.7'
    df = spark.createDataFrame([(1, log), (2, "none")], "id int, log string")
    assert [(r["id"], r["acc"]) for r in readers.accuracies(df, "log", ["id"]).collect()] == [(1, 0.65), (1, 0.7)]


def test_second_write_is_skipped(spark, tmp_path):
    path = f"{tmp_path}/out"
    writers.write_if_absent(spark.range(3), path)
    writers.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_delimited(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 0.5), ("c", None)], "model string, x double")
    for sep in ("\t", ","):
        writers.write_csv(df, f"{tmp_path}/{ord(sep)}", sep)
        back = readers.delimited_scores(spark, f"{tmp_path}/{ord(sep)}", "model string, x double", sep)
        assert {tuple(r) for r in back.collect()} == {("a/b", 0.5), ("c", None)}


def test_spread_leaves_large_tables_alone(spark):
    assert readers.spread(spark.range(0, 100, 1, 8)).rdd.getNumPartitions() == 8
    assert readers.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_objects_with_any_keys(spark, tmp_path):
    for model, value in {"m1": {"a": 0.5, "odd key": "0.25"}, "m2": {"b": 1, "a": "n/a"}, "m3": {}}.items():
        (tmp_path / model).mkdir()
        (tmp_path / model / "score.json").write_text(json.dumps(value, indent=2))
    wide = scores.collect_objects(readers.json_key_values(spark, f"{tmp_path}/*/score.json", r"([^/]+)/score\.json"))
    assert wide.columns == ["model", "a", "b", "odd key"]
    assert {tuple(r) for r in wide.collect()} == {("m1", 0.5, None, 0.25), ("m2", None, 1.0, None), ("m3", None, None, None)}


@pytest.mark.parametrize("indent", [None, 1])
def test_one_large_array_is_read_by_several_tasks(spark, tmp_path, indent):
    odd = ["", ",", ",,", '"', '\\', '\\",[', "]}", "[{", "a, b", "日本,語", "line\nbreak", None]
    items = [odd[i % len(odd)] if i % 3 else f"{i} " + '",[{\\' * (i % 50) for i in range(20_000)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "s" / "none.json").write_text("[]")
    (tmp_path / "s" / "blank.json").write_text("")
    size = (tmp_path / "s" / "a.json").stat().st_size
    settings = {"spark.sql.files.maxPartitionBytes": str(size // 7), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        read = readers.json_array(spark, f"{tmp_path}/s")
        tasks = spark.read.option("lineSep", ",").text(f"{tmp_path}/s").rdd.getNumPartitions()
        rows = sorted(
            ((r["pos"], r["item"]) for r in read.collect()), key=lambda r: r[0])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks >= 7
    assert rows == list(enumerate(items))


def test_array_of_nested_records(spark, tmp_path):
    items = [{"type": f"t{i}", "user_en": 'a "quoted", [x', "id": i} for i in range(50)]
    (tmp_path / "tasks.json").write_text(json.dumps(items))
    rows = readers.json_array(spark, f"{tmp_path}/tasks.json", readers.TASK).orderBy("pos").collect()
    assert [(r["pos"], r["item"]["type"], r["item"]["user_en"], r["item"]["id"]) for r in rows] == [
        (i, t["type"], t["user_en"], i) for i, t in enumerate(items)]


def test_accuracies_of_files_cut_at_commas(spark, tmp_path):
    (tmp_path / "a.log").write_text('x "acc": 0.65,\n"acc_norm": 0.5, {"acc":\n 0.7, "acc": 1} "acc": 0.25')
    read = readers.accuracies(readers.log_pieces(spark, f"{tmp_path}/a.log"), "log", [])
    assert sorted(r["acc"] for r in read.collect()) == [0.25, 0.65, 0.7]


def test_a_stopped_write_is_finished_and_not_repeated(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(1000)
    assert resume.write_parts(df, path, "id", "v1", only=[0, 1, 2]) == [0, 1, 2]
    half = tmp_path / "out" / resume.run_folder(df, path, "id", "v1").rsplit("/", 1)[1] / "part=3"
    half.mkdir()
    (half / "part-00000-left.snappy.parquet").write_bytes(b"cut off")
    with pytest.raises(FileNotFoundError):
        resume.read_published(spark, path)
    assert resume.write_resumable(df, path, "id", "v1") == [3, 4, 5, 6, 7]
    assert sorted(r[0] for r in resume.read_published(spark, path).collect()) == list(range(1000))
    assert resume.write_resumable(df, path, "id", "v1") == []
    assert len(resume.write_parts(spark.range(5), path, "id", "v2", only=[0])) == 1
    assert resume.read_published(spark, path).count() == 1000
    resume.write_resumable(spark.range(5), path, "id", "v2")
    assert resume.read_published(spark, path).count() == 5


def test_input_stamp_changes_with_the_files(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    first = resume.input_stamp(spark, f"{tmp_path}/in")
    assert first == resume.input_stamp(spark, f"{tmp_path}/in")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in")
    assert first != resume.input_stamp(spark, f"{tmp_path}/in")


def test_merge_leaves_untouched_parts_alone(spark, tmp_path):
    path = f"{tmp_path}/keyed"
    target = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v"))
    batch = spark.createDataFrame([(1, "7", "new"), (2, "7", "newest"), (3, "x", "in")], "seq int, id string, v string")
    keyed.write_keyed(target, path, "id", 8)
    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "keyed").rglob("*.parquet")}

    before = files()
    touched = keyed.merge_keyed(spark, path, batch, "id", "seq", upsert.replace_rows, 8)
    assert 1 <= len(touched) <= 2
    stay = {f: t for f, t in before.items() if int(f.split("_part=")[1].split("/")[0]) not in touched}
    assert stay.items() <= files().items() and len(stay) >= 6
    got = {tuple(r) for r in keyed.read_keyed(spark, path).collect()}
    assert got == {tuple(r) for r in upsert.replace_rows(target, batch, "id", "seq").collect()}
    assert keyed.merge_keyed(spark, path, batch.where("false"), "id", "seq", upsert.replace_rows, 8) == []
