import zipfile

from pyspark.sql import functions as F

from lapidary.operators import tables
from lapidary.sources import readers, sinks


def lines(spark, path):
    return [r.value for r in spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("f", "at").collect()]


def test_folders_and_ordered_merge(spark, tmp_path):
    for folder, name, text in [("a", "2.json", "x\n\ny\n"), ("a", "1.JSON", "z\n"), ("a", "3.jsonx", "no\n"), ("b_err", "1.json", "no\n"), ("c", "1.json", "w\n")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text, encoding="utf-8")
    (tmp_path / "file.txt").write_text("no", encoding="utf-8")
    assert readers.subfolders(spark, str(tmp_path)) == ["a", "c"]
    assert [(r.file_name, r.value) for r in readers.merged_lines(spark, str(tmp_path / "a")).collect()] == [("1.JSON", "z"), ("2.json", "x"), ("2.json", "y")]
    names = spark.createDataFrame([("err-1.json",), ("terror.json",), ("a_err.json",)], "file_name string")
    assert [r.file_name for r in readers.without_errors(names).collect()] == ["terror.json"]


def test_images_books_and_lists(spark, tmp_path):
    for path in ("b1/试题包/题目/1.PNG", "b1/试题包/2.jpg", "b2/other/3.jpeg", "b2/other/note.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x", encoding="utf-8")
    found = readers.image_inventory(spark, str(tmp_path))
    assert found.count() == 3 and readers.image_inventory(spark, str(tmp_path), under="试题包").count() <= 3
    paths = spark.createDataFrame([("b1/试题包/1.png",), ("b1/x/2.png",), ("b2/x/3.png",)], "path string")
    assert [r.book for r in readers.books_without(paths).collect()] == ["b2"]
    (tmp_path / "list.txt").write_text(" a \n\nb\n", encoding="utf-8")
    assert [r.value for r in readers.text_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    sorted_books = spark.createDataFrame([("语文/辅学类/b1/x",), ("语文/b2/x",), ("英语/b3/x",), ("数学/辅学类/b4",)], "path string")
    assert {tuple(r) for r in readers.books(sorted_books).collect()} == {("语文", "辅学类", "b1"), ("英语", None, "b3"), ("数学", None, "辅学类")}


def test_copies_run_once_and_are_told(spark, tmp_path):
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / name).write_text(name, encoding="utf-8")
    out = str(tmp_path / "out")
    plan = sinks.copy_plan(spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("a.jpg", "b.jpg", "gone.jpg")], "path string"), "path", out, 0)
    for want in ({"copied": 2, "failed": 1}, {"there": 2, "failed": 1}):
        done = sinks.run_copies(plan.select("src", F.col("dst"))).collect()
        assert {s: sum(r.status == s for r in done) for s in {r.status for r in done}} == want
    assert (tmp_path / "out" / "a.jpg").read_text(encoding="utf-8") == "a.jpg"
    assert sinks.zip_folder(out, str(tmp_path / "z.zip")) == 2 and sorted(zipfile.ZipFile(tmp_path / "z.zip").namelist()) == ["a.jpg", "b.jpg"]


def test_reports_and_exports(spark, tmp_path):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in ("abc", "cd"))
    left, right, _ = tables.reconcile(a, b, "k")
    sinks.reconciliation_log(tables.coverage(a, b, "k"), left, right, "k", str(tmp_path / "log"))
    assert lines(spark, str(tmp_path / "log")) == ["referenced: 3", "physical: 2", "found: 1", "missing: 2", "unreferenced: 1", "coverage: 33.33", "missing: a", "missing: b", "unreferenced: d"]
    sinks.line_count(a, str(tmp_path / "n"))
    assert lines(spark, str(tmp_path / "n")) == ["3"]
    sinks.by_source(spark.createDataFrame([("s", "1"), (" ", "2"), (None, "3")], "source_type string, value string"), str(tmp_path / "by"))
    assert {(r.source_type, r.value) for r in spark.read.text(str(tmp_path / "by")).collect()} == {("s", "1"), ("未知", "2"), ("未知", "3")}
    sinks.sorted_list(spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), "k", str(tmp_path / "sorted"))
    assert lines(spark, str(tmp_path / "sorted")) == ["a", "b"]
    rows = spark.createDataFrame([("s", "t", i) for i in (3, 1, 2)], "source_type string, section string, n long")
    sinks.by_section(rows, str(tmp_path / "sections"), ["n"])
    files = spark.read.json(str(tmp_path / "sections")).select("n", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("at")).orderBy("f", "at")
    assert [r.n for r in files.collect()] == [1, 2, 3]
    sinks.by_kind(spark.createDataFrame([("x", 1), ("y", 2)], "kind string, n int"), str(tmp_path / "kinds"))
    assert spark.read.json(str(tmp_path / "kinds" / "kind=x")).count() == 1 and spark.read.json(str(tmp_path / "kinds")).count() == 2
