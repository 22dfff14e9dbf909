"""Saved runs through their data source: the rows of the plain reader, fewer files where filters tell."""

import json

from pyspark.sql import functions as F

from stallmark.sources import runs, saved


def a_run(folder):
    (folder / "flipkart.json").write_text(json.dumps([{"title": "A", "price": "₹1,299"}, 5, {"title": "B", "selling_price": {"amount": 900}}, {"error": "timeout"}]))
    (folder / "amazon-p2.json").write_text(json.dumps({"products": [{"name": "C", "final_price": 12.5}, {"name": "D", "final_price": "0"}]}))
    (folder / "other.json").write_text(json.dumps([{"name": "E", "url": "https://www.reliancedigital.in/x", "price": "Rs. 5"}]))
    (folder / "manifest.json").write_text("{}")
    lines = folder / "platform=tatacliq" / "page=3"
    lines.mkdir(parents=True)
    (lines / "part-0.txt").write_text('{"title": "F", "mrp": 3}\n{"title": "G", "price": 70}\n')


def test_rows_are_those_of_the_plain_reader(spark, tmp_path):
    a_run(tmp_path)
    got = saved.saved_runs(spark, str(tmp_path))
    assert {(r["platform"], r["page"], r["file"], r["pos"], r["price"]) for r in got.collect()} == {
        ("flipkart", None, "flipkart.json", 0, 1299.0), ("flipkart", None, "flipkart.json", 2, 900.0), ("flipkart", None, "flipkart.json", 3, None), ("amazon", 2, "amazon-p2.json", 0, 12.5), ("amazon", 2, "amazon-p2.json", 1, None),
        ("reliance", None, "other.json", 0, 0.5), ("tatacliq", 3, "part-0.txt", 0, None), ("tatacliq", 3, "part-0.txt", 1, 70.0),
    }
    columns = ["platform", "title", "price", "mrp"]
    plain = runs.listings(runs.cards(spark, str(tmp_path))).select(columns)
    own = runs.listings(saved.as_cards(got.where("platform <> 'tatacliq'"))).select(columns)
    assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect())) and own.count() == 5


def test_filters_go_to_the_source(spark, tmp_path):
    a_run(tmp_path)
    asked = saved.saved_runs(spark, f"file://{tmp_path}").where((F.col("platform") == "amazon") & (F.col("page") <= 2) & (F.col("price") < 100) & F.col("raw").contains("C"))
    pushed = spark._jvm.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "formatted").split("PushedFilters: ")[1].split("\n")[0]
    assert all(x in pushed for x in ("platform", "page", "price"))
    # Files that can't hold an answer are broken, and nobody notices; the one without a name for its platform has no page.
    for name in ("flipkart.json", "other.json", "platform=tatacliq/page=3/part-0.txt"):
        (tmp_path / name).write_text("{broken")
    assert [(r["platform"], r["price"]) for r in asked.collect()] == [("amazon", 12.5)]


def test_what_a_reader_takes_in():
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan, StringContains

    reader = saved.Reader("x")
    left = list(reader.pushFilters([EqualTo(("platform",), "amazon"), In(("page",), (1, 2)), LessThan(("price",), 10), IsNotNull(("price",)), StringContains(("raw",), "x"), EqualTo(("pos",), 1)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "StringContains", "EqualTo"]
    assert reader.passes("page", 2) and not reader.passes("page", 3) and not reader.passes("page", None) and reader.passes("price", 9.5)
