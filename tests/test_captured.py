import json

from pyspark.sql import functions as F

from stallmark.operators import grouping
from stallmark.sources import captured, runs


def test_payloads(spark):
    texts = ['{"a": 1}\n{"a": 2', "[]", "", None, '{\n "a": {"b": 1}\n}', "garbage", '[{"a": 1}, 2]']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    got = captured.json_lines(rows).select("id", "pos", F.to_json("raw")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, '{"a":1}'), (4, 0, '{"a":{"b":1}}'), (6, 0, '{"a":1}'), (6, 1, "2")]
    whole = rows.withColumn("payload", F.when(F.col("id") == 0, '{"body": "page"}').when(F.col("id") == 4, '{"body": 5}').otherwise(F.col("payload")))
    got = dict(whole.select("id", captured.unwrapped(F.col("payload"))).collect())
    assert got == {0: "page", 1: "[]", 2: "", 3: None, 4: '{"body": 5}', 5: "garbage", 6: '[{"a": 1}, 2]'}


def test_manifest_and_time(spark, tmp_path):
    health = spark.createDataFrame([("b", 3, "ok", None), ("a", 0, "empty", None), ("c", 1, "error", "late")], "platform string, raw_cards long, status string, first_error string")
    told = captured.manifest(health, "best phones", "phones", "2024-01-02T03:04:05Z").first()["value"]
    parsed = json.loads(told)
    assert [p["platform"] for p in parsed["platforms"]] == ["a", "b", "c"] and parsed["platforms"][2]["error"] == "late" and parsed["searchQuery"] == "phones"
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.json").write_text("[]")
    assert captured.captured_at(spark, [str(tmp_path / "run")]).startswith("20")
    (tmp_path / "run" / "manifest.json").write_text(told)
    assert captured.captured_at(spark, [str(tmp_path / "run")]) == "2024-01-02T03:04:05Z"
    (tmp_path / "run" / "manifest.json").write_text('{"capturedAt": "2023"}')
    assert captured.captured_at(spark, [str(tmp_path / "run")]) == "2023"


def test_search_rows_are_cards(spark):
    rows = spark.sql("""SELECT 'amazon' AS platform, 'x' AS file, 0 AS pos, parse_json('{"title": "Poco X5", "price": 12999, "originalPrice": "15,999", "discount": 18, "reviewsCount": 40, "rating": 4.1, "url": "https://x/dp/1"}') AS raw""")
    got = runs.listings(captured.search_cards(rows)).first()
    assert (got["title"], got["price"], got["mrp"], got["discount_pct"], got["rating_count"]) == ("Poco X5", 12999.0, 15999.0, 18, 40)


def test_sinks(spark):
    rows = spark.createDataFrame([("m", 1, "x")], "model string, listings int, raw string")
    assert captured.slim(rows).first()["value"] == '{"model":"m"}'
    refused = spark.createDataFrame([("m", "q", ["over budget"])], "model string, query_id string, reasons array<string>")
    both = captured.rejected_listings(refused, spark.createDataFrame([("m", 1), ("m", 2), ("n", 3)], "model string, id int"), ["model"])
    assert sorted((r["id"], r["query_id"], r["reasons"]) for r in both.collect()) == [(1, "q", ["over budget"]), (2, "q", ["over budget"])]


def test_promotion_of_no_and_null_pages(spark):
    rows = spark.createDataFrame([("m", 1, "u", "a", 100.0, None, None, 1)], "model string, id int, url string, platform string, price double, mrp double, in_stock boolean, ord int")
    empty = spark.createDataFrame([], "id int, page_price long, page_mrp long, in_stock boolean")
    nulls = spark.createDataFrame([(1, None, None, None)], empty.schema)
    for pages in (empty, nulls):
        got = grouping.promoted(grouping.best_offers(rows, ["model"]), rows, pages, ["model"]).first()
        assert (got["price"], got["in_stock"], got["n_offers"], got["best"]["url"]) == (100.0, None, 1, "u")
