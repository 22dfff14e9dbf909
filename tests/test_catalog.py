import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stallmark.functions import maths, parse
from stallmark.operators import external, grouping, history, intent, notes, pages, ranking, specs, text
from stallmark.plans import rank_cards
from stallmark.sources import runs
from stallmark.streaming import observations


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("₹12,999", 12999.0), ("Rs 1.2.3", 1.2), ("free", None), ("0", None), (None, None), ("7.", 7.0)])
def test_money(spark, raw, want):
    assert one(spark, parse.money(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("67% OFF", 67.0), ("12.5 % off", 13.0), ("0%", None), ("nothing", None), ("250%", None)])
def test_percent(spark, raw, want):
    assert one(spark, parse.percent(F.col("c")), c=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1,234", 1234), ("1.5k", 1500), ("2 lakh", 200000), ("3m", 3000000), ("none", None)])
def test_counts(spark, raw, want):
    assert one(spark, parse.count_of(F.col("c")), c=raw) == want


def test_scalars(spark):
    assert one(spark, parse.flag(F.col("c")), c=" No ") is False
    assert one(spark, parse.rating(F.col("c")), c=86.0) == 4.3
    assert one(spark, parse.rating(F.col("c")), c=0.0) is None
    assert one(spark, parse.rupees(F.col("c")), c=1234567.0) == "₹12,34,567"
    assert one(spark, parse.rupees(F.col("c")), c=999.0) == "₹999"
    assert one(spark, parse.short_count(F.col("c")), c=123456.0) == "1.2L"
    assert one(spark, parse.age_label(F.col("c")), c=5 * 3600 + 180) == "5h 03m"
    assert one(spark, maths.jround(F.col("c"), 2), c=0.285) == 0.28
    assert one(spark, parse.canonical_url(F.col("c")), c="https://a.b/p/x?q=1&pid=7#z") == "https://a.b/p/x?pid=7"
    assert one(spark, parse.canonical_url(F.col("c")), c="not a url?x") == "not a url"
    assert one(spark, parse.title_from_url(F.col("c")), c="https://a.b/oneplus-nord-5g/p/itm0a1b2c3d") == "OnePlus Nord 5G"

    def base36(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        out = ""
        while h:
            out, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out, h // 36
        return out

    assert one(spark, parse.stable_id(F.lit("p"), F.col("c")), c="https://a.b/x") == "p:" + base36("https://a.b/x")


def test_curve(spark):
    for x, want in ((1.0, 10.0), (3.0, 22.5), (16.0, 100.0), (99.0, 100.0)):
        assert one(spark, maths.curve(F.col("c"), maths.RAM), c=x) == want


INTENTS = {
    "best phones under 15k": ("phone", None, 15000, "under"),
    "gaming phone between 10,000 and 20000": ("phone", 10000, 20000, "between"),
    "earbuds around 2000": ("earbuds", 1700, 2300, "around"),
    "laptop above 1 lakh": ("laptop", 100000, None, "over"),
    "samsung phone 12000": ("phone", None, 12000, "under"),
    "phone": ("phone", None, None, "none"),
}


def test_intents(spark):
    rows = intent.intents(spark.createDataFrame([(q, q) for q in [*INTENTS, "amoled phone not samsung under 20000 nothing"]], "query_id string, query string")).collect()
    got = {r["raw"]: r for r in rows}
    for q, want in INTENTS.items():
        r = got[q]
        assert (r["category_wanted"], r["budget_min"], r["budget_max"], r["budget_operator"]) == want, q
    last = got["amoled phone not samsung under 20000 nothing"]
    assert last["exclude_brands"] == ["Samsung"] and last["brands"] == ["Nothing"] and last["must_have"] == ["amoled"]


def test_specs_from_text(spark):
    t = "Acme X1 5G (Midnight Blue, 128 GB) 8 GB RAM | 6.67 inch FHD+ AMOLED 120Hz display | 5000 mAh, 67W fast charging | 50MP + 8MP ultrawide, OIS, IP54, NFC, f/1.8"
    df = specs.with_specs(spark.createDataFrame([(t,)], "t string"), F.col("t"), "x").first()
    want = {"ram_gb": 8, "storage_gb": 128, "battery_mah": 5000, "charging_w": 67, "display_inches": 6.67, "refresh_hz": 120, "panel": "AMOLED", "resolution": "FHD+", "main_camera_mp": 50, "ultra_wide_mp": 8, "ois": True, "has5g": True, "ip_rating": "IP54", "nfc": True, "aperture": 1.8, "colour": "Midnight Blue"}
    assert {k: df[f"x_{k}"] for k in want} == want


def test_merge_precedence(spark):
    df = spark.createDataFrame([(None, 6, 8)], "page_ram_gb int, kb_ram_gb int, title_ram_gb int")
    row = specs.merged(df, ["page", "kb", "title"]).first()
    assert row["ram_gb"] == 6 and row["spec_sources"] == {"ram_gb": "kb"}


def test_fold_and_offers(spark):
    rows = spark.createDataFrame([("m", "8r-128s", 100, 1, "a", True), ("m", "?r-128s", 90, 2, "b", None), ("m", "6r-64s", 50, 3, "a", False), ("n", "?r-?s", 10, 4, "a", None), ("m", "8r-128s", 100, 5, "a", False)], "model string, config string, price long, ord long, platform string, in_stock boolean")
    got = {(r["model"], r["config"]): r["target"] for r in grouping.fold_configs(rows).collect()}
    assert got[("m", "?r-128s")] == "8r-128s" and got[("n", "?r-?s")] == "?r-?s"
    best = {(r["model"], r["config"]): r for r in grouping.best_offers(rows, ["model", "config"]).collect()}
    assert len(best[("m", "8r-128s")]["offers"]) == 1 and best[("m", "8r-128s")]["best"]["in_stock"] is True


def test_knn_over_every_part(spark, tmp_path):
    import __spark_entry__ as e

    rng = random.Random(4)
    parts = [(i, rng.choice([1, 2, 3, 7, 8, 30]), round(rng.uniform(900, 2000), 2)) for i in range(1, 90)] + [(90, 50, 1000.0), (91, None, 1000.0), (92, 7, None)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["q"]: r["ratio"] for r in e.queries()["knn_ratio"](spark, str(tmp_path)).collect()}
    want = {91: None}
    for q, x, _ in parts:
        if x is not None:
            near = sorted((abs(kx - x), k, y / (kx + 1)) for k, kx, y in parts if kx is not None and y is not None)[:5]
            want[q] = math.floor(sorted(r for *_, r in near)[2] * 1000 + 0.5) / 1000
    assert got == want


def test_history(spark):
    rows = spark.createDataFrame([("k", "a", dt.datetime(2024, 1, d), float(p), d) for d, p in ((1, 100), (2, 90), (3, 80))] + [("z", "a", dt.datetime(2024, 1, 1), 5.0, 9)], "key string, platform string, ts timestamp, price double, ord long")
    got = {r["key"]: r for r in history.stats(rows).collect()}
    assert got["k"]["trend"] == "falling" and got["k"]["position"] == 0.0 and got["k"]["current"] == 80.0
    assert got["z"]["trend"] == "stable"
    assert {r["level"] for r in history.buckets(history.series(rows.where("key = 'z'"), 5)).collect()} == {3}


def test_pages_and_reviews(spark):
    page = "Phone 20% 14,999 ₹11,999 + ₹49 Protect Promise Fee | Delivery by 24 Aug, Mon | Seller ShopOne 4.5 | No Cost EMI | Bank offers ₹500 off"
    r = pages.checkout(spark.createDataFrame([(page,)], "text string")).first()
    assert (r["page_price"], r["page_mrp"], r["in_stock"], r["seller"], r["bank_offer"], r["no_cost_emi"]) == (11999, 14999, True, "ShopOne", 500, True)
    html = '<html><script type="application/ld+json">{"sku":"A","offers":{"price":"99","availability":"https://schema.org/InStock"}}</script><b>x &amp; y</b></html>'
    assert one(spark, pages.json_ld(F.col("c")), c=html) == "LD_PRICE=99 LD_SKU=A LD_STOCK=InStock"
    assert one(spark, text.html_to_text(F.col("c")), c=html) == "x & y"
    body = "5 ★ 10 4 ★ 5 3 ★ 2 2 ★ 1 1 ★ 1,000 5.0 • Great battery but bad camera Verified Purchase · Mar, 2025 1.0 • Not good &amp; hot Helpful for 3"
    df = spark.createDataFrame([(1, body)], "id long, text string")
    got = pages.reviews(df, "id", "text").orderBy("pos").collect()
    assert [x["stars"] for x in got] == [5.0, 1.0] and got[0]["verified"] and got[0]["date"] == "Mar, 2025" and got[1]["text"] == "Not good & hot"
    assert one(spark, pages.histogram(F.col("c")), c=body)[1] == 1000
    tally = {r["aspect"]: (r["positive"], r["negative"]) for r in text.aspects(pages.reviews(df, "id", "text"), "pos", "text", [("battery", r"\bbattery\b"), ("camera", r"\bcamera\b")], r"\b(good|great)\b", r"\bbad\b", r"\bnot\b").collect()}
    assert tally == {"battery": (1, 0), "camera": (0, 1)}


def card(name, price, ram, storage, mah, rating, votes, **more):
    return {"product_name": f"{name} ({'Black'}, {storage} GB) {ram} GB RAM | 6.5 inch FHD+ AMOLED 120Hz display | {mah} mAh, 33W fast charging | 50MP camera 5G smartphone", "selling_price": {"value": price}, "rating": rating, "review_count": votes, "product_url": f"https://shop.example/{name.replace(' ', '-')}-{ram}/p/itm?pid={name}{ram}{storage}", **more}


def test_cards_to_ranking(spark, tmp_path):
    cards = [card("Redmi Alpha", 14000, 8, 128, 5000, 4.3, 5000), card("Redmi Alpha", 13000, 6, 128, 5000, 4.3, 900), card("Vivo Beta", 14500, 4, 64, 4000, 3.9, 40), card("Poco Gamma", 19999, 12, 256, 6000, 4.5, 9000), {"product_name": "Back Cover for Redmi Alpha", "selling_price": "₹199"}, {"error": "timeout"}, 5]
    (tmp_path / "flipkart.json").write_text(json.dumps(cards))
    (tmp_path / "amazon.json").write_text(json.dumps({"products": [{"name": "Nokia Keypad 105 feature phone", "final_price": 1200, "sponsored": "false"}]}))
    (tmp_path / "manifest.json").write_text("{}")
    raw = runs.cards(spark, str(tmp_path))
    got = {r["platform"]: r["status"] for r in runs.health(raw).collect()}
    assert got == {"flipkart": "ok", "amazon": "ok"}
    rows = runs.listings(raw)
    assert rows.count() == 6
    cands = rank_cards.candidates(rank_cards.analysed(rows))
    asked = intent.intents(spark.createDataFrame([("a", "best phones under 15000"), ("b", "value phones under 20000")], "query_id string, query string"))
    ranked, rejected = rank_cards.rank(cands, asked)
    out = ranked.orderBy("query_id", "rank").select("query_id", "rank", "name", "price", "total", "variant_of", "badges").collect()
    a = [r for r in out if r["query_id"] == "a"]
    assert len(a) == 3 and all(r["price"] <= 15000 for r in a) and [r["rank"] for r in a] == [1, 2, 3]
    assert "Alpha" in a[0]["name"] and "TOP PICK" in a[0]["badges"] and sum(r["variant_of"] is not None for r in a) == 1
    assert len([r for r in out if r["query_id"] == "b"]) == 4
    again, _ = rank_cards.rank(cands, asked, parts=3)
    assert {(r["query_id"], r["rank"], r["name"], r["total"]) for r in again.collect()} == {(r["query_id"], r["rank"], r["name"], r["total"]) for r in out}
    said = notes.annotated(ranked.withColumn("soc_name", F.lit(None).cast("string"))).where("query_id = 'a' AND rank = 1").first()
    assert "AMOLED panel" in said["pros"] and "chipset unknown — performance not verified" in said["cons"] and said["verdict"].startswith("Best overall pick at ₹")
    table = notes.head_to_head(ranked, ["price", "total"], 2).where("query_id = 'a' AND metric = 'total'").first()
    assert float(table["p1"]) >= float(table["p2"])
    why = {x for r in rejected.collect() for x in r["reasons"]}
    assert {"over budget", "category"} <= why


def test_gates_let_unknown_pass(spark):
    rules = [(F.col("x") == F.lit(False), "no x")]
    df = spark.createDataFrame([(None,), (False,), (True,)], "x boolean").withColumn("r", ranking.reasons(rules))
    assert [r["r"] for r in df.collect()] == [[], ["no x"], []]


def test_external(spark):
    html = '<a href="acme_one-12.php"><img><span>Acme One</span></a><a href="news-1.php">News</a><a href="acme_one_pro-13.php">Acme One Pro</a>'
    index = external.index_entries(spark.createDataFrame([("Acme", html)], "brand string, html string"))
    assert {(r["slug"], r["name"]) for r in index.collect()} == {("acme_one-12.php", "Acme One"), ("acme_one_pro-13.php", "Acme One Pro")}
    asked = spark.createDataFrame([(1, "Acme One 5G", "Acme"), (2, "One", "Acme"), (3, "Acme Two", None)], "id long, name string, brand string")
    assert [(r["id"], r["slug"]) for r in external.resolve(asked, index).collect()] == [(1, "acme_one-12.php")]
    page = "Acme One - Full phone specifications\nDisplay Type AMOLED, 120Hz Size 6.67 inches Resolution 1080 x 2400 Chipset Qualcomm SM8 Snapdragon 8 (4 nm) AnTuTu: 900000 Main Camera 50 MP OIS NFC Yes Charging 67W 5000 mAh IP68"
    row = external.spec_page(spark.createDataFrame([(page,)], "t string"), F.col("t")).first()
    assert (row["external_name"], row["external_soc_name"], row["external_antutu"], row["external_panel"], row["external_resolution"], row["external_nfc"], row["external_ip_rating"]) == ("Acme One", "Snapdragon 8", 900000, "AMOLED", "FHD+", True, "IP68")
    boxed = '{"name":[0,"Chipset"],"displayName":[0,"Processor"],"value":[0,"Chip 9"]} &quot;name&quot;:&quot;nfc&quot;,&quot;value&quot;:&quot;No&quot; "lowPrice": 9000, "highPrice": 12000'
    assert one(spark, external.page_fields(F.col("c")), c=boxed) == {"chipset": "Chip 9", "processor": "Chip 9", "nfc": "No"}
    assert tuple(one(spark, external.market_price(F.col("c")), c=boxed)) == (9000, 12000)


def test_stream(spark, tmp_path):
    rows = [("k", "p", dt.datetime(2024, 1, d, 1), float(d)) for d in (1, 1, 2, 9)]
    spark.createDataFrame(rows, observations.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = observations.append(observations.daily(observations.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["low"], r["n"]) for r in got} == {(1.0, 2), (2.0, 1)}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "catalog_rank" in e.queries()


def test_earlier_folds_change_later_targets(spark):
    """The known one of 128 is dearer until '?r-128s' folds into it; then '?r-?s' follows, where prices before folds say 64."""
    rows = [("m", "8r-128s", 100, 1), ("m", "6r-64s", 90, 2), ("m", "?r-128s", 80, 3), ("m", "?r-?s", 70, 4), ("m", "4r-?s", None, 5), ("u", "8r-128s", None, 6), ("u", "?r-128s", 5, 7)]
    got = {(r["model"], r["config"]): r["target"] for r in grouping.fold_configs(spark.createDataFrame(rows, "model string, config string, price long, ord long")).collect()}
    assert got[("m", "?r-128s")] == got[("m", "?r-?s")] == got[("m", "4r-?s")] == "8r-128s"
    assert got[("u", "?r-128s")] == "?r-128s"


def test_reviews_of_a_product(spark):
    from stallmark.operators import reviews

    page = "Great 4.2 ★ 1,234 Ratings and 56 Reviews 5 ★ 100 4 ★ 50 3 ★ 20 2 ★ 10 1 ★ 20 5.0 • Review for: Phone Color Red Storage 128 GB Battery is great and it heats up. Not bad camera Verified Purchase · Mar, 2025 Helpful for 3 1.0 • The sound! Doesn&#x27;t heat, battery is a waste 3.0 • display 4.0 • " + "Battery " + "very " * 20 + "good"
    rows = spark.createDataFrame([("a", 1, page), ("a", 2, "2.0 • camera, CAMERA is poor"), ("b", 1, "nothing here"), ("c", 1, None)], "key string, ord int, text string")
    got = {r["key"]: r for r in reviews.summaries(rows).collect()}
    a = got["a"]
    assert (a["total_ratings"], a["total_reviews"], a["sampled"], a["distribution"][2], a["negative_share"]) == (1234, 56, 5, 10, 30 / 200)
    tally = {t["aspect"]: (t["positive"], t["negative"], t["example"]) for t in a["aspects"]}
    assert tally == {"battery": (2, 1, "Battery is great"), "camera": (1, 2, "Not bad camera Verified Purchase · Mar"), "heating": (1, 1, "it heats up"), "sound": (0, 1, "The sound")}
    assert [t["aspect"] for t in a["aspects"]] == ["battery", "camera", "heating", "sound"]
    assert [t["aspect"] for t in a["praised"]] == ["battery"] and [t["aspect"] for t in a["complained"]] == ["camera"]
    assert got["b"]["sampled"] == got["c"]["sampled"] == 0 and got["b"]["aspects"] == [] and got["c"]["distribution"] is None
