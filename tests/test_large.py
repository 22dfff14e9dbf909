"""Registered queries against their oracles on rows that only larger tables have: high numbers, copies, chance collisions."""

import time

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from stallmark import registry
from stallmark.operators import external, intent, pages, ranking, reviews, text
from stallmark.plans import products
from stallmark.sources import runs


def same(spark, tmp_path, name, **tables):
    """Whether a query equals its oracle on these tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.to_parquet(tmp_path / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0

    def rows(df):
        return sorted(repr([None if pd.isna(v) else float(v) if isinstance(v, int | float) or hasattr(v, "dtype") else v for v in r]) for r in df[columns].itertuples(index=False, name=None))

    return rows(got) == rows(want)


def test_checkout_of_pages_with_high_numbers(spark, tmp_path):
    """List prices under the price stand as they are; prices of seven digits are read."""
    ids = [*range(12), *range(9000, 9012), *range(18000, 18012), *range(1_200_000, 1_200_012)]
    assert same(spark, tmp_path, "checkout_pages", pages=pd.DataFrame({"page_id": ids, "url": "x", "html": ""}))


def test_sections_of_pages_with_high_numbers(spark, tmp_path):
    """The head before a heading doesn't grow with a page's number."""
    assert same(spark, tmp_path, "spec_sections", pages=pd.DataFrame({"page_id": [0, 1, 2, 3_000_000_000, 3_000_000_001], "url": "x", "html": ""}))


def tasks(df):
    return df.rdd.getNumPartitions()


def test_page_values_of_a_small_file_are_dealt(spark):
    """A file of one row group goes to as many tasks as the session shuffles to; a page of many fields is read once."""
    html = ",".join(f'{{"name":"Field {i}","value":"{i}"}}' for i in range(2000)) + ',{"name":"Chipset","value":"Chip 1"}'
    df = spark.createDataFrame([(1, html)], "id int, html string").coalesce(1)
    out = external.field_page(df, F.col("html"))
    assert tasks(out) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = time.time()
    assert out.first()["external_soc_name"] == "Chip 1"
    assert time.time() - t < 15


def test_overlap_makes_the_other_words_once(spark):
    """A long text against one with very many words: linear in the first, times the distinct words of the second."""
    df = spark.createDataFrame([(" ".join(["word", "other"] * 10000), "word " * 20000)], "a string, b string")
    t = time.time()
    assert df.select(text.token_overlap(F.col("a"), F.col("b"), ["the"])).first()[0] == 10000
    assert time.time() - t < 15


def test_wishes_of_a_small_file_are_dealt(spark):
    df = spark.createDataFrame([(1, "phones under 9k")], "query_id int, query string").coalesce(1)
    assert tasks(intent.intents(df)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_titles_of_a_small_file_are_dealt(spark):
    assert tasks(products.titles(spark, "/root/testdata/sf0.001")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_addresses_of_one_hash_are_two_listings(spark):
    """Aa and BB have the same 32-bit hash."""
    cards = spark.sql("""SELECT 'flipkart' AS platform, 'f' AS file, id AS pos, parse_json(concat('{"title": "Phone", "url": "https://www.flipkart.com/g/p/itm?pid=', pid, '"}')) AS raw FROM VALUES (0, 'Aa'), (1, 'BB'), (2, 'Aa') AS t(id, pid)""")
    ids = [r["id"] for r in runs.listings(cards).orderBy("pos").collect()]
    assert ids[0] == ids[2] != ids[1]
    assert ids[0].split("-")[0] == ids[1].split("-")[0]


def test_histogram_reads_a_page_once(spark):
    """Stars and counts are taken out of a page once each, not for every star; the last count of a star stands."""
    df = spark.createDataFrame([("5 ★ 1,000 4 ★ 2 3 ★ 3 2 ★ 4 1 ★ 5 5 ★ 7",), ("5 ★ 1",), (None,)], "t string").select(pages.histogram(F.col("t")).alias("h"))
    assert [r["h"] for r in df.collect()] == [{1: 5, 2: 4, 3: 3, 4: 2, 5: 7}, None, None]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2


def test_weights_are_quotients_of_decimals(spark):
    """To the last bit, lifted or not: else products whose scores are equal tie in one engine only, and shares of a large set differ."""
    for wish, lifted, total in ((["performance", "battery"], {"performance": 0.45, "battery": 0.32}, 1.3), (["value"], {}, 1.0), (["camera"], {"camera": 0.27}, 1.15)):
        got = spark.range(1).select(*(w.alias(k) for k, w in ranking.weights(F.array(*map(F.lit, wish))).items())).first().asDict()
        assert got == {k: (w | lifted)[k] / total for w in [ranking.WEIGHTS] for k in w}


def test_aspects_meet_a_clause_once(spark):
    """No pattern of the clauses is in the plan, where a filter on the side had each of them run again; sides are as before."""
    said = ["Not a bad camera", "heating", "no heating issue", "Speakers are ok", "The POWER BANK is good and bad", "It is what it is", "", None, "fast, slow. Battery"]
    df = spark.createDataFrame([(1, 0, i, float(i % 5 + 1), t) for i, t in enumerate(said)], "key int, ord int, pos int, stars double, text string")
    out = reviews.mentions(df)
    got = sorted((r["pos"], r["at"], r["aspect"], r["side"], r["clause"]) for r in out.collect())
    assert got == [(0, 0, "camera", 1, "Not a bad camera"), (1, 0, "heating", -1, "heating"), (2, 0, "heating", 1, "no heating issue"), (3, 0, "sound", 1, "Speakers are ok"), (4, 0, "battery", 1, "The POWER BANK is good"), (8, 0, "performance", 1, "fast"), (8, 1, "performance", -1, "slow"), (8, 2, "battery", 1, "Battery")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("fabulous") == 0
    assert reviews.mentions(df.limit(0)).count() == 0


def test_summaries_read_a_page_once(spark):
    """One pass over the pages and no join, where facts, counts of reviews and aspects had each read all pages; equal reviews count each."""
    liked = "5.0 • Great battery. The display is dull Helpful for 3 "
    rows = [("a", 2, "12 Ratings and 3 Reviews 5 ★ 1 4 ★ 2 3 ★ 3 2 ★ 4 1 ★ 5 " + liked * 3), ("a", 1, "x9.0 • é" + liked + "1.0 •　Camera"), ("b", 1, "99999999999999999999 ratings and 7 reviews 5 ★ 1"), ("c", 1, None), ("d", 1, "")]
    out = reviews.summaries(spark.createDataFrame(rows, "key string, ord int, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    got = {r["key"]: r for r in out.collect()}
    a = got["a"]
    assert (a["total_ratings"], a["total_reviews"], a["sampled"], a["distribution"], a["negative_share"]) == (12, 3, 5, {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}, 9 / 15)
    assert [tuple(t) for t in a["aspects"]] == [("battery", 4, 0, "Great battery"), ("display", 0, 4, "The display is dull"), ("camera", 0, 1, "Camera")]
    assert ([t["aspect"] for t in a["praised"]], [t["aspect"] for t in a["complained"]]) == (["battery"], ["display"])
    assert [(got[k]["total_ratings"], got[k]["total_reviews"], got[k]["sampled"], got[k]["aspects"], got[k]["distribution"]) for k in "bcd"] == [(None, 7, 0, [], None), (None, None, 0, [], None), (None, None, 0, [], None)]


def test_tallies_are_sums_of_mentions(spark):
    """What pages say, read once for all equal reviews, is what their reviews say one by one."""
    some = ["5.0 • Not a bad camera", "1.0 • heating and lag", "3.0 • screen", "4.0 • " + "very " * 20 + "good screen", "2.0 • nice sound, bad sound; price"]
    rows = [(k, p, "Reviews " + " ".join(some[(k * 7 + p * 3 + i * i) % 5] for i in range(k % 4 * 5))) for k in range(40) for p in range(3)]
    df = spark.createDataFrame(rows, "key int, ord int, text string")
    when = F.struct("ord", "pos", "at", "turn")
    each = reviews.mentions(pages.reviews(df, "key", "text", "ord").withColumnRenamed("id", "key")).groupBy("key", "aspect").agg(F.count_if(F.col("side") > 0), F.count_if(F.col("side") < 0), F.min_by(F.when(F.length("clause") <= 70, F.col("clause")), F.when(F.length("clause") <= 70, when)), F.min(when))
    got = sorted(tuple(r) for r in reviews.tallies(df).collect())
    assert len(got) > 100 and got == sorted(tuple(r) for r in each.collect())


def test_pages_are_held_by_their_bytes(monkeypatch):
    """A slice is a page and less than HELD bytes more; no page is lost."""
    monkeypatch.setattr(reviews, "HELD", 100)
    texts = ["x" * 60, None, "y" * 60, "z" * 1000, "", "w" * 10]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    held = [b.column("text").to_pylist() for b in reviews._held(batch)]
    assert sum(held, []) == texts and len(held) > 2 and all(sum(len(t or "") for t in h[1:]) < 100 for h in held)
    assert [b.num_rows for b in reviews._held(batch.slice(0, 0))] == [0]


def test_counts_are_the_histogram(spark):
    """One page in Python or a column of them: the same ratings by star."""
    texts = ["5 ★ 1,000 4 ★ 2 3★3 2 ★ 4 1 ★ 5 5 ★ 7", "5★4★3 3 ★ 1 2 ★ 1 1 ★ 1", "5 ★ 1 4 ★ , 3 ★ 1 2 ★ 1 1 ★ 1", "5 ★ 0001 4 ★ 9223372036854775807 3 ★ 0 2 ★ 1 1 ★ 1", "5 ★ 1 4 ★ 9223372036854775808 3 ★ 1 2 ★ 1 1 ★ 1", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", pages.histogram(F.col("t")).alias("h"))
    for r in df.collect():
        want = pages.counts(r["t"])
        assert r["h"] == (want and dict(enumerate(want, 1)))


def test_totals_of_a_page_of_digits():
    """Time is linear in a run of digits that no total ends."""
    t = time.time()
    assert pages.totals("1," * 100000 + " " * 100000) == (None, None) and pages.totals("see 1,2 Ratings and 3 reviews") == (12, 3)
    assert time.time() - t < 5
