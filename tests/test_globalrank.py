import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stallmark.operators.globalrank import global_percent_rank, global_row_number


def test_ranks_equal_those_of_one_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, float(rng.randint(0, 20))) for i in range(400)] + [("c", 1, 1.0)]
    df = spark.createDataFrame(rows, "q string, i long, v double")
    w = Window.partitionBy("q").orderBy("v", "i")
    want = {(r["q"], r["i"]): (r["n"], r["p"]) for r in df.withColumn("n", F.row_number().over(w)).withColumn("p", F.percent_rank().over(Window.partitionBy("q").orderBy("v"))).collect()}
    got = {(r["q"], r["i"]): r["n"] for r in global_row_number(df, ["q"], [F.col("v"), F.col("i")], "n", 6).collect()}
    assert got == {k: n for k, (n, _) in want.items()}
    share = {(r["q"], r["i"]): r["p"] for r in global_percent_rank(df, ["q"], F.col("v"), "p", 6).collect()}
    assert share[("c", 1)] is None
    assert all(abs(share[k] - p) < 1e-12 for k, (_, p) in want.items() if k[0] != "c")


def test_medians_of_several_columns(spark):
    import statistics

    from stallmark.operators.globalrank import global_medians

    rng = random.Random(8)
    rows = [(q, rng.choice([None, 1.0, 2.5, 7.0, float(rng.randint(0, 90))]), rng.randint(0, 5), None) for q in ("a", "b", "c") for _ in range(rng.randint(1, 60))]
    got = {r["q"]: r for r in global_medians(spark.createDataFrame(rows, "q string, x double, y int, z double"), ["q"], ["x", "y", "z"], 5).collect()}
    for q in ("a", "b", "c"):
        for i, c in ((1, "x"), (2, "y")):
            known = [r[i] for r in rows if r[0] == q and r[i] is not None]
            assert got[q][c] == (statistics.median(known) if known else None)
        assert got[q]["z"] is None


def test_budgets_run_over_the_whole_order(spark):
    from pyspark.sql import functions as F

    from stallmark.operators.external import affordable

    rows = [("q", i, (i * 7) % 5 + 1) for i in range(40)] + [("r", 1, 100), ("r", 2, 1)]
    got = sorted((r["q"], r["i"], r["spent"]) for r in affordable(spark.createDataFrame(rows, "q string, i int, cost int"), "q", ["i"], F.col("cost"), 20, 6).collect())
    want, spent = [], 0
    for q, i, cost in rows[:40]:
        if spent < 20:
            want.append((q, i, spent))
        spent += cost
    assert got == [*want, ("r", 1, 0)]
