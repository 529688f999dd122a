"""The spread-out path for large groups must give what a plain window gives."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tideline.operators import ranking
from tideline.operators.scale import number_rows, order_statistics, prefix_total

RND = random.Random(7)
ROWS = [("hot" if RND.random() < 0.4 else f"g{RND.randrange(5)}", i, float(RND.randrange(40))) for i in range(400)]


def frame(spark):
    return spark.createDataFrame(ROWS, "g string, id long, v double")


def test_positions_equal_a_window_on_split_groups(spark):
    out = number_rows(frame(spark), ["g"], [F.col("v").desc(), F.col("id")]).toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values(["v", "id"], ascending=[False, True])
        assert list(part["rank"]) == list(range(1, len(part) + 1))


def test_weighted_prefix_on_split_groups(spark):
    out = prefix_total(frame(spark), ["g"], [F.col("id")], F.col("v"), out="before").toPandas().sort_values("id")
    for _, part in out.groupby("g"):
        assert list(part["before"]) == list(part["v"].cumsum() - part["v"])


def test_quantiles_are_linear_interpolation(spark):
    out = order_statistics(frame(spark), ["g"], "v", {"a": 0.01, "b": 0.37, "c": 0.99}).toPandas().set_index("g")
    src = pd.DataFrame(ROWS, columns=["g", "id", "v"])
    for g, part in src.groupby("g"):
        assert np.allclose(out.loc[g, ["a", "b", "c"]].astype(float), np.quantile(part["v"], [0.01, 0.37, 0.99]))


def test_quantile_worked_numbers(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (10, 20, 30, 40)], "g int, v double")
    row = order_statistics(df, ["g"], "v", {"lo": 0.01, "hi": 0.99}).first()
    assert abs(row["lo"] - 10.3) < 1e-9 and abs(row["hi"] - 39.7) < 1e-9


def test_scores_equal_ranks_in_pandas(spark):
    long = frame(spark).select(F.col("g").alias("d"), F.lit("f").alias("factor"), F.col("id").alias("code"), F.col("v").alias("value"))
    got = ranking.score_cross_section(long, F.lit(False), lower_pct=10, upper_pct=90).toPandas().set_index("code")
    src = pd.DataFrame(ROWS, columns=["g", "code", "v"]).set_index("code")
    for _, part in src.groupby("g"):
        low, high = np.quantile(part["v"], [0.1, 0.9])
        clamped = part["v"].clip(low, high)
        mine = got.loc[part.index]
        assert np.allclose(mine["winsorized"], clamped) and np.allclose(mine["midrank"].astype(float), clamped.rank())
        assert np.allclose(mine["score"].astype(float), (clamped.rank() - 1) / (len(part) - 1))


def test_composite_counts_factors_active_by_their_inputs(spark):
    rows = [("d1", f"f{RND.randrange(2)}", c, RND.random()) for c in range(40)]
    scored = spark.createDataFrame(rows, "d string, factor string, code long, score double")
    states = [("d1", "f0", "active"), ("d1", "f1", "active"), ("d1", "f2", "active"), ("d1", "f3", "input_empty")]
    activity = spark.createDataFrame(states, "d string, factor string, state string")
    out = {r["code"]: r for r in ranking.composite_rank(ranking.composite(scored, activity)).collect()}
    for _, _, code, score in rows:
        assert out[code]["active"] == 3 and abs(out[code]["composite"] - (score + 1.0) / 3) < 1e-12
    assert sorted(r["rank"] for r in out.values()) == list(range(1, 41))
