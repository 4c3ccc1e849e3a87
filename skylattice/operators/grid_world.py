"""A grid world's transitions, and its values as fixpoints of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.sources.shared import written

#: Fixed order of the four moves.
MOVES = ((0, "up", -1, 0), (1, "down", 1, 0), (2, "left", 0, -1), (3, "right", 0, 1))


def transitions(spark: SparkSession, rows: int, cols: int, terminals: tuple[tuple[int, int], ...], reward: float = -1.0) -> DataFrame:
    """``i, j, action, ni, nj, reward`` of all moves; walls keep one in place, terminal states have no moves."""
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
    ends = F.lit(False)
    for a, b in terminals:
        ends = ends | ((F.col("i") == a) & (F.col("j") == b))
    moves = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, MOVES)) + " AS m(rank, action, di, dj)")
    near = lambda at, by, n: F.least(F.greatest(at + by, F.lit(0)), F.lit(n - 1))
    pairs = cells.where(~ends).crossJoin(F.broadcast(moves))  # four moves a state
    return pairs.select("i", "j", "action", "rank", near(F.col("i"), F.col("di"), rows).alias("ni"), near(F.col("j"), F.col("dj"), cols).alias("nj"), F.lit(reward).alias("reward"))


def _fixpoint(moves: DataFrame, gamma: float, theta: float, how: str) -> DataFrame:
    """Sweeps that use the previous values only, until no value changes by ``theta`` or more."""
    states = moves.select("i", "j").unionByName(moves.select(F.col("ni").alias("i"), F.col("nj").alias("j"))).distinct()
    values = written(states.withColumn("value", F.lit(0.0)))
    while True:
        after = values.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("value").alias("later"))
        gain = F.col("reward") + gamma * F.col("later")
        best = moves.join(after, ["ni", "nj"]).groupBy("i", "j").agg((F.max(gain) if how == "max" else F.avg(gain)).alias("new"))
        both = written(values.join(best, ["i", "j"], "left").select("i", "j", F.coalesce("new", "value").alias("new"), "value"))
        values = both.select("i", "j", F.col("new").alias("value"))
        if both.agg(F.max(F.abs(F.col("new") - F.col("value")))).first()[0] < theta:
            return values


def optimal_values(moves: DataFrame, gamma: float = 0.9, theta: float = 1e-6) -> DataFrame:
    """``i, j, value`` under the best moves."""
    return _fixpoint(moves, gamma, theta, "max")


def policy_values(moves: DataFrame, gamma: float = 0.9, theta: float = 1e-6) -> DataFrame:
    """``i, j, value`` if all moves are equally likely."""
    return _fixpoint(moves, gamma, theta, "avg")


def greedy_policy(moves: DataFrame, values: DataFrame, gamma: float = 0.9) -> DataFrame:
    """The best move of each state, the first of equals."""
    after = values.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("value").alias("later"))
    gain = F.round(F.col("reward") + gamma * F.col("later"), 9)
    return moves.join(after, ["ni", "nj"]).groupBy("i", "j").agg(F.max_by("action", F.struct(gain, -F.col("rank"))).alias("action"))
