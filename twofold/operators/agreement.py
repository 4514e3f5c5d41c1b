"""Agreement of partitions: contingency, mutual information, adjusted Rand, purity, rank correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twofold.errors import ContractError
from twofold.session import settled


def contingency(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, n): nodes in community a of `left` and b of `right`."""
    return (
        left.select("node_id", F.col("community").alias("a")).join(right.select("node_id", F.col("community").alias("b")), "node_id")
        .groupBy("a", "b").agg(F.count("*").alias("n"))
    )


def require_same_nodes(left: DataFrame, right: DataFrame) -> None:
    odd = left.join(right, "node_id", "left_anti").select("node_id").unionByName(right.join(left, "node_id", "left_anti").select("node_id")).limit(5).collect()
    if odd:
        raise ContractError(f"nodes of one partition only: {[r['node_id'] for r in odd]}")


def scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n, nmi (arithmetic mean; 1 where both are one group, 0 where one is), ari, purity of `left` against `right`.

    The degenerate adjusted Rand, with no pair to tell apart, is 1 where the numbers of the communities agree on every
    node and 0 otherwise.
    """
    table = contingency(left, right)
    rows = table.groupBy("a").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    log = lambda c: F.sum(F.col(c) * F.ln(F.col(c).cast("double")))
    t = table.agg(F.sum("n").alias("N"), log("n").alias("tl"), pairs("n").alias("tp"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    r = rows.agg(log("n").alias("rl"), pairs("n").alias("rp"), F.count("*").alias("rk"), F.sum("top").alias("top"))
    c = cols.agg(log("n").alias("cl"), pairs("n").alias("cp"), F.count("*").alias("ck"))
    n = F.col("N")
    one = t.crossJoin(r).crossJoin(c).where("N > 0")  # one row each
    h = lambda x: F.ln(n.cast("double")) - F.col(x) / n
    mutual = h("rl") + h("cl") - h("tl")
    expected = F.col("rp") * F.col("cp") / F.greatest(n * (n - 1) / 2.0, F.lit(1.0))
    best = (F.col("rp") + F.col("cp")) / 2.0
    agree = F.when(F.col("same") == n, 1.0).otherwise(0.0)
    return one.select(
        n.alias("n"),
        F.round(F.when((F.col("rk") == 1) & (F.col("ck") == 1), 1.0).when((F.col("rk") == 1) | (F.col("ck") == 1), 0.0).otherwise(F.greatest(F.try_divide(2.0 * mutual, h("rl") + h("cl")), F.lit(0.0))), 6).alias("nmi"),
        F.round(F.coalesce(F.try_divide(F.col("tp") - expected, F.when(F.abs(best - expected) > 1e-12, best - expected)), agree), 6).alias("ari"),
        F.round(F.col("top") / n, 6).alias("purity"),
    )


def agreement_matrix(partitions: dict[str, DataFrame]) -> DataFrame:
    """(left, right, n, nmi, ari, purity) of every two named partitions."""
    names, out = sorted(partitions), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            row = scores(partitions[a], partitions[b]).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "*")
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ContractError("agreement needs two partitions or more")
    return out


def average_ranks(scored: DataFrame, column: str) -> DataFrame:
    """(node_id, rank): ties share the mean of their places. Places come from the distinct values, whose counts are added up in
    ranges of values, so no single task orders all rows."""
    counts = scored.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranged = settled(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranks")  # read twice, one numbering
    before_part = ranged.groupBy("part").agg(F.sum("c").alias("s"))
    offsets = before_part.withColumn("o", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "o")
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    ranks = ranged.withColumn("upto", upto).join(F.broadcast(offsets), "part").select(  # one row a partition
        "v", (F.col("o") + F.col("upto") - (F.col("c") - 1) / 2.0).cast("double").alias("rank")
    )
    return scored.join(ranks, scored[column].eqNullSafe(ranks["v"])).select("node_id", "rank")


def spearman(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (spearman) of two score tables (node_id, score); NaN where one is constant."""
    both = average_ranks(left, "score").withColumnRenamed("rank", "x").join(average_ranks(right, "score").withColumnRenamed("rank", "y"), "node_id")
    x, y = F.col("x"), F.col("y")
    s = both.agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")
    )
    n = F.col("n")
    spread = F.sqrt((n * F.col("xx") - F.col("sx") ** 2) * (n * F.col("yy") - F.col("sy") ** 2))
    return s.select(F.when(spread > 0, F.round((n * F.col("xy") - F.col("sx") * F.col("sy")) / F.when(spread > 0, spread), 6)).otherwise(F.lit(float("nan"))).alias("spearman"))


def rank_auc(scored: DataFrame, outcomes: DataFrame, positive: tuple[str, ...]) -> DataFrame:
    """One row (n_positive, n_negative, auc): the chance that a positive scores higher, ties half; null without both classes."""
    labelled = scored.join(outcomes.select(F.col("student_id").alias("node_id"), "final_result"), "node_id").where("final_result is not null")
    ranks = average_ranks(labelled.select("node_id", "score"), "score").join(labelled.select("node_id", "final_result"), "node_id")
    yes = F.col("final_result").isin(*positive)
    s = ranks.agg(F.sum(yes.cast("long")).alias("p"), F.sum((~yes).cast("long")).alias("q"), F.sum(F.when(yes, F.col("rank"))).alias("r"))
    auc = F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q"))
    return s.select(F.coalesce("p", F.lit(0)).alias("n_positive"), F.coalesce("q", F.lit(0)).alias("n_negative"), F.round(auc, 6).alias("auc"))
