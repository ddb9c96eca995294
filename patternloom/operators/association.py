"""Association rules between arrays, level by level.

A set's support is the sum of the least counts over the cells that all its arrays have. Each level keeps the
cells of its candidate sets as a table; one join with the items and one aggregate give the supports of the next.
Only rules and the candidates' supports, never cells, reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settling import settled

#: Sets of a smaller support are dropped.
LEAST_SUPPORT = 1e-6


def mine(cells: DataFrame, lhs: list[str], rhs: list[str], conf: float = 0.75, sig: float = 0.1, diff: float = 0.1, max_depth: int = 32) -> DataFrame:
    """``lhs`` (names joined by commas), ``rhs, depth, conf, sig``.

    conf = support(A and b) / support(A), sig = support(A and b) / support(b). A set is extended by later items of
    ``lhs`` only; it is dropped where its support or significance is too small, or where the last item took less
    than ``diff`` of the support away. A rule that reaches ``conf`` is emitted, unless a shorter emitted rule of the
    same right side is part of it, and not extended. Without cells there are no rules.
    """
    spark = cells.sparkSession
    items = cells.where(F.col("name").isin(lhs)).groupBy("name", "x", "y").agg(F.sum("cnt").alias("cnt"))
    place = spark.createDataFrame([(n, i) for i, n in enumerate(lhs)], "name string, item int")
    items = settled(items.join(F.broadcast(place), "name").select("item", "x", "y", "cnt"))
    targets = cells.where(F.col("name").isin(rhs)).groupBy("name", "x", "y").agg(F.sum("cnt").alias("b")).withColumnRenamed("name", "rhs")
    targets = settled(targets)
    base = targets.groupBy("rhs").agg(F.sum("b").alias("supp_b"))
    one = items.select(F.array("item").alias("set"), "x", "y", "cnt")
    rules, level, before = [], one, None
    for depth in range(1, max_depth + 1):
        level = settled(level)
        supp_a = level.groupBy("set").agg(F.sum("cnt").alias("supp")).where(F.col("supp") >= LEAST_SUPPORT)
        both = level.join(targets, ["x", "y"]).groupBy("set", "rhs").agg(F.sum(F.least("cnt", "b")).alias("supp_ab"))
        rows = both.join(supp_a, "set").join(F.broadcast(base), "rhs").select("set", "rhs", "supp", (F.col("supp_ab") / F.col("supp")).alias("conf"), (F.col("supp_ab") / F.col("supp_b")).alias("sig"))
        rows = rows.where(F.col("sig") >= sig)
        if before is not None:  # the set without its last item, still a candidate of the same right side
            prefix = before.select(F.col("set").alias("part"), "rhs", F.col("supp").alias("supp_part"))
            rows = rows.withColumn("part", F.slice("set", 1, depth - 1)).join(prefix, ["part", "rhs"]).where((F.col("supp_part") - F.col("supp")) / F.col("supp_part") >= diff).drop("part", "supp_part")
        rows = settled(rows)
        new = rows.where(F.col("conf") >= conf)
        for old in rules:
            shorter = old.select(F.col("set").alias("less"), F.col("rhs").alias("less_rhs"))
            new = new.join(shorter, (F.col("rhs") == F.col("less_rhs")) & (F.size(F.array_except("less", "set")) == 0), "left_anti")
        new = settled(new.withColumn("depth", F.lit(depth)))
        rules.append(new)
        before = rows.where(F.col("conf") < conf)
        if before.isEmpty():
            break
        alive = before.select("set").distinct()
        grown = level.join(alive, "set").withColumnRenamed("cnt", "a").join(items.withColumnRenamed("cnt", "b"), ["x", "y"])
        level = grown.where(F.col("item") > F.element_at("set", -1)).select(F.concat("set", F.array("item")).alias("set"), "x", "y", F.least("a", "b").alias("cnt"))
    out = rules[0]
    for more in rules[1:]:
        out = out.unionByName(more)
    names = F.array(*(F.lit(n) for n in lhs))
    return out.select(F.array_join(F.transform("set", lambda i: F.element_at(names, i + 1)), ",").alias("lhs"), "rhs", "depth", "conf", "sig")


def redundant(rules: DataFrame) -> DataFrame:
    """Rules of which a shorter one with the same right side is part."""
    r = rules.select("*", F.split("lhs", ",").alias("s"))
    less = r.select(F.col("s").alias("less"), F.col("rhs").alias("less_rhs"))
    return r.join(less, (F.col("rhs") == F.col("less_rhs")) & (F.size("less") < F.size("s")) & (F.size(F.array_except("less", "s")) == 0), "left_semi").select(*rules.columns)


def as_text(rules: DataFrame) -> DataFrame:
    return rules.select(F.concat(F.lit("{"), "lhs", F.lit("}=>{"), "rhs", F.lit("}")).alias("rule"), "conf", "sig")
