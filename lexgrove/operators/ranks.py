"""Numbers and first rows of groups of any size, without a window over a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.operators.work import written

#: Groups up to which their first numbers are broadcast, a few dozen bytes each; beyond it they are joined by shuffling.
FEW_GROUPS = 50_000
#: Hex digits by which a bound is refined in one pass, and rows beyond those wanted that a bound may let through.
DIGITS, SLACK = 3, 64


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))


def numbered(rows: DataFrame, order: list[str | Column], by: list[str] | tuple[str, ...] = (), name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the place from 0 in ``order`` among the rows that agree in ``by`` (nulls are equal and come first).

    Rows are dealt by ranges of (by, order) and sorted, and a row's place in its partition is written with it. The counts of the
    partitions, one number each, give the places of all rows; a group's first one is taken off. So a group of any size lies
    in as many partitions as it fills. Rows that agree in ``by`` and ``order`` get different numbers, in any order.
    """
    spark = rows.sparkSession
    keys = [F.col(k) if isinstance(k, str) else k for k in (*by, *order)]
    dealt = rows.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(dealt.withColumns({"__part": F.spark_partition_id(), "__at": in_part}), "numbered")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    if not before:
        return placed.drop("__part", "__at").withColumn(name, F.lit(0).cast("long"))
    # One row for each partition.
    offsets = spark.createDataFrame(before, "__part int, __before long")
    out = placed.join(F.broadcast(offsets), "__part").withColumn("__at", F.col("__at") + F.col("__before")).drop("__part", "__before")
    if not by:
        return out.withColumnRenamed("__at", name)
    firsts = written(out.groupBy(*by).agg(F.min("__at").alias("__first")), "firsts")
    few = firsts.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    firsts = firsts.withColumnsRenamed({k: f"__of_{k}" for k in by})
    joined = out.join(F.broadcast(firsts) if few else firsts, _same(list(by)))
    return joined.withColumn(name, F.col("__at") - F.col("__first")).drop("__at", "__first", *(f"__of_{k}" for k in by))


def hash_bounds(rows: DataFrame, keys: list[str], wanted: DataFrame, h: str = "h", slack: int = SLACK) -> DataFrame:
    """(keys, need, bound): the beginning of a hash up to which at least ``need`` rows of a group lie, and not many more.

    ``wanted`` (keys, need) names the groups, as few as strata are; ``h`` is a hexadecimal hash of equal length. Counts of
    the hashes' next DIGITS digits show in which of their values the wanted number is reached, and a pass looks only
    into that one, until it holds at most ``slack`` rows. A group with no more rows than wanted has the empty bound, and
    gives them all. What is shuffled are counts.
    """
    length = rows.agg(F.max(F.length(h))).first()[0] or 0
    state = written(wanted.select(*keys, "need", F.lit("").alias("bound"), F.col("need").cast("long").alias("rest"), F.lit(False).alias("done")), "bounds")
    for _ in range(-(-length // DIGITS)):
        live = state.where("not done and need > 0")
        if live.isEmpty():
            break
        inside = rows.select(*keys, h).join(F.broadcast(live.select(*keys, "bound")), keys).where(F.startswith(F.col(h), F.col("bound")))
        next_ = F.substr(F.col(h), F.length("bound") + 1, F.lit(DIGITS)).alias("d")
        counts = inside.groupBy(*keys, next_).agg(F.count("*").alias("n"))
        # 16**DIGITS rows of a group at most.
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("upto", upto).join(F.broadcast(live.select(*keys, "rest")), keys).where("upto >= rest")
        hit = reached.groupBy(*keys).agg(F.min(F.struct("d", "n", "upto")).alias("m"))
        new = state.join(F.broadcast(hit), keys, "left")
        rest = F.col("rest") - F.col("m.upto") + F.col("m.n")
        state = written(new.select(
            *keys, "need", F.concat("bound", F.coalesce("m.d", F.lit(""))).alias("bound"), F.coalesce(rest, F.col("rest")).alias("rest"),
            (F.col("done") | F.col("m").isNull() | (F.col("m.n") <= slack)).alias("done"),
        ), "bounds")
    return state.select(*keys, "need", "bound")


def first_by_hash(rows: DataFrame, keys: list[str], wanted: DataFrame, h: str = "h", slack: int = SLACK) -> DataFrame:
    """Of each group the ``need`` first rows by hash, with ``need`` and the place ``n`` from 1; ``wanted`` (keys, need) as in ``hash_bounds``.

    Only about the wanted rows leave the scan; of these alone a group's are numbered in one place. Groups that are not
    wanted have no rows. Rows of equal hash are numbered in any order.
    """
    bounds = hash_bounds(rows, keys, wanted, h, slack)
    near = rows.join(F.broadcast(bounds.where("need > 0")), keys).where(F.left(F.col(h), F.length("bound")) <= F.col("bound"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(h))
    return near.drop("bound").withColumn("n", n).where(F.col("n") <= F.col("need"))


def first_of_known(rows: DataFrame, keys: list[str], wanted: DataFrame, h: str = "h") -> DataFrame:
    """As ``first_by_hash``, where ``wanted`` (keys, need, found) also tells how many rows each group has.

    The share of a group that is wanted, with a margin, gives a bound on the first eight hex digits, so that one pass over ``rows``
    does, which need not be written. A group that gives fewer rows than it should is read again up to a bound four times as high.
    """
    share = F.least(F.lit(1.0), (F.col("need") + 6 * F.sqrt("need") + 16) / F.col("found"))
    live = written(wanted.select(*keys, "need", "found", share.alias("share")).where("need > 0 and found > 0"), "bounds")
    parts = []
    while True:
        bound = F.lower(F.lpad(F.hex(F.least(F.col("share") * 2**32, F.lit(2**32 - 1)).cast("long")), 8, "0"))
        near = rows.join(F.broadcast(live.select(*keys, "need", bound.alias("bound"))), keys).where(F.left(h, F.lit(8)) <= F.col("bound"))
        near = written(near.drop("bound"), "near")
        counts = live.join(near.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").fillna(0, ["n"])
        short = written(counts.where("n < least(need, found) and share < 1").select(*keys, "need", "found", F.least(F.lit(1.0), 4 * F.col("share")).alias("share")), "short")
        parts.append(near.join(F.broadcast(short.select(*keys)), keys, "left_anti"))
        if short.isEmpty():
            break
        live = short
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(h))
    return reduce(DataFrame.unionByName, parts).withColumn("n", n).where(F.col("n") <= F.col("need"))
