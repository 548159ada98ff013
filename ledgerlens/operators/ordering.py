"""Global order without a single-task window: running totals, row numbers and exact quantiles.

An unpartitioned window would move all rows into one task. Here rows are range partitioned, written once (so the
partition ids are the same for every reader), summed per partition, and each partition starts from the totals of the
partitions before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def range_partitioned(df: DataFrame, columns: Sequence) -> DataFrame:
    """``df`` cut into ranges of ``columns``, stored, with the range number in ``_part``."""
    return materialize(df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "ranged")


def _with_offsets(ranged: DataFrame, by: Sequence[str], totals: Mapping[str, str], descending: bool) -> DataFrame:
    """Joins, per (by, partition), the totals of all partitions that come earlier in the order."""
    order = F.col("_part").desc() if descending else F.col("_part").asc()
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_part = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_off_{out}") for out, c in totals.items()])
    offsets = per_part.select(*by, "_part", *[F.coalesce(F.sum(f"_off_{out}").over(earlier), F.lit(0)).alias(f"_off_{out}")
                                              for out in totals])
    same = F.lit(True)
    for c in [*by, "_part"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return (ranged.alias("l").join(offsets.alias("r"), same)
            .select("l.*", *[f"r._off_{out}" for out in totals]))


def running_totals(table: DataFrame, order: str, totals: Mapping[str, str], by: Sequence[str] = (),
                   descending: bool = True) -> DataFrame:
    """Adds ``{out: column}`` running sums along ``order`` within ``by``, the row itself included.

    ``table`` holds one row per (by, order): pre-aggregate first, so that a frequent value is one row, not a hot range.
    """
    ranged = range_partitioned(table, [*by, order])
    joined = _with_offsets(ranged, by, totals, descending)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "_part").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(*table.columns, *[(F.sum(c).over(inside) + F.col(f"_off_{out}")).alias(out)
                                           for out, c in totals.items()])


def global_row_number(df: DataFrame, order: Sequence, by: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Row number along ``order`` (columns or sort expressions, ending in a unique id) within ``by``."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = range_partitioned(df.withColumn("_one", F.lit(1).cast("bigint")), [*[F.col(b) for b in by], *order])
    joined = _with_offsets(ranged, by, {"n": "_one"}, descending=False)
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    return joined.select(*df.columns, (F.row_number().over(inside) + F.col("_off_n")).alias(out))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of the non-missing values: columns by, ``i`` (index into probs), ``q``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    return quantiles_of_table(running_totals(counts, "_v", {"_upto": "_n"}, by, descending=False), probs, by)


def quantiles_of_table(table: DataFrame, probs: Sequence[float], by: Sequence[str] = (),
                       carry: Sequence[str] = ()) -> DataFrame:
    """Quantiles from distinct values ``_v`` with counts ``_n`` and ascending running counts ``_upto``.

    ``carry`` columns are taken from the smallest value that is not below the quantile. ``probs`` must be evenly spaced; a row
    then finds the few quantile positions it covers by arithmetic.
    """
    m = len(probs)
    start, step = probs[0], ((probs[-1] - probs[0]) / (m - 1) if m > 1 else 1.0)
    totals = table.groupBy(*by).agg(F.sum("_n").alias("_total"))
    table = _attach(table, totals, by)
    span = F.greatest(F.col("_total") - 1, F.lit(1))
    first = F.floor(((F.col("_upto") - F.col("_n") - 1) / span - start) / step)
    last = F.ceil((F.col("_upto") / span - start) / step)
    first = F.greatest(first, F.lit(0)).cast("int")
    last = F.least(last, F.lit(m - 1)).cast("int")
    hits = table.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("i") + 1)
    hits = hits.withColumn("_pos", p * (F.col("_total") - 1))

    def covers(position):
        return (position >= F.col("_upto") - F.col("_n")) & (position < F.col("_upto"))

    low, high = covers(F.floor("_pos")), covers(F.ceil("_pos"))
    found = F.struct("_v", *carry)
    ends = (hits.where(low | high).groupBy(*by, "i")  # one row each for the lower and the upper neighbour
            .agg(F.max(F.when(low, found)).alias("_lo"), F.max(F.when(high, found)).alias("_hi"),
                 F.max("_pos").alias("_pos")))
    lo, hi = F.col("_lo._v"), F.col("_hi._v")
    ends = ends.withColumn("q", lo + (hi - lo) * (F.col("_pos") - F.floor("_pos")))
    return ends.select(*by, "i", "q", *[F.when(F.col("q") > lo, F.col(f"_hi.{c}")).otherwise(F.col(f"_lo.{c}")).alias(c)
                                        for c in carry])


def wide_quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles of many columns: ``feature``, ``i`` (index into probs), ``q``; exact, without unpivoting the rows.

    Sketches give a bracket around each quantile, wider than their error bound; one pass counts what lies below each bracket and
    hands on only the values inside it, combined by value. A bracket of one value is the quantile itself. A column without values
    has no rows. What reaches the driver is one number per column, quantile and bound.
    """
    names, m = list(columns), len(probs)
    x = [columns[k].cast("double") for k in names]
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(x)]).first()
    slots = [(i, j) for i in range(len(names)) for j in range(m) if sizes[f"n{i}"]]
    if not slots:
        return df.sparkSession.createDataFrame([], "feature string, i int, q double")

    def bounds(i: int, j: int) -> list[float]:
        near = 2.0 / accuracy + 2.0 / sizes[f"n{i}"]
        return [max(probs[j] - near, 0.0), min(probs[j] + near, 1.0)]

    ends = df.agg(*[F.percentile_approx(x[i], F.array(*[F.lit(b) for j in range(m) for b in bounds(i, j)]), F.lit(accuracy)).alias(f"b{i}")
                    for i in sorted({i for i, _ in slots})]).first()
    bracket = {(i, j): (ends[f"b{i}"][2 * j], ends[f"b{i}"][2 * j + 1]) for i, j in slots}
    found = {s: lo for s, (lo, hi) in bracket.items() if lo == hi}
    open_ = [s for s in slots if s not in found]
    if open_:
        below = df.agg(*[F.count(F.when(x[i] < bracket[i, j][0], 1)).alias(f"c{k}") for k, (i, j) in enumerate(open_)]).first()
        inside = [F.when(x[i].between(*bracket[i, j]), F.struct(F.lit(k).alias("slot"), x[i].alias("_v"))) for k, (i, j) in enumerate(open_)]
        values = df.select(F.explode(F.array_compact(F.array(*inside))).alias("p")).groupBy("p.slot", "p._v").agg(F.count("*").alias("_n"))
        totals = running_totals(values, "_v", {"_upto": "_n"}, ["slot"], descending=False)
        place = [probs[j] * (sizes[f"n{i}"] - 1) for i, j in open_]
        wanted = F.array(*[F.lit(float(int(p) - below[f"c{k}"])) for k, p in enumerate(place)])
        first = F.element_at(wanted, F.col("slot") + 1)
        pair = totals.groupBy("slot").agg(F.min(F.when(F.col("_upto") > first, F.col("_v"))).alias("lo"),
                                          F.min(F.when(F.col("_upto") > first + 1, F.col("_v"))).alias("hi")).collect()
        for r in pair:
            part = place[r["slot"]] - int(place[r["slot"]])
            found[open_[r["slot"]]] = r["lo"] if not part or r["hi"] is None else r["lo"] + (r["hi"] - r["lo"]) * part
    return df.sparkSession.createDataFrame([(names[i], j, float(q)) for (i, j), q in sorted(found.items())],
                                           "feature string, i int, q double")


def join_null_safe(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inner join on equal or both missing ``by``; without ``by`` the single row of ``right`` goes to every row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    rest = [F.col(f"r.{c}") for c in right.columns if c not in by]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *rest)


def _attach(table: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the columns of a one-row-per-group table; a single row is broadcast, groups join on their key."""
    if not by:
        return table.crossJoin(F.broadcast(small))
    return table.join(small, list(by), "left")
