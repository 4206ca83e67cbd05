"""Exact order statistics of large groups: quantiles, ranks and the Gini coefficient.

Each works on value cells (`order_bucket`) so that no task ever sorts a whole group: cells are
counted with map-side partial sums, a running sum over the few cells gives each cell its
offset, and only rows of one cell meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthpanel.functions.columns import order_bucket
from hearthpanel.functions.skew import HOT_ROWS, join_by_weight
from hearthpanel.session import cut_lineage

SLICE_ROWS = 100_000
BROADCAST_ROWS = 100_000
RUNNING = (Window.unboundedPreceding, Window.currentRow)


def _ranks(prob: float) -> tuple[str, str, str]:
    """Position of a quantile among the sorted values, and the two ranks it lies between."""
    place = f"(_total - 1) * {float(prob)!r}D"
    return place, f"floor({place})", f"ceil({place})"


def _holds_target(probs: list[float]) -> Column:
    """True for the stretch [_off, _end) of ranks when it holds a rank some quantile needs."""
    ranks = [rank for p in probs for rank in _ranks(p)[1:]]
    return F.expr(" or ".join(f"({rank} >= _off and {rank} < _end)" for rank in ranks))


def _interpolate(probs: dict[str, float]) -> list[Column]:
    """The values at both ranks, which lie in rows covering [_end - _n, _end), and the line between."""
    out = []
    for name, p in probs.items():
        place, below, above = _ranks(p)
        low, high = (f"max(case when {r} >= _end - _n and {r} < _end then _x end)" for r in (below, above))
        out.append(F.expr(f"{low} + (max({place}) - floor(max({place}))) * ({high} - {low})").alias(name))
    return out


def _usable(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value as a double `_x`; rows without a value or a group are left out."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return df.select(*by, x.alias("_x")).na.drop("any")


# Value cells per unit of log(1 + |x|): a coarse grid that gives few counts, and a fine one that
# splits each wanted coarse cell into about 4,096 parts.
COARSE, FINE = 256, 256 * 4096


def _running_cells(counts: DataFrame, parts: list[str], cell: str, wanted: list[float]) -> DataFrame:
    """Keep the cells that hold a wanted rank; `_off` becomes the number of rows below the cell."""
    order = Window.partitionBy(*parts).orderBy(cell).rowsBetween(*RUNNING)
    return (counts.withColumn("_end", F.col("_off") + F.sum("_n").over(order))
                  .withColumn("_off", F.col("_end") - F.col("_n"))
                  .filter(_holds_target(wanted)))


def _cells_of_groups(cells: DataFrame, by: list[str], cell: str) -> DataFrame:
    """One row per group with its few wanted cells as a map to their offsets."""
    return cells.groupBy(*by).agg(F.max("_total").alias("_total"),
                                  F.map_from_entries(F.collect_list(F.struct(cell, "_off"))).alias("_offs"))


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Last step: distinct values of one part with the rank range each of them covers."""
    values = rows.groupBy(*by, "_part", "_x").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_off").alias("_off"), F.max("_total").alias("_total"))
    part = Window.partitionBy(*by, "_part")
    return (values.withColumn("_end", F.coalesce("_off", F.lit(0))
                              + F.sum("_n").over(part.orderBy("_x").rowsBetween(*RUNNING)))
                  .withColumn("_total", F.coalesce("_total", F.sum("_n").over(part))))


def _hot_rows_only(rows: DataFrame, by: list[str], wanted: list[float], hot_rows: int) -> DataFrame:
    """Rows of heavy groups cut down to the wanted fine cells; rows of other groups as they are."""
    counts = rows.groupBy(*by, "_coarse").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.lit(0).cast("bigint"))
    counts = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by))).filter(F.col("_total") >= hot_rows)
    # at most one row per `hot_rows` rows, each with at most two cells per quantile
    coarse = _cells_of_groups(_running_cells(counts, by, "_coarse", wanted), by, "_coarse")
    inside = (rows.join(F.broadcast(coarse), by).withColumn("_off", F.col("_offs")[F.col("_coarse")])
                  .filter(F.col("_off").isNotNull()))
    finer = inside.groupBy(*by, "_coarse", "_fine").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_off").alias("_off"), F.max("_total").alias("_total"))
    fine = _cells_of_groups(_running_cells(finer, [*by, "_coarse"], "_fine", wanted), by, "_fine")
    return (rows.join(F.broadcast(fine), by, "left").withColumn("_off", F.col("_offs")[F.col("_fine")])
                .filter(F.col("_total").isNull() | F.col("_off").isNotNull())
                .withColumn("_part", F.when(F.col("_total").isNotNull(), F.col("_fine"))))


def _wanted_rows_overall(rows: DataFrame, wanted: list[float]) -> DataFrame:
    """The same for one single group: the wanted cells are joined by the cell itself."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    counts = rows.groupBy("_coarse").agg(F.count(F.lit(1)).alias("_n"), F.lit(0).cast("bigint").alias("_off"))
    coarse = _running_cells(counts.withColumn("_total", total), [], "_coarse", wanted).select("_coarse", "_off", "_total")
    finer = rows.join(F.broadcast(coarse), "_coarse").groupBy("_coarse", "_fine").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_off").alias("_off"), F.max("_total").alias("_total"))
    fine = _running_cells(finer, ["_coarse"], "_fine", wanted).select("_fine", "_off", "_total")
    return rows.join(F.broadcast(fine), "_fine").withColumn("_part", F.col("_fine"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    hot_rows: int | None = None, count: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    `probs` maps an output name to a probability; `count` names a column for the number of values. Heavy groups (at least `hot_rows` rows) are
    narrowed down in two passes that count value cells with map-side partial sums: coarse cells
    first, then fine cells inside the few coarse ones that hold a wanted rank. The last pass
    shuffles only rows of the wanted fine cells. All other groups are small and ranked directly.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    wanted = list(probs.values())
    rows = _usable(df, by, value).withColumns({"_coarse": order_bucket(F.col("_x"), COARSE),
                                               "_fine": order_bucket(F.col("_x"), FINE)})
    kept = _hot_rows_only(rows, by, wanted, hot_rows) if by else _wanted_rows_overall(rows, wanted)
    size = [] if count is None else [F.max("_total").alias(count)]
    return _ranked(kept, by).groupBy(*by).agg(*_interpolate(probs), *size)


def subset_quantiles(df: DataFrame, by: list[str], subsets: dict[str, Column], value: str, probs: dict[str, float],
                     hot_rows: int | None = None) -> DataFrame:
    """Exact quantiles of overlapping subsets: one row per group `by` and `subset`, as `exact_quantiles` gives them.

    `subsets` maps at most 31 names to the condition of belonging; a row that a condition leaves open does not belong. A first
    pass counts rows per group, value cell and combination of subsets with map-side sums, and only these counts are
    copied into the subsets. The cells that hold a wanted rank are written once; in the second pass a row goes to
    just the subsets that want its cell, so most rows are never copied. Wanted cells of at least `hot_rows` rows are
    cut into finer ones by one more pass; without such cells there is none.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    wanted, group = list(probs.values()), [*by, "subset"]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(subsets.values())])
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, x.alias("_x"), mask.alias("_mask")).na.drop("any").filter("_mask <> 0").withColumns(
        {"_coarse": order_bucket(F.col("_x"), COARSE), "_fine": order_bucket(F.col("_x"), FINE)})

    mine = lambda entries: F.inline(F.filter(entries, lambda e: F.col("_mask").bitwiseAND(e["_bit"]) != 0))
    names = F.array(*[F.struct(F.lit(name).alias("subset"), F.lit(1 << i).alias("_bit")) for i, name in enumerate(subsets)])
    counts = (rows.groupBy(*by, "_mask", "_coarse").agg(F.count(F.lit(1)).alias("_n")).select(*by, "_coarse", "_n", mine(names))
                  .groupBy(*group, "_bit", "_coarse").agg(F.sum("_n").alias("_n")).withColumn("_off", F.lit(0).cast("bigint")))
    counts = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    cells = _running_cells(counts, group, "_coarse", wanted).withColumn("_hot", F.col("_n") >= hot_rows)
    entry = F.struct("subset", "_bit", "_off", "_total", "_hot")
    cells = cut_lineage(df.sparkSession, cells.groupBy(*by, "_coarse").agg(F.collect_list(entry).alias("_wants"), F.max("_hot").alias("_any")))
    # One row per group and wanted cell: a small table, read from storage and broadcast by its counted size. Beyond that
    # the join shuffles, and adaptive execution can split a hot cell.
    size, hot = cells.agg(F.count(F.lit(1)), F.coalesce(F.max("_any"), F.lit(False))).first()
    inside = rows.join(F.broadcast(cells) if size <= BROADCAST_ROWS else cells, [*by, "_coarse"]).select(
        *by, "_x", "_mask", "_coarse", "_fine", mine(F.col("_wants")))
    part = F.struct("_coarse", F.lit(None).cast("int").alias("_in"))
    if hot:
        finer = inside.filter("_hot").groupBy(*group, "_coarse", "_fine").agg(
            F.count(F.lit(1)).alias("_n"), F.max("_off").alias("_off"), F.max("_total").alias("_total"))
        fine = _cells_of_groups(_running_cells(finer, [*group, "_coarse"], "_fine", wanted), group, "_fine").drop("_total")
        # at most one row per `hot_rows` rows of a subset
        inside = inside.join(F.broadcast(fine), group, "left").withColumn(
            "_off", F.when(F.col("_hot"), F.col("_offs")[F.col("_fine")]).otherwise(F.col("_off"))).filter("_off is not null")
        part = F.struct("_coarse", F.when(F.col("_hot"), F.col("_fine")).alias("_in"))
    return _ranked(inside.withColumn("_part", part), group).groupBy(*group).agg(*_interpolate(probs))


def gini(df: DataFrame, by: list[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient per group: sum of |xi - xj| over pairs, divided by n squared times the mean.

    Uses the rank form 2 * sum(i * x(i)) / (n * sum(x)) - (n + 1) / n, so no pair is built. Equal
    values are merged before the shuffle, ranks inside a value cell are local, and the offset of a
    cell enters as offset * (sum of the cell).
    """
    counts = (_usable(df, by, value).withColumn("_cell", order_bucket(F.col("_x")))
                  .groupBy(*by, "_cell", "_x").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    inside = Window.partitionBy(*by, "_cell").orderBy("_x").rowsBetween(*RUNNING)
    before = F.sum("_n").over(inside) - F.col("_n")
    cells = (counts.withColumn("_before", before)
                   .groupBy(*by, "_cell")
                   .agg(F.sum("_n").alias("_n"),
                        F.sum(F.col("_n") * F.col("_x")).alias("_s"),
                        F.sum(F.col("_x") * (F.col("_n") * F.col("_before")
                                             + F.col("_n") * (F.col("_n") + 1) / 2)).alias("_r")))
    over_cells = Window.partitionBy(*by).orderBy("_cell").rowsBetween(*RUNNING)
    placed = cells.withColumn("_off", F.sum("_n").over(over_cells) - F.col("_n"))
    n, s = F.sum("_n"), F.sum("_s")
    weighted = F.sum(F.col("_r") + F.col("_off") * F.col("_s"))
    return placed.groupBy(*by).agg(
        (F.try_divide(2 * weighted, n * s) - (n + 1) / n).alias(name))


def rank_by_draw(df: DataFrame, by: list[str], draw: str, tie: str, name: str, slice_rows: int | None = None) -> DataFrame:
    """1-based rank of each row in its group by a uniform draw, ties by `tie`; rows without a group are left out.

    A group of more than SLICE_ROWS rows is cut into slices of the draw, by its own count, so that a group with a
    third of all rows is ranked by many tasks and a small one by one.
    """
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_slices", F.ceil(F.col("_n") / (slice_rows or SLICE_ROWS)))
    rows = join_by_weight(df, sizes, by, "_n", "inner")
    rows = rows.withColumn("_slice", F.floor(F.col(draw) * F.col("_slices")).cast("int")).drop("_slices")
    slices = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(*RUNNING)
    slices = slices.select(*by, "_slice", (F.sum("_n").over(over) - F.col("_n")).alias("_off"))
    inside = Window.partitionBy(*by, "_slice").orderBy(draw, tie)
    return (rows.join(slices, [*by, "_slice"])
                .withColumn(name, (F.row_number().over(inside) + F.col("_off")).cast("bigint"))
                .drop("_slice", "_off"))
