"""Order and state over groups of any size: places by ranges, running totals in two levels, prefixes of composed maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import written

#: Units that one step of a prefix composes, and places that one window sums.
FAN_IN = 16
CELL = 4096


def ranked(rows: DataFrame, group: str, order: list[str | Column], label: str) -> DataFrame:
    """The rows with ``pos``, their place from 0 in their group, and ``n``, the rows of the group.

    ``group`` has no nulls.  Rows are dealt by ranges of (group, order), equal ones told apart by where they were read, and
    each range adds what its group has before it: a large group is many tasks.  The dealt rows are written, so that ranges
    stay as they are when an executor is lost.
    """
    read = written(rows.withColumn("read_from", F.monotonically_increasing_id()), label)
    keys = [F.col(group), *order, F.col("read_from")]
    dealt = read.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("read_from")
    dealt = written(dealt.withColumn("seat", F.monotonically_increasing_id()), f"{label}-order")
    dealt = dealt.withColumn("range", F.shiftright("seat", 33))
    runs = dealt.groupBy(group, "range").agg(F.count("*").alias("in_range"), F.min("seat").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("in_range").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "range", "first", before.alias("before"), F.sum("in_range").over(whole).alias("n"))
    placed = dealt.join(runs, [group, "range"]).withColumn("pos", F.col("before") + F.col("seat") - F.col("first"))
    return placed.drop("range", "seat", "first", "before")


def sum_before(rows: DataFrame, group: str, place: str, value: str, cell: int = CELL) -> DataFrame:
    """The rows with ``before``, the sum of ``value`` over smaller places of the group.

    One window sums inside cells of places and one over the cells, so no window holds a whole large group.
    """
    rows = written(rows.withColumn("cell", F.expr(f"{place} div {cell}")), "sums")
    earlier = (Window.unboundedPreceding, -1)
    cells = rows.groupBy(group, "cell").agg(F.sum(value).alias("in_cell"))
    up_to = F.coalesce(F.sum("in_cell").over(Window.partitionBy(group).orderBy("cell").rowsBetween(*earlier)), F.lit(0))
    cells = cells.select(group, "cell", up_to.alias("up_to"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(group, "cell").orderBy(place).rowsBetween(*earlier)), F.lit(0))
    joined = rows.withColumn("before", inside).join(cells, [group, "cell"])
    return joined.withColumn("before", F.col("before") + F.col("up_to")).drop("cell", "up_to")


def _composed(parts: str) -> Column:
    """The map of consecutive units: through the first one, then the next ones."""
    first = F.col(parts)[0]["map"]
    rest = F.slice(parts, F.lit(2), F.size(parts))
    return F.aggregate(rest, first, lambda met, part: F.transform(met, lambda i: F.element_at(part["map"], i + 1)))


def _passed(parts: str, entry: Column) -> Column:
    """The entry of each of consecutive units, if the first one is entered at ``entry``."""
    none = F.array().cast("array<struct<place: bigint, entry: int>>")
    return F.aggregate(
        parts,
        F.struct(entry.alias("at"), none.alias("met")),
        lambda s, part: F.struct(
            F.element_at(part["map"], s["at"] + 1).alias("at"),
            F.concat(s["met"], F.array(F.struct(part["place"].alias("place"), s["at"].alias("entry")))).alias("met"),
        ),
        lambda s: s["met"],
    )


def entries(units: DataFrame, key: str, fan_in: int = FAN_IN) -> DataFrame:
    """(key, place, entry): where each unit (key, place, map) is entered.

    ``map`` gives, for each way into a unit, the way into the next one of its key; the first unit is entered at 0.  Maps of
    ``fan_in`` consecutive units are composed, level by level, until a key has one; then entries go down again.  A key
    with very many units is many tasks at every level, and a row holds ``fan_in`` maps at most.
    """
    low, high = units.agg(F.min("place"), F.max("place")).first()
    level = units.select(key, (F.col("place") - F.lit(low or 0)).alias("place"), "map")
    span, levels = (high or 0) - (low or 0), []
    while True:
        grouped = level.groupBy(key, F.expr(f"place div {fan_in}").alias("above")).agg(
            F.sort_array(F.collect_list(F.struct("place", "map"))).alias("parts")
        )
        levels.append(written(grouped, "prefix"))
        span //= fan_in
        if not span:
            break
        level = levels[-1].select(key, F.col("above").alias("place"), _composed("parts").alias("map"))
    found = levels[-1].select(key, F.explode(_passed("parts", F.lit(0))).alias("u")).select(key, "u.*")
    for parts in reversed(levels[:-1]):
        over = found.select(key, F.col("place").alias("above"), "entry")
        found = parts.join(over, [key, "above"]).select(key, F.explode(_passed("parts", F.col("entry"))).alias("u")).select(key, "u.*")
    return found.select(key, (F.col("place") + F.lit(low or 0)).alias("place"), "entry")


COMBINED = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def carried(
    rows: DataFrame, keys: list[str], at: str, order: list[str], values: dict[str, tuple[str, Column]], cell_ms: int, after: bool = False
) -> DataFrame:
    """The rows with one column for each of ``values``: the max, min or sum of a value over the rows before it in its group,
    or behind it.

    ``keys`` have no nulls and ``order`` begins with the time ``at`` in milliseconds.  One window goes over the rows of a time
    cell and one over the cells, so a group of any size is many tasks; of a cell only its totals are shuffled further.  The rows
    are written, since both windows read them and calls follow each other.
    """
    frame = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    rows = rows.withColumns({name: value for name, (_, value) in values.items()}).withColumn("cell", F.floor(F.col(at) / cell_ms))
    rows = written(rows, "carried")
    cells = rows.groupBy(*keys, "cell").agg(*[COMBINED[kind][0](name).alias(name) for name, (kind, _) in values.items()])
    over = Window.partitionBy(*keys).orderBy("cell").rowsBetween(*frame)
    cells = cells.select(*keys, "cell", *[COMBINED[kind][0](name).over(over).alias(f"far_{name}") for name, (kind, _) in values.items()])
    inside = Window.partitionBy(*keys, "cell").orderBy(*order).rowsBetween(*frame)
    near = rows.withColumns({name: COMBINED[kind][0](name).over(inside) for name, (kind, _) in values.items()})
    joined = near.join(cells, [*keys, "cell"])
    combined = {name: COMBINED[kind][1](F.col(name), F.col(f"far_{name}")) for name, (kind, _) in values.items()}
    return joined.withColumns(combined).drop("cell", *[f"far_{name}" for name in values])
