"""Statistics tables: scalars, categories, histograms, spatial bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions import ieee
from cellframe.model import AXES, Cell

MOST_BINS_PER_AXIS, MOST_BINS = 4096, 1 << 20
LEGEND_BANDS, MOST_INTEGER_BANDS = 48, 64


def scalar_aggregates(x: Column) -> list[Column]:
    """Counts by kind of value, and moments of the finite ones; NaN where there are none."""
    x = x.cast("double")
    good = F.when(ieee.finite(x), x)
    or_nan = lambda c: F.coalesce(c, ieee.nan())
    return [
        F.count_if(ieee.finite(x)).alias("finite_count"), F.count_if(F.isnan(x)).alias("nan_count"), F.count_if(F.abs(x) == float("inf")).alias("infinite_count"),
        or_nan(F.min(good)).alias("minimum"), or_nan(F.max(good)).alias("maximum"), or_nan(F.avg(good)).alias("mean"), or_nan(F.stddev_pop(good)).alias("population_stddev"),
    ]


def property_statistics(table: DataFrame, properties: list[str], by: list[str] | None = None) -> DataFrame:
    """One row a property (and group): a single pass over the unpivoted columns."""
    by = by or []
    long = table.select(*by, *[F.col(p).cast("double").alias(p) for p in properties]).unpivot(by, properties, "property", "value")
    return long.groupBy(*by, "property").agg(*scalar_aggregates(F.col("value")))


def category_populations(table: DataFrame, column: str, categories: DataFrame) -> DataFrame:
    """id, label, count, fraction: listed categories even if empty, then ids that are not listed."""
    counts = table.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("count"))
    total = table.agg(F.count("*").alias("total"))
    listed = categories.select("id", "label").join(counts, "id", "left").fillna(0, ["count"])
    rest = counts.join(categories.select("id"), "id", "left_anti").select("id", F.lit("Unclassified").alias("label"), "count")
    return listed.unionByName(rest).crossJoin(F.broadcast(total)).select("id", "label", "count", (F.col("count") / F.col("total")).alias("fraction"))


def generic_histogram(table: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lower, upper, count between the smallest and largest value; constant data have one bin."""
    x = F.col(column).cast("double")
    good = table.where(ieee.finite(x)).select(x.alias("v"))
    bounds = good.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    wide = good.crossJoin(F.broadcast(bounds))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor(ieee.divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int"))
    counts = wide.groupBy(at.alias("bin")).agg(F.count("*").alias("count"))
    spine = bounds.withColumn("bin", F.explode(F.when(F.col("high") == F.col("low"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))))
    return spine.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * width).alias("lower"), F.when(F.col("bin") == bins - 1, F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))


def legend_histogram(table: DataFrame, column: str, low: float, high: float, bands: int = LEGEND_BANDS) -> DataFrame:
    """band, count for a legend's range; band -1 counts what is below and ``bands`` what is above."""
    x = F.col(column).cast("double")
    at = F.when(x < low, -1).when(x > high, bands).otherwise(F.least(F.floor((x - low) / (high - low) * bands), F.lit(bands - 1)).cast("int"))
    counts = table.where(ieee.finite(x)).groupBy(at.alias("band")).agg(F.count("*").alias("count"))
    spine = table.sparkSession.range(-1, bands + 1).select(F.col("id").cast("int").alias("band"))
    return spine.join(counts, "band", "left").fillna(0, ["count"])


def bin_of(s: Column, bins: int, periodic: bool) -> Column:
    """Bin of a reduced coordinate: -1 outside of an open axis, -2 if not finite; the upper face is in the last bin."""
    s = s.cast("double")
    finite = s.isNotNull() & ieee.finite(s)
    safe = F.when(finite, s).otherwise(0.0)
    inner = safe - F.floor(safe) if periodic else safe
    at = F.least(F.floor(inner * bins), F.lit(bins - 1)).cast("int")
    inside = F.lit(True) if periodic else (safe >= 0) & (safe <= 1)
    return F.when(~finite, -2).when(~inside, -1).otherwise(at)


def _layout(axes: list[int], bins: list[int]) -> int:
    if not 1 <= len(axes) <= 2 or len(set(axes)) != len(axes) or len(bins) != len(axes) or not set(axes) <= {0, 1, 2}:
        raise ValueError("Bins go along one or two different cell vectors")
    if any(not 1 <= b <= MOST_BINS_PER_AXIS for b in bins) or bins[0] * (bins[1:] or [1])[0] > MOST_BINS:
        raise ValueError(f"Between 1 and {MOST_BINS_PER_AXIS} bins along an axis and at most {MOST_BINS} in all")
    return bins[0] * (bins[1:] or [1])[0]


def binned(atoms: DataFrame, cell: Cell, axes: list[int], bins: list[int], value: str | None = None) -> DataFrame:
    """``atoms`` with row_bin and col_bin (negative: not binned)."""
    _layout(axes, bins)
    first = bin_of(F.col(AXES[axes[0]]), bins[0], cell.pbc[axes[0]])
    second = bin_of(F.col(AXES[axes[1]]), bins[1], cell.pbc[axes[1]]) if len(axes) > 1 else F.lit(0)
    return atoms.withColumn("row_bin", first).withColumn("col_bin", second)


def spatial_bins(atoms: DataFrame, cell: Cell, axes: list[int], bins: list[int], value: str | None = None) -> DataFrame:
    """row_bin, col_bin and their statistics pooled over frames, empty bins included.

    Count and density are means per frame; the property's statistics pool all its finite values.
    """
    total = _layout(axes, bins)
    inside = binned(atoms, cell, axes, bins).where("row_bin >= 0 and col_bin >= 0")
    frames = atoms.agg(F.count_distinct("frame_index").alias("frames"))
    aggregates = [F.count("*").alias("n")]
    if value is not None:
        v = F.col(value).cast("double")
        good = F.when(ieee.finite(v), v)
        aggregates += [F.count_if(ieee.finite(v)).alias("valid"), F.sum(good).alias("sum"), F.avg(good).alias("mean"), F.min(good).alias("minimum"), F.max(good).alias("maximum"), F.stddev_pop(good).alias("stddev")]
    found = inside.groupBy("row_bin", "col_bin").agg(*aggregates)
    spark = atoms.sparkSession
    columns = (bins[1:] or [1])[0]
    spine = spark.range(total).select(F.floor(F.col("id") / columns).cast("int").alias("row_bin"), (F.col("id") % columns).cast("int").alias("col_bin"))
    full = spine.join(found, ["row_bin", "col_bin"], "left").crossJoin(F.broadcast(frames))
    count = F.coalesce("n", F.lit(0)) / F.col("frames")
    out = ["row_bin", "col_bin", count.alias("count"), (count / (cell.volume / total)).alias("density")]
    if value is not None:
        nan = ieee.nan()
        out += [F.coalesce("valid", F.lit(0)).alias("valid"), (F.coalesce("n", F.lit(0)) - F.coalesce("valid", F.lit(0))).alias("skipped"), F.coalesce("sum", F.lit(0.0)).alias("sum")]
        out += [F.coalesce(c, nan).alias(c) for c in ("mean", "minimum", "maximum", "stddev")]
    return full.select(*out)


def binning_totals(atoms: DataFrame, cell: Cell, axes: list[int], bins: list[int]) -> DataFrame:
    """selected, binned, outside, invalid: they add up."""
    at = F.least("row_bin", "col_bin")
    return binned(atoms, cell, axes, bins).agg(F.count("*").alias("selected"), F.count_if(at >= 0).alias("binned"), F.count_if(at == -1).alias("outside"), F.count_if(at == -2).alias("invalid"))


def frame_summary(atoms: DataFrame) -> DataFrame:
    """frame_index, type_label, count, first_row and bounds: types in the order in which they come."""
    bounds = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return atoms.groupBy("frame_index", "type_label").agg(F.count("*").alias("count"), F.min("row_idx").alias("first_row"), *bounds)


def atom_table(atoms: DataFrame, properties: list[str]) -> DataFrame:
    """id, type and position of every atom with its properties, as tables of atoms are written."""
    return atoms.select("frame_index", F.col("atom_id").alias("id"), F.col("type_label").alias("type"), *"xyz", *properties)


def summary_table(atoms: DataFrame, cell, properties: list[str]) -> DataFrame:
    """frame_index, analysis, metric, category, value: what is known of each frame, one number a row.

    Numbers of atoms, cell volume and density, types with their shares, and the statistics of properties.
    """
    volume = float(cell.volume)
    row = lambda analysis, metric, value, category="": F.struct(F.lit(analysis).alias("analysis"), F.lit(metric).alias("metric"), (F.lit(category) if isinstance(category, str) else category).alias("category"), value.cast("double").alias("value"))
    sizes = atoms.groupBy("frame_index").agg(F.count("*").alias("n"))
    rows = [row("input", "atom_count", F.col("n")), row("input", "cell_volume", F.lit(volume)), row("input", "number_density", F.col("n") / volume)]
    rows += [row("input", "periodic_boundary", F.lit(float(p)), axis) for axis, p in zip("abc", cell.pbc, strict=True)]
    flat = lambda table, parts: table.select("frame_index", F.explode(F.array(*parts)).alias("r")).select("frame_index", "r.*")
    found = flat(sizes, rows)
    types = atoms.groupBy("frame_index", "type_label").agg(F.count("*").alias("k")).join(sizes, "frame_index")
    found = found.unionByName(flat(types, [row("input", "atomType.count", F.col("k"), F.col("type_label")), row("input", "atomType.fraction", F.col("k") / F.col("n"), F.col("type_label"))]))
    if properties:
        stats = property_statistics(atoms, properties, ["frame_index"])
        metrics = ("finite_count", "nan_count", "infinite_count", "minimum", "maximum", "mean", "population_stddev")
        parts = [F.struct(F.lit("input").alias("analysis"), F.concat("property", F.lit(f".{m}")).alias("metric"), F.lit("").alias("category"), F.col(m).cast("double").alias("value")) for m in metrics]
        found = found.unionByName(flat(stats, parts))
    return found
