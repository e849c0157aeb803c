"""Plain tables as frames, so that every operator runs over data of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.model import LATTICES, Cell, lattice_cell, with_positions

#: The cell of the points.
BOX = Cell.cube(10.0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as one frame: the first three components are reduced coordinates, the label is the type."""
    e = table(spark, folder, "embeddings")
    s = [F.element_at("embedding", k + 1).cast("double").alias(a) for k, a in enumerate(("sa", "sb", "sc"))]
    rest = [F.element_at("embedding", k).cast("double").alias(f"p{k}") for k in (4, 5, 6, 7)]
    atoms = e.select(F.lit(0).alias("frame_index"), F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("atom_id"), F.col("label").cast("string").alias("type_label"), *s, *rest)
    return with_positions(atoms, BOX)


def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a trajectory: a frame a day, a user's first event of the day an atom."""
    e = table(spark, folder, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    rows = e.select(day.cast("int").alias("frame_index"), F.col("user_id").cast("string").alias("atom_id"), F.col("event_id"), F.col("event_type").alias("type_label"), (seconds / 86400.0).alias("sa"), (F.pmod("user_id", F.lit(97)) / 97.0).alias("sb"), F.lit(0.5).alias("sc"), "value")
    first = rows.groupBy("frame_index", "atom_id").agg(F.min_by(F.struct("event_id", "type_label", "sa", "sb", "sc", "value"), "event_id").alias("r"))
    atoms = first.select("frame_index", "atom_id", F.col("r.event_id").alias("row_idx"), "r.type_label", "r.sa", "r.sb", "r.sc", "r.value")
    return with_positions(atoms, BOX)


def event_points(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` with every event an atom of its day's frame."""
    e = table(spark, folder, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(day.cast("int").alias("frame_index"), F.col("event_id").alias("row_idx"), F.col("event_type").alias("type_label"), (seconds / 86400.0).alias("sa"), (F.pmod("user_id", F.lit(97)) / 97.0).alias("sb"), (F.col("value") / 400.0).alias("sc"), "value")


def order_points(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as forty frames of points all over the cell."""
    o = table(spark, folder, "orders")
    part = lambda x: x - F.floor(x)
    s = [part(F.col("o_totalprice") / 977.0).alias("sa"), part(F.col("o_custkey") * 0.6180339887).alias("sb"), part(F.col("o_orderkey") * 0.7548776662).alias("sc")]
    atoms = o.select((F.col("o_orderkey") % 40).cast("int").alias("frame_index"), F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("atom_id"), F.col("o_orderstatus").alias("type_label"), *s)
    return with_positions(atoms, BOX)


#: Nearest distance of the crystals, and how far an atom lies off its site at most along an axis.
BOND, OFF = 2.5, 0.05


def order_crystals(spark: SparkSession, folder: str) -> tuple[DataFrame, Cell]:
    """``orders`` as atoms of crystals: a frame for each lattice, in it two crystals turned to different orientations, prices as noise.

    The order's key numbers the sites.  The cell is open and as large as the crystals need; type and
    crystal (0 or 1) are columns.
    """
    o = table(spark, folder, "orders")
    cells = {k: lattice_cell(k) for k in LATTICES}
    each = o.count() // (2 * len(LATTICES)) + 1  # atoms of a crystal
    sides = {k: max(1, round((each / len(sites)) ** (1 / 3) + 0.5)) for k, (_, sites) in cells.items()}
    extent = max(sides[k] * max(edges) for k, (edges, _) in cells.items()) * BOND
    cell = Cell.cube(2 * 3**0.5 * extent, (False, False, False))
    frame, crystal = (F.col("o_orderkey") % len(LATTICES)).cast("int"), F.floor(F.col("o_orderkey") / len(LATTICES)) % 2
    site = F.floor(F.col("o_orderkey") / (2 * len(LATTICES)))
    off = [(F.pmod(F.hash(F.col("o_totalprice"), F.col("o_orderkey"), F.lit(k)), F.lit(2001)) / 1000.0 - 1) * OFF for k in range(3)]
    sites = [(f, c, n, len(cells[k][1]), sides[k], *cells[k][0], *map(float, at), *turned(f, c)) for f, k in enumerate(LATTICES) for c in (0, 1) for n, at in enumerate(cells[k][1])]
    places = spark.createDataFrame(sites, "frame_index int, crystal int, site int, sites int, side int, e0 double, e1 double, e2 double, b0 double, b1 double, b2 double, cos double, sin double")
    counts = F.element_at(F.array(*[F.lit(len(cells[k][1])) for k in LATTICES]), frame + 1)
    rows = o.select(frame.alias("frame_index"), F.col("o_orderkey").alias("row_idx"), F.col("o_orderkey").cast("string").alias("atom_id"), F.col("o_orderstatus").alias("type_label"), crystal.cast("int").alias("crystal"), (site % counts).cast("int").alias("site"), F.floor(site / counts).alias("no"), *[c.alias(f"off{k}") for k, c in enumerate(off)])
    rows = rows.join(F.broadcast(places), ["frame_index", "crystal", "site"])  # some eighty rows
    side = F.col("side")
    index = [F.col("no") % side, F.floor(F.col("no") / side) % side, F.floor(F.col("no") / (side * side))]
    rows = rows.withColumns({f"l{k}": (index[k] + F.col(f"b{k}") - side / 2) * F.col(f"e{k}") * BOND for k in range(3)})
    c, s, l0, l1, l2 = (F.col(n) for n in ("cos", "sin", "l0", "l1", "l2"))
    length = float(cell.lengths[0])
    placed = [l0 * c - l1 * s + F.when(F.col("crystal") == 0, length / 4).otherwise(3 * length / 4), (l0 * s + l1 * c) * c - l2 * s + length / 2, (l0 * s + l1 * c) * s + l2 * c + length / 2]
    s = [((placed[k] + F.col(f"off{k}")) / length).alias(a) for k, a in enumerate(("sa", "sb", "sc"))]
    return with_positions(rows.select("frame_index", "row_idx", "atom_id", "type_label", "crystal", *s), cell), cell


def turned(frame: int, crystal: int) -> tuple[float, float]:
    """Cosine and sine of the angle by which a crystal is turned, about z and then about x."""
    angle = 0.1 + 0.07 * frame + 0.3 * crystal
    return math.cos(angle), math.sin(angle)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as a wide table of properties; its flags are the type."""
    rows = table(spark, folder, "lineitem")
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("type_label"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def months(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as frames by month from January 1995."""
    o = table(spark, folder, "orders")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return o.select(month.cast("int").alias("frame_index"), F.col("o_orderkey").alias("row_idx"), F.col("o_orderstatus").alias("type_label"), "o_totalprice")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as dislocation segments: a customer's orders, by key, are nodes of a chain, closed for every seventh customer.

    Every other segment is stored backwards; at urgent orders a short segment of another vector branches off.
    """
    o = table(spark, folder, "orders")
    part = lambda x: x - F.floor(x)
    s = [part(F.col("o_totalprice") / 977.0), part((F.col("o_custkey") + 0.5) * 0.6180339887), part(F.col("o_orderkey") * 0.7548776662)]
    kinds = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in ((1 / 2, 1 / 2, 0), (1 / 6, 1 / 6, 1 / 3), (1 / 6, 1 / 6, 0), (1 / 3, 0, 0), (1 / 3, 1 / 3, 1 / 3), (0.4, 0, 0))])
    own = F.element_at(kinds, (F.col("o_custkey") % 6 + 1).cast("int"))
    swap = F.col("o_custkey") % 2 == 1
    nodes = o.select((F.col("o_custkey") % 4).cast("int").alias("frame_index"), F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("i"), F.col("o_orderpriority").startswith("1").alias("urgent"), F.array(*s).alias("s"), F.when(swap, F.reverse(own)).otherwise(own).alias("b"))
    along = Window.partitionBy("c").orderBy("i")
    both = F.struct(F.col("i").alias("j"), F.col("s").alias("t"))
    onward = F.coalesce(F.lead(both).over(along), F.when(F.col("c") % 7 == 0, F.first(both).over(along)))
    chain = nodes.withColumn("n", onward).where("n is not null").select("frame_index", (F.col("i") * 2).alias("segment"), "i", "n.j", "s", F.transform("n.t", lambda t, k: t + F.when(k == F.col("i") % 3, F.col("i") % 5 - 2).otherwise(0)).alias("t"), "b", (F.col("i") % 2 == 1).alias("back"))
    short = nodes.where("urgent").select("frame_index", (F.col("i") * 2 + 1).alias("segment"), "i", (-F.col("i")).alias("j"), "s", F.transform("s", lambda x, k: x + F.when(k == 0, 0.25).otherwise(0.0)).alias("t"), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)).alias("b"), F.lit(False).alias("back"))
    rows = chain.unionByName(short)
    back = F.col("back")
    at = lambda a, b, k: F.element_at(F.when(back, F.col(b)).otherwise(F.col(a)), k + 1)
    burgers = [F.when(back, -F.element_at("b", k + 1)).otherwise(F.element_at("b", k + 1)).alias(n) for k, n in enumerate(("bx", "by", "bz"))]
    return rows.select("frame_index", "segment", F.when(back, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(back, F.col("i")).otherwise(F.col("j")).alias("j"), *burgers, *[at("s", "t", k).alias(n) for k, n in enumerate(("sa", "sb", "sc"))], *[at("t", "s", k).alias(n) for k, n in enumerate(("ta", "tb", "tc"))])
