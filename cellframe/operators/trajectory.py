"""Operators along the frames of a trajectory: unwrapping, smoothing, lines, replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.ieee import nearest_image
from cellframe.model import AXES, Cell, with_positions

IMAGES = ("ix", "iy", "iz")
MOST_SMOOTHING = 50


def unwrapped(atoms: DataFrame, cell: Cell) -> DataFrame:
    """``atoms`` with ix, iy, iz and ux, uy, uz: coordinates that go on across the periodic faces.

    Along each atom's own frames the step to the last frame in which it was present is the shortest
    one, so its image number changes by the rounded difference; atoms that are absent for a while go on
    from where they were last seen.
    """
    along = Window.partitionBy("atom_id").orderBy("frame_index")
    for axis, image, periodic in zip(AXES, IMAGES, cell.pbc, strict=True):
        step = nearest_image(F.col(axis) - F.lag(axis).over(along)) if periodic else F.lit(0.0)
        atoms = atoms.withColumn(f"_{image}", F.coalesce(step, F.lit(0.0)))
    for image in IMAGES:
        atoms = atoms.withColumn(image, (-F.sum(f"_{image}").over(along)).cast("int")).drop(f"_{image}")
    u = cell.cartesian(tuple(F.col(a) + F.col(i) for a, i in zip(AXES, IMAGES, strict=True)))
    return atoms.withColumns({n: c for n, c in zip(("ux", "uy", "uz"), u, strict=True)})


def smoothed(atoms: DataFrame, cell: Cell, half: int) -> DataFrame:
    """frame_index, atom_id, sa, sb, sc averaged over the frames up to ``half`` before and behind.

    Each frame's coordinates enter as the shortest difference to the centre frame's; windows are cut at
    the ends, and only frames that hold the atom count.
    """
    if not 0 <= half <= MOST_SMOOTHING:
        raise ValueError(f"Smoothing reaches at most {MOST_SMOOTHING} frames to either side")
    near = atoms.select(F.explode(F.sequence(F.col("frame_index") - half, F.col("frame_index") + half)).alias("frame_index"), "atom_id", *[F.col(a).alias(f"{a}_n") for a in AXES])
    both = atoms.select("frame_index", "atom_id", *AXES).join(near, ["frame_index", "atom_id"])
    means = []
    for axis, periodic in zip(AXES, cell.pbc, strict=True):
        d = F.col(f"{axis}_n") - F.col(axis)
        d = d - nearest_image(d) if periodic else d
        means.append((F.first(axis) + F.avg(d)).alias(axis))
    found = both.groupBy("frame_index", "atom_id").agg(*means)
    return with_positions(found, cell)


def trajectory_lines(atoms: DataFrame, stride: int = 1, least: int = 2) -> DataFrame:
    """atom_id, point_no, t (0 to 1), ux, uy, uz: the sampled way of each atom with at least two points."""
    finite = ~(F.isnan("ux") | F.isnan("uy") | F.isnan("uz"))
    points = atoms.where(finite & (F.pmod("frame_index", F.lit(stride)) == 0))
    own = Window.partitionBy("atom_id")
    number = F.row_number().over(own.orderBy("frame_index"))
    whole = points.withColumn("point_no", number).withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= least)
    span = points.agg(F.min("frame_index").alias("_low"), F.max("frame_index").alias("_high"))
    t = (F.col("frame_index") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1))
    return whole.crossJoin(F.broadcast(span)).select("atom_id", "frame_index", "point_no", t.alias("t"), "ux", "uy", "uz")


def replicated(atoms: DataFrame, cell: Cell, counts: tuple[int, int, int]) -> tuple[DataFrame, Cell]:
    """Copies of the frame along the cell vectors, a fastest; the first copy keeps its ids, others are copy:a:b:c:id."""
    na, nb, nc = counts
    if min(counts) < 1:
        raise ValueError("Copies count from one")
    both = atoms
    for c, n in zip(("ca", "cb", "cc"), counts, strict=True):  # row by row, so any number of copies streams
        both = both.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    both = both.withColumn("copy", F.col("ca") + na * (F.col("cb") + nb * F.col("cc")))
    atom_id = F.when(F.col("copy") == 0, F.col("atom_id")).otherwise(F.concat_ws(":", F.lit("copy"), "ca", "cb", "cc", "atom_id"))
    size = F.lit(atoms.agg(F.max("row_idx")).first()[0] + 1)
    s = {a: (F.col(a) + F.col(c)) / n for a, c, n in zip(AXES, ("ca", "cb", "cc"), counts, strict=True)}
    large = Cell(tuple(float(v) * n for row, n in zip(cell.matrix, counts, strict=True) for v in row), cell.pbc, cell.origin)
    moved = both.withColumns({"atom_id": atom_id, "row_idx": F.col("copy") * size + F.col("row_idx"), **s}).drop("copy", "ca", "cb", "cc")
    return with_positions(moved, large), large


def displayed(atoms: DataFrame, cell: Cell, counts: tuple[int, int, int]) -> DataFrame:
    """Copies of the frame for display: positions moved by whole cells, ids and rows as they are, with the copy's numbers."""
    if min(counts) < 1:
        raise ValueError("Copies count from one")
    both = atoms
    for c, n in zip(("ca", "cb", "cc"), counts, strict=True):
        both = both.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = cell.cartesian((F.col("ca"), F.col("cb"), F.col("cc")), placed=False)
    return both.withColumns({n: F.col(n) + m for n, m in zip("xyz", moved, strict=True)})


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Files' frames under one numbering: the frames of each part behind those of the ones before."""
    result, offset = None, 0
    for part in parts:
        moved = part.withColumn("frame_index", F.col("frame_index") + offset)
        result = moved if result is None else result.unionByName(moved, allowMissingColumns=True)
        offset += (part.agg(F.max("frame_index")).first()[0] or 0) + 1
    return result


def id_digests(atoms: DataFrame) -> DataFrame:
    """frame_index, n and digests of each frame's ids that do not depend on their order: equal sets have equal digests."""
    hashed = [F.xxhash64("atom_id"), F.xxhash64(F.lit("id"), "atom_id")]
    return atoms.groupBy("frame_index").agg(F.count("*").alias("n"), *[F.bit_xor(h).alias(f"xor{k}") for k, h in enumerate(hashed)], F.sum(hashed[0].cast("decimal(38,0)")).alias("sum0"))


def continuity(atoms: DataFrame) -> DataFrame:
    """frame_index, n, continuous: whether a frame has the ids of the first one; one aggregation, and a row a frame.

    Ids that repeat in a frame break it: they change the sum even where they cancel out otherwise.
    """
    digests = id_digests(atoms)
    names = digests.columns[1:]
    first = digests.agg(F.min_by(F.struct(*names), "frame_index").alias("first"))
    same = F.struct(*names) == F.col("first")
    return digests.join(F.broadcast(first)).select("frame_index", "n", same.alias("continuous"))  # one row


def continuous(atoms: DataFrame) -> DataFrame:
    """``atoms``, refused unless every frame of the sequence has the same ids."""
    broken = continuity(atoms).where("not continuous").agg(F.min("frame_index")).first()[0]
    if broken is not None:
        raise ValueError(f"Frame {broken} does not have the ids of the first frame")
    return atoms
