"""Attributes of frames: cell measures, counts, means; their narrow table and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions import ieee


def _vector(k: int) -> list[Column]:
    return [F.element_at("h", 3 * k + i + 1) for i in range(3)]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))


def cell_measures(frames: DataFrame) -> DataFrame:
    """``frames`` with cell_a, cell_b, cell_c, alpha, beta, gamma (degrees) and cell_volume."""
    a, b, c = (_vector(k) for k in range(3))
    length = [F.sqrt(_dot(v, v)) for v in (a, b, c)]
    angle = lambda u, v, k, m: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / (length[k] * length[m])))))
    cross = [b[1] * c[2] - b[2] * c[1], b[2] * c[0] - b[0] * c[2], b[0] * c[1] - b[1] * c[0]]
    return frames.withColumns({"cell_a": length[0], "cell_b": length[1], "cell_c": length[2], "alpha": angle(b, c, 1, 2), "beta": angle(a, c, 0, 2), "gamma": angle(a, b, 0, 1), "cell_volume": F.abs(_dot(a, cross))})


def cell_strain(measured: DataFrame, reference_frame: int) -> DataFrame:
    """Engineering strain of the cell vectors and the volume against one frame: strain_a, strain_b, strain_c, strain_volume."""
    names = ("cell_a", "cell_b", "cell_c", "cell_volume")
    base = measured.where(F.col("frame_index") == reference_frame).limit(1).select(*[F.col(n).alias(f"{n}_0") for n in names])
    wide = measured.crossJoin(F.broadcast(base))
    return wide.select("frame_index", *[(F.col(n) / F.col(f"{n}_0") - 1).alias(o) for n, o in zip(names, ("strain_a", "strain_b", "strain_c", "strain_volume"), strict=True)])


def type_counts(atoms: DataFrame, prefix: str = "Type") -> DataFrame:
    """Narrow attributes ``prefix.label.count`` and ``prefix.label.fraction`` of each frame, zero counts included."""
    counts = atoms.groupBy("frame_index", "type_label").agg(F.count("*").alias("n"))
    totals = counts.groupBy("frame_index").agg(F.sum("n").alias("total"))
    spine = totals.crossJoin(F.broadcast(counts.select("type_label").distinct()))
    full = spine.join(counts, ["frame_index", "type_label"], "left").fillna(0, ["n"])
    label = F.regexp_replace("type_label", r"[^\x21-\x7e]+", "_")
    both = F.array(F.struct(F.lit("count").alias("kind"), F.col("n").cast("double").alias("value")), F.struct(F.lit("fraction").alias("kind"), (F.col("n") / F.col("total")).alias("value")))
    return full.select("frame_index", label.alias("label"), F.explode(both).alias("v")).select("frame_index", F.concat_ws(".", F.lit(prefix), "label", "v.kind").alias("name"), "v.value")


def property_means(atoms: DataFrame, properties: list[str]) -> DataFrame:
    """Narrow attributes ``Mean.<property>`` over finite values."""
    long = atoms.select("frame_index", *[F.col(p).cast("double").alias(p) for p in properties]).unpivot(["frame_index"], properties, "p", "v")
    mean = F.coalesce(F.avg(F.when(ieee.finite(F.col("v")), F.col("v"))), ieee.nan())
    return long.groupBy("frame_index", "p").agg(mean.alias("value")).select("frame_index", F.concat(F.lit("Mean."), "p").alias("name"), "value")


def narrow(measured: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Frame columns as narrow attributes under the names given."""
    renamed = measured.select("frame_index", *[F.col(c).cast("double").alias(n) for n, c in columns.items()])
    return renamed.unpivot(["frame_index"], list(columns), "name", "value")


def sampled(attributes: DataFrame, first: int, stride: int, last: int) -> DataFrame:
    """Attributes of the frames first, first + stride, ... up to last."""
    if stride < 1 or (last - first) // stride + 1 > 100_000:
        raise ValueError("A series has a positive stride and at most 100000 frames")
    return attributes.where(F.col("frame_index").between(first, last) & (F.pmod(F.col("frame_index") - first, F.lit(stride)) == 0))


def current_points(points: DataFrame) -> DataFrame:
    """Points (name, signature, stamp, frame_index, value) of each name's newest signature, the newest of each frame."""
    newest = points.groupBy("name").agg(F.max_by("signature", "stamp").alias("signature"))
    kept = points.join(newest, ["name", "signature"])
    return kept.groupBy("name", "signature", "frame_index").agg(F.max_by("value", "stamp").alias("value"))


def time_series(attributes: DataFrame, names: list[str], frames: DataFrame | None = None) -> DataFrame:
    """One row a frame with a column for each name; absent values are null.  x is the timestep if every frame has one, else the frame's number from 1."""
    wide = attributes.groupBy("frame_index").pivot("name", names).agg(F.first("value", ignorenulls=True))
    number = wide.withColumn("frame_number", F.col("frame_index") + 1)
    if frames is None:
        return number.withColumn("x", F.col("frame_number"))
    all_have = F.broadcast(frames.agg(F.bool_and(F.col("timestep").isNotNull()).alias("stepped")))
    joined = number.join(frames.select("frame_index", "timestep"), "frame_index", "left").crossJoin(all_have)
    return joined.withColumn("x", F.when(F.col("stepped"), F.col("timestep")).otherwise(F.col("frame_number"))).drop("stepped")


def label_text(template: str, columns: list[str]) -> Column:
    """A label from ``[Name]`` and ``[Name:spec]`` fields; ``[[`` and ``]]`` are brackets, unknown names show as [?Name]."""
    parts: list[Column] = []
    text, at = "", 0
    while at < len(template):
        if template.startswith(("[[", "]]"), at):
            text, at = text + template[at], at + 2
        elif template[at] == "[" and "]" in template[at:]:
            end = template.index("]", at)
            name, _, spec = template[at + 1 : end].partition(":")
            parts.append(F.lit(text))
            text, at = "", end + 1
            known = [c for c in columns if c == name] or [c for c in columns if c.lower() == name.lower()]
            if len(known) != 1:
                parts.append(F.lit(f"[?{name}]"))
            elif spec:
                value = F.col(f"`{known[0]}`")
                parts.append(F.format_string("%" + spec.lstrip("%"), value.cast("bigint") if spec[-1] == "d" else value.cast("double")))
            else:
                parts.append(F.col(f"`{known[0]}`").cast("string"))
        else:
            text, at = text + template[at], at + 1
    return F.concat(*parts, F.lit(text)) if parts else F.lit(text)


def vector_columns(table: DataFrame, family: str) -> DataFrame:
    """``table`` with familyMagnitude from familyX, familyY, familyZ; NaN if a component is not finite."""
    parts = [F.col(f"{family}{n}").cast("double") for n in "XYZ"]
    good = ieee.finite(parts[0]) & ieee.finite(parts[1]) & ieee.finite(parts[2])
    size = F.hypot(F.hypot(parts[0], parts[1]), parts[2])
    return table.withColumn(f"{family}Magnitude", F.when(good, size).otherwise(ieee.nan()))


def euler_angles(table: DataFrame, w: str = "qw", x: str = "qx", y: str = "qy", z: str = "qz") -> DataFrame:
    """``table`` with axis and angle, and Bunge's Euler angles in degrees, of unit quaternions."""
    q = [F.col(c).cast("double") for c in (w, x, y, z)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    sine = F.sqrt(q[1] ** 2 + q[2] ** 2 + q[3] ** 2)
    axis = [F.when(sine > 0, sign * c / F.when(sine > 0, sine).otherwise(1.0)).otherwise(1.0 if k == 2 else 0.0) for k, c in enumerate(q[1:])]
    angle = F.degrees(2 * F.atan2(sine, F.abs(q[0])))
    total, half = F.atan2(q[3], q[0]), F.atan2(q[2], q[1])
    turn = lambda a: F.pmod(F.degrees(a), F.lit(360.0))
    middle = F.degrees(2 * F.atan2(F.sqrt(q[1] ** 2 + q[2] ** 2), F.sqrt(q[0] ** 2 + q[3] ** 2)))
    return table.withColumns({"axis_x": axis[0], "axis_y": axis[1], "axis_z": axis[2], "rotation_angle": angle, "euler_phi1": turn(total + half), "euler_Phi": middle, "euler_phi2": turn(total - half)})


def densities(measured: DataFrame, masses: DataFrame) -> DataFrame:
    """frame_index and density in g/cm3 from cell_volume (cubic angstrom) and the frame's mass (atomic units)."""
    return measured.join(masses, "frame_index").select("frame_index", (F.col("mass") / F.col("cell_volume") / 0.602214076).alias("density"))


