"""Writers: CSV tables, structures and meshes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(name: str, kind: str) -> Column:
    """A CSV field: text quoted where it must be, null empty, NaN and infinities kept, shortest doubles."""
    c = F.col(f"`{name}`")
    text = c.cast("string")
    if kind == "string":
        text = F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    elif kind in ("double", "float"):
        whole = (c == F.floor(F.when(F.isnan(c) | (F.abs(c) > 1e15), 0.0).otherwise(c))) & (F.abs(c) < 1e15)
        text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").when(whole, F.when(whole, c).otherwise(0.0).cast("bigint").cast("string")).otherwise(text)
    return F.coalesce(text, F.lit(""))


def csv_lines(table: DataFrame) -> DataFrame:
    """line: the table's rows as CSV text without line ends."""
    return table.select(F.concat_ws(",", *[_field(n, t) for n, t in table.dtypes]).alias("line"))


def write_csv(table: DataFrame, path: str) -> None:
    """CSV parts with CRLF ends and a header in each, the same text however many parts there are."""
    header = ",".join(f'"{n.replace(chr(34), chr(34) * 2)}"' if any(c in n for c in '",\r\n') else n for n in table.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([header])], ["line"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["line"])

    csv_lines(table).mapInArrow(headed, "line string").write.option("lineSep", "\r\n").mode("overwrite").text(path)


def _ordered_lines(head: list[str], rows: DataFrame, order: list[str]) -> DataFrame:
    """The head's lines before those of ``rows`` (line and the columns of ``order``), sorted over all tasks."""
    keys = [f"_{n}" for n in range(len(order))]
    top = rows.sparkSession.createDataFrame([(k, line) for k, line in enumerate(head)], "_head int, line string")
    below = rows.select(F.lit(len(head)).alias("_head"), "line", *[F.col(o).alias(k) for o, k in zip(order, keys, strict=True)])
    return top.unionByName(below, allowMissingColumns=True).orderBy("_head", *keys).select("line")


def poscar_lines(atoms: DataFrame, frame_index: int, cell) -> DataFrame:
    """One frame as the lines of a POSCAR, in order; types come in the order of their first atoms."""
    own = atoms.where(F.col("frame_index") == frame_index)
    types = own.groupBy("type_label").agg(F.min("row_idx").alias("first"), F.count("*").alias("n"))
    listed = types.orderBy("first").collect()  # a row a type
    head = ["frame", "1.0", *(" ".join(repr(float(v)) for v in row) for row in cell.matrix), " ".join(t["type_label"] for t in listed), " ".join(str(t["n"]) for t in listed), "Direct"]
    rows = own.join(types.select("type_label", "first"), "type_label").select("first", "row_idx", F.concat_ws(" ", "sa", "sb", "sc").alias("line"))
    return _ordered_lines(head, rows, ["first", "row_idx"])


def cif_lines(atoms: DataFrame, frame_index: int, cell) -> DataFrame:
    """One frame as the lines of a CIF in space group P1, in order."""
    a, b, c = cell.matrix
    angle = lambda u, v: float(np.degrees(np.arccos(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))))
    head = ["data_frame", *(f"_cell_length_{n} {float(np.linalg.norm(v))!r}" for n, v in zip("abc", (a, b, c), strict=True))]
    head += [f"_cell_angle_alpha {angle(b, c)!r}", f"_cell_angle_beta {angle(a, c)!r}", f"_cell_angle_gamma {angle(a, b)!r}", "_symmetry_space_group_name_H-M 'P 1'"]
    head += ["loop_", "_atom_site_label", "_atom_site_type_symbol", "_atom_site_fract_x", "_atom_site_fract_y", "_atom_site_fract_z"]
    symbol = F.replace("type_label", F.lit(" "), F.lit(""))
    rows = atoms.where(F.col("frame_index") == frame_index).select("row_idx", F.concat_ws(" ", F.concat(symbol, F.col("row_idx") + 1), symbol, "sa", "sb", "sc").alias("line"))
    return _ordered_lines(head, rows, ["row_idx"])


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text parts whose names are in the order of the lines; the parts one after another are the file."""
    lines.write.mode("overwrite").text(path)


def mesh_text(vertices: np.ndarray, triangles: np.ndarray, kind: str) -> str:
    """A triangle mesh as ASCII ``stl`` (without triangles of no area), ``ply`` or ``obj``."""
    if kind == "obj":
        return "".join(f"v {x!r} {y!r} {z!r}\n" for x, y, z in vertices.tolist()) + "".join(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in triangles.tolist())
    if kind == "ply":
        head = f"ply\nformat ascii 1.0\nelement vertex {len(vertices)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(triangles)}\nproperty list uchar int vertex_indices\nend_header\n"
        return head + "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in vertices.tolist()) + "".join(f"3 {a} {b} {c}\n" for a, b, c in triangles.tolist())
    if kind != "stl":
        raise ValueError(f"Unknown mesh format {kind}")
    out = ["solid mesh"]
    for p in vertices[triangles]:
        normal = np.cross(p[1] - p[0], p[2] - p[0])
        size = np.linalg.norm(normal)
        if size > 0:
            out += ["facet normal " + " ".join(repr(float(v)) for v in normal / size), "outer loop", *("vertex " + " ".join(repr(float(v)) for v in q) for q in p), "endloop", "endfacet"]
    return "\n".join([*out, "endsolid mesh"]) + "\n"


@dataclass
class Recipe:
    """A configuration without data: what was computed, selected and analysed, for a source by name, size and path."""

    source: dict = field(default_factory=dict)
    computed: list[dict] = field(default_factory=list)
    groups: list[dict] = field(default_factory=list)
    analyses: list[dict] = field(default_factory=list)
    version: int = 1

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=1)

    @classmethod
    def loads(cls, text: str) -> "Recipe":
        given = json.loads(text)
        if not isinstance(given, dict) or set(given) - set(cls.__dataclass_fields__) or given.get("version") != 1:
            raise ValueError("Not a recipe of version 1")
        return cls(**given)

    def fits(self, source: dict) -> bool:
        return all(self.source.get(k) == source.get(k) for k in ("name", "size", "path"))
