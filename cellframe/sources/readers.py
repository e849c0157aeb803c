"""Structure files as tables of frames and atoms, read by Spark and parsed on the executors.

A dump is read with its frames as records, so large files are split between tasks at frame
boundaries; the other formats are one record a file.  gzip is opened by Spark itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.sources import formats
from cellframe.sources.parsed import Frame, FormatError

BASE = "frame_index int, row_idx long, atom_id string, type_label string, sa double, sb double, sc double, x double, y double, z double, ix int, iy int, iz int"
FRAMES = "frame_index int, source_file string, timestep long, sim_time double, id_source string, origin array<double>, h array<double>, pbc array<boolean>, atom_count long"


def natural(name: str) -> list:
    """Sort key that counts runs of digits as numbers."""
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]


def _records(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """file, file_no, place, text: one row a frame of a dump, or a file of another format."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    if kind == "dump":
        found = spark.read.text(paths, lineSep="ITEM: TIMESTEP\n")
    else:
        found = spark.read.text(paths, wholetext=True)
    rows = found.select(F.col("value").alias("text"), *place, F.monotonically_increasing_id().alias("place")).where(F.trim("text") != "")
    return rows.withColumn("name", F.element_at(F.split("file", "/"), -1))


def _numbered(records: DataFrame) -> DataFrame:
    """Records with their number in the order of natural file names, then of the place in the file."""
    padded = F.expr("array_join(transform(split(lower(name), '(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])'), p -> if(p rlike '^[0-9]+$', lpad(p, 20, '0'), p)), '')")
    return records.withColumn("record", F.row_number().over(Window.orderBy(padded, "file", "block", "place")) - 1)


#: Lines and characters that tell a format.
HEAD_LINES, HEAD = 1000, 1 << 16


def _kind(spark: SparkSession, paths: list[str]) -> str:
    """The format that the first lines of a file tell; files of any size are read no further."""
    lines = spark.read.text(paths).select(F.substring("value", 1, HEAD).alias("v"), F.col("_metadata.file_path").alias("f")).limit(HEAD_LINES).collect()
    if not lines:
        raise FormatError("No file")
    name = lines[0]["f"]
    return formats.detect("\n".join(r["v"] for r in lines if r["f"] == name)[:HEAD], name)


def read(spark: SparkSession, paths: list[str] | str, kind: str | None = None, projection: str = "full") -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of structure files.

    ``projection`` is ``full``, ``coordinates`` (no properties) or ``header`` (no atoms: the second is None).
    Properties are those of all frames; where a frame lacks one its atoms have NaN.
    """
    paths = [paths] if isinstance(paths, str) else paths
    kind = kind or _kind(spark, paths)
    parse = formats.PARSERS[kind]
    records = _records(spark, paths, kind)
    # Frames are numbered by records; only names and places, not texts, go through the numbering.
    order = _numbered(records.select("file", "name", "block", "place")).select("file", "place", "record")
    if kind in ("xyz", "pdb"):
        sizes = records.select("file", "place", "text").mapInPandas(_counter(parse), "file string, place long, n long")
        before = Window.orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
        order = order.join(sizes, ["file", "place"]).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    else:
        order = order.withColumn("start", F.col("record"))
    texts = records.select("file", "name", "place", "text").join(order.select("file", "place", "start"), ["file", "place"])

    def frames_of(rows: pd.DataFrame) -> Iterator[tuple[int, str, Frame]]:
        for text, name, start in zip(rows["text"], rows["name"], rows["start"], strict=True):
            for k, frame in enumerate(parse(text)):
                yield int(start) + k, name, frame

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [{"frame_index": i, "source_file": n, "timestep": f.timestep, "sim_time": f.time, "id_source": "row-order" if f.ids is None else "explicit", "origin": list(map(float, f.cell.origin)), "h": list(map(float, f.cell.h)), "pbc": list(map(bool, f.cell.pbc)), "atom_count": len(f.raw)} for i, n, f in frames_of(rows)]
            table = pd.DataFrame(out, columns=[c.split()[0] for c in FRAMES.split(", ")])
            yield table.astype({"timestep": "Int64"})

    frames = texts.mapInPandas(headers, FRAMES)
    if projection == "header":
        return frames, None

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"name": sorted({n for text in rows["text"] for frame in parse(text) for n in frame.properties})}, dtype=object)

    names = sorted(r["name"] for r in records.select("text").mapInPandas(named, "name string").distinct().collect()) if projection == "full" else []

    def columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, _, frame in frames_of(rows):
                own = frame.atoms()
                table = pd.DataFrame({"frame_index": i, **{k: v for k, v in own.items() if k not in frame.properties}})
                yield table.assign(**{n: frame.properties.get(n, float("nan")) for n in names})

    atoms = texts.mapInPandas(columns, BASE + "".join(f", `{n}` double" for n in names))
    # pandas hands NaN over as null.
    return frames, atoms.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(float("nan"))) for n in names}) if names else atoms


def volumes(spark: SparkSession, paths: list[str] | str, kind: str = "volume") -> tuple[DataFrame, DataFrame]:
    """(frames, samples) of volume files: samples are source_file, i, j, k, value, one row each.

    ``kind`` is ``cube``, ``charge`` (values are divided by the cell's volume) or ``volume`` (as written).
    A file is read whole by one task and handed on plane by plane.
    """
    paths = [paths] if isinstance(paths, str) else paths
    parse = {"cube": lambda t: formats.cube_frame(t)[:2], "charge": lambda t: formats.volume_grid(t, True), "volume": lambda t: formats.volume_grid(t, False)}[kind]
    texts = spark.read.text(paths, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"))

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for text, name in zip(rows["value"], rows["source_file"], strict=True):
                frame, values = parse(text)
                yield pd.DataFrame([{"source_file": name, "origin": list(map(float, frame.cell.origin)), "h": list(map(float, frame.cell.h)), "pbc": list(map(bool, frame.cell.pbc)), "shape": list(values.shape), "atom_count": len(frame.raw)}])

    def planes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for text, name in zip(rows["value"], rows["source_file"], strict=True):
                values = parse(text)[1]
                j, k = np.indices(values.shape[1:]).reshape(2, -1)
                for i, plane in enumerate(values):
                    yield pd.DataFrame({"source_file": name, "i": i, "j": j, "k": k, "value": plane.ravel()})

    frames = texts.mapInPandas(headers, "source_file string, origin array<double>, h array<double>, pbc array<boolean>, shape array<int>, atom_count long")
    return frames, texts.mapInPandas(planes, "source_file string, i int, j int, k int, value double")


def _counter(parse):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["file", "place"]].assign(n=[len(parse(t)) for t in rows["text"]])

    return count


def sequences(names: list[str]) -> list[dict]:
    """Groups of file names that differ in one run of digits: pattern, files in natural order, indices, gaps."""
    groups: dict[tuple, list[tuple[int, str]]] = {}
    for name in names:
        runs = list(re.finditer(r"\d+", name))
        for run in runs[-1:]:
            groups.setdefault((name[: run.start()], name[run.end() :]), []).append((int(run.group()), name))
    found = []
    for (head, tail), members in sorted(groups.items()):
        members.sort(key=lambda m: (m[0], natural(m[1])))
        indices = [i for i, _ in members]
        if len(members) > 1 and len(set(indices)) == len(indices):
            found.append({"pattern": f"{head}*{tail}", "files": [n for _, n in members], "indices": indices, "gaps": indices[-1] - indices[0] + 1 - len(indices)})
    return found


def external_properties(spark: SparkSession, path: str) -> DataFrame:
    """Columns by atom id from text: a header with id, then numbers or NaN; white space or commas between."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("n"), F.trim("value").alias("line"))
    head = lines.orderBy("n").first()["line"]
    comma = "," in head
    names = [re.sub(r"\s*\[.*?\]\s*$", "", w).strip() for w in (head.removeprefix("#columns:").split(",") if comma else re.findall(r"\S+(?:\s+\[[^\]]*\])?", head.removeprefix("#columns:")))]
    key = next((k for k, n in enumerate(names) if n.lower() in ("id", "atom_id", "atomid")), None)
    if key is None:
        raise FormatError("External properties need an id column")
    parts = F.split("line", r"\s*,\s*" if comma else r"\s+")
    rows = lines.where((F.col("line") != head) & ~F.col("line").startswith("#")).select(parts.alias("w"))
    value = lambda k: F.when(F.lower(F.element_at("w", k + 1)) == "nan", F.lit(float("nan"))).otherwise(F.element_at("w", k + 1).cast("double"))
    table = rows.select(F.element_at("w", key + 1).alias("atom_id"), *[value(k).alias(n) for k, n in enumerate(names) if k != key])
    numbers = [n for k, n in enumerate(names) if k != key]
    if numbers and table.where(" or ".join(f"abs(`{n}`) = double('infinity')" for n in numbers)).limit(1).count():
        raise FormatError("External properties must not be infinite")
    return table
