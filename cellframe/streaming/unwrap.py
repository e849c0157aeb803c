"""Unwrapping of a stream of frames: state by atom, frames in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.model import AXES, Cell

STATE = "last_frame int, sa double, sb double, sc double, ix int, iy int, iz int"
OUT = "atom_id string, frame_index int, sa double, sb double, sc double, ix int, iy int, iz int, ux double, uy double, uz double"


def unwrap_stream(frames: DataFrame, cell: Cell) -> DataFrame:
    """Continuous coordinates of a stream of (atom_id, frame_index, sa, sb, sc).

    Each atom's frames must come in increasing order across batches; a frame at or before the last one
    is an error and changes no state.  An atom that was absent goes on from where it was last seen.
    """
    periodic = np.array(cell.pbc)
    matrix, origin = cell.matrix, np.array(cell.origin)

    def carry_on(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable")
        numbers, s = rows["frame_index"].to_numpy(), rows[list(AXES)].to_numpy(dtype=float)
        if not np.isfinite(s).all():
            raise ValueError(f"Atom {key[0]} has coordinates that are not finite")
        if state.exists:
            last, *kept = state.get
            before, image = np.array(kept[:3], dtype=float), np.array(kept[3:], dtype=np.int64)
        else:
            last, before, image = None, s[0], np.zeros(3, dtype=np.int64)
        if (np.diff(numbers) <= 0).any() or last is not None and numbers[0] <= last:
            raise ValueError(f"Atom {key[0]}: frames must come once and in order")
        steps = np.where(periodic, np.floor(np.diff(s, axis=0, prepend=before[None]) + 0.5), 0).astype(np.int64)
        images = image - np.cumsum(steps, axis=0)
        state.update((int(numbers[-1]), *map(float, s[-1]), *map(int, images[-1])))
        u = (s + images) @ matrix + origin
        yield pd.DataFrame({"atom_id": key[0], "frame_index": numbers, **{a: s[:, k] for k, a in enumerate(AXES)}, **{i: images[:, k] for k, i in enumerate(("ix", "iy", "iz"))}, **{n: u[:, k] for k, n in enumerate(("ux", "uy", "uz"))}})

    plain = frames.select(F.col("atom_id").cast("string").alias("atom_id"), F.col("frame_index").cast("int").alias("frame_index"), *[F.col(a).cast("double").alias(a) for a in AXES])
    return plain.groupBy("atom_id").applyInPandasWithState(carry_on, OUT, STATE, "append", "NoTimeout")


def windowed_statistics(events: DataFrame, time: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Count, mean and bounds of ``value`` by event-time window, late rows within the watermark included."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late) if events.isStreaming else events
    return grouped.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "low", "high")
