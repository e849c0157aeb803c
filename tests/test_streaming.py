import pandas as pd

from cellframe.model import Cell
from cellframe.operators import trajectory
from cellframe.streaming.unwrap import unwrap_stream

ROWS = [(t, a, (0.9 + 0.2 * t * s) % 1.0, 0.5, 0.5) for t in range(4) for a, s in (("1", 1), ("2", -1)) if (t, a) != (2, "2")]
SCHEMA = "frame_index int, atom_id string, sa double, sb double, sc double"


def test_stream_equals_batch(spark, tmp_path):
    cell = Cell.cube(10.0)
    source = tmp_path / "in"
    source.mkdir()
    for t in range(4):
        pd.DataFrame([r for r in ROWS if r[0] == t], columns=["frame_index", "atom_id", "sa", "sb", "sc"]).astype({"frame_index": "int32"}).to_parquet(source / f"{t}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = unwrap_stream(stream, cell).writeStream.format("memory").queryName("unwrapped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.frame_index, r.atom_id): (r.ix, round(r.ux, 6)) for r in spark.table("unwrapped").collect()}
    batch = trajectory.unwrapped(spark.createDataFrame(ROWS, SCHEMA), cell)
    assert found == {(r.frame_index, r.atom_id): (r.ix, round(r.ux, 6)) for r in batch.collect()}
    assert found[(3, "1")] == (1, 15.0)
