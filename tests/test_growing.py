"""Dump files that grow while they are read: each whole frame once, over restarts of the query."""

from cellframe.model import Cell
from cellframe.streaming import growing
from cellframe.streaming.unwrap import unwrap_stream


def frame(step, atoms=3):
    rows = "".join(f"{n} 1 {(0.9 + 0.2 * step) % 1.0:.3f} 0.5 0.5\n" for n in range(1, atoms + 1))
    return f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n{atoms}\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type xs ys zs\n{rows}"


def run(spark, folder, out, checkpoint, make=lambda s: s):
    stream = make(spark.readStream.format("growing_dumps").load(str(folder)))
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_each_frame_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(growing.GrowingDumps)
    folder, out, checkpoint = (tmp_path / n for n in ("in", "out", "c"))
    folder.mkdir()
    whole = "".join(frame(t) for t in range(6))
    cut = len(frame(0)) * 2 + 90  # in the middle of the third frame
    (folder / "a.dump").write_text(whole[:cut])
    run(spark, folder, out, checkpoint)
    found = lambda: sorted((r.file, r.timestep, r.text) for r in spark.read.parquet(str(out)).collect())
    assert [x[:2] for x in found()] == [("a.dump", 0), ("a.dump", 1)]
    (folder / "a.dump").write_text(whole[: cut + len(frame(0))])
    (folder / "b.dump").write_text(frame(7) + frame(8, 0))
    run(spark, folder, out, checkpoint)
    assert [x[:2] for x in found()] == [("a.dump", 0), ("a.dump", 1), ("a.dump", 2), ("b.dump", 7), ("b.dump", 8)]
    run(spark, folder, out, checkpoint)  # nothing new
    (folder / "a.dump").write_text(whole)
    run(spark, folder, out, checkpoint)
    assert [x[:2] for x in found()] == [("a.dump", t) for t in range(6)] + [("b.dump", 7), ("b.dump", 8)]
    assert "".join(x[2] for x in found()[:6]) == whole


def test_frames_are_found_wherever_chunks_and_tasks_end(tmp_path, monkeypatch):
    texts = [frame(t, t % 4) for t in range(9)]
    path = tmp_path / "x.dump"
    path.write_text("".join(texts))
    starts = [sum(map(len, texts[:k])) for k in range(10)]
    for chunk in (23, 64, 1000):
        monkeypatch.setattr(growing, "CHUNK", chunk)
        with open(path, "rb") as source:
            assert list(growing.marks(source, 0, starts[-1])) == starts[:-1]
            for size in range(0, starts[-1] + 1, 7):
                assert growing.whole_until(source, 0, size) == max(s for s in starts if s <= size)
        for task in (50, 333, 10_000):
            monkeypatch.setattr(growing, "TASK", task)
            reader = growing._Reader(str(tmp_path))
            rows = [r for p in reader.partitions({"x.dump": starts[2]}, {"x.dump": starts[7]}) for r in reader.read(p)]
            assert [(r[1], r[2], r[3]) for r in rows] == [(starts[k], k, texts[k]) for k in range(2, 7)]


def test_growing_frames_are_unwrapped(spark, tmp_path):
    spark.dataSource.register(growing.GrowingDumps)
    folder, out, checkpoint = (tmp_path / n for n in ("in", "out", "c"))
    folder.mkdir()
    for upto in (2, 4):
        (folder / "a.dump").write_text("".join(frame(t) for t in range(upto)))
        run(spark, folder, out, checkpoint, lambda s: unwrap_stream(growing.frame_atoms(s), Cell.cube(10.0)))
    found = {(r.frame_index, r.atom_id): round(r.ux, 6) for r in spark.read.parquet(str(out)).collect()}
    assert len(found) == 12 and all(found[(t, "2")] == round(9.0 + 2 * t, 6) for t in range(4))
