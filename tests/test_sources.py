import gzip
import math

import numpy as np
import pytest

from cellframe.model import Cell, crystal
from cellframe.sources import formats, readers, sinks
from cellframe.sources.parsed import FormatError

DUMP = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp ff\n0 10\n0 10\n0 10\nITEM: ATOMS id type element x y z ix iy iz c_pe\n7 1 Ni {x} 5 5 1 0 0 -1.5\n3 2 Fe 1 2 3 0 0 0 2\n"


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_dump_frames_are_split_numbered_and_projected(spark, tmp_path):
    path = write(tmp_path, "run.dump", "".join(DUMP.format(t=t * 100, x=9.5 + t) for t in range(5)))
    frames, atoms = readers.read(spark, path)
    assert [(r.frame_index, r.timestep, r.atom_count) for r in frames.orderBy("frame_index").collect()] == [(k, 100 * k, 2) for k in range(5)]
    first = atoms.where("atom_id = '7'").orderBy("frame_index").collect()
    assert [round(r.x, 6) for r in first] == [9.5, 0.5, 1.5, 2.5, 3.5] and [r.ix for r in first] == [1, 2, 2, 2, 2] and first[0].c_pe == -1.5
    assert "c_pe" not in readers.read(spark, path, projection="coordinates")[1].columns
    assert readers.read(spark, path, projection="header")[1] is None


def test_dump_rules():
    frame = formats.dump_frame(DUMP.format(t=1, x=1).replace("BOX BOUNDS pp pp ff\n0 10\n0 10", "BOX BOUNDS xy xz yz pp pp pp\n0 12 2\n0 10 0").replace("0 10\nITEM: ATOMS", "0 10 0\nITEM: ATOMS"))
    assert frame.cell.h[:5] == (10.0, 0, 0, 2.0, 10.0) and frame.labels == ["Ni", "Fe"]
    with pytest.raises(FormatError):
        formats.dump_frame(DUMP.format(t=1, x=1).replace("3 2 Fe", "7 2 Fe"))
    with pytest.raises(FormatError):
        formats.dump_frame(DUMP.format(t=1, x="nan"))


def test_xyz(spark, tmp_path):
    text = '2\nLattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:id:I:1:f:R:2 Step=9\nNi 0 0 0 4 1 2\n26 5 1d0 1 2 3 nan\n1\nplain\nH 0 0 0\n'
    frames, atoms = readers.read(spark, write(tmp_path, "a.xyz", text))
    rows = atoms.orderBy("frame_index", "row_idx").collect()
    assert [(r.frame_index, r.type_label, r.atom_id) for r in rows] == [(0, "Ni", "4"), (0, "Fe", "2"), (1, "H", "1")]
    assert rows[1].x == 1.0 and rows[1].ix == 1 and math.isnan(rows[1].f_1) and math.isnan(rows[2].f_0)
    assert [r.pbc for r in frames.orderBy("frame_index").collect()] == [[True] * 3, [False] * 3]


def test_cfg_sequence_in_natural_order_and_gzip(spark, tmp_path):
    head = "Number of particles = 2\nA = 1.0 Angstrom\n" + "".join(f"H0({i},{j}) = {4.0 if i == j else 0.0} A\n" for i in (1, 2, 3) for j in (1, 2, 3))
    body = head + ".NO_VELOCITY.\nentry_count = 5\nauxiliary[0] = id\nauxiliary[1] = e [eV]\n58.7\nNi\n{x} 0.5 0.5 2 1.25\n-0.000001 0 1.2 1 3\n"
    for k in (10, 2):
        with gzip.open(tmp_path / f"r.{k}.cfg.gz", "wt") as out:
            out.write(body.format(x=k / 100))
    frames, atoms = readers.read(spark, [str(tmp_path / f"r.{k}.cfg.gz") for k in (10, 2)])
    assert [r.source_file for r in frames.orderBy("frame_index").collect()] == ["r.2.cfg.gz", "r.10.cfg.gz"]
    row = atoms.where("frame_index = 0 and atom_id = '1'").first()
    assert (row.sa, row.iz, row.e) == (0.0, 1, 3.0) and row.sc == pytest.approx(0.2)
    assert readers.sequences(["r.10.cfg", "r.2.cfg", "other.txt"]) == [{"pattern": "r.*.cfg", "files": ["r.2.cfg", "r.10.cfg"], "indices": [2, 10], "gaps": 7}]


def test_poscar_data_pdb_cif_cube():
    p = formats.poscar_frame("x\n-64\n1 0 0\n0 1 0\n0 0 1\nNi Fe_pv\n1 1\nSelective\nDirect\n0 0 0 T T F\n0.5 0.5 1.0 F F F\n")
    assert p.cell.volume == pytest.approx(64) and p.labels == ["Ni", "Fe"] and p.properties["selective_z"].tolist() == [0, 0]
    d = formats.data_frame("c\n\n2 atoms\n0 4 xlo xhi\n0 4 ylo yhi\n0 4 zlo zhi\n\nMasses\n\n1 58.7\n\nAtoms # charge\n\n5 1 0.5 1 1 1\n6 1 -0.5 5 1 1\n\nVelocities\n\n6 1 2 3\n5 0 0 1\n")
    assert d.ids == ["5", "6"] and d.properties["vz"].tolist() == [1.0, 3.0] and d.atoms()["ix"].tolist() == [0, 1]
    line = "ATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  5.00           C  \n"
    f = formats.pdb_frames("CRYST1   10.000   10.000   10.000  90.00  90.00  90.00 P 1\nMODEL 1\n" + line + "ENDMDL\nMODEL 2\n" + line + "ENDMDL\n")
    assert len(f) == 2 and f[1].timestep == 2 and f[0].labels == ["C"] and np.allclose(f[0].raw, [[0.1, 0.2, 0.3]])
    c = formats.cif_frame("data_x\n" + "".join(f"_cell_length_{n} 4.0(1)\n" for n in "abc") + "".join(f"_cell_angle_{n} 90\n" for n in ("alpha", "beta", "gamma")) + "loop_\n_space_group_symop_operation_xyz\n'x, y, z'\n'-x, -y, z+1/2'\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nNi1 0 0 0.25\nO1 0.1 0.2 0.3\n")
    assert c.labels == ["Ni", "Ni", "O", "O"] and np.allclose(c.raw[3], [0.9, 0.8, 0.8])
    frame, samples, _ = formats.cube_frame("a\nb\n1 0 0 0\n-2 1 0 0\n-2 0 1 0\n-2 0 0 1\n28 0 0.5 0.5 0.5\n1 2 3\n4 5 6 7 8\n")
    assert samples[0, 0, 1] == 2 and samples[1, 0, 0] == 5 and frame.labels == ["Ni"]
    assert [formats.detect(t) for t in ("ITEM: TIMESTEP\n0", "Number of particles = 1", "3\nc\nH 0 0 0", "CRYST1 1")] == ["dump", "cfg", "xyz", "pdb"]


def test_external_properties(spark, tmp_path):
    table = readers.external_properties(spark, write(tmp_path, "e.csv", "id, strain [%], q\n1, 0.5, NaN\n2, 1e-3, 4\n"))
    assert table.columns == ["atom_id", "strain", "q"] and {r.atom_id: r.strain for r in table.collect()} == {"1": 0.5, "2": 0.001}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', 1.0, None), ("c", float("nan"), 0.1)], "t string, v double, w double")
    assert [r.line for r in sinks.csv_lines(rows).collect()] == ['"a,""b""",1,', "c,NaN,0.1"]
    atoms, cell = crystal(spark, "bcc", 1, 3.0)
    text = lambda lines: "\n".join(r.line for r in lines.collect()) + "\n"
    again = formats.poscar_frame(text(sinks.poscar_lines(atoms, 0, cell)))
    assert np.allclose(again.raw, [[0, 0, 0], [0.5, 0.5, 0.5]]) and again.cell == cell
    assert len(formats.cif_frame(text(sinks.cif_lines(atoms, 0, cell))).raw) == 2
    sinks.write_lines(sinks.poscar_lines(atoms.repartition(4), 0, cell), str(tmp_path / "parts"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert formats.poscar_frame(whole).labels == again.labels
    v, t = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[0, 1, 2], [0, 0, 1]])
    assert sinks.mesh_text(v, t, "stl").count("facet normal") == 1 and sinks.mesh_text(v, t, "obj").count("f ") == 2 and "element face 2" in sinks.mesh_text(v, t, "ply")
    recipe = sinks.Recipe(source={"name": "a", "size": 1, "path": "p"}, computed=[{"name": "x", "expression": "1"}])
    assert sinks.Recipe.loads(recipe.dumps()) == recipe and recipe.fits({"name": "a", "size": 1, "path": "p"})
    with pytest.raises(ValueError):
        sinks.Recipe.loads('{"version": 2}')
    with pytest.raises(ValueError):
        Cell((1, 0, 0, 2, 0, 0, 0, 0, 1))


def test_properties_of_later_frames_stay(spark, tmp_path):
    plain = DUMP.format(t=0, x=1).replace(" c_pe", "").replace(" -1.5", "").replace("0 0 0 2\n", "0 0 0\n")
    path = write(tmp_path, "grows.dump", plain + DUMP.format(t=1, x=1))
    rows = {(r.frame_index, r.atom_id): r.c_pe for r in readers.read(spark, path)[1].collect()}
    assert math.isnan(rows[0, "7"]) and rows[1, "7"] == -1.5 and rows[1, "3"] == 2.0


def test_csv_is_the_same_text_in_one_part_or_many(spark, tmp_path):
    rows = [(k, f'a"{k}', float(k) / 3 if k % 3 else float("nan")) for k in range(40)]
    table = spark.createDataFrame(rows, 'id long, `odd,"name` string, v double')
    found = []
    for parts in (1, 5):
        sinks.write_csv(table.repartition(parts), str(tmp_path / f"p{parts}"))
        files = [p.read_bytes().decode().split("\r\n") for p in (tmp_path / f"p{parts}").glob("part-*")]
        assert all(lines[0] == 'id,"odd,""name",v' and lines[-1] == "" for lines in files)
        found.append(sorted(line for lines in files for line in lines[1:-1]))
    assert found[0] == found[1] and len(found[0]) == 40 and '3,"a""3",NaN' in found[0]


def test_volume_samples_are_a_table(spark, tmp_path):
    values = list(range(24))  # the first axis runs fastest
    text = "grid\n1.0\n4 0 0\n0 4 0\n0 0 4\nSi\n1\nDirect\n0 0 0\n\n2 3 4\n" + "\n".join(" ".join(map(str, values[k : k + 5])) for k in range(0, 24, 5)) + "\n"
    path = write(tmp_path, "CHGCAR", text)
    frames, samples = readers.volumes(spark, path)
    assert {(r.i, r.j, r.k): r.value for r in samples.collect()} == {(i, j, k): i + 2 * j + 6 * k for i in range(2) for j in range(3) for k in range(4)}
    assert frames.first().shape == [2, 3, 4] and frames.first().atom_count == 1
    assert readers.volumes(spark, path, "charge")[1].where("i = 1 and j = 2 and k = 3").first().value == pytest.approx(23 / 64)
