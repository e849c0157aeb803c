"""Parsers of the text formats, each from text to frames; they hold no more than the text they are given."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from cellframe.model import Cell
from cellframe.sources.parsed import Frame, FormatError, cell_of_lengths, finite, number, padded_cell, reduced, uniform

#: Fixed value: bohr in angstrom.
BOHR = 0.529177210903
#: Elements by atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba "
    "La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def element(word: str) -> str:
    return ELEMENTS[int(word) - 1] if word.isdigit() and 0 < int(word) <= len(ELEMENTS) else word


# --- dump ------------------------------------------------------------------------------------------

_DUMP_SETS = (("xs", "ys", "zs", True), ("x", "y", "z", False), ("xsu", "ysu", "zsu", True), ("xu", "yu", "zu", False))
_DUMP_OWN = {"id", "type", "element", "ix", "iy", "iz", *(c for s in _DUMP_SETS for c in s[:3])}


def dump_frame(text: str) -> Frame:
    """One frame of a text dump, with or without its first ITEM line."""
    parts = re.split(r"^ITEM: ?", ("TIMESTEP\n" if not text.lstrip().startswith("ITEM") else "") + text.lstrip("\n"), flags=re.MULTILINE)
    blocks: dict[str, tuple[str, list[str]]] = {}
    for part in parts:
        if part.strip():
            head, _, body = part.partition("\n")
            name = next((n for n in ("TIMESTEP", "NUMBER OF ATOMS", "BOX BOUNDS", "ATOMS", "UNITS", "TIME") if head.startswith(n)), head)
            if name in blocks:
                raise FormatError(f"The block {name} comes twice")
            blocks[name] = (head[len(name) :].strip(), body.splitlines())
    for need in ("TIMESTEP", "NUMBER OF ATOMS", "BOX BOUNDS", "ATOMS"):
        if need not in blocks:
            raise FormatError(f"The block {need} is missing")
    words = blocks["BOX BOUNDS"][0].split()
    if "abc" in words:
        raise FormatError("General triclinic boxes are not supported")
    tilted = words[:3] == ["xy", "xz", "yz"]
    flags = words[3:] if tilted else words
    bounds = np.array([[number(w) for w in line.split()] for line in blocks["BOX BOUNDS"][1][:3]])
    xy, xz, yz = bounds[:, 2] if tilted else (0.0, 0.0, 0.0)
    low, high = bounds[:, 0].copy(), bounds[:, 1].copy()
    low[0], high[0] = low[0] - min(0, xy, xz, xy + xz), high[0] - max(0, xy, xz, xy + xz)
    low[1], high[1] = low[1] - min(0, yz), high[1] - max(0, yz)
    size = high - low
    pbc = tuple(f == "pp" for f in flags[:3]) if len(flags) >= 3 else (True, True, True)
    cell = Cell((size[0], 0, 0, xy, size[1], 0, xz, yz, size[2]), pbc, tuple(low))
    columns = blocks["ATOMS"][0].split()
    count = int(blocks["NUMBER OF ATOMS"][1][0])
    rows = [line.split() for line in blocks["ATOMS"][1] if line.strip()]
    if len(rows) != count:
        raise FormatError(f"{len(rows)} atoms instead of {count}")
    table = dict(zip(columns, zip(*uniform(rows, len(columns), "ATOMS"), strict=True), strict=True)) if rows else {c: () for c in columns}
    if "id" not in table or len(set(table["id"])) != count:
        raise FormatError("A dump needs unique ids")
    chosen = next((s for s in _DUMP_SETS if all(c in table for c in s[:3])), None)
    if chosen is None:
        raise FormatError("A dump needs one complete set of coordinates")
    images = None
    flags3 = [c for c in ("ix", "iy", "iz") if c in table]
    if flags3 and len(flags3) < 3:
        raise FormatError("Image flags come all or not at all")
    values = finite(np.array([[number(w) for w in table[c]] for c in chosen[:3]]).T.reshape(-1, 3), "Coordinates")
    if flags3:
        images = np.array([[int(w) for w in table[c]] for c in flags3], dtype=np.int32).T
    raw = values if chosen[3] else reduced(values, cell)
    if "element" in table:
        labels = list(table["element"])
        if "type" in table and len(set(zip(table["type"], labels, strict=True))) != len(set(table["type"])):
            raise FormatError("A type stands for two elements")
    else:
        labels = [f"Type {t}" for t in table.get("type", ["1"] * count)]
    own = {c: finite(np.array([number(w) for w in v]), c) for c, v in table.items() if c not in _DUMP_OWN}
    time = number(blocks["TIME"][1][0]) if "TIME" in blocks else None
    return Frame(cell, raw, labels, list(table["id"]), int(blocks["TIMESTEP"][1][0]), time, own, images)


# --- xyz -------------------------------------------------------------------------------------------



def _truth(word: str) -> bool:
    if word.lower() not in ("t", "true", "1", "f", "false", "0"):
        raise FormatError(f"{word!r} is no truth value")
    return word.lower() in ("t", "true", "1")


def xyz_frames(text: str) -> list[Frame]:
    """All frames of plain or extended XYZ."""
    lines, at, frames = text.splitlines(), 0, []
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        if not lines[at].strip().isdigit():
            raise FormatError(f"Line {at + 1} should count the atoms of a frame")
        count = int(lines[at])
        if at + 2 + count > len(lines):
            raise FormatError("The last frame is cut off")
        frames.append(_xyz_frame(lines[at + 1], [line.split() for line in lines[at + 2 : at + 2 + count]]))
        at += 2 + count
    return frames


def _xyz_frame(comment: str, rows: list[list[str]]) -> Frame:
    given = {}
    for key, a, b, c in re.findall(r"([A-Za-z_][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", comment):
        given[key.lower()] = a or b or c
    fields = given.get("properties", "species:S:1:pos:R:3").split(":")
    layout = [(fields[k], fields[k + 1], int(fields[k + 2])) for k in range(0, len(fields), 3)]
    width = sum(n for *_, n in layout)
    if "properties" not in given:
        rows = [r[:4] for r in rows]
    columns = list(zip(*uniform(rows, width, "XYZ"), strict=True)) if rows else [()] * width
    ids, labels, positions, own, at = None, None, None, {}, 0
    for name, kind, n in layout:
        part, at = columns[at : at + n], at + n
        folded = name.lower()
        if folded in ("species", "element", "type") and kind == "S":
            labels = [element(w) for w in part[0]]
        elif folded in ("pos", "position", "positions"):
            positions = finite(np.array([[number(w) for w in c] for c in part]).T.reshape(-1, 3), "Positions")
        elif folded == "id":
            ids = list(part[0])
            if len(set(ids)) != len(ids):
                raise FormatError("Ids repeat")
        elif kind != "S":
            for k, c in enumerate(part):
                own[name if n == 1 else f"{name}_{k}"] = np.array([float(_truth(w)) if kind == "L" else number(w) for w in c])
    if positions is None:
        raise FormatError("XYZ needs positions")
    if "lattice" in given:
        pbc = tuple(_truth(w) for w in given["pbc"].split()) if "pbc" in given else (True, True, True)
        cell = Cell(tuple(number(w) for w in given["lattice"].split()), pbc, tuple(number(w) for w in given.get("origin", "0 0 0").split()))
    else:
        if any(_truth(w) for w in given.get("pbc", "F F F").split()):
            raise FormatError("Periodic axes need a Lattice")
        cell = padded_cell(positions)
    step = next((given[k] for k in ("step", "timestep") if k in given), None)
    return Frame(cell, reduced(positions, cell), labels or ["X"] * len(positions), ids, int(step) if step else None, None, own)


# --- cfg -------------------------------------------------------------------------------------------


def cfg_frame(text: str) -> Frame:
    """Basic or extended CFG."""
    given: dict[str, str] = {}
    rows, names, extended, width = [], {}, None, None
    label, mass = None, None
    labels, masses = [], []
    for line in text.splitlines():
        line = line.split("#")[0].strip() if not line.startswith("auxiliary") else line.strip()
        if not line:
            continue
        if match := re.match(r"auxiliary\[(\d+)\]\s*=\s*(.+)", line):
            names[int(match[1])] = re.sub(r"\s*\[.*\]\s*$", "", match[2].split("#")[0]).strip()
        elif line.startswith(".NO_VELOCITY."):
            given["no_velocity"] = "1"
        elif "=" in line:
            key, _, value = line.partition("=")
            given[key.strip()] = value.strip()
        else:
            words = line.split()
            extended = "entry_count" in given
            if extended and len(words) == 1:
                mass, label = (words[0], label) if re.match(r"[-+.\d]", words[0]) else (mass, words[0])
                continue
            if not extended:
                mass, label, words = words[0], words[1], words[2:]
            width = width or (int(given["entry_count"]) if extended else len(words))
            if len(words) != width:
                raise FormatError(f"A row has {len(words)} entries instead of {width}")
            labels.append(label)
            masses.append(number(mass))
            rows.append([number(w) for w in words])
    if int(given.get("Number of particles", -1)) != len(rows):
        raise FormatError("The number of particles does not match")
    scale = number(given.get("A", "1").split()[0])
    try:
        h0 = np.array([[number(given[f"H0({i},{j})"].split()[0]) for j in (1, 2, 3)] for i in (1, 2, 3)])
    except KeyError as missing:
        raise FormatError(f"{missing} is missing") from None
    part = lambda name, i, j, base: number(given.get(f"{name}({i},{j})", given.get(f"{name}({j},{i})", base) if name == "eta" else base).split()[0])
    turn = np.array([[part("Transform", i, j, "1" if i == j else "0") for j in (1, 2, 3)] for i in (1, 2, 3)])
    eta = np.array([[part("eta", i, j, "0") for j in (1, 2, 3)] for i in (1, 2, 3)])
    if not np.allclose(turn, np.eye(3)) and eta.any():
        raise FormatError("Transform and eta exclude each other")
    if eta.any():
        values, vectors = np.linalg.eigh(np.eye(3) + 2 * eta)
        turn = vectors @ np.diag(np.sqrt(values)) @ vectors.T
    cell = Cell(tuple((h0 @ turn * scale).ravel()))
    table = finite(np.array(rows).reshape(len(rows), -1), "Rows")
    raw = table[:, :3].copy()
    near = np.round(raw)
    raw = np.where(np.abs(raw - near) <= 1e-5, near, raw)
    moving = 0 if "no_velocity" in given else 3
    own = {"mass": np.array(masses)} | ({c: table[:, 3 + k] for k, c in enumerate(("vx", "vy", "vz"))} if moving and table.shape[1] >= 6 else {})
    for k in range(table.shape[1] - 3 - moving):
        own[names.get(k, f"aux_{k}")] = table[:, 3 + moving + k]
    ids, images = None, None
    if "id" in own:
        whole = own.pop("id")
        if (whole != np.floor(whole)).any() or (whole < 1).any() or len(set(whole)) != len(whole):
            raise FormatError("Ids must be positive whole numbers and unique")
        ids = [str(int(v)) for v in whole]
    flags = [c for c in ("ix", "iy", "iz") if c in own]
    if flags:
        if len(flags) < 3 or any((own[c] != np.floor(own[c])).any() for c in flags):
            raise FormatError("Image flags are whole and come all or not at all")
        images = np.stack([own.pop(c) for c in flags], axis=1).astype(np.int32)
    return Frame(cell, raw, labels, ids, None, None, own, images)


# --- poscar, data, pdb, cif, cube ------------------------------------------------------------------


def poscar_frame(text: str) -> Frame:
    lines = text.splitlines()
    factors = [number(w) for w in lines[1].split()]
    vectors = np.array([[number(w) for w in line.split()[:3]] for line in lines[2:5]])
    if len(factors) == 1 and factors[0] < 0:
        factors = [(-factors[0] / abs(np.linalg.det(vectors))) ** (1 / 3)]
    scale = np.array(factors if len(factors) == 3 else factors * 3)
    at = 5
    named = not lines[5].split()[0].isdigit()
    species = [re.split(r"[_/]", w)[0] for w in lines[5].split()] if named else lines[0].split()
    at += named
    counts = [int(w) for w in lines[at].split()]
    if len(species) != len(counts):
        species = [f"Type {k + 1}" for k in range(len(counts))]
    at += 1
    selective = lines[at].strip()[:1].lower() == "s"
    at += selective
    direct = lines[at].strip()[:1].lower() not in ("c", "k")
    rows = [line.split() for line in lines[at + 1 : at + 1 + sum(counts)]]
    if len(rows) != sum(counts):
        raise FormatError("Coordinates are missing")
    values = finite(np.array([[number(w) for w in r[:3]] for r in rows]), "Coordinates")
    cell = Cell(tuple((vectors * scale).ravel()))
    own = {f"selective_{c}": np.array([1.0 if r[3 + k][:1].lower() in ("t", ".") and "f" not in r[3 + k].lower()[:2] else 0.0 for r in rows]) for k, c in enumerate("xyz")} if selective else {}
    labels = [s for s, n in zip(species, counts, strict=True) for _ in range(n)]
    return Frame(cell, values if direct else reduced(values * scale, cell), labels, properties=own)


#: Columns of the atom styles before x y z.
ATOM_STYLES = {"atomic": ("id", "type"), "charge": ("id", "type", "q"), "bond": ("id", "molecule", "type"), "angle": ("id", "molecule", "type"), "molecular": ("id", "molecule", "type"), "full": ("id", "molecule", "type", "q"), "sphere": ("id", "type", "diameter", "density")}


def data_frame(text: str) -> Frame:
    """A data file: header, Masses, Atoms # style, Velocities."""
    sections = re.split(r"^\s*(Masses|Atoms|Velocities|Atom Type Labels)\b[ \t]*(?:#[ \t]*(\S+))?[^\n]*$", text, flags=re.MULTILINE)
    header = sections[0]
    found = {sections[k]: (sections[k + 1], [line.split("#")[0].split() for line in sections[k + 2].splitlines() if line.split("#")[0].strip()]) for k in range(1, len(sections), 3)}
    edges = {axis: [number(w) for w in re.search(rf"^\s*(\S+)\s+(\S+)\s+{axis}lo\s+{axis}hi", header, re.MULTILINE).groups()] for axis in "xyz"}
    tilt = re.search(r"^\s*(\S+)\s+(\S+)\s+(\S+)\s+xy\s+xz\s+yz", header, re.MULTILINE)
    xy, xz, yz = (number(w) for w in tilt.groups()) if tilt else (0.0, 0.0, 0.0)
    size = [edges[a][1] - edges[a][0] for a in "xyz"]
    cell = Cell((size[0], 0, 0, xy, size[1], 0, xz, yz, size[2]), (True, True, True), tuple(edges[a][0] for a in "xyz"))
    style, rows = found["Atoms"]
    columns = ATOM_STYLES.get(style or "atomic")
    if columns is None:
        raise FormatError(f"Unknown atom style {style}")
    width = len(columns) + 3
    with_images = bool(rows) and len(rows[0]) == width + 3
    table = dict(zip([*columns, "x", "y", "z", *(("ix", "iy", "iz") if with_images else ())], zip(*uniform(rows, width + 3 * with_images, "Atoms"), strict=True), strict=True))
    names = {r[0]: r[1] for r in found.get("Atom Type Labels", (None, []))[1]}
    masses = {r[0]: number(r[1]) for r in found.get("Masses", (None, []))[1]}
    types = table["type"]
    own = {c: np.array([number(w) for w in table[c]]) for c in columns if c not in ("id", "type")}
    own["mass"] = np.array([masses.get(t, float("nan")) for t in types])
    if "Velocities" in found:
        speeds = {r[0]: r[1:4] for r in found["Velocities"][1]}
        if set(speeds) != set(table["id"]):
            raise FormatError("Velocities must cover every atom once")
        own |= {c: np.array([number(speeds[i][k]) for i in table["id"]]) for k, c in enumerate(("vx", "vy", "vz"))}
    positions = np.array([[number(w) for w in table[c]] for c in "xyz"]).T
    images = np.array([[int(w) for w in table[c]] for c in ("ix", "iy", "iz")], dtype=np.int32).T if with_images else None
    return Frame(cell, reduced(positions, cell), [names.get(t, f"Type {t}") for t in types], list(table["id"]), None, None, own, images)


def pdb_frames(text: str) -> list[Frame]:
    cell, frames, atoms, model = None, [], [], None

    def close() -> None:
        nonlocal atoms
        if atoms:
            positions = np.array([a[2] for a in atoms])
            box = cell or padded_cell(positions)
            own = {n: np.array([a[k] for a in atoms]) for n, k in (("occupancy", 3), ("bfactor", 4))}
            frames.append(Frame(box, reduced(positions, box), [a[1] for a in atoms], [a[0] for a in atoms], model, None, own))
            atoms = []

    for line in text.splitlines():
        kind = line[:6].strip()
        if kind == "CRYST1":
            cell = cell_of_lengths(*(number(line[k : k + n]) for k, n in ((6, 9), (15, 9), (24, 9), (33, 7), (40, 7), (47, 7))))
        elif kind == "MODEL":
            close()
            model = int(line[6:].split()[0])
        elif kind == "ENDMDL":
            close()
        elif kind in ("ATOM", "HETATM") and line[16:17] in ("", " ", "A"):
            line = line.ljust(80)
            symbol = line[76:78].strip() or re.sub(r"[^A-Za-z]", "", line[12:14]).strip()
            value = lambda text: number(text) if text.strip() else float("nan")
            atoms.append((line[6:11].strip(), symbol.capitalize(), [number(line[k : k + 8]) for k in (30, 38, 46)], value(line[54:60]), value(line[60:66])))
    close()
    return frames


def _cif_words(text: str) -> list[str]:
    found = []
    for match in re.finditer(r"^;(.*?)^;|'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|\"((?:[^\"\n]|\"(?=\S))*)\"(?=\s|$)|#[^\n]*|(\S+)", text, re.MULTILINE | re.DOTALL):
        value = next((g for g in match.groups() if g is not None), None)
        if value is not None:
            found.append(value if match.group(4) is not None else "\0" + value)
    return found


def _affine(operation: str) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of an operation such as x, -y+1/2, z."""
    turn, move = np.zeros((3, 3)), np.zeros(3)
    for row, part in enumerate(operation.lower().replace(" ", "").split(",")):
        for sign, a, b, axis in re.findall(r"([+-]?)(?:(\d*\.?\d+)(?:/(\d+))?)?([xyz])?", part):
            if axis:
                turn[row, "xyz".index(axis)] += -1 if sign == "-" else 1
            elif a:
                move[row] += (-1 if sign == "-" else 1) * float(a) / float(b or 1)
    if abs(abs(np.linalg.det(turn)) - 1) > 1e-9:
        raise FormatError(f"{operation!r} is no symmetry operation")
    return turn, move


def cif_frame(text: str) -> Frame:
    """Sites of one data block under its symmetry, images of a site that coincide taken once."""
    words, at = _cif_words(text), 0
    single, loops = {}, []
    while at < len(words):
        word = words[at]
        if word.lower() == "loop_":
            at += 1
            names = []
            while at < len(words) and words[at].startswith("_"):
                names.append(words[at].lower())
                at += 1
            values = []
            while at < len(words) and not words[at].startswith("_") and words[at].lower() != "loop_" and not words[at].lower().startswith("data_"):
                values.append(words[at].lstrip("\0"))
                at += 1
            if len(values) % len(names):
                raise FormatError("A loop is not complete")
            loops.append({n: values[k :: len(names)] for k, n in enumerate(names)})
        elif word.startswith("_") and at + 1 < len(words):
            single[word.lower()] = words[at + 1].lstrip("\0")
            at += 2
        else:
            at += 1
    plain = lambda w: float("nan") if w in (".", "?") else number(re.sub(r"\(\d+\)$", "", w))
    cell = cell_of_lengths(*(plain(single[f"_cell_{n}"]) for n in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")))
    sites = next((p for p in loops if "_atom_site_fract_x" in p), None)
    if sites is None:
        raise FormatError("A CIF needs sites with fractional coordinates")
    key = next((n for n in ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz") if any(n in p for p in loops)), None)
    operations = [_affine(o) for o in (next(p for p in loops if key in p)[key] if key else ["x,y,z"])]
    s = np.array([[plain(w) for w in sites[f"_atom_site_fract_{c}"]] for c in "xyz"]).T
    names = sites.get("_atom_site_type_symbol") or sites["_atom_site_label"]
    occupancy = [plain(w) for w in sites.get("_atom_site_occupancy", ["1"] * len(s))]
    raw, labels, own = [], [], []
    for k, site in enumerate(s):
        images: list[np.ndarray] = []
        for turn, move in operations:
            image = (turn @ site + move) % 1.0
            if not any((np.abs(image - o - np.round(image - o)) < 1e-7).all() for o in images):
                images.append(image)
        raw += images
        labels += [re.match(r"[A-Za-z]+", names[k])[0]] * len(images)
        own += [occupancy[k]] * len(images)
    return Frame(cell, np.array(raw), labels, properties={"occupancy": np.array(own)})


def cube_frame(text: str) -> tuple[Frame, np.ndarray, np.ndarray]:
    """Frame, samples[i, j, k] of the first field, and the three step vectors in angstrom."""
    lines = text.splitlines()
    head = [line.split() for line in lines[2:6]]
    atoms = int(head[0][0])
    shape = [int(row[0]) for row in head[1:]]
    unit = 1.0 if shape[0] < 0 else BOHR
    shape = [abs(n) for n in shape]
    steps = np.array([[number(w) for w in row[1:4]] for row in head[1:]]) * unit
    origin = np.array([number(w) for w in head[0][1:4]]) * unit
    rows = [line.split() for line in lines[6 : 6 + abs(atoms)]]
    words = " ".join(lines[6 + abs(atoms) :]).split()
    fields = int(head[0][4]) if len(head[0]) > 4 else 1
    if atoms < 0:
        fields = int(words[0])
        words = words[1 + fields :]
    values = np.array([number(w) for w in words])
    if len(values) != fields * int(np.prod(shape)):
        raise FormatError("The number of samples does not match")
    cell = Cell(tuple((steps * np.maximum(np.array(shape) - 1, 1)[:, None]).ravel()), (False, False, False), tuple(origin))
    positions = np.array([[number(w) for w in r[2:5]] for r in rows]).reshape(-1, 3) * unit
    return Frame(cell, reduced(positions, cell), [element(r[0]) for r in rows]), values.reshape(*shape, fields)[..., 0], steps


def volume_grid(text: str, charge: bool = True) -> tuple[Frame, np.ndarray]:
    """Structure and samples[i, j, k] of a volume file; charge densities are divided by the cell's volume."""
    head, _, body = re.split(r"(\n\s*\n)", text, maxsplit=1)
    frame = poscar_frame(head)
    first, *rest = body.lstrip("\n").split("\n")
    shape = [int(w) for w in first.split()]
    words = []
    for line in rest:
        words += line.split()
        if len(words) >= int(np.prod(shape)):
            break
    values = np.array([number(w) for w in words[: int(np.prod(shape))]])
    if len(values) != int(np.prod(shape)):
        raise FormatError("The number of samples does not match")
    return frame, values.reshape(shape, order="F") / (frame.cell.volume if charge else 1.0)


#: Detection by what a header looks like, in order; the name of the file decides what is left.
_SIGNS: tuple[tuple[str, Callable[[list[str], str], bool]], ...] = (
    ("cfg", lambda lines, text: text.lstrip().startswith("Number of particles")),
    ("dump", lambda lines, text: lines[0].startswith("ITEM:")),
    ("cif", lambda lines, text: re.search(r"^data_", text, re.MULTILINE) is not None),
    ("data", lambda lines, text: re.search(r"^\s*\S+\s+\S+\s+xlo\s+xhi", text, re.MULTILINE) is not None),
    ("cube", lambda lines, text: len(lines) > 5 and all(re.fullmatch(r"\s*-?\d+(\s+[-+.\dEe]+){3,4}\s*", line) for line in lines[2:6])),
    ("poscar", lambda lines, text: len(lines) > 6 and all(re.fullmatch(r"\s*([-+.\dEeDd]+\s*){1,3}", lines[k]) for k in (1, 2, 3, 4))),
    ("xyz", lambda lines, text: lines[0].strip().isdigit()),
    ("pdb", lambda lines, text: re.match(r"(HEADER|TITLE|CRYST1|MODEL|ATOM|HETATM|REMARK)", lines[0]) is not None),
)


def detect(head: str, name: str = "") -> str:
    """The format of a file by its beginning, else by its name."""
    lines = head.splitlines() or [""]
    for kind, looks in _SIGNS:
        if looks(lines, head):
            return kind
    for kind, hint in (("cfg", ".cfg"), ("dump", ".dump"), ("cif", ".cif"), ("data", ".data"), ("cube", ".cube"), ("poscar", "POSCAR"), ("xyz", ".xyz"), ("pdb", ".pdb")):
        if hint.lower() in name.lower():
            return kind
    raise FormatError(f"Unknown format of {name or 'the file'}")


#: From a file's text to its frames.
PARSERS: dict[str, Callable[[str], list[Frame]]] = {
    "cfg": lambda t: [cfg_frame(t)], "dump": lambda t: [dump_frame(t)], "xyz": xyz_frames, "pdb": pdb_frames, "poscar": lambda t: [poscar_frame(t)], "data": lambda t: [data_frame(t)], "cif": lambda t: [cif_frame(t)],
    "cube": lambda t: [cube_frame(t)[0]],
}
