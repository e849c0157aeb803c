"""The expression language against a small evaluator of generated trees."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cellframe.functions.expressions import Computed, ExpressionError, compile_column, parse, references, scope_of, select_where, tokenize, with_computed

#: Binding strength of the operators, from the grammar: 1 is the loosest.
LEVEL = {"||": 2, "&&": 3, "==": 4, "!=": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}
COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b and a == a and b == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ROWS = [(0, 2.5, -3.0), (1, -0.75, 4.0), (2, 6.0, 0.0), (3, float("nan"), 1.25)]


def truth(x):
    return x == x and x != 0


def arithmetic(op, a, b):
    if op in COMPARE:
        return float(COMPARE[op](a, b))
    if op == "&&":
        return float(truth(a) and truth(b))
    if op == "||":
        return float(truth(a) or truth(b))
    if op == "/":
        return math.nan if b == 0 and (a == 0 or a != a) else math.copysign(math.inf, a) if b == 0 else a / b
    if op == "%":
        return math.nan if b == 0 or a != a or b != b or math.isinf(a) else math.fmod(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def grown(rng, depth, row):
    """(text, level, value) of a random tree; the text has no more parentheses than its levels ask for."""
    kind = rng.random()
    if depth == 0 or kind < 0.15:
        if rng.random() < 0.4:
            name = rng.choice(["energy", "`odd name`"])
            return name, 10, row[1] if name == "energy" else row[2]
        value = rng.choice([0.5, 1.0, 2.0, 3.0, 12.25])
        return f"{value:g}", 10, value
    inner = lambda least, p: p[0] if p[1] >= least else f"({p[0]})"
    if kind < 0.7:
        op = rng.choice(list(LEVEL))
        a, b = grown(rng, depth - 1, row), grown(rng, depth - 1, row)
        level = LEVEL[op]
        # Comparisons do not chain; the others take their own level on the left.
        left = inner(6 if op in COMPARE else level, a)
        right = inner(6 if op in COMPARE else level + 1, b)
        return f"{left} {op} {right}", level, arithmetic(op, a[2], b[2])
    if kind < 0.78:
        a = grown(rng, depth - 1, row)
        sign = rng.choice("-!")
        return f"{sign}{inner(8, a)}" if a[0][0] not in "-" else f"{sign}({a[0]})", 8, -a[2] if sign == "-" else float(not truth(a[2]))
    if kind < 0.86:
        c, a, b = (grown(rng, depth - 1, row) for _ in range(3))
        return f"{inner(2, c)} ? {inner(2, a)} : {b[0]}", 1, a[2] if truth(c[2]) else b[2]
    a, b = grown(rng, depth - 1, row), grown(rng, depth - 1, row)
    name = rng.choice(["min", "max", "abs", "isnan", "floor", "ceil"])
    if name in ("min", "max"):
        value = math.nan if a[2] != a[2] or b[2] != b[2] else {"min": min, "max": max}[name](a[2], b[2])
        return f"{name}({a[0]}, {b[0]})", 10, value
    one = {"abs": abs, "isnan": lambda x: float(x != x), "floor": lambda x: x if not math.isfinite(x) else float(math.floor(x)), "ceil": lambda x: x if not math.isfinite(x) else float(math.ceil(x))}
    return f"{name}({a[0]})", 10, one[name](a[2])


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(n, float(n + 100), kind, e, o) for (n, e, o), kind in zip(ROWS, ["Cu", "Zr", "Cu", "Al"], strict=True)]
    return spark.createDataFrame(rows, "row_idx long, atom_num double, type_label string, energy double, `odd name` double")


def test_generated_trees(atoms):
    scope, checked = scope_of(atoms), 0
    for seed in range(60):
        wanted, columns = [], []
        for k in range(8):
            texts = [grown(random.Random(f"{seed}/{k}"), 4, row) for row in ROWS]
            assert len({t[0] for t in texts}) == 1
            columns.append(compile_column(texts[0][0], scope).alias(f"v{k}"))
            wanted.append((texts[0][0], [t[2] for t in texts]))
        if seed % 6:
            continue  # compiled only; one batch in six is computed
        rows = atoms.orderBy("row_idx").select(*columns).collect()
        for k, (text, values) in enumerate(wanted):
            for row, value in zip(rows, values, strict=True):
                same = math.isnan(row[k]) if math.isnan(value) else row[k] == pytest.approx(value, rel=1e-12)
                assert same, (text, row[k], value)
                checked += 1
    assert checked == 10 * 8 * len(ROWS)


def test_functions_are_those_of_the_math_library(spark):
    xs = [-7.5, -2.5, -1.0, -0.3, 0.0, 0.4, 1.0, 2.5, 9.0]
    table = spark.createDataFrame([(x,) for x in xs], "u double")
    half_up = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)
    log = lambda x, f: -math.inf if x == 0 else math.nan if x < 0 else f(x)
    inside = lambda f: lambda x: f(x) if abs(x) <= 1 else math.nan
    want = {
        "sin(u)": math.sin, "cos(u)": math.cos, "tan(u)": math.tan, "asin(u)": inside(math.asin), "acos(u)": inside(math.acos), "atan(u)": math.atan, "exp(u)": math.exp,
        "sqrt(u)": lambda x: math.sqrt(x) if x >= 0 else math.nan, "log(u)": lambda x: log(x, math.log), "log10(u)": lambda x: log(x, math.log10), "round(u)": half_up,
        "atan2(u, 2)": lambda x: math.atan2(x, 2), "pow(u, 3)": lambda x: x**3, "u^2": lambda x: x**2, "2^u": lambda x: 2**x, "-u^2": lambda x: -(x**2), "2^u^0": lambda x: 2.0,
        "min(u, 1, -1)": lambda x: min(x, 1, -1), "u * pi": lambda x: x * math.pi, "u < inf": lambda x: 1.0,
    }
    rows = table.select("u", *[compile_column(t, scope_of(table)).alias(f"v{k}") for k, t in enumerate(want)]).collect()
    for row in rows:
        for k, (text, f) in enumerate(want.items()):
            value = f(row["u"])
            assert math.isnan(row[k + 1]) if math.isnan(value) else row[k + 1] == pytest.approx(value, rel=1e-12, abs=1e-300), (text, row["u"])


def test_selection_by_types_ids_and_columns(atoms):
    chosen = lambda text: [r[0] for r in select_where(atoms, text, ["Al", "Cu", "Zr"]).orderBy("row_idx").select("row_idx").collect()]
    assert chosen('ParticleType == "cu"') == [0, 2] and chosen('Type != "Cu" && energy < 0') == [1]
    assert chosen("ID >= 102") == [2, 3] and chosen("Index < 2 || isnan(energy)") == [0, 1, 3]
    assert chosen("`odd name` > energy") == [1] and chosen('Type == "Pt"') == []
    assert references("energy * (`odd name` - Energy)") == ["energy", "odd name", "Energy"]


@pytest.mark.parametrize("text, part", [("energy >= 1 >= 0", "chained"), ("wobble(energy)", "Unknown function"), ("floot(1)", "floor"), ("enrgy + 1", "energy"), ("max(energy, (2)", "Expected"), ("energy *", "end"), ("max(energy)", "two or more"), ('energy + "Cu"', "Quoted"), ("   ", "Empty"), ("energy # 2", "Unexpected character"), ("(" * 90 + "energy" + ")" * 90, "nested"), ("energy" + " - 1" * 400, "chain")])
def test_faults_are_told(atoms, text, part):
    with pytest.raises(ExpressionError, match=part):
        compile_column(text, scope_of(atoms))


def test_faults_have_their_place_and_numbers_their_forms():
    with pytest.raises(ExpressionError) as fault:
        parse("energy\n  * 7 7")
    assert (fault.value.line, fault.value.column) == (2, 7)
    numbers = ["7", "0.125", ".75", "4.", "6e2", "2.5E+1", "8e-3"]
    assert [t.value for t in tokenize(" ".join(numbers))[:-1]] == [float(n) for n in numbers]


def test_computed_columns_wait_for_each_other(atoms):
    recipe = [Computed("twice", "energy * 2", "eV"), Computed("more", "twice + `odd name`"), Computed("never", "absent / 2"), Computed("atom_num", "0")]
    done, states = with_computed(atoms, recipe)
    assert states == {"twice": "ready", "more": "ready", "never": "waiting", "atom_num": "conflict"}
    assert [r.more for r in done.where("energy = energy and row_idx < 3").orderBy("row_idx").collect()] == [2.0, 2.5, 12.0]
    assert done.schema["twice"].metadata["unit"] == "eV" and done.where(F.isnan("more")).count() == 1
    with pytest.raises(ValueError):
        with_computed(atoms, [Computed("left", "right"), Computed("right", "2")])
