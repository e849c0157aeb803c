"""The per-atom expression language, compiled to Spark columns.

Text is parsed into a small tree within fixed limits, names are resolved against a frame's columns,
and the tree becomes one column that Catalyst plans like any other: nothing is evaluated here and no
host code ever runs.  The result is a double; truth is 1.0 and 0.0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions import ieee

#: Fixed limits of the language: characters, nested levels, operations in a chain.
MOST_CHARACTERS, MOST_NESTING, MOST_CHAIN = 4096, 64, 256

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_.]*(?:\[\d+\])*)
    |(?P<column>`[^`]*`)|(?P<text>"[^"]*"|'[^']*')|(?P<op>\|\||&&|==|!=|<=|>=|[-+*/%^<>!?:(),])""",
    re.VERBOSE,
)

_ONE = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": ieee.logarithm, "log10": lambda x: ieee.logarithm(x, 10), "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "floor": ieee.floor, "ceil": ieee.ceil, "round": ieee.round_half_away, "isnan": lambda x: ieee.truth(F.isnan(x)),
}
_TWO = {"atan2": F.atan2, "pow": ieee.power}
_MANY = {"min": ieee.lesser, "max": ieee.greater}
FUNCTIONS = sorted([*_ONE, *_TWO, *_MANY])
CONSTANTS = {"pi": math.pi, "inf": math.inf}
#: Built-in names, in lower case, and the frame columns they stand for.
BUILT_IN = {
    "position.x": "x", "position.y": "y", "position.z": "z", "reducedposition.x": "sa", "reducedposition.y": "sb", "reducedposition.z": "sc",
    "type": "type_number", "particletype": "type_number", "id": "atom_num", "particleidentifier": "atom_num", "index": "row_idx", "particleindex": "row_idx",
    "velocity.x": "vx", "velocity.y": "vy", "velocity.z": "vz", "n": "atom_count", "cellvolume": "cell_volume", "celllength.a": "cell_a", "celllength.b": "cell_b", "celllength.c": "cell_c",
    "timestep": "timestep", "frame": "frame_index",
}
ALIASES = {"csp": "centralSymmetry", "centrosymmetry": "centralSymmetry"}
TYPE_NAMES = ("type", "particletype")


class ExpressionError(ValueError):
    """A fault in an expression, with its place: position, line and column (both from 1), length."""

    def __init__(self, message: str, text: str, position: int, length: int = 1):
        self.position, self.length = position, length
        self.line = text.count("\n", 0, position) + 1
        self.column = position - (text.rfind("\n", 0, position) + 1) + 1
        place = f"line {self.line}, column {self.column}" if "\n" in text else f"column {self.column}"
        super().__init__(f"{message} ({place})")


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    position: int
    length: int


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    parts: tuple["Node", ...] = ()
    position: int = 0


def tokenize(text: str) -> list[Token]:
    if len(text) > MOST_CHARACTERS:
        raise ExpressionError(f"An expression has at most {MOST_CHARACTERS} characters", text, MOST_CHARACTERS)
    found, at = [], 0
    while at < len(text):
        match = _TOKEN.match(text, at)
        if match is None:
            what = "Quoted name or text without end" if text[at] in "`\"'" else f"Unexpected character {text[at]!r}"
            raise ExpressionError(what, text, at)
        kind, raw = match.lastgroup, match.group()
        if kind == "number":
            if re.match(r"[A-Za-z0-9_.]", text[match.end() : match.end() + 1]):
                raise ExpressionError("Malformed number", text, at, len(raw))
            found.append(Token("number", float(raw), at, len(raw)))
        elif kind in ("column", "text"):
            found.append(Token(kind, raw[1:-1], at, len(raw)))
        elif kind != "space":
            found.append(Token(kind, raw, at, len(raw)))
        at = match.end()
    return [*found, Token("end", "", len(text), 0)]


#: Binary operators from the loosest; the last two levels of comparison do not chain.
_LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))
_UNCHAINED = {"==", "!=", "<", "<=", ">", ">="}


@dataclass
class _Parser:
    text: str
    tokens: list[Token] = field(init=False)
    at: int = 0
    depth: int = 0

    def __post_init__(self):
        self.tokens = tokenize(self.text)

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str, token: Token | None = None) -> ExpressionError:
        token = token or self.now
        return ExpressionError(message, self.text, token.position, max(1, token.length))

    def taken(self, *values: str) -> Token | None:
        if self.now.kind == "op" and self.now.value in values:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def expect(self, value: str) -> None:
        if not self.taken(value):
            raise self.fail(f"Expected {value!r}")

    def nested(self, parse) -> Node:
        self.depth += 1
        if self.depth > MOST_NESTING:
            raise self.fail(f"More than {MOST_NESTING} nested levels")
        node = parse()
        self.depth -= 1
        return node

    def conditional(self) -> Node:
        condition = self.binary(0)
        mark = self.taken("?")
        if not mark:
            return condition
        yes = self.nested(self.conditional)
        self.expect(":")
        return Node("if", None, (condition, yes, self.nested(self.conditional)), mark.position)

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left, count = self.binary(level + 1), 0
        while op := self.taken(*_LEVELS[level]):
            count += 1
            if op.value in _UNCHAINED and count > 1:
                raise self.fail("Comparisons cannot be chained; join them with &&", op)
            if count > MOST_CHAIN:
                raise self.fail(f"More than {MOST_CHAIN} operations in a chain", op)
            left = Node("binary", op.value, (left, self.binary(level + 1)), op.position)
        return left

    def unary(self) -> Node:
        if op := self.taken("+", "-", "!"):
            return Node("unary", op.value, (self.nested(self.unary),), op.position)
        return self.power()

    def power(self) -> Node:
        base = self.primary()
        if op := self.taken("^"):
            return Node("binary", "^", (base, self.nested(self.unary)), op.position)
        return base

    def primary(self) -> Node:
        token = self.now
        self.at += 1
        if token.kind == "number":
            return Node("number", token.value, (), token.position)
        if token.kind in ("column", "text"):
            return Node(token.kind, token.value, (), token.position)
        if token.kind == "name":
            return self.call(token) if self.taken("(") else Node("name", token.value, (), token.position)
        if token.kind == "op" and token.value == "(":
            inside = self.nested(self.conditional)
            self.expect(")")
            return inside
        self.at -= 1
        raise self.fail("Unexpected end of expression" if token.kind == "end" else f"Unexpected {token.value!r}", token)

    def call(self, token: Token) -> Node:
        name = token.value.lower()
        if name not in FUNCTIONS:
            raise self.fail(f"Unknown function {token.value}" + suggestion(token.value, FUNCTIONS), token)
        parts = [self.nested(self.conditional)] if not self.taken(")") else []
        while parts and not self.taken(")"):
            self.expect(",")
            parts.append(self.nested(self.conditional))
            if len(parts) > MOST_CHAIN:
                raise self.fail(f"More than {MOST_CHAIN} arguments", token)
        want = "one argument" if name in _ONE else "two arguments" if name in _TWO else "two or more arguments"
        if len(parts) < (1 if name in _ONE else 2) or name not in _MANY and len(parts) > (1 if name in _ONE else 2):
            raise self.fail(f"{name} takes {want}, not {len(parts)}", token)
        return Node("call", name, tuple(parts), token.position)


def parse(text: str) -> Node:
    parser = _Parser(text)
    if parser.now.kind == "end":
        raise parser.fail("Empty expression")
    node = parser.conditional()
    if parser.now.kind != "end":
        raise parser.fail(f"Unexpected {parser.now.value!r}")
    return node


def edits(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours counting as one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def suggestion(name: str, known: list[str]) -> str:
    near = sorted((edits(name.lower(), k.lower()), k) for k in known)
    near = [k for n, k in near if n <= max(1, len(name) // 3)][:3]
    return f"; did you mean {' or '.join(near)}?" if near else ""


@dataclass
class Scope:
    """The names of a frame: numeric columns, type labels, and which columns carry built-in variables."""

    columns: list[str]
    type_labels: list[str] = field(default_factory=list)
    strict_types: bool = False
    built_in: dict[str, str] = field(default_factory=lambda: dict(BUILT_IN))

    def column(self, name: str, text: str, position: int) -> Column:
        if name in self.columns:
            return _double(name)
        folded = [c for c in self.columns if c.lower() == name.lower()]
        if len(folded) > 1:
            raise ExpressionError(f"{name} is ambiguous: {', '.join(folded)}", text, position, len(name))
        if folded:
            return _double(folded[0])
        alias = ALIASES.get(name.lower())
        if alias and alias in self.columns:
            return _double(alias)
        known = [*self.columns, *self.built_in, *CONSTANTS]
        raise ExpressionError(f"Unknown variable {name}" + suggestion(name, known), text, position, len(name))

    def variable(self, name: str, text: str, position: int) -> Column:
        folded = name.lower()
        if folded in CONSTANTS:
            return ieee.number(CONSTANTS[folded])
        if folded == "velocity.magnitude" and all(c in self.columns for c in ("vx", "vy", "vz")):
            return F.hypot(F.hypot(_double("vx"), _double("vy")), _double("vz"))
        if folded in self.built_in and self.built_in[folded] in self.columns:
            return F.coalesce(_double(self.built_in[folded]), ieee.nan())
        return self.column(name, text, position)

    def label(self, wanted: str, text: str, position: int) -> str | None:
        if wanted in self.type_labels:
            return wanted
        folded = [t for t in self.type_labels if t.lower() == wanted.lower()]
        if len(folded) == 1:
            return folded[0]
        if self.strict_types:
            raise ExpressionError(f"Unknown type {wanted}" + suggestion(wanted, self.type_labels), text, position, len(wanted) + 2)
        return None


def _double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def compile_column(text: str, scope: Scope) -> Column:
    """The expression as a double column over frames with the scope's columns."""

    def type_test(node: Node) -> Column | None:
        sides = [n for n in node.parts if n.kind == "text"]
        if not sides:
            return None
        other = [n for n in node.parts if n.kind != "text"]
        if node.value not in ("==", "!=") or len(other) != 1 or other[0].kind != "name" or other[0].value.lower() not in TYPE_NAMES:
            raise ExpressionError("Quoted text is only compared with Type, by == or !=", text, sides[0].position, len(sides[0].value) + 2)
        label = scope.label(sides[0].value, text, sides[0].position)
        same = F.col("type_label") == label if label is not None else F.lit(False)
        return ieee.truth(same if node.value == "==" else ~same)

    def build(node: Node) -> Column:
        if node.kind == "number":
            return ieee.number(node.value)
        if node.kind == "name":
            return scope.variable(node.value, text, node.position)
        if node.kind == "column":
            return scope.column(node.value, text, node.position)
        if node.kind == "text":
            raise ExpressionError("Quoted text is only compared with Type, by == or !=", text, node.position, len(node.value) + 2)
        if node.kind == "binary" and (tested := type_test(node)) is not None:
            return tested
        parts = [build(p) for p in node.parts]
        if node.kind == "if":
            return F.when(ieee.is_true(parts[0]), parts[1]).otherwise(parts[2])
        if node.kind == "unary":
            return {"+": parts[0], "-": -parts[0], "!": ieee.truth(~ieee.is_true(parts[0]))}[node.value]
        if node.kind == "call":
            if node.value in _ONE:
                return _ONE[node.value](parts[0])
            if node.value in _TWO:
                return _TWO[node.value](*parts)
            found = parts[0]
            for part in parts[1:]:
                found = _MANY[node.value](found, part)
            return found
        a, b = parts
        match node.value:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return ieee.divide(a, b)
            case "%":
                return ieee.remainder(a, b)
            case "^":
                return ieee.power(a, b)
            case "&&":
                return ieee.truth(ieee.is_true(a) & ieee.is_true(b))
            case "||":
                return ieee.truth(ieee.is_true(a) | ieee.is_true(b))
            case op:
                return ieee.compare(op, a, b)

    return build(parse(text))


def references(text: str) -> list[str]:
    """Names that an expression reads, in order and once each."""
    found: dict[str, None] = {}

    def walk(node: Node) -> None:
        if node.kind in ("name", "column"):
            found[node.value] = None
        for part in node.parts:
            walk(part)

    walk(parse(text))
    return list(found)


def scope_of(frame: DataFrame, type_labels: list[str] | None = None, strict_types: bool = False) -> Scope:
    numeric = [n for n, t in frame.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    return Scope(numeric, type_labels or [], strict_types)


#: Names that a computed property cannot take.
RESERVED = {*BUILT_IN, *ALIASES, *CONSTANTS, "velocity.magnitude", "coordination", "atomicvolume"}
MOST_COMPUTED = 64


@dataclass(frozen=True)
class Computed:
    """A computed property: name, expression, unit."""

    name: str
    expression: str
    unit: str = ""


def with_computed(frame: DataFrame, recipe: list[Computed], type_labels: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Adds computed properties in order; each may use those above it.

    Returns the frame and each property's state: ``ready``, ``waiting`` (an input is not there) or
    ``conflict`` (a column has its name).
    """
    if len(recipe) > MOST_COMPUTED:
        raise ValueError(f"At most {MOST_COMPUTED} computed properties")
    states: dict[str, str] = {}
    own = [c.name.lower() for c in recipe]
    for k, item in enumerate(recipe):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", item.name) or item.name.lower() in RESERVED or own.index(item.name.lower()) != k:
            raise ValueError(f"{item.name} cannot name a computed property")
        later = set(own[k:])
        if any(r.lower() in later for r in references(item.expression)):
            raise ValueError(f"{item.name} uses itself or a later property")
        if any(c.lower() == item.name.lower() for c in frame.columns):
            states[item.name] = "conflict"
            continue
        try:
            column = compile_column(item.expression, scope_of(frame, type_labels))
        except ExpressionError as fault:
            if not str(fault).startswith("Unknown variable"):
                raise
            states[item.name] = "waiting"
            continue
        frame = frame.withColumn(item.name, column) if not item.unit else frame.withColumn(item.name, column).withMetadata(item.name, {"unit": item.unit})
        states[item.name] = "ready"
    return frame, states


def select_where(frame: DataFrame, condition: str, type_labels: list[str] | None = None) -> DataFrame:
    """The rows for which ``condition`` is nonzero and not NaN."""
    return frame.where(ieee.is_true(compile_column(condition, scope_of(frame, type_labels))))
