"""Array expressions, compiled from a safe part of Python's syntax to columns; nothing is ever executed as Python."""

from __future__ import annotations

import ast
import math
import re
import warnings
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.model import Dataset, Var, idx
from gridspark.operators.combine import OPERATORS
from gridspark.safe import log, masked_invalid

_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
CALLS = {
    "abs": F.abs, "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "exp": F.exp, "log": log, "log10": lambda c: F.when(c > 0, F.log10(c)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arctan": F.atan, "arctan2": F.atan2, "radians": F.radians, "degrees": F.degrees,
    "minimum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "maximum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "where": lambda c, a, b: F.when(c, a).otherwise(b), "power": OPERATORS["**"], "floor": F.floor, "ceil": F.ceil, "round": F.rint,
    "masked_less": lambda c, v: F.when(c >= v, c), "masked_greater": lambda c, v: F.when(c <= v, c), "masked_where": lambda cond, c: F.when(~cond, c), "masked_invalid": masked_invalid,
}
#: A side of at most this many cells, known from the lengths of its dimensions, is broadcast.
BROADCAST_CELLS = 100_000
CONSTANTS = {"pi": math.pi, "e": math.e, "c": 299_792_458.0, "g": 9.80665, "R": 8.314462618, "N_A": 6.02214076e23, "k": 1.380649e-23}


class _Compiler(ast.NodeVisitor):
    def __init__(self, names: set[str], attrs: dict, calls: dict | None = None):
        self.names, self.attrs, self.used, self.calls = names, attrs, [], CALLS if calls is None else calls

    def generic_visit(self, node: ast.AST):
        raise ValueError(f"not allowed in an expression: {type(node).__name__}")

    def _col(self, x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    def visit_Constant(self, node: ast.Constant):
        if not isinstance(node.value, (int, float, bool, str)):
            raise ValueError("not allowed in an expression: this constant")
        return node.value

    def visit_Name(self, node: ast.Name):
        if node.id in self.names:
            if node.id not in self.used:
                self.used.append(node.id)
            return F.col(node.id)
        if node.id in self.attrs:
            return self.attrs[node.id]
        if node.id in CONSTANTS:
            return CONSTANTS[node.id]
        raise ValueError(f"unknown name: {node.id}")

    def visit_Attribute(self, node: ast.Attribute):
        if isinstance(node.value, ast.Name) and node.value.id in ("np", "numpy") and node.attr in ("pi", "e"):
            return CONSTANTS[node.attr]
        return self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript):
        """X[:] is X; other subscripts are slices of the dataset."""
        parts = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        if all(isinstance(p, ast.Slice) and p.lower is p.upper is p.step is None for p in parts):
            return self.visit(node.value)
        raise ValueError("slice the dataset before the expression")

    def visit_BinOp(self, node: ast.BinOp):
        a, b = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            return a & b if isinstance(node.op, ast.BitAnd) else a | b
        if type(node.op) not in _BINARY:
            return self.generic_visit(node)
        return OPERATORS[_BINARY[type(node.op)]](self._col(a), self._col(b))

    def visit_UnaryOp(self, node: ast.UnaryOp):
        x = self.visit(node.operand)
        if isinstance(node.op, ast.USub):
            return -x
        if isinstance(node.op, ast.UAdd):
            return x
        return ~x

    def visit_BoolOp(self, node: ast.BoolOp):
        out = self._col(self.visit(node.values[0]))
        for v in node.values[1:]:
            x = self._col(self.visit(v))
            out = out & x if isinstance(node.op, ast.And) else out | x
        return out

    def visit_Compare(self, node: ast.Compare):
        left, out = self._col(self.visit(node.left)), None
        for op, right in zip(node.ops, node.comparators, strict=True):
            r = self._col(self.visit(right))
            one = OPERATORS[_COMPARE[type(op)]](left, r)
            out, left = one if out is None else out & one, r
        return out

    def visit_IfExp(self, node: ast.IfExp):
        return F.when(self.visit(node.test), self._col(self.visit(node.body))).otherwise(self._col(self.visit(node.orelse)))

    def visit_Call(self, node: ast.Call):
        f, name = node.func, None
        if isinstance(f, ast.Name):
            name = f.id
        elif isinstance(f, ast.Attribute):
            base = f.value
            while isinstance(base, ast.Attribute):
                base = base.value
            if isinstance(base, ast.Name) and base.id in ("np", "numpy", "ma"):
                name = f.attr
        if name not in self.calls or node.keywords:
            raise ValueError(f"unknown function: {name}")
        return self.calls[name](*[self._col(self.visit(a)) for a in node.args])


def evaluate(ds: Dataset, program: str, copy_all: bool = False, constants: dict[str, float] | None = None, functions: dict[str, Callable[..., Column]] | None = None) -> Dataset:
    """Assignments, one a line or after ';': each assigned name becomes a variable.

    It takes its dimensions and attributes from the first variable that it uses, and
    variables with fewer dimensions are spread along the others.  A name whose value
    uses no variable is a constant for the lines after it.  ``constants`` and
    ``functions`` (of columns) are known by their names too; attributes come before
    constants.  Unless ``copy_all``, only assigned variables and coordinates stay.
    """
    from gridspark.operators.select import subset

    out, made, known, calls = ds, [], dict(constants or {}), {**CALLS, **(functions or {})}
    for st in ast.parse(program.strip()).body:
        if not isinstance(st, ast.Assign) or len(st.targets) != 1 or not isinstance(st.targets[0], ast.Name):
            raise ValueError("only assignments to one name")
        name = st.targets[0].id
        c = _Compiler(set(out.vars), {**known, **out.attrs}, calls)
        value = c.visit(st.value)
        if not c.used:
            known[name] = value
            continue
        keys = list(dict.fromkeys(out.vars[v].dims for v in c.used))
        key = max(keys, key=len)
        df = out.frames[key]
        for k in keys:
            if k != key:
                if not set(k) <= set(key):
                    raise ValueError(f"dimensions {k} and {key} don't fit")
                side = out.frames[k].select(*[idx(d) for d in k], *[v for v in c.used if out.vars[v].dims == k])
                df = df.join(F.broadcast(side) if math.prod(out.dims[d] for d in k) <= BROADCAST_CELLS else side, [idx(d) for d in k]) if k else df.crossJoin(F.broadcast(side))
        value = value if isinstance(value, Column) else F.lit(value)
        df = df.withColumn(name, value).select(*out.index(key), *dict.fromkeys([*out.names(key), name]))
        first = out.vars[c.used[0]]
        out = replace(out, frames={**out.frames, key: df}, vars={**out.vars, name: Var(key, {**first.attrs, "expression": ast.unparse(st.value)})})
        made.append(name)
    if not made:
        raise ValueError("no line uses a variable")
    return out if copy_all else subset(out, made)


def pick(ds: Dataset, keys: list[str]) -> Dataset:
    """Variables by name, and what expressions among the keys make (named by the key, with _ for all but letters and digits).

    Keys that are neither are left out with a warning.
    """
    from gridspark.operators.select import subset

    out, kept = ds, []
    for key in keys:
        name = key
        if key not in ds.vars:
            name = re.sub(r"\W", "_", key.strip())
            name = f"_{name}" if name[:1].isdigit() else name
            try:
                if name == key.strip():
                    raise ValueError(f"no such variable: {key}")
                out = evaluate(out, f"{name} = {key}", copy_all=True)
            except (ValueError, SyntaxError) as e:
                warnings.warn(str(e), stacklevel=2)
                continue
        kept.append(name)
    return subset(out, kept)


def condition(ds: Dataset, text: str, key: tuple[str, ...]) -> Column | None:
    """A condition over the variables of one group, or None if the group lacks one of them."""
    c = _Compiler(set(ds.vars), ds.attrs)
    value = c.visit(ast.parse(text.strip(), mode="eval").body)
    return value if all(ds.vars[v].dims == key for v in c.used) else None
