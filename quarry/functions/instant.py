"""Scalar evaluators: calculator, base conversion, urls, templates, sizes, times, flags."""

from __future__ import annotations

import math
import re
import shlex
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.sources import catalog as C

_TOKEN = re.compile(r"\s*(?:(0x[0-9a-fA-F]+)|(0b[01]+)|(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_π]\w*)|(.))")
#: Functions with their least and largest number of arguments; of more than two, min and max read two.
ARITY = {"sin": (1, 1), "cos": (1, 1), "tan": (1, 1), "asin": (1, 1), "acos": (1, 1), "atan": (1, 1), "sqrt": (1, 1), "cbrt": (1, 1), "abs": (1, 1), "ln": (1, 1), "log": (1, 2), "log2": (1, 1), "log10": (1, 1), "exp": (1, 1), "floor": (1, 1), "ceil": (1, 1), "round": (1, 2), "min": (2, 99), "max": (2, 99)}


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple[Any, ...]


class CalcError(ValueError):
    """The text is no expression, or has no result."""


def parse(text: str) -> Node:
    """'+ - * / % ^ ()', '^' to the right, unary minus before '^'; numbers in decimal, 0x and 0b."""
    tokens = [next((k, v) for k, v in zip(("hex", "bin", "num", "name", "op"), m.groups()) if v) for m in _TOKEN.finditer(text.strip())]
    at = 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) else None

    def take(*wanted: str) -> str | None:
        nonlocal at
        if peek() in wanted and tokens[at][0] == "op":
            at += 1
            return tokens[at - 1][1]
        return None

    def chain(ops: tuple[str, ...], below: Callable[[], Node]) -> Node:
        left = below()
        while op := take(*ops):
            left = Node(op, (left, below()))
        return left

    def power() -> Node:
        left = unary()
        return Node("^", (left, power())) if take("^") else left

    def unary() -> Node:
        if take("-"):
            return Node("neg", (unary(),))
        return unary() if take("+") else atom()

    def atom() -> Node:
        nonlocal at
        if take("("):
            inner = total()
            if not take(")"):
                raise CalcError("parenthesis isn't closed")
            return inner
        if at >= len(tokens):
            raise CalcError("ends too soon")
        kind, value = tokens[at]
        at += 1
        if kind in ("hex", "bin"):
            return Node("num", (float(int(value, 0)),))
        if kind == "num":
            return Node("num", (float(value),))
        if kind != "name":
            raise CalcError(f"{value!r} is no operand")
        if not take("("):
            return Node("name", (value,))
        args = [total()]
        while take(","):
            args.append(total())
        low, high = ARITY.get(value, (1, 0))
        if not take(")") or not low <= len(args) <= high:
            raise CalcError(f"{value} can't be called so")
        return Node("call", (value, *args))

    def total() -> Node:
        return chain(("+", "-"), lambda: chain(("*", "/", "%"), power))

    tree = total()
    if at != len(tokens):
        raise CalcError(f"{peek()!r} is left over")
    return tree


_PY: dict[str, Callable[..., float]] = {"ln": math.log, "log": lambda x, b=10.0: math.log(x, b) if b != 10.0 else math.log10(x), "ceil": math.ceil, "floor": math.floor, "round": lambda x, n=0.0: round(x, int(n)), "min": lambda a, b, *_: min(a, b), "max": lambda a, b, *_: max(a, b), "abs": abs}


def evaluate(text: str) -> float | None:
    """The value, or None if there is none (division by zero, not finite, no expression)."""

    def value(n: Node) -> float:
        if n.op == "num":
            return n.args[0]
        if n.op == "name":
            if n.args[0] not in ("pi", "π", "e"):
                raise CalcError(n.args[0])
            return math.e if n.args[0] == "e" else math.pi
        if n.op == "call":
            f = _PY.get(n.args[0]) or getattr(math, n.args[0])
            return float(f(*map(value, n.args[1:])))
        a = value(n.args[0])
        if n.op == "neg":
            return -a
        b = value(n.args[1])
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": lambda: float(a**b)}[n.op]()

    try:
        v = value(parse(text))
        return v if math.isfinite(v) else None
    except (CalcError, ArithmeticError, ValueError, TypeError):
        return None


def to_column(text: str, names: dict[str, Column]) -> Column:
    """The expression over columns, natively; null where there is no result."""
    one = {"ln": F.log, "ceil": F.ceil, "floor": F.floor}

    def build(n: Node) -> Column:
        if n.op == "num":
            return F.lit(n.args[0])
        if n.op == "name":
            return names[n.args[0]] if n.args[0] in names else F.lit(math.e if n.args[0] == "e" else math.pi)
        if n.op == "call":
            f, args = n.args[0], [build(a) for a in n.args[1:]]
            if f == "log":
                return F.log10(args[0]) if len(args) == 1 else F.log(args[0]) / F.log(args[1])
            if f == "round":
                scale = F.pow(F.lit(10.0), args[1]) if len(args) > 1 else F.lit(1.0)
                return F.rint(args[0] * scale) / scale
            if f in ("min", "max"):
                return (F.least if f == "min" else F.greatest)(args[0], args[1])
            return (one.get(f) or getattr(F, f))(args[0]).cast("double")
        args = [build(a) for a in n.args]
        if n.op == "neg":
            return -args[0]
        zero = lambda b: F.when(b == 0, None).otherwise(b)
        return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / zero(b), "%": lambda a, b: a % zero(b), "^": F.pow}[n.op](*args)

    return build(parse(text))


_GATE = re.compile(r"[0-9A-Za-z\s+\-*/%^().,π_]+")


def calculate(text: str) -> str | None:
    """What the launcher shows for an expression: an integer whole, else up to 10 decimals; nothing for a plain number."""
    t = text.strip()
    if not _GATE.fullmatch(t) or not re.search(r"[0-9eπ]|pi", t) or (t.isalpha() and t not in ("pi", "e", "π")):
        return None
    v = evaluate(t)
    if v is None:
        return None
    shown = f"{v:.0f}" if v == math.floor(v) and abs(v) < 1e15 else f"{v:.10f}".rstrip("0").rstrip(".")
    return None if shown == t else shown


def convert_base(text: str) -> str | None:
    """'<0x…|0b…|decimal> to hex|bin|oct|dec'."""
    m = re.fullmatch(r"\s*(0x[0-9a-f]+|0b[01]+|\d+(?:\.\d+)?)\s+to\s+(hex|bin|oct|dec)\s*", text, re.I)
    if not m:
        return None
    number = float(m[1]) if "." in m[1] else int(m[1], 0 if m[1][:2].lower() in ("0x", "0b") else 10)
    if m[2].lower() == "dec":
        return f"{number:g}" if isinstance(number, float) else str(number)
    n = int(number)
    return {"hex": f"0x{n:X}", "bin": f"0b{n:b}", "oct": f"0{n:o}"}[m[2].lower()]


def base_columns(n: Column) -> dict[str, Column]:
    return {"as_hex": F.concat(F.lit("0x"), F.hex(n)), "as_bin": F.concat(F.lit("0b"), F.bin(n)), "as_oct": F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8))}


def is_url(text: Column) -> Column:
    return (F.length(text) >= 8) & text.rlike(r"^(?i)https?://[^/?#\s]+[^\s]*$")


def percent_encoded(term: Column) -> Column:
    return F.replace(F.url_encode(term), F.lit("+"), F.lit("%20"))


def fill_url(template: str, term: str) -> str:
    """'%s', else '{0}', else appended."""
    t = quote(term, safe="")
    for mark in ("%s", "{0}"):
        if mark in template:
            return template.replace(mark, t)
    return template + t


def fill_command(template: str, rest: str) -> str:
    """'%sN' and '{N}' are the N-th argument (missing: empty), '%s' and '{}' all of them."""
    args = shlex.split(rest) if rest.count('"') % 2 == 0 and "'" not in rest else rest.split()
    pick = lambda m: args[int(m[1] or m[2]) - 1] if 0 < int(m[1] or m[2]) <= len(args) else ""
    out = re.sub(r"%s(\d+)|\{(\d+)\}", pick, template)
    return out.replace("%s", rest).replace("{}", rest)


def size_label(size: Column) -> Column:
    """B, KB … TB by 1024 with up to two decimals."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.lit(None).cast("string")
    for i, u in enumerate(units):
        value = size / float(1 << (10 * i))
        text = F.regexp_replace(F.format_string("%.2f", F.rint(value * 100) / 100), r"\.?0+$", "")
        fits = (size >= (1 << (10 * i) if i else 0)) if i == len(units) - 1 else (size >= (1 << (10 * i) if i else 0)) & (size < 1 << (10 * (i + 1)))
        out = F.when(fits, F.concat(text, F.lit(f" {u}"))).otherwise(out)
    return out


def attributes(flags: Column) -> Column:
    """Names of the flags that are set, in order."""
    each = [("directory", C.DIRECTORY), ("hidden", C.HIDDEN), ("system", C.SYSTEM), ("readonly", C.READ_ONLY)]
    return F.concat_ws(",", *(F.when(flags.bitwiseAND(F.lit(b)) != 0, n) for n, b in each))


def age_label(seconds: Column) -> Column:
    """'5s ago', '12m ago', '3h 4m ago', '2d 1h ago'; the second part is left out where it is zero."""
    whole = lambda unit: F.floor((seconds - seconds % unit) / unit).cast("long")
    part = lambda unit, of, name: F.when(whole(unit) % of > 0, F.concat(F.lit(" "), (whole(unit) % of).cast("string"), F.lit(name))).otherwise("")
    text = (
        F.when(seconds < 60, F.concat(seconds.cast("long").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(60).cast("string"), F.lit("m")))
        .when(seconds < 86400, F.concat(whole(3600).cast("string"), F.lit("h"), part(60, 60, "m")))
        .otherwise(F.concat(whole(86400).cast("string"), F.lit("d"), part(3600, 24, "h")))
    )
    return F.concat(text, F.lit(" ago"))


def expand_env(text: Column, values: dict[str, str]) -> Column:
    """%NAME% replaced by its value, case aside; unknown names stay."""
    known = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k.lower(), v))) if values else None
    pieces = F.split(text, "%")

    def add(out: Column, i: Column) -> Column:
        piece = F.element_at(pieces, i + 1)
        value = F.try_element_at(known, F.lower(piece)) if known is not None else F.lit(None).cast("string")
        # state: text so far, and whether the piece stands after an opening '%'
        opened = out["open"] & (i + 1 < F.size(pieces)) & value.isNotNull()
        return F.struct(
            F.when(i == 0, piece).when(opened, F.concat(out["text"], value)).when(out["joined"], F.concat(out["text"], piece)).otherwise(F.concat(out["text"], F.lit("%"), piece)).alias("text"),
            (~opened).alias("open"),
            opened.alias("joined"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("open"), F.lit(False).alias("joined"))
    return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, add)["text"]


def filetime_seconds(filetime: Column) -> Column:
    """100 ns since 1601 to unix seconds, clamped to 32 bits; 0 stays unknown."""
    seconds = F.call_function("div", filetime, F.lit(10_000_000)) - 11_644_473_600
    return F.when(filetime > 0, F.least(F.greatest(seconds, F.lit(0)), F.lit(4294967295))).otherwise(0).cast("long")


def normal_path(path: Column) -> Column:
    """One kind of separator, none at the end."""
    one = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(one.endswith("/"), F.regexp_replace(one, "(?<=.)/+$", "")).otherwise(one)


def path_id(path: Column) -> Column:
    """64-bit id of a path, case and separators aside."""
    return F.xxhash64(F.lower(normal_path(path)))


def calculate_udf():
    """Text -> what calculate() shows, or null; each distinct text of a batch is worked out once."""

    def run(texts: pd.Series) -> pd.Series:
        shown = {t: calculate(t) for t in set(texts) if t is not None}
        return texts.map(lambda t: shown.get(t)).astype(object)

    return F.pandas_udf(run, "string")


def command_udf(template: str):
    """Rest of a query -> the command that a template makes of it."""

    def run(rest: pd.Series) -> pd.Series:
        return rest.map(lambda t: fill_command(template, t) if t is not None else None).astype(object)

    return F.pandas_udf(run, "string")
