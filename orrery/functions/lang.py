"""The embedded language's expressions: reader, and compiler of the expressible forms to columns.

Compiled: arithmetic, comparison, logic, if/let/begin, lambda in map/filter/reduce, quoted lists, lists, dicts, strings,
math, JSON, hashes, user functions by defun (expanded where they are used) and templates by defmacro. Loops, exceptions,
classes, generators and processes have no column form: generators are table functions (see ``collect_generator``), folds
are ``reduce``. Integer division of two integers gives a double, % takes the sign of the dividend; nil and false are one
value in conditions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalar as X

TOKEN = re.compile(r"""\s*(?:;[^\n]*\s*)*(?:(?P<open>[(\[])|(?P<close>[)\]])|(?P<quote>')|(?P<string>"(?:[^"\\]|\\.)*")|(?P<atom>[^\s()\[\]'";]+)|(?P<end>$))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "0": "\0"}


class Symbol(str):
    """A name in source text."""


def read_all(text: str) -> list:
    """Forms of a source text: nested lists, symbols, numbers, strings, booleans and nil."""
    stack: list[list] = [[]]
    marks: list[int] = []
    at = 0
    quoted: list[int] = []

    def put(v):
        while quoted and quoted[-1] == len(stack):
            quoted.pop()
            v = [Symbol("quote"), v]
        stack[-1].append(v)

    while True:
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unreadable at {at}")
        at = m.end()
        if m["open"]:
            stack.append([])
            marks.append(m.start("open"))
        elif m["close"]:
            if len(stack) == 1:
                raise SyntaxError(f"unmatched ) at {m.start('close')}")
            done = stack.pop()
            marks.pop()
            put(done)
        elif m["quote"]:
            quoted.append(len(stack))
        elif m["string"] is not None:
            put(re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m["string"][1:-1]))
        elif m["atom"]:
            put(atom(m["atom"]))
        else:
            if len(stack) > 1:
                raise SyntaxError(f"( at {marks[-1]} is never closed")
            return stack[0]


def atom(s: str):
    if s in ("#t", "true"):
        return True
    if s in ("#f", "false"):
        return False
    if s == "nil":
        return None
    t = s.replace("_", "") if re.match(r"[+-]?\d", s) else s
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    if m := re.fullmatch(r"([+-]?)0([xob])([0-9a-fA-F]+)", t):
        return int(m[1] + m[3], {"x": 16, "o": 8, "b": 2}[m[2]])
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", t):
        return float(t)
    if t in ("+inf.0", "-inf.0", "+nan.0"):
        return float(t[:4])
    return Symbol(s)


def truth(c: Column) -> Column:
    """nil and false are false; everything else is true."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def fold(op: Callable[[Column, Column], Column]):
    def f(*args: Column) -> Column:
        out = args[0]
        for a in args[1:]:
            out = op(out, a)
        return out

    return f


def chain(op: Callable[[Column, Column], Column]):
    def f(*args: Column) -> Column:
        out = F.lit(True)
        for a, b in zip(args, args[1:]):
            out = out & op(a, b)
        return out

    return f


def dict_of(*args: Column) -> Column:
    return F.create_map(*args)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "+": fold(lambda a, b: a + b), "-": lambda *a: -a[0] if len(a) == 1 else fold(lambda x, y: x - y)(*a), "*": fold(lambda a, b: a * b), "/": fold(lambda a, b: a / b), "%": lambda a, b: a % b,
    "<": chain(lambda a, b: a < b), ">": chain(lambda a, b: a > b), "<=": chain(lambda a, b: a <= b), ">=": chain(lambda a, b: a >= b), "=": chain(lambda a, b: a.eqNullSafe(b)), "!=": lambda a, b: ~a.eqNullSafe(b),
    "not": lambda a: ~truth(a), "null?": lambda a: a.isNull(), "type-of": F.typeof,
    "math.floor": F.floor, "math.ceil": F.ceil, "math.abs": F.abs, "math.sqrt": F.sqrt, "math.sin": F.sin, "math.cos": F.cos, "math.max": F.greatest, "math.min": F.least, "math.pow": F.pow, "math.exp": F.exp, "math.log": F.log, "math.pi": lambda: F.lit(3.141592653589793), "math.random": lambda seed=None: F.rand(0),
    "string.length": F.char_length, "string.byte-length": F.octet_length, "string.upper": F.upper, "string.lower": F.lower, "string.trim": F.trim, "string.split": X.split, "string.join": lambda xs, sep: F.array_join(xs, sep) if isinstance(sep, str) else F.call_function("array_join", xs, sep),
    "string.replace": F.replace, "string.substring": X.substring, "string.char-at": X.char_at, "string.contains": F.contains, "string.starts-with": F.startswith, "string.ends-with": F.endswith, "string.encode": lambda s: F.encode(s, "UTF-8"),
    "bytes.length": F.octet_length, "bytes.slice": X.bytes_slice, "bytes.concat": F.concat, "bytes.decode": lambda b: F.decode(b, "UTF-8"), "bytes.byte-at": X.byte_at,
    "collections.range": X.range_, "collections.sort": F.sort_array, "collections.reverse": F.reverse, "collections.unique": F.array_distinct, "collections.zip": X.zip_, "collections.flatten": F.flatten,
    "collections.dict-keys": F.map_keys, "collections.dict-values": F.map_values, "collections.dict-merge": X.dict_merge,
    "list": F.array, "car": lambda xs: F.try_element_at(xs, F.lit(1)), "cdr": lambda xs: F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), "cons": lambda x, xs: F.concat(F.array(x), xs), "nth": lambda xs, i: F.get(xs, i), "set-nth": X.set_nth,
    "length": F.size, "append": F.concat, "slice": lambda xs, a, b: F.slice(xs, a + 1, F.greatest(b - a, F.lit(0))), "del-nth": X.del_nth,
    "dict": dict_of, "get-attr": lambda d, k: F.try_element_at(d, k), "set-attr": lambda d, k, v: X.dict_merge(d, F.create_map(k, v)), "del-attr": X.del_attr,
    "str": lambda *a: F.concat(*(x.cast("string") for x in a)), "str-concat": F.concat, "url-encode": X.url_encode, "url-decode": X.url_decode,
    "json-parse": F.parse_json, "json-encode": F.to_json, "sha256": X.sha256, "sha256-hex": lambda s: F.sha2(s.cast("binary"), 256), "parse-number": X.parse_number,
}


class Compiler:
    """Forms to columns. Free names are columns of the table; functions can be added with :meth:`register`."""

    def __init__(self):
        self.functions, self.defined, self.macros = dict(FUNCTIONS), {}, {}

    def register(self, name: str, f: Callable[..., Column]) -> None:
        """A host function from columns to a column, pandas UDFs included."""
        self.functions[name] = f

    def compile(self, text: str) -> Column:
        """Column of the last form; definitions before it are remembered."""
        out = None
        for form in read_all(text):
            out = self.column(form, {})
        if out is None:
            raise SyntaxError("no expression")
        return out

    def column(self, form, env: dict[str, Column]) -> Column | None:
        if isinstance(form, Symbol):
            return env[form] if form in env else F.col(form)
        if not isinstance(form, list):
            return F.lit(form)
        if not form:
            return F.lit(None)
        head, *args = form
        c = lambda x: self.column(x, env)
        match head:
            case "quote":
                return self.quoted(args[0])
            case "if":
                out = F.when(truth(c(args[0])), c(args[1]))
                return out.otherwise(c(args[2])) if len(args) > 2 else out
            case "and":
                return fold(lambda a, b: F.when(truth(a), b).otherwise(a))(*map(c, args)) if args else F.lit(True)
            case "or":
                return fold(lambda a, b: F.when(truth(a), a).otherwise(b))(*map(c, args)) if args else F.lit(False)
            case "begin":
                out = None
                for a in args:
                    out = c(a)
                return out
            case "let":
                inner = dict(env)
                for name, value in args[0]:
                    inner[name] = self.column(value, inner)
                out = None
                for a in args[1:]:
                    out = self.column(a, inner)
                return out
            case "defun":
                self.defined[args[0]] = (args[1], args[2:])
                return None
            case "defmacro":
                self.macros[args[0]] = (args[1], args[2])
                return None
            case "collections.map":
                return F.transform(c(args[1]), self.function(args[0], env, 1))
            case "collections.filter":
                f = self.function(args[0], env, 1)
                return F.filter(c(args[1]), lambda x: truth(f(x)))
            case "collections.reduce":
                return F.aggregate(c(args[2]), c(args[1]), self.function(args[0], env, 2))
        if isinstance(head, list) and head and head[0] == "lambda":
            return self.called((head[1], head[2:]), [c(a) for a in args], env)
        if head in self.macros:
            names, body = self.macros[head]
            return self.column(replaced(body, dict(zip(names, args))), env)
        if head in self.defined:
            return self.called(self.defined[head], [c(a) for a in args], env)
        if head in self.functions:
            return self.functions[head](*map(c, args))
        raise NameError(f"{head} has no column form")

    def called(self, function, values: list[Column], env) -> Column:
        names, body = function
        if len(names) != len(values):
            raise TypeError("wrong number of arguments")
        out = None
        for form in body:
            out = self.column(form, env | dict(zip(names, values)))
        return out

    def function(self, form, env, n: int) -> Callable[..., Column]:
        if isinstance(form, list) and form and form[0] == "lambda":
            made = form[1], form[2:]
        elif form in self.defined:
            made = self.defined[form]
        else:
            return (lambda a: self.functions[form](a)) if n == 1 else (lambda a, b: self.functions[form](a, b))
        return (lambda a: self.called(made, [a], env)) if n == 1 else (lambda a, b: self.called(made, [a, b], env))

    def quoted(self, form) -> Column:
        return F.array(*(self.quoted(x) for x in form)) if isinstance(form, list) else F.lit(str(form) if isinstance(form, Symbol) else form)


def replaced(form, by: dict):
    if isinstance(form, Symbol):
        return by.get(form, form)
    return [replaced(x, by) for x in form] if isinstance(form, list) else form


def evaluate(df: DataFrame, **programs: str) -> DataFrame:
    """The table with a column for each program."""
    return df.withColumns({name: Compiler().compile(text) for name, text in programs.items()})


def collect_generator(df: DataFrame, generate: Callable, schema: str, *cols: str) -> DataFrame:
    """Rows yielded by a Python generator for each row: a table function."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def rows(frames):
        for f in frames:
            yield pd.DataFrame([r for values in f.itertuples(index=False) for r in generate(*values)], columns=names)

    return df.select(*cols).mapInPandas(rows, schema)
