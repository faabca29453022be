"""Symbol and import extractors.

Go, imports and the prose extractor are native regex expressions.  Python
symbols need ``ast`` and the C/C++ function pattern overflows the JVM regex
stack on long lines (SURVEY H3), so those two run as Arrow-batched pandas
UDFs.  Every extractor returns ``ARRAY<STRUCT<symbol STRING, kind STRING>>``
in extraction order.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The extraction patterns of the reference (Python ``re``
# syntax; ``(?U)`` is added on the JVM side where Python's Unicode ``\w``/``\s``
# matters).
GO_FUNC = r"func\s+(\w+)\s*\("
GO_TYPE = r"type\s+(\w+)\s+(?:struct|interface)"
GO_METHOD = r"func\s+\([^)]+\)\s+(\w+)\s*\("
PY_DEF_FALLBACK = r"def\s+(\w+)\s*\("
PY_CLASS_FALLBACK = r"class\s+(\w+)\s*[:(]"
CPP_FUNC = r"(?:^|\n)\s*(?:[\w:]+\s+)*(\w+)\s*\([^)]*\)\s*[{;]"
CPP_CLASS = r"class\s+(\w+)(?:\s*:|[^;]*{)"
CPP_STRUCT = r"struct\s+(\w+)(?:\s*:|[^;]*{)"
GO_IMPORT = r'import\s+(?:"([^"]+)"|`([^`]+)`)'
PY_IMPORT = r"(?:^|\n)\s*(?:import|from)\s+(\S+)"
C_INCLUDE = r'#include\s*[<"]([^>"]+)[>"]'
# The test-data "prose" extractor of SURVEY 7.1 (capitalised words).
PROSE_WORD = r"[A-Z][a-z]{3,}"
# ---------------------------------------------------------------------------

SYMBOL_STRUCT = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("kind", T.StringType()),
])
SYMBOL_ARRAY = T.ArrayType(SYMBOL_STRUCT)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _tag(arr: Column, kind: str) -> Column:
    return F.transform(arr, lambda s: F.struct(s.alias("symbol"), F.lit(kind).alias("kind")))


def go_functions(content) -> Column:
    """F1."""
    return F.regexp_extract_all(_c(content), F.lit("(?U)" + GO_FUNC), 1)


def go_types(content) -> Column:
    """F2."""
    return F.regexp_extract_all(_c(content), F.lit("(?U)" + GO_TYPE), 1)


def go_methods(content) -> Column:
    """F3."""
    return F.regexp_extract_all(_c(content), F.lit("(?U)" + GO_METHOD), 1)


def go_symbols(content) -> Column:
    """F1-F3 concatenated (U2): functions, then types, then methods."""
    c = _c(content)
    return F.concat(_tag(go_functions(c), "function"), _tag(go_types(c), "type"),
                    _tag(go_methods(c), "method"))


def prose_symbols(content) -> Column:
    """R8 'prose' extractor used for the documents corpus view."""
    return _tag(F.regexp_extract_all(_c(content), F.lit(PROSE_WORD), 0), "word")


# ----------------------------------------------------------------- Python side

#: What a syntax node declares: (names, kind); other nodes declare nothing.
_DECLARED = {
    ast.FunctionDef: lambda n: ([n.name], "function"),
    ast.ClassDef: lambda n: ([n.name], "class"),
    ast.Assign: lambda n: ([t.id for t in n.targets if isinstance(t, ast.Name)], "variable"),
}
#: Of invalid syntax: all defs, then all classes.
_SPELLED = ((PY_DEF_FALLBACK, "function"), (PY_CLASS_FALLBACK, "class"))
#: Patterns of the languages that have braces: (pattern, kind) in extraction order.
_BRACED = {"go": ((GO_FUNC, "function"), (GO_TYPE, "type"), (GO_METHOD, "method")),
           "cpp": (("(?m)" + CPP_FUNC, "function"), (CPP_CLASS, "class"), (CPP_STRUCT, "struct"))}


class _Places:
    """Line numbers (from 1) of a text's offsets, and the ends of its blocks."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.opened, self.closed, inner = [], {}, []
        for m in re.finditer("[{}]", text):
            if m.group() == "{":
                self.opened.append(m.start())
                inner.append(m.start())
            elif inner:
                self.closed[inner.pop()] = m.start()

    def line(self, offset: int) -> int:
        return bisect_left(self.breaks, offset) + 1

    def block_end(self, offset: int) -> int:
        """The last line of the block that opens first from ``offset`` on."""
        i = bisect_left(self.opened, offset)
        return self.line(self.closed.get(self.opened[i], offset) if i < len(self.opened) else offset)


def python_declarations(text: str) -> list[tuple[str, str, int, int]]:
    """F4/F5 on one text: (name, kind, first line, last line) of declarations in
    breadth-first order, or of what is spelled like one where the syntax is
    invalid (its one line)."""
    try:
        nodes = [n for n in ast.walk(ast.parse(text)) if type(n) in _DECLARED]
        return [(name, kind, n.lineno, n.end_lineno) for n in nodes for names, kind in (_DECLARED[type(n)](n),) for name in names]
    except (SyntaxError, ValueError):
        at = _Places(text)
        found = [(m, kind) for pattern, kind in _SPELLED for m in re.finditer(pattern, text)]
        return [(m.group(1), kind, at.line(m.start(1)), at.line(m.start(1))) for m, kind in found]


def braced_declarations(text: str, language: str) -> list[tuple[str, str, int, int]]:
    """F1-F3, F6, F7 on one text: (name, kind, first line, last line); a
    declaration reaches to the end of its block, a prototype to its semicolon."""
    at = _Places(text)
    out = []
    for pattern, kind in _BRACED[language]:
        for m in re.finditer(pattern, text):
            first, end = at.line(m.start(1)), m.end() - 1
            out.append((m.group(1), kind, first, at.line(end) if text[end] == ";" else max(first, at.block_end(end))))
    return [d for d in out if language == "go" or len(d[0]) > 1 and d[0].isalnum()]


def declarations_of(text: str | None, language: str) -> list[tuple[str, str, int, int]] | None:
    if text is None:
        return None
    return python_declarations(text) if language == "python" else braced_declarations(text, "go" if language == "go" else "cpp")


def python_symbols_of(text: str | None) -> list[dict] | None:
    """F4/F5 without lines."""
    return None if text is None else [{"symbol": d[0], "kind": d[1]} for d in python_declarations(text)]


def cpp_symbols_of(text: str | None) -> list[dict] | None:
    """F6/F7 on one text: functions, classes, structs; alnum names > 1 char."""
    if text is None:
        return None
    found = [(m, kind) for pattern, kind in _BRACED["cpp"] for m in re.findall(pattern, text)]
    return [{"symbol": s, "kind": k} for s, k in found if len(s) > 1 and s.isalnum()]


#: Rows of a batch that stand as Python objects at the same time.
SLICE_ROWS = 32


def by_slices(fn, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``fn`` on each row of the columns.  A batch may hold many thousand whole
    texts: a slice at a time becomes Python objects, and its results go back
    to Arrow before the next one."""
    done = []
    for start in range(0, len(columns[0]), SLICE_ROWS):
        rows = zip(*(c.slice(start, SLICE_ROWS).to_pylist() for c in columns))
        done.append(pa.array([fn(*row) for row in rows], kind))
    return pa.concat_arrays(done) if done else pa.array([], kind)


#: Declarations with their lines.
PLACED = T.ArrayType(T.StructType([T.StructField("symbol", T.StringType()), T.StructField("kind", T.StringType()),
                                   T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType())]))


ARROW_PLACED = pa.list_(pa.struct([("symbol", pa.string()), ("kind", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32())]))


@F.arrow_udf(PLACED)
def declarations_udf(content: pa.Array, language: pa.Array) -> pa.Array:
    """Declarations of each file with their lines; none where the analysis fails."""
    def one(text, language):
        try:
            return [dict(zip(("symbol", "kind", "first_line", "last_line"), d)) for d in declarations_of(text, language) or []]
        except Exception:  # noqa: BLE001 - isolate one bad file
            return None
    return by_slices(one, ARROW_PLACED, content, language)


def python_syntax_of(text: str | None, path: str | None = None) -> dict | None:
    """parse check; the message is the path and what the parser says.  A
    text that the parser gives up on (too complex) is not valid either."""
    if text is None:
        return None
    try:
        ast.parse(text)
        return {"ok": True, "message": None}
    except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
        return {"ok": False, "message": f"{path}: {e}"}


#: Symbols of a file, or why its analysis failed.
CHECKED = T.StructType([T.StructField("symbols", SYMBOL_ARRAY), T.StructField("error", T.StringType())])


ARROW_CHECKED = pa.struct([("symbols", pa.list_(pa.struct([("symbol", pa.string()), ("kind", pa.string())]))), ("error", pa.string())])


def _checked(fn, text: str | None) -> dict:
    """A file whose analysis fails has an error and the batch goes on."""
    try:
        return {"symbols": fn(text), "error": None}
    except Exception as e:  # noqa: BLE001 - isolate one bad file
        return {"symbols": None, "error": f"{type(e).__name__}: {e}"}


def checked_udf(by_language: dict):
    """One Arrow UDF (content, language) -> (symbols, error) that calls the
    registered Python extractor of each row's language."""
    def run(content: pa.Array, language: pa.Array) -> pa.Array:
        none = {"symbols": None, "error": None}
        return by_slices(lambda c, lg: none if c is None or lg not in by_language else _checked(by_language[lg], c),
                         ARROW_CHECKED, content, language)

    return F.arrow_udf(run, CHECKED)


SYNTAX_STRUCT = T.StructType([T.StructField("ok", T.BooleanType()),
                              T.StructField("message", T.StringType())])


@F.pandas_udf(SYNTAX_STRUCT)
def py_syntax_udf(content: pd.Series, path: pd.Series) -> pd.DataFrame:
    rows = [python_syntax_of(c, p) or {"ok": None, "message": None} for c, p in zip(content, path)]
    return pd.DataFrame(rows, columns=["ok", "message"])


# ------------------------------------------------------------------ imports

def go_imports(content) -> Column:
    """single-line quoted or back-ticked import (grouped ones missed, X4)."""
    whole = F.regexp_extract_all(_c(content), F.lit(GO_IMPORT), 0)
    one = "^" + GO_IMPORT + "$"
    return F.transform(whole, lambda m: F.coalesce(
        F.nullif(F.regexp_extract(m, one, 1), F.lit("")), F.regexp_extract(m, one, 2)))


def py_imports(content) -> Column:
    """token after a line-initial import/from (``import a, b`` -> ``a,``)."""
    return F.regexp_extract_all(_c(content), F.lit("(?mU)" + PY_IMPORT), 1)


def c_includes(content) -> Column:
    """F11."""
    return F.regexp_extract_all(_c(content), F.lit(C_INCLUDE), 1)


def imports_expr(content, language) -> Column:
    """Dispatch of F9-F11 by language; other languages give an empty list."""
    c, lang = _c(content), _c(language)
    return (F.when(lang == "go", go_imports(c))
            .when(lang == "python", py_imports(c))
            .when(lang.isin("cpp", "c"), c_includes(c))
            .otherwise(F.array().cast("array<string>")))
