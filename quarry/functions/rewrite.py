"""Text rewrites.

All rewrites are native ``regexp_replace`` expressions, the per-language head
rewrites of parity mode (quirks X6/X17) included.  Only the clone of a Python
function (nested quantifier, SURVEY H3) is a line scan in Python, run through a
pandas UDF on the files that need it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as TX

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's output.
RENAME_SUFFIXES = ["Renamed", "Legacy", "V2", "Updated", "New", "Modified"]
RENAME_PREFIXES = ["Old", "Legacy", "Compat", "Wrapper"]
V2_SUFFIX = "V2"
WRAPPER_INFIX = "_wrapper"
LEGACY_DIR_SUFFIX = "_legacy"
DRIFT_LITERALS = [('"INFO"', '"DEBUG"'), ("'error'", "'warn'")]
DRIFT_LINE_HEADER = "// LEGACY VERSION - DO NOT USE\n"
DRIFT_BLOCK_HEADER = "/* LEGACY VERSION */\n"
DRIFT_CONSTANTS = [("1024", "1000"), ("60", "65")]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def new_name(symbol, seed: int = 42) -> Column:
    """F16: 70 % ``<name>_<suffix>``, else ``<prefix>_<name>``, hash-chosen."""
    from quarry.operators.sampling import hash_int, hash_key
    h = hash_key(seed, "new_name", _c(symbol))
    sfx = F.element_at(F.array(*[F.lit(s) for s in RENAME_SUFFIXES]),
                       (F.pmod(hash_int(h, 9), F.lit(len(RENAME_SUFFIXES))) + 1).cast("int"))
    pfx = F.element_at(F.array(*[F.lit(s) for s in RENAME_PREFIXES]),
                       (F.pmod(hash_int(h, 17), F.lit(len(RENAME_PREFIXES))) + 1).cast("int"))
    return F.when(F.pmod(hash_int(h, 1), F.lit(10)) < 7, F.concat(_c(symbol), F.lit("_"), sfx)) \
        .otherwise(F.concat(pfx, F.lit("_"), _c(symbol)))


def apply_word_renames(content, pairs, boundary: str = "unicode") -> Column:
    """Sequential whole-word renames of ``pairs`` (ARRAY<STRUCT<old,new,...>>)
    in array order, in one expression (one pass per pair, no shuffle)."""
    return F.aggregate(_c(pairs), _c(content),
                       lambda acc, p: TX.replace_word(acc, p["old"], p["new"], boundary))


def v2_name(symbol) -> Column:
    """F23."""
    return F.concat(_c(symbol), F.lit(V2_SUFFIX))


def clone_go_function(content, old, new) -> Column:
    """copy ``func OLD(..) .. { .. }`` (up to the first ``}``) as NEW right
    after every identical occurrence."""
    pat = F.concat(F.lit(r"(?s)(func\s+"), TX.quote_regex(old), F.lit(r"\s*\([^)]*\)\s*[^{]*\{[^}]*\})"))
    orig = F.call_function("regexp_extract", _c(content), pat, F.lit(1))
    v2 = F.replace(orig, F.concat(F.lit("func "), _c(old)), F.concat(F.lit("func "), _c(new)))
    return F.when(orig == "", _c(content)).otherwise(
        F.replace(_c(content), orig, F.concat(orig, F.lit("\n\n"), v2)))


def wrapper_path(path) -> Column:
    """``dir/stem_wrapper.suffix`` (no dir when the path has none)."""
    p = _c(path)
    d = TX.dirname(p)
    name = F.concat(TX.stem(p), F.lit(WRAPPER_INFIX), TX.suffix(p))
    return F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))


def call_chain(wrapper_file, original_file) -> Column:
    """F26."""
    return F.format_string("caller -> %s -> %s", _c(wrapper_file), _c(original_file))


def drift_literals(content) -> Column:
    """F27."""
    c = _c(content)
    for old, new in DRIFT_LITERALS:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def drift_header(content) -> Column:
    """F28 (after F27): a ``//`` line for texts starting ``//`` or ``#`` (X8),
    a block comment for texts starting ``/*``."""
    c = _c(content)
    return (F.when(c.startswith("//") | c.startswith("#"), F.concat(F.lit(DRIFT_LINE_HEADER), c))
            .when(c.startswith("/*"), F.concat(F.lit(DRIFT_BLOCK_HEADER), c))
            .otherwise(c))


def drift_constants(content) -> Column:
    """whole-number swaps with Python's Unicode word boundary."""
    c = _c(content)
    for old, new in DRIFT_CONSTANTS:
        c = F.regexp_replace(c, F.lit(r"(?U)\b" + old + r"\b"), F.lit(new))
    return c


def drift(content) -> Column:
    """F27 -> F28 -> F29."""
    return drift_constants(drift_header(drift_literals(content)))


def is_rewritable(path) -> Column:
    """P11."""
    return TX.basename(path).rlike(r"\.(go|py|cpp|h)$")


# ------------------------------------------------------------- parity renames

def _swap(content, old, new, before: str, after: str, head) -> Column:
    """Replace ``before OLD after`` (regex parts around the literal name) by ``head``."""
    pat = F.concat(F.lit("(?U)" + before), TX.quote_regex(old), F.lit(after))
    return F.regexp_replace(content, pat, head)


def rename_go(content, old, new) -> Column:
    """function heads, the receivers of methods called OLD (every
    occurrence of OLD inside the parentheses, quirk X6), type heads, whole
    words.  The receiver step is one pattern: ``\\G`` carries a match on from
    the previous one, so replacements stay inside the receiver they began in."""
    to = TX.escape_replacement(new)
    out = _swap(content, old, new, r"\bfunc\s+", r"\s*\(", F.concat(F.lit("func "), to, F.lit("(")))
    receiver = F.concat(F.lit(r"(?U)(\bfunc\s+\((?=[^)]+\)\s+"), TX.quote_regex(old), F.lit(r"\s*\()|\G(?!\A))([^)]*?)"),
                        TX.quote_regex(old))
    out = F.regexp_replace(out, receiver, F.concat(F.lit("$1$2"), to))
    out = _swap(out, old, new, r"\btype\s+", r"\s+", F.concat(F.lit("type "), to, F.lit(" ")))
    return TX.replace_word(out, old, new)


def rename_python(content, old, new) -> Column:
    """class heads (OLD is also replaced inside the keyword, quirk X6),
    def heads, whole words."""
    to = TX.escape_replacement(new)
    keyword = TX.escape_replacement(F.replace(F.lit("class"), _c(old), _c(new)))
    out = _swap(content, old, new, r"\bclass(\s+)", r"(\s*[:(])", F.concat(keyword, F.lit("$1"), to, F.lit("$2")))
    out = _swap(out, old, new, r"\bdef\s+", r"\s*\(", F.concat(F.lit("def "), to, F.lit("(")))
    return TX.replace_word(out, old, new)


def apply_parity_renames(content, language, pairs) -> Column:
    """The renames of a file in array order, by the rule of its language; native."""
    def fold(rule):
        return F.aggregate(_c(pairs), _c(content), lambda acc, p: rule(acc, p["old"], p["new"]))
    return (F.when(_c(language) == "go", fold(rename_go)).when(_c(language) == "python", fold(rename_python))
            .otherwise(fold(TX.replace_word)))


# ------------------------------------------------------------- API migration

def clone_python_function(content: str, old: str, new: str) -> str:
    """the function OLD (head without return annotation, then the lines
    that are empty or indented by four spaces) is followed by its copy NEW,
    wherever exactly this text stands."""
    head = re.search(rf"def\s+{re.escape(old)}\s*\([^)]*\):", content)
    if head is None:
        return content
    newline = content.find("\n", head.end())
    while newline >= 0 and content.startswith(("    ", "\n"), newline + 1):
        newline = content.find("\n", newline + 1)
    function = content[head.start():] if newline < 0 else content[head.start():newline + 1]
    return content.replace(function, function + "\n\n" + function.replace(f"def {old}", f"def {new}"))


@F.pandas_udf(T.StringType())
def migrate_python_udf(content: pd.Series, actions: pd.Series) -> pd.Series:
    """T3 on Python files that define a migrated function; a file whose
    rewrite fails gives null (P8)."""
    def rewrite(text, steps):
        if text is None or steps is None:
            return None
        try:
            for a in steps:
                if a["action"] == "define":
                    text = clone_python_function(text, a["old"], a["new"])
                else:
                    text = re.sub(rf"\b{re.escape(a['old'])}\b", lambda _, to=a["new"]: to, text)
            return text
        except Exception:  # noqa: BLE001 - isolate one bad file
            return None
    return pd.Series([rewrite(c, a) for c, a in zip(content, actions)], dtype=object)


def apply_migrations(content, language, actions) -> Column:
    """T3 on one file, actions in array order: ``define`` clones the function
    (go, python), ``migrate`` replaces whole words.  Native but for Python
    files that define a symbol; only those cross to Python, the others as
    nulls.  A file whose rewrite fails keeps its text."""
    c, lang, acts = _c(content), _c(language), _c(actions)
    native = F.aggregate(acts, c, lambda acc, a: F.when(a["action"] == "migrate", TX.replace_word(acc, a["old"], a["new"]))
                         .when(lang == "go", clone_go_function(acc, a["old"], a["new"])).otherwise(acc))
    in_python = (lang == "python") & F.exists(acts, lambda a: a["action"] == "define")
    return F.when(in_python, F.coalesce(migrate_python_udf(F.when(in_python, c), F.when(in_python, acts)), c)).otherwise(native)
