"""Column expressions for file text and paths.

All of these are plain Catalyst expressions: they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Extensions scanned for source files (P1), in the reference's order.
SOURCE_EXTS = ("go", "py", "cpp", "h", "hpp", "c", "java", "js", "ts")
# Path fragments that exclude a directory (P2) or a file name.
EXCLUDE_FRAGMENTS = ("vendor/", "node_modules/", "third_party/", ".git/",
                     "test/", "tests/", "_test.", ".test.", "generated/")
# Lower-cased last suffix -> language (P4); anything else is "unknown".
LANGUAGE_BY_SUFFIX = {
    ".go": "go",
    ".py": "python",
    ".cpp": "cpp", ".cxx": "cpp", ".cc": "cpp",
    ".h": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".c": "c",
    ".java": "java",
    ".js": "javascript",
    ".ts": "typescript",
}
# Characters Python's str.splitlines() treats as line breaks.
LINE_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# ---------------------------------------------------------------------------

ASCII_WORD = "A-Za-z0-9_"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_text(raw) -> Column:
    """Bytes -> text, invalid UTF-8 dropped, \\r\\n and \\r folded to \\n."""
    # a replacement character that stands in the file is kept apart from those that mark invalid bytes
    text = F.replace(_c(raw).cast("string"), F.lit("\uFFFD"), F.lit("\uFDD0\uFDD1"))
    text = F.replace(F.make_valid_utf8(text), F.lit("\uFFFD"), F.lit(""))
    text = F.replace(text, F.lit("\uFDD0\uFDD1"), F.lit("\uFFFD"))
    return F.regexp_replace(text, "\r\n?", "\n")


def size_bytes(content) -> Column:
    """P5: UTF-8 byte length."""
    return F.octet_length(_c(content)).cast("long")


def line_count(content) -> Column:
    """The count Python's ``str.splitlines`` returns.  A text's breaks are
    what goes when they are replaced by nothing: plain byte searches."""
    c = _c(content)
    rest = c
    for b in LINE_BREAKS:
        rest = F.replace(rest, F.lit(b), F.lit(""))
    pairs = F.length(c) - F.length(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    tail = F.when((c != F.lit("")) & ~F.substring(c, -1, 1).isin(*LINE_BREAKS), 1).otherwise(0)
    return (F.length(c) - F.length(rest) - pairs + tail).cast("int")


def basename(path) -> Column:
    """last path component."""
    return F.substring_index(_c(path), "/", -1)


def dirname(path) -> Column:
    """Directory string without trailing slash ('' for a bare name)."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def suffix(path) -> Column:
    """Suffix of the last component, as ``PurePath.suffix`` (dot kept)."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def stem(path) -> Column:
    """Last component without its suffix (``PurePath.stem``)."""
    name = basename(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def detect_language(path) -> Column:
    """Language from the lower-cased last suffix."""
    mapping = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, F.lower(suffix(path))), F.lit("unknown"))


def is_source_ext(path) -> Column:
    """File name ends (case-sensitively) with one of the scanned suffixes."""
    return basename(path).rlike(r"\.(" + "|".join(SOURCE_EXTS) + r")$")


def dir_excluded(path) -> Column:
    """Directory string (no trailing slash, quirk X1) holds a fragment."""
    d = dirname(path)
    cond = F.lit(False)
    for frag in EXCLUDE_FRAGMENTS:
        cond = cond | d.contains(frag)
    return cond


def name_excluded(path) -> Column:
    """File name holds a fragment (only ``_test.``/``.test.`` can)."""
    n = basename(path)
    cond = F.lit(False)
    for frag in EXCLUDE_FRAGMENTS:
        cond = cond | n.contains(frag)
    return cond


def is_scanned(path) -> Column:
    """P1 AND NOT P2 AND NOT P3."""
    return is_source_ext(path) & ~dir_excluded(path) & ~name_excluded(path)


# --------------------------------------------------------------------------
# Whole-word matching with a per-row key

def quote_regex(key) -> Column:
    """``\\Q..\\E`` quoting of a literal key (handles an embedded ``\\E``)."""
    k = _c(key)
    return F.concat(F.lit("\\Q"), F.replace(k, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def escape_replacement(value) -> Column:
    """Escape ``$`` and ``\\`` so a value is taken literally as replacement."""
    return F.regexp_replace(_c(value), r"([\\$])", r"\\$1")


def word_pattern(key, boundary: str = "unicode", suffix_re: str = "") -> Column:
    """Regex for ``key`` as a whole word.

    ``unicode`` is Python's ``\\b`` (letters of any script are word
    characters); ``ascii`` is the ASCII boundary DuckDB/RE2 use, written with
    look-arounds so Java gives the same answer.
    """
    q = quote_regex(key)
    if boundary == "unicode":
        return F.concat(F.lit("(?U)\\b"), q, F.lit("\\b" + suffix_re))
    if boundary == "ascii":
        return F.concat(F.lit(f"(?<![{ASCII_WORD}])"), q, F.lit(f"(?![{ASCII_WORD}])" + suffix_re))
    raise ValueError(f"unknown boundary {boundary!r}")


def count_word(content, word, boundary: str = "unicode") -> Column:
    """whole-word occurrences."""
    return F.regexp_count(_c(content), word_pattern(word, boundary)).cast("int")


def count_calls(content, word, boundary: str = "unicode") -> Column:
    """whole word, optional spaces, then ``(``."""
    if boundary == "unicode":
        pat = F.concat(F.lit("(?U)\\b"), quote_regex(word), F.lit("\\s*\\("))
    else:
        pat = F.concat(F.lit(f"(?<![{ASCII_WORD}])"), quote_regex(word), F.lit("\\s*\\("))
    return F.regexp_count(_c(content), pat).cast("int")


def replace_word(content, old, new, boundary: str = "unicode") -> Column:
    """whole-word replacement of ``old`` by ``new``."""
    return F.regexp_replace(_c(content), word_pattern(old, boundary), escape_replacement(new))


def api_name(signature) -> Column:
    """first word followed by ``(``; empty string when absent."""
    return F.regexp_extract(_c(signature), r"(?U)(\w+)\s*\(", 1)


def folder_of(name) -> Column:
    """``src/<name>/``."""
    return F.format_string("src/%s/", _c(name))


def ratio_safe(x, n) -> Column:
    """x / max(n, 1) as double."""
    return _c(x).cast("double") / F.greatest(_c(n), F.lit(1)).cast("double")


def task_type_of(task_id) -> Column:
    """task id without its last ``_`` part ('' when there is no ``_``)."""
    return F.regexp_replace(_c(task_id), r"_?[^_]*$", "")


def split_lines(content) -> Column:
    """Lines of a text split on ``\\n`` (text is already newline-folded)."""
    return F.split(_c(content), "\n", -1)
