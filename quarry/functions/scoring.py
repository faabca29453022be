"""Scoring predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as TX

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's scoring.
ANALYSIS_KEYWORDS = ["call", "trace", "path", "flow", "implementation", "function", "method"]
FIX_PATTERNS = ["if.*null", "null.*check", "!= null", "== null", "try.*catch", "error.*handle",
                "validate", "bounds.*check", "len.*check", "size.*check"]
TASK_WEIGHTS = {"cross_file_reasoning": 1.0, "refactor_rename": 1.2, "api_upgrade": 1.5,
                "bug_localization": 2.0}
REASONING_SOURCES = ["REASONING.md", "reasoning.txt", "analysis.md", "SOLUTION.md"]
BUG_SOURCES = ["BUG_ANALYSIS.md", "bug_report.txt", "DIAGNOSIS.md"]
REASONING_COMMITS = 5
BUG_COMMITS = 3
# Documented-only rules: performance bands (D1) and overtime penalties.
BANDS = [(90, "Expert"), (75, "Proficient"), (60, "Competent"), (40, "Developing")]
BAND_FLOOR = "Novice"
OVERTIME = [(0.25, 0.9), (0.50, 0.75), (1.00, 0.5)]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mentions_file(text, path) -> Column:
    """F32 (reasoning variant): lower-cased basename in lower-cased text, or
    the full path in the raw text."""
    t, p = _c(text), _c(path)
    return F.lower(t).contains(F.lower(TX.basename(p))) | t.contains(p)


def mentions_file_bug(text, path) -> Column:
    """F32 (bug variant): full path or basename, both case-sensitive."""
    t, p = _c(text), _c(path)
    return t.contains(p) | t.contains(TX.basename(p))


def path_step_hit(step, text_lower) -> Column:
    """a step with ``::``, ``->`` or ``.`` hits when any non-blank part
    (split on ``: > .``) occurs lower-cased; otherwise the whole step."""
    s, t = _c(step), _c(text_lower)
    structured = s.contains("::") | s.contains("->") | s.contains(".")
    parts = F.split(s, r"[:>.]", -1)
    any_part = F.exists(parts, lambda x: (F.trim(x) != "") & t.contains(F.lower(F.trim(x))))
    return F.when(structured, any_part).otherwise(t.contains(F.lower(s)))


def path_accuracy(steps, text_lower) -> Column:
    """Share of steps hit (sum of 1/len per hit, as the reference adds)."""
    st = _c(steps)
    hits = F.size(F.filter(st, lambda s: path_step_hit(s, text_lower)))
    return F.when(F.size(st) > 0, hits.cast("double") / F.size(st).cast("double")).otherwise(F.lit(0.0))


def keyword_ratio(text_lower) -> Column:
    """F34."""
    kw = F.array(*[F.lit(k) for k in ANALYSIS_KEYWORDS])
    return F.size(F.filter(kw, lambda k: _c(text_lower).contains(k))).cast("double") / float(len(ANALYSIS_KEYWORDS))


def ints_in_text(text) -> Column:
    """whole-word digit runs in text order, as DECIMAL(38,0) (NULL when
    longer than 38 digits)."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?U)\b(\d+)\b"), 1),
                       lambda d: d.try_cast("decimal(38,0)"))


def line_band(text, start, end) -> Column:
    """The first number inside [start-5, end+5] decides."""
    s, e = _c(start), _c(end)
    nums = ints_in_text(text)
    first = F.try_element_at(F.filter(nums, lambda n: n.isNotNull() & (n >= s - 5) & (n <= e + 5)), F.lit(1))
    return (F.when(first.isNull(), F.lit(0.0))
            .when((first >= s - 2) & (first <= e + 2), F.lit(1.0))
            .otherwise(F.lit(0.75)))


def has_fix_pattern(text_lower) -> Column:
    """any fix pattern on the joined, lower-cased lines (``.`` stops at a
    line end, as in Python)."""
    pat = "(?d)" + "|".join(f"(?:{p})" for p in FIX_PATTERNS)
    return _c(text_lower).rlike(pat)


def noise_line(path, line) -> Column:
    """F42 on ``path:line`` as grep prints it."""
    s = F.concat(_c(path), F.lit(":"), _c(line))
    return s.contains("//") | s.contains("#") | s.contains('"') | s.contains("'")


def clamp01(x) -> Column:
    """F40."""
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def task_weight(task_id) -> Column:
    """Weight of the type in the task id, 1.0 when unknown."""
    m = F.create_map(*[F.lit(x) for kv in TASK_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, TX.task_type_of(task_id)), F.lit(1.0))


def performance_band(score) -> Column:
    """D1 on score*100 with half-open bands."""
    pct = _c(score) * 100.0
    expr = None
    for floor_, name in BANDS:
        expr = F.when(pct >= floor_, F.lit(name)) if expr is None else expr.when(pct >= floor_, F.lit(name))
    return expr.otherwise(F.lit(BAND_FLOOR))


def overtime_factor(elapsed, limit) -> Column:
    """1-25 % over: x0.9; 26-50 %: x0.75; 51-100 %: x0.5; more: 0."""
    over = (_c(elapsed) - _c(limit)) / _c(limit)
    expr = F.when(over <= 0, F.lit(1.0))
    for bound, factor in OVERTIME:
        expr = expr.when(over <= bound, F.lit(factor))
    return expr.otherwise(F.lit(0.0))
