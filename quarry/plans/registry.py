"""Extension points (R7, R8): per-language extractors and per-type scorers.

An extractor is either a *native* function ``Column -> Column`` (content to
``ARRAY<STRUCT<symbol, kind>>``) or a pandas UDF of the same type.  Native
extractors are combined into one ``CASE`` expression; UDF extractors get the
content only for their own languages (``NULL`` otherwise), so the JVM sends
nothing else over Arrow and the scan is read once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column

from quarry.functions import extract as X


@dataclass(frozen=True)
class Extractor:
    """``native``: ``fn(content Column) -> Column``.  Otherwise ``fn`` is a
    plain Python function ``text -> list[{"symbol", "kind"}]`` run inside one
    Arrow-batched UDF shared by all Python-side languages."""
    fn: Callable
    native: bool = True


@dataclass
class ExtractorRegistry:
    by_language: dict[str, Extractor] = field(default_factory=dict)

    def register(self, language: str, fn: Callable[[Column], Column], native: bool = True) -> "ExtractorRegistry":
        self.by_language[language] = Extractor(fn, native)
        return self

    def copy(self) -> "ExtractorRegistry":
        return ExtractorRegistry(dict(self.by_language))


def code_extractors() -> ExtractorRegistry:
    """F8 dispatch: go natively, python and cpp/c through UDFs."""
    reg = ExtractorRegistry()
    reg.register("go", X.go_symbols, native=True)
    reg.register("python", X.python_symbols_of, native=False)
    reg.register("cpp", X.cpp_symbols_of, native=False)
    reg.register("c", X.cpp_symbols_of, native=False)
    return reg


def prose_extractors(languages=("go", "python", "cpp", "c", "java", "javascript", "typescript", "unknown")) -> ExtractorRegistry:
    """The prose extractor for every language (documents corpus view)."""
    reg = ExtractorRegistry()
    for lang in languages:
        reg.register(lang, X.prose_symbols, native=True)
    return reg


DEFAULT_EXTRACTORS = code_extractors()


def register_extractor(language: str, fn: Callable[[Column], Column], native: bool = True) -> None:
    """Add or replace the extractor of a language in the default registry."""
    DEFAULT_EXTRACTORS.register(language, fn, native)
