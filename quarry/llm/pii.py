"""Personal data: a semi-Markov conditional random field over text regions.

Base rules give spans of four kinds (patterns fixed by the task).  Around
every digit, ``@`` and disguised ``@`` (``[at]``, ``(at)``) the text is cut into
a region of tokens that reaches ``LONGEST`` tokens to both sides, so no candidate
is cut; candidate segments of at most ``LONGEST`` tokens get features of the whole span (digit
count, separators, checksum, neighbours), and a bounded dynamic programme
chooses boundaries and kinds of all segments of a region at once.  Base spans
are fixed segments of that programme, so they always stay; what it finds
beside them is added when its segment beats the same tokens left outside by
``MARGIN``.  The weights maximise the conditional likelihood of regions drawn
from all documents, those with the least hash of their text: at most
``SAMPLE_PLAIN`` distinct ones without a base span and ``SAMPLE_KIND`` with a span of
each kind (documented bounds; of a region over ``PIECE`` characters the
surroundings of each base span, or its beginning): base spans as they are, and the same spans in disguise
(``00`` or no ``+`` before a phone number, ``[at]``, ``(at)``, ``[.]``, dots in a
card number), which the base rules cannot see; every such span is a candidate.

Defined results: null text counts as empty and has no spans; spans are
[start, end) in code points; repeated rows each give their row; an empty
table gives an empty result; a sample without regions adds nothing; work is
linear in the length of a text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, map_batches

KINDS = ("email", "ip", "card", "phone")
O = len(KINDS)  # the label of a token outside every span
LONGEST = 24
MARGIN = 3.0
#: Distinct regions learned from: without a base span, and with one of each kind.
SAMPLE_PLAIN, SAMPLE_KIND = 300, 100
#: Characters of a region that is learned from whole.
PIECE = 400
EPOCHS, RATE, SHRINK = 6, 0.15, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
# [0-9] first lets the scan jump to digits; a match never starts inside a run of digits
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and int(p or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(map(_byte_part, m.group().split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- regions

_AT = re.compile(r"\[at\]|\(at\)", re.IGNORECASE)
_TRIGGER = re.compile(rf"[0-9@]+|{_AT.pattern}", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\S\n]|.|\n")
# the same tokens, read from either end
_BESIDE = re.compile(rf"(?:[0-9]++|[^\W\d_]++|[^\S\n]|.|\n){{0,{LONGEST}}}+")


def regions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Disjoint [start, end) pieces that hold every digit, ``@``, disguised ``@``
    and base span, with the ``LONGEST`` tokens on both sides."""
    marks = sorted([m.span() for m in _TRIGGER.finditer(text)] + [s[1:] for s in spans])
    out: list[list[int]] = []
    back, size = text[::-1] if marks else "", len(text)
    for a, b in marks:
        if out and a <= out[-1][1]:
            lo = out[-1][0]   # what is left of it lies in the region already
        else:
            lo = size - _BESIDE.match(back, size - a).end()
        hi = _BESIDE.match(text, b).end()
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(r) for r in out]


# ---------------------------------------------------------------- features

_CLUES = ("mail", "tel", "phone", "fon", "call", "card", "ip", "version", "token", "key", "id", "at")
_SIZES = (1, 2, 3, 4, 6, 8, 9, 10, 12, 13, 16, 17, 20, 33)
N_FEATURES = 128


def _bucket(n: int) -> int:
    return sum(n >= s for s in _SIZES)


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "._-+@" else 4


def span_features(text: str, start: int, end: int) -> list[int]:
    """Indices of the binary features of one candidate segment."""
    s = text[start:end]
    digits = _digits(s)
    n, letters, dots = len(digits), sum(map(str.isalpha, s)), s.count(".")
    out = [0, 1 + _bucket(n), 17 + min(dots, 4), 22 + min(s.count("@"), 2), 25 + _side(text[start - 1:start]), 30 + _side(text[end:end + 1]),
           35 + _bucket(len(s))]
    for i, flag in enumerate((
            s[0] == "+", s[:2] == "00", "(" in s and ")" in s, "-" in s, " " in s, letters > 0, _AT.search(s) is not None, "[.]" in s,
            13 <= n <= 19 and letters == 0 and luhn(digits), s[0].isalnum() or s[0] == "+", s[-1].isalnum(), "\n" in s,
            letters > 0 and n > 0, letters == 0 and n >= 9 and n < len(s), letters == 0 and n == len(s), "%" in s or "$" in s,
            s[-1].isalpha(), "_" in s or "=" in s or '"' in s)):
        if flag:
            out.append(52 + i)
    if letters == 0:
        parts = s.replace("[.]", ".").split(".")
        if len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte_part(p) for p in parts):
            out.append(80)
    # the shape of separators between digit groups, for spans without letters
    if letters == 0:
        groups = re.findall(r"[0-9]+", s)
        out.append(81 + min(len(groups), 6))
        if len({c for c in s if not c.isdigit()}) == 1:
            out.append(88 + min(" -.".find(next(c for c in s if not c.isdigit())) + 1, 3))
    left = text[max(0, start - 14):start].lower()
    out += [96 + i for i, c in enumerate(_CLUES) if c in left]
    return out


class Region:
    """Tokens, candidate segments and their features of one piece of text;
    spans of ``gold`` are candidates whatever their length."""

    def __init__(self, text: str, lo: int, hi: int, spans: list[tuple[int, int, int]], gold: list[tuple[int, int, int]] = ()):
        bounds = [lo, *(m.end() for m in _TOKEN.finditer(text, lo, hi))]
        cuts = sorted(set(bounds) | {p for _, a, b in [*spans, *gold] if lo <= a and b <= hi for p in (a, b)})
        self.n, self.at = len(cuts) - 1, cuts
        index = {p: i for i, p in enumerate(cuts)}
        inside = [(k, index[a], index[b]) for k, a, b in spans if lo <= a and b <= hi]
        self.base = {(i, j): k for k, i, j in reversed(inside)}
        busy = np.zeros(self.n, dtype=bool)
        for i, j in self.base:
            busy[i:j] = True
        blank = [text[cuts[i]].isspace() for i in range(self.n)]
        at = {m.start() + 1 for m in _AT.finditer(text, lo, hi)}
        hot = np.concatenate(([0], np.cumsum([text[cuts[i]].isdigit() or text[cuts[i]] == "@" or cuts[i] in at for i in range(self.n)])))
        taken = np.concatenate(([0], np.cumsum(busy)))
        self.segments = [(i, i + 1, None) for i in range(self.n)]
        for i in range(self.n):
            if blank[i] or busy[i]:
                continue
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                if taken[j] > taken[i]:
                    break
                # a span begins and ends where a word does, and holds a digit, @ or disguised @
                if not blank[j - 1] and hot[j] - hot[i] and cuts[j] - cuts[i] >= 7:
                    self.segments.append((i, j, None))
        if gold:
            known = {x[:2] for x in self.segments[self.n:]}
            self.segments += [(i, j, None) for i, j in sorted({(index[a], index[b]) for _, a, b in gold} - known)]
        self.segments += [(i, j, k) for (i, j), k in self.base.items()]
        feats = [span_features(text, cuts[i], cuts[j]) for i, j, _ in self.segments]
        width = max(map(len, feats))
        self.feats = np.array([f + [N_FEATURES] * (width - len(f)) for f in feats])

    def scores(self, w: np.ndarray) -> np.ndarray:
        """(segment, label); minus infinity where the label isn't allowed."""
        s = w[:, self.feats].sum(axis=2).T
        single = np.arange(len(s)) < self.n
        s[single, :O] = -np.inf
        s[~single, O] = -np.inf
        for x, (_, _, k) in enumerate(self.segments):
            if k is not None:
                s[x, [y for y in range(O) if y != k]] = -np.inf
        return s

    def ending(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(self.n + 1)]
        for x, (_, j, _) in enumerate(self.segments):
            out[j].append(x)
        return out

    def decode(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """Best segmentation as (kind, start, end) in the text; base spans are
        preferred over anything else."""
        s, best, back = self.scores(w), np.full(self.n + 1, -np.inf), [None] * (self.n + 1)
        outside = np.concatenate(([0.0], np.cumsum(s[:self.n, O])))
        best[0] = 0.0
        for j, own in enumerate(self.ending()):
            for x in own:
                i, _, k = self.segments[x]
                y = int(np.argmax(s[x]))
                v = best[i] + s[x, y]
                if y != O:
                    v = best[i] + max(s[x, y], outside[j] - outside[i]) + 1e6 if k is not None else v - MARGIN
                if v > best[j]:
                    best[j], back[j] = v, (i, y)
        out, j = [], self.n
        while j:
            i, y = back[j]
            if y != O:
                out.append((y, self.at[i], self.at[j]))
            j = i
        return out

    def gradient(self, w: np.ndarray, gold: list[tuple[int, int, int]]) -> np.ndarray:
        """Of the log likelihood of ``gold`` (kind, first token, last token)."""
        s = self.scores(w)
        total = np.logaddexp.reduce(s, axis=1)
        alpha, beta = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        alpha[0] = beta[self.n] = 0.0
        ending = self.ending()
        for j in range(1, self.n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[self.segments[x][0]] + total[x] for x in ending[j]])
        for j in range(self.n, 0, -1):
            for x in ending[j]:
                i = self.segments[x][0]
                beta[i] = np.logaddexp(beta[i], beta[j] + total[x])
        i, j = np.array([x[0] for x in self.segments]), np.array([x[1] for x in self.segments])
        p = np.exp(alpha[i][:, None] + s + beta[j][:, None] - alpha[self.n])
        want = np.zeros_like(p)
        where = {x[:2]: k for k, x in enumerate(self.segments) if k >= self.n}
        covered = np.zeros(self.n, dtype=bool)
        for kind, a, b in gold:
            want[where[a, b], kind] = 1   # a KeyError here would be a gold span that is no candidate
            covered[a:b] = True
        want[np.flatnonzero(~covered), O] = 1
        g = np.zeros_like(w)
        for y in range(O + 1):
            np.add.at(g[y], self.feats, (want[:, y] - p[:, y])[:, None])
        g[:, N_FEATURES] = 0
        return g


# ---------------------------------------------------------------- learning

def _disguised(rng: random.Random, kind: int, s: str) -> str:
    if kind == 0:
        return s.replace("@", rng.choice((" [at] ", "[at]", " (at) ", "(at)")), 1)
    if kind == 1:
        return s.replace(".", "[.]")
    if kind == 2:
        d = _digits(s)
        return ".".join(d[i:i + 4] for i in range(0, len(d), 4))
    return s.replace("+", rng.choice(("00", "")), 1)


def train(samples: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray | None:
    """Weights from (text, base spans) of sampled regions; None without any."""
    rng = random.Random(11)
    work = []
    for text, spans in samples:
        work.append((Region(text, 0, len(text), [], spans), text, spans))
        flat = [s for s in spans if not any(o != s and o[1] < s[2] and s[1] < o[2] for o in spans)]
        out, new, last = "", [], 0
        for kind, a, b in sorted(flat, key=lambda s: s[1]):
            out += text[last:a]
            put = _disguised(rng, kind, text[a:b])
            new.append((kind, len(out), len(out) + len(put)))
            out, last = out + put, b
        if new:
            out += text[last:]
            work.append((Region(out, 0, len(out), [], new), out, new))
    if not work:
        return None
    w = np.zeros((O + 1, N_FEATURES + 1))
    square = np.full_like(w, 1e-6)
    for _ in range(EPOCHS):
        rng.shuffle(work)
        for region, _, spans in work:
            index = {p: i for i, p in enumerate(region.at)}
            gold = [(k, index[a], index[b]) for k, a, b in spans]
            g = region.gradient(w, gold) - SHRINK * w
            square += g * g
            w += RATE * g / np.sqrt(square)
    return w


def _pieces(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(piece, its base spans) of the regions of a text."""
    base = base_spans(text)
    for lo, hi in regions(text, base):
        own = [s for s in base if lo <= s[1] and s[2] <= hi]
        cuts = [(lo, hi)]
        if hi - lo > PIECE:
            reach = PIECE // 4
            cuts = sorted({(max(lo, a - reach), min(hi, c + reach)) for _, a, c in own}) or [(lo, lo + PIECE)]
        for p, q in cuts:
            # a span that a cut would part stays whole
            p, q = min([p, *(a for _, a, c in own if a < p < c)]), max([q, *(c for _, a, c in own if a < q < c)])
            yield text[p:q], [(k, a - p, c - p) for k, a, c in own if p <= a and c <= q]


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class (each kind, and no span) the pieces of least hash of one partition."""
    least: list[dict[str, tuple]] = [{} for _ in range(O + 1)]
    bound = [SAMPLE_KIND] * O + [SAMPLE_PLAIN]
    for b in batches:
        for t in b.column("text").to_pylist():
            for piece, spans in _pieces(t or ""):
                row = (blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), piece, spans)
                for c in {k for k, _, _ in spans} or {O}:
                    least[c][piece] = row
                    if len(least[c]) >= 4 * bound[c]:
                        least[c] = {r[1]: r for r in sorted(least[c].values())[:bound[c]]}
    rows = [(c, *r) for c in range(O + 1) for r in sorted(least[c].values())[:bound[c]]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()),
         pa.array([[x for s in r[3] for x in s] for r in rows], pa.list_(pa.int32()))], names=["class", "hash", "text", "spans"])


def learn(docs: DataFrame) -> np.ndarray | None:
    """Weights from a bounded sample of the regions of all documents, drawn by class."""
    found = map_batches(docs.select("text"), _sample_batches, "class int, hash string, text string, spans array<int>")
    found = Scratch(docs.sparkSession, "pii").save(found, "sample")
    rows = {}
    for c in range(O + 1):
        own = found.where(F.col("class") == c).select("hash", "text", "spans").distinct()
        for r in own.orderBy("hash", "text").limit(SAMPLE_PLAIN if c == O else SAMPLE_KIND).collect():
            rows[r.hash, r.text] = r.spans
    return train([(text, [tuple(x[i:i + 3]) for i in range(0, len(x), 3)]) for (_, text), x in sorted(rows.items())])


# ---------------------------------------------------------------- finding

def find_spans(text: str, weights: np.ndarray | None) -> tuple[list, list]:
    """(base spans, added spans) of one text, each by kind, then start."""
    base = base_spans(text)
    added = set()
    if weights is not None:
        for lo, hi in regions(text, base):
            for span in Region(text, lo, hi, base).decode(weights):
                if not any(a < span[2] and span[1] < b for _, a, b in base):
                    added.add(span)
    return base, sorted(added)


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _rows(spans: list) -> list:
    return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]


def find(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, base and added spans of every row; narrow, whole texts."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [find_spans(t or "", weights) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([_rows(x) for x, _ in found], _SPAN_TYPE), pa.array([_rows(x) for _, x in found], _SPAN_TYPE)],
                names=["doc_id", "base", "added"])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, f"doc_id long, base {SPANS}, added {SPANS}")


def redact_text(text: str, weights: np.ndarray | None) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind."""
    out, last = [], 0
    base, added = find_spans(text, weights)
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], s[0])):
        if a >= last:
            out += [text[last:a], f"<{KINDS[kind].upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """All rows and columns of ``docs`` with the spans replaced in text, and
    n_chars, where there is one, counted anew; a null text stays null."""
    names, kinds = docs.columns, dict(docs.dtypes)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = pa.array([t if t is None else redact_text(t, weights) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in names], names=names)
    out = map_batches(docs, batches, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kinds["n_chars"]))
    return out
