"""Unicode search projection: what Spark's functions can't express, as Arrow functions.

Offsets count UTF-16 units, as the clients of the data do. A projection is NFKD, full case folding, NFKD, and
each of its units knows the source units that it came from, so a match can be taken back to the text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F, types as T

SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
PROJECTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])
MATCH = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("safe", T.BooleanType())]))


def units(s: str) -> int:
    return len(s) + sum(c > "￿" for c in s)


def _decomposed(chars: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """NFKD of tagged characters; marks in canonical order, each run of them sorted stably by class."""
    flat = [(d, s, e) for c, s, e in chars for d in unicodedata.normalize("NFKD", c)]
    out: list[tuple[str, int, int]] = []
    for item in flat:
        k, order = len(out), unicodedata.combining(item[0])
        while order and k and unicodedata.combining(out[k - 1][0]) > order:
            k -= 1
        out.insert(k, item)
    return out


class _Folds(dict):
    """Each character's own projection, kept once it is known."""

    def __init__(self, match_case: bool):
        super().__init__()
        self.match_case = match_case

    def __missing__(self, c: str) -> str:
        done = unicodedata.normalize("NFKD", c)
        self[c] = done if self.match_case else unicodedata.normalize("NFKD", done.casefold())
        return self[c]


_FOLDS = {m: _Folds(m) for m in (False, True)}


def _spans(text: str, match_case: bool) -> tuple[str, np.ndarray, np.ndarray]:
    """(projected text, first and last source unit of each of its units).

    Characters project by themselves, unless marks change places over them: what the whole text's projection tells.
    """
    if text.isascii():  # each character is a unit and stays one
        at = np.arange(len(text), dtype=np.int32)
        return text if match_case else text.lower(), at, at + 1
    folds = _FOLDS[match_case]
    parts = list(map(folds.__getitem__, text))
    shown = "".join(parts)
    whole = unicodedata.normalize("NFKD", text)
    if shown != (whole if match_case else unicodedata.normalize("NFKD", whole.casefold())):
        shown, spans = _spans_by_character(text, match_case)
        low, high = np.array(spans, np.int32).reshape(-1, 2).T
        return shown, low, high
    wide = max(text) > "\uffff"
    own = np.fromiter(map(units, text), np.int32, len(text)) if wide else np.ones(len(text), np.int32)
    made = np.fromiter(map(units if max(shown, default="") > "\uffff" else len, parts), np.int32, len(parts))
    ends = np.cumsum(own, dtype=np.int32)
    return shown, np.repeat(ends - own, made), np.repeat(ends, made)


def _spans_by_character(text: str, match_case: bool) -> tuple[str, list[tuple[int, int]]]:
    tagged, at = [], 0
    for c in text:
        tagged.append((c, at, at + units(c)))
        at += units(c)
    done = _decomposed(tagged)
    if not match_case:
        done = _decomposed([(f, s, e) for c, s, e in done for f in c.casefold()])
    return "".join(c for c, _, _ in done), [(s, e) for c, s, e in done for _ in range(units(c))]


def project(text: str, match_case: bool = False) -> tuple[str, list[tuple[int, int]]]:
    """(projected text, source span of each of its UTF-16 units)."""
    shown, low, high = _spans(text, match_case)
    return shown, list(zip(low.tolist(), high.tolist(), strict=True))


class _Edges:
    """Where pieces of a text may begin and end, line by line as they are asked for: a line feed parts pieces of any kind."""

    def __init__(self, text: str, pattern: regex.Pattern, whole: bool):
        self.text, self.pattern, self.whole, self.known = text, pattern, whole, {}

    def holds(self, at: int) -> bool:
        low = self.text.rfind("\n", 0, at) + 1
        if at in (0, len(self.text)):
            return True
        if low not in self.known:
            high = self.text.find("\n", low) + 1 or len(self.text)
            found = self.pattern.finditer(self.text, low, high)
            self.known[low] = {m.end() if self.whole else m.start() for m in found} | {low, high}
        return at in self.known[low]


WORDS, GRAPHEMES = regex.compile(r"(?w)\b"), regex.compile(r"\X")


def _places(text: str) -> np.ndarray | range:
    """The UTF-16 offset of each character, and the end's."""
    if not text or max(text) <= "\uffff":
        return range(len(text) + 1)
    return np.concatenate(([0], np.cumsum(np.fromiter(map(units, text), np.int64, len(text)))))


def find(text: str, needle: str, match_case: bool = False, whole_words: bool = False) -> list[tuple[int, int, str, bool]]:
    """Matches that don't overlap: (start, end, text, safe) in source units.

    A match is safe if it starts and ends where source characters do, on grapheme boundaries, and its source
    span projects to the match and nothing more.
    """
    want = project(needle, match_case)[0]
    if not want:
        return []
    plain = text.isascii()
    shown = (text if match_case else text.lower()) if plain else None
    if plain and want not in shown:
        return []
    if not plain:
        shown, low, high = _spans(text, match_case)
        if want not in shown:
            return []
    words = _Edges(shown, WORDS, False) if whole_words else None
    graphemes = _Edges(text, GRAPHEMES, True)
    at = _places(shown)
    source = _places(text)
    raw = None if plain else text.encode("utf-16-le", "surrogatepass")
    out, start = [], 0
    while (k := shown.find(want, start)) >= 0:
        start = k + len(want)
        if words is not None and not (words.holds(k) and words.holds(start)):
            continue
        if plain:
            out.append((k, start, text[k:start], "\r" not in text or (graphemes.holds(k) and graphemes.holds(start))))
            continue
        a, b = int(at[k]), int(at[start])
        s, e = int(low[a:b].min()), int(high[a:b].max())
        near = slice(max(0, a - 64), b + 64)
        own = np.flatnonzero((low[near] < e) & (high[near] > s)) + near.start
        inside = bool(((own >= a) & (own < b)).all())
        first, last = (int(np.searchsorted(source, v)) for v in (s, e))
        safe = inside and source[first] == s and source[last] == e and graphemes.holds(first) and graphemes.holds(last)
        out.append((s, e, raw[2 * s : 2 * e].decode("utf-16-le", "surrogatepass"), safe))
    return out


@F.arrow_udf(PROJECTION)
def project_udf(text: pa.Array) -> pa.Array:
    rows = [None if t is None else _spans(t, False) for t in text.to_pylist()]
    sizes = [0 if r is None else len(r[1]) for r in rows]
    low, high = (np.concatenate([np.empty(0, np.int32), *[r[i] for r in rows if r is not None]]).astype(np.int32) for i in (1, 2))
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(low), pa.array(high)], ["s", "e"]))
    return pa.StructArray.from_arrays([pa.array([r and r[0] for r in rows], pa.string()), spans], ["text", "spans"], mask=pa.array([r is None for r in rows], pa.bool_()))


def find_udf(needle: str, match_case: bool = False, whole_words: bool = False):
    """Column function text -> array of MATCH."""

    @F.arrow_udf(MATCH)
    def found(text: pa.Array) -> pa.Array:
        names = ("start", "end", "text", "safe")
        rows = [[dict(zip(names, m, strict=True)) for m in find(t or "", needle, match_case, whole_words)] for t in text.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("safe", pa.bool_())])))

    return found


@F.arrow_udf(T.BooleanType())
def is_rtl(text: pa.Array) -> pa.Array:
    """Whether the first strong character runs from right to left; false without one."""

    def rtl(t: str | None) -> bool:
        for c in t or "":
            kind = unicodedata.bidirectional(c)
            if kind in ("L", "R", "AL"):
                return kind != "L"
        return False

    return pa.array([rtl(t) for t in text.to_pylist()], pa.bool_())
