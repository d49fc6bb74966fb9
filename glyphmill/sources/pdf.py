"""Text-showing operators and glyphs of PDF files, by a small reader in plain Python.

It reads what the object model needs and no more: indirect objects (also in object streams), Flate and plain
streams, the page tree, form XObjects, fonts (see fonts.py), and the content operators that place text, paths
and images. What it can't read becomes a row with a reason, never a guess. Files arrive as Spark's binaryFile
rows, so reading is spread over the executors, a file a row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.fonts import Font
from glyphmill.sources.tables import binary_documents

MAX_DEPTH, MAX_STREAM = 64, 64 << 20
SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"


class Name(str):
    """A name object; a str of its own so that it differs from a keyword."""


class Ref(tuple):
    """(number, generation) of an indirect object."""


@dataclass
class Stream:
    info: dict
    raw: bytes


class Keyword(str):
    pass


def tokens(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, object]]:
    """(offset, token) of PDF syntax: numbers, strings as bytes, names, keywords and brackets."""
    end = len(data) if end is None else end
    while at < end:
        c = data[at : at + 1]
        if c in SPACE and c:
            at += 1
        elif c == b"%":
            while at < end and data[at : at + 1] not in b"\r\n":
                at += 1
        elif c == b"(":
            start, depth, out = at, 1, bytearray()
            at += 1
            while at < end and depth:
                c = data[at : at + 1]
                if c == b"\\":
                    octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
                    if octal:
                        out.append(int(octal[0], 8) & 255)
                        at = octal.end()
                        continue
                    n = data[at + 1 : at + 2]
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}.get(n, n)
                    at += 3 if n == b"\r" and data[at + 2 : at + 3] == b"\n" else 2
                    continue
                depth += (c == b"(") - (c == b")")
                if depth:
                    out += c
                at += 1
            yield start, bytes(out)
        elif data[at : at + 2] in (b"<<", b">>"):
            yield at, Keyword(data[at : at + 2].decode())
            at += 2
        elif c == b"<":
            close = data.find(b">", at, end)
            close = end if close < 0 else close
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:close])
            yield at, bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            at = close + 1
        elif c in b"[]{})>":
            yield at, Keyword(c.decode())
            at += 1
        else:
            start = at
            at += 1
            while at < end and data[at : at + 1] not in SPACE and data[at : at + 1] not in DELIMITERS:
                at += 1
            word = data[start:at]
            if c == b"/":
                yield start, Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), word).decode("latin-1"))
            else:
                try:
                    yield start, float(word) if b"." in word else int(word)
                except ValueError:
                    yield start, Keyword(word.decode("latin-1"))


class Document:
    """The objects of a file. A repeated object number means the last one, as with appended revisions."""

    def __init__(self, data: bytes):
        self.data, self.objects, self.trailer = data, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b", data):
            self.objects[int(m[1])] = m.end()
        self.cache: dict[int, object] = {}
        for m in re.finditer(rb"\btrailer\b", data):
            self.trailer |= self._parse(m.end())[0] or {}
        for n in list(self.objects):
            o = self.get(Ref((n, 0)))
            if isinstance(o, Stream) and o.info.get("/Type") == "/ObjStm":
                self._unpack(o)
            elif isinstance(o, Stream) and o.info.get("/Type") == "/XRef":
                self.trailer |= o.info
        self.encrypted = "/Encrypt" in self.trailer

    def _unpack(self, o: Stream) -> None:
        body, n, first = self.content(o), self.get(o.info.get("/N")), self.get(o.info.get("/First"))
        head = [t for _, t in tokens(body, 0, first)]
        for number, at in list(zip(head[::2], head[1::2], strict=False))[: int(n)]:
            if number not in self.objects:
                self.cache[number] = self._parse(first + at, body)[0]

    def _parse(self, at: int, data: bytes | None = None) -> tuple[object, int]:
        data = self.data if data is None else data
        stack: list[list] = [[]]
        for off, t in tokens(data, at):
            if isinstance(t, Keyword):
                if t in ("[", "<<"):
                    stack.append([])
                    continue
                if t in ("]", ">>") and len(stack) > 1:
                    items = stack.pop()
                    t = items if t == "]" else dict(zip(items[::2], items[1::2], strict=False))
                elif t == "R" and len(stack[-1]) >= 2:
                    g, n = stack[-1].pop(), stack[-1].pop()
                    t = Ref((n, g))
                elif t == "stream":
                    info = stack[0][0] if stack[0] else {}
                    start = off + 6
                    start += 2 if data[start : start + 2] == b"\r\n" else 1
                    length = info.get("/Length")
                    length = self.get(length) if isinstance(length, Ref) else length
                    stop = start + length if isinstance(length, int) and data[start + length : start + length + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", start)
                    return Stream(info, data[start:stop]), stop
                elif t in ("endobj", "obj", "startxref", "xref"):
                    break
                else:
                    t = {"true": True, "false": False, "null": None}.get(t, t)
            stack[-1].append(t)
            if len(stack) == 1 and isinstance(stack[0][0], (bytes, Name, list)):
                break
            if len(stack) == 1 and isinstance(stack[0][0], dict) and not data[off + 2 : off + 40].lstrip(SPACE).startswith(b"stream"):
                break
        if len(stack[0]) == 1 or stack[0]:
            return stack[0][0], at
        return None, at

    def get(self, o: object) -> object:
        for _ in range(MAX_DEPTH):
            if not isinstance(o, Ref):
                return o
            n = o[0]
            if n not in self.cache:
                self.cache[n] = None  # an object that refers to itself is null
                self.cache[n] = self._parse(self.objects[n])[0] if n in self.objects else None
            o = self.cache[n]
        return None

    def content(self, s: Stream) -> bytes:
        filters = self.get(s.info.get("/Filter"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        out = s.raw
        for f in filters:
            if self.get(f) != "/FlateDecode":
                raise ValueError(f"unsupported filter {f}")
            d = zlib.decompressobj()
            out = d.decompress(out, MAX_STREAM)
            if d.unconsumed_tail:
                raise ValueError("stream over the size limit")
        return out

    def pages(self) -> list[dict]:
        """The pages in order, with what they inherit; a page tree that loops is walked once."""
        root = self.get(self.trailer.get("/Root")) or {}
        out, seen = [], set()

        def walk(ref: object, inherited: dict, depth: int) -> None:
            key = tuple(ref) if isinstance(ref, Ref) else id(ref)
            node = self.get(ref)
            if key in seen or depth > MAX_DEPTH or not isinstance(node, dict):
                return
            seen.add(key)
            own = inherited | {k: node[k] for k in ("/Resources", "/MediaBox", "/CropBox", "/Rotate") if k in node}
            if node.get("/Type") == "/Page" or "/Kids" not in node:
                out.append(own | node)
                return
            for kid in self.get(node["/Kids"]) or []:
                walk(kid, own, depth + 1)

        walk(root.get("/Pages"), {}, 0)
        return out


def times(a: tuple, b: tuple) -> tuple:
    """The matrix a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


@dataclass
class State:
    ctm: tuple = IDENTITY
    font: str = ""
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    rise: float = 0.0
    leading: float = 0.0
    mode: int = 0
    fill: str = "0"
    clipped: bool = False
    fonts: dict = field(default_factory=dict)

    def copy(self) -> State:
        return State(**self.__dict__)


# Operators and rulings of a page beyond which it has none, levels of saved states, and how far from
# level or upright a ruling may be.
MOST_OPERATORS, MOST_RULINGS, MOST_SAVED, SLANT = 100_000, 4096, 128, 0.01


class Rulings:
    """The straight lines that a page strokes. Anything unsure leaves them out: a curve or a slanting line its path, a clip
    what is drawn until it ends, and broken syntax the page."""

    def __init__(self):
        self.found: list[tuple] = []
        self.usable, self.n_saved, self.n_operators = True, 0, 0
        self._begin()

    def _begin(self) -> None:
        self.path: list[tuple] = []
        self.at = self.start = None
        self.plain = True

    def _line(self, end: tuple | None) -> None:
        if self.at is None or end is None or not all(math.isfinite(v) for v in (*self.at, *end)):
            self.plain = False
        elif abs(self.at[0] - end[0]) > SLANT and abs(self.at[1] - end[1]) > SLANT:
            self.plain = False
        elif self.at != end:
            self.path.append((*self.at, *end))
        self.at = end

    def saw(self, op: str, v: list, state: State, offset: int) -> None:
        """An operator, with the state that it is drawn in."""
        self.n_saved += (op == "q") - (op == "Q")
        if not 0 <= self.n_saved <= MOST_SAVED or self.n_operators > MOST_OPERATORS or len(self.path) + len(self.found) > MOST_RULINGS:
            self.usable = False

        def point(x: float, y: float) -> tuple:
            return times((1.0, 0.0, 0.0, 1.0, x, y), state.ctm)[4:]

        if op == "m":
            self.at = self.start = point(v[0], v[1])
        elif op == "l":
            self._line(point(v[0], v[1]))
        elif op == "h" and self.start:
            self._line(self.start)
        elif op == "re":
            x, y, w, h = v[:4]
            self.at = self.start = point(x, y)
            for corner in ((x + w, y), (x + w, y + h), (x, y + h), (x, y)):
                self._line(point(*corner))
        elif op in ("c", "v", "y"):
            self.plain = False
        elif op in ("W", "W*"):
            state.clipped = True
        elif op in ("S", "s", "B", "B*", "b", "b*", "f", "F", "f*", "n"):
            if op in ("s", "b", "b*") and self.start:
                self._line(self.start)
            if op not in ("f", "F", "f*", "n") and self.plain and not state.clipped:
                self.found += [(offset, *p) for p in self.path]
            self._begin()

    def rows(self) -> Iterator[dict]:
        """The rulings in device space, each from its lower left end."""
        for offset, a, b, c, d in self.found if self.usable else ():
            yield {"kind": "ruling", "op_offset": offset, "x": min(a, c), "y": min(b, d), "dx": abs(a - c), "dy": abs(b - d), "path": []}


PATHS = ("m", "l", "re", "h", "c", "v", "y", "W", "W*", "n", "f", "F", "f*", "S", "s", "B", "B*", "b", "b*")


def walk(doc: Document, page: dict, body: bytes, resources: dict, state: State, path: tuple, depth: int, rulings: Rulings | None = None) -> Iterator[dict]:
    """Rows of a content stream: kind glyph, image, path or form, with place, font and offsets; forms are walked too. rulings takes in a page's lines."""
    stack: list[State] = []
    tm = tlm = IDENTITY
    operands: list[object] = []
    fonts, xobjects = doc.get(resources.get("/Font")) or {}, doc.get(resources.get("/XObject")) or {}
    arrays: list[list] = []

    def show(s: bytes, offset: int, item: int | None) -> Iterator[dict]:
        nonlocal tm
        font = state.fonts.get(state.font) or state.fonts.setdefault(state.font, Font(doc.get, doc.content, tokens, doc.get(fonts.get(state.font)) or {}))
        for i, code, ch, width in font.codes(s):
            trm = times((state.size * state.scale, 0.0, 0.0, state.size, 0.0, state.rise), times(tm, state.ctm))
            wide = (width / 1000 * state.size + state.char_space + (state.word_space if code == 32 and font.n_bytes == 1 else 0.0)) * state.scale
            moved = times((1.0, 0.0, 0.0, 1.0, wide, 0.0), tm)
            end = times((1.0, 0.0, 0.0, 1.0, 0.0, 0.0), times(moved, state.ctm))
            yield {
                "kind": "glyph", "op_offset": offset, "item": item, "byte": i, "code": code, "ch": ch, "x": trm[4], "y": trm[5],
                "dx": end[4] - times(tm, state.ctm)[4], "dy": end[5] - times(tm, state.ctm)[5], "em": (trm[2] ** 2 + trm[3] ** 2) ** 0.5, "font": font.name, "mode": state.mode, "visible": state.mode not in (3, 7), "rise": state.rise, "fill": state.fill,
            }
            tm = moved

    for offset, t in tokens(body):
        if not isinstance(t, Keyword) or t in ("[", "]", "<<", ">>"):
            if t == "[":
                arrays.append([])
            elif t == "]" and arrays:
                done = arrays.pop()
                (arrays[-1] if arrays else operands).append(done)
            else:
                (arrays[-1] if arrays else operands).append(t)
            continue
        n, rows = operands, []
        if rulings:
            rulings.n_operators += 1
        try:
            if rulings and (t in PATHS or t in ("q", "Q")):
                rulings.saw(t, [float(v) for v in n], state, offset)
            if t == "q":
                stack.append(state.copy())
            elif t == "Q":
                state = stack.pop() if stack else state
            elif t == "cm":
                state.ctm = times(tuple(map(float, n[-6:])), state.ctm)
            elif t == "BT":
                tm = tlm = IDENTITY
            elif t == "Tf":
                state.font, state.size = str(n[-2]), float(n[-1])
            elif t in ("Td", "TD"):
                state.leading = -float(n[-1]) if t == "TD" else state.leading
                tm = tlm = times((1.0, 0.0, 0.0, 1.0, float(n[-2]), float(n[-1])), tlm)
            elif t == "Tm":
                tm = tlm = tuple(map(float, n[-6:]))
            elif t in ("T*", "'", '"'):
                if t == '"':
                    state.word_space, state.char_space = float(n[-3]), float(n[-2])
                tm = tlm = times((1.0, 0.0, 0.0, 1.0, 0.0, -state.leading), tlm)
                rows = show(n[-1], offset, None) if t != "T*" else []
            elif t in ("Tc", "Tw", "Tz", "Ts", "TL", "Tr"):
                name = {"Tc": "char_space", "Tw": "word_space", "Tz": "scale", "Ts": "rise", "TL": "leading", "Tr": "mode"}[t]
                setattr(state, name, int(n[-1]) if t == "Tr" else float(n[-1]) / (100 if t == "Tz" else 1))
            elif t in ("g", "rg", "k", "sc", "scn"):
                state.fill = " ".join(str(v) for v in n)
            elif t == "Tj":
                rows = show(n[-1], offset, None)
            elif t == "TJ":
                for i, item in enumerate(n[-1]):
                    if isinstance(item, bytes):
                        for r in show(item, offset, i):
                            yield r | {"path": list(path)}
                    else:
                        tm = times((1.0, 0.0, 0.0, 1.0, -float(item) / 1000 * state.size * state.scale, 0.0), tm)
            elif t in ("re", "f", "F", "f*", "S", "s", "B", "B*", "b", "b*"):
                rows = [{"kind": "path", "op_offset": offset}]
            elif t == "Do":
                ref = xobjects.get(n[-1])
                x = doc.get(ref)
                if isinstance(x, Stream) and x.info.get("/Subtype") == "/Image":
                    corners = [times((1, 0, 0, 1, a, b), state.ctm)[4:] for a in (0, 1) for b in (0, 1)]
                    xs, ys = zip(*corners, strict=True)
                    rows = [{"kind": "image", "op_offset": offset, "x": min(xs), "y": min(ys), "dx": max(xs) - min(xs), "dy": max(ys) - min(ys)}]
                elif isinstance(x, Stream) and isinstance(ref, Ref) and ref[0] not in path and depth < MAX_DEPTH:
                    inner = state.copy()
                    matrix = [float(doc.get(v)) for v in doc.get(x.info.get("/Matrix")) or IDENTITY]
                    inner.ctm, inner.fonts = times(tuple(matrix), state.ctm), {}
                    yield {"kind": "form", "op_offset": offset, "code": ref[0], "path": list(path)}
                    yield from walk(doc, page, doc.content(x), doc.get(x.info.get("/Resources")) or resources, inner, (*path, ref[0]), depth + 1)
            for r in rows:
                yield r | {"path": list(path)}
        except (IndexError, TypeError, ValueError) as e:
            if rulings and (t in PATHS or t == "cm"):
                rulings.usable = False
            said = str(e) if str(e) == "codes of unknown width" else f"malformed operands of {t}"
            yield {"kind": "refused", "op_offset": offset, "ch": said, "path": list(path)}
        operands = []


SCHEMA = (
    "path string, source_hash string, page int, part int, ord int, kind string, op_offset long, item int, byte int, code int, ch string, x double, y double, dx double, dy double, em double, "
    "font string, mode int, visible boolean, rise double, fill string, xobj_path array<int>, media_box array<double>, rotation int"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])


def rows_of(path: str, source_hash: str, data: bytes) -> Iterator[dict]:
    """All rows of a file; one of kind refused for a file or page that can't be read."""
    base = {"path": path, "source_hash": source_hash}
    if not data.startswith(b"%PDF"):
        yield base | {"kind": "refused", "ch": "not a PDF"}
        return
    doc = Document(data)
    if doc.encrypted:
        yield base | {"kind": "refused", "ch": "encrypted"}
        return
    for number, page in enumerate(doc.pages()):
        contents = doc.get(page.get("/Contents"))
        parts = contents if isinstance(contents, list) else [page.get("/Contents")] if contents else []
        box = [float(doc.get(v)) for v in doc.get(page.get("/MediaBox")) or (0, 0, 612, 792)]
        place = base | {"page": number, "media_box": box, "rotation": int(doc.get(page.get("/Rotate")) or 0) % 360}
        yield place | {"kind": "page", "ord": -1}
        try:
            bodies = [doc.content(s) for p in parts if isinstance(s := doc.get(p), Stream)]
        except (ValueError, zlib.error) as e:
            yield place | {"kind": "refused", "ch": str(e)}
            continue
        starts = [0]
        for b in bodies:
            starts.append(starts[-1] + len(b) + 1)
        rulings = Rulings()
        rows = walk(doc, page, b"\n".join(bodies), doc.get(page.get("/Resources")) or {}, State(), (), 0, rulings)
        for i, r in enumerate(r for found in (rows, rulings.rows()) for r in found):
            part = max(k for k, s in enumerate(starts[:-1] or [0]) if s <= r["op_offset"]) if not r["path"] else 0
            yield place | r | {"path": path, "xobj_path": r["path"], "ord": i, "part": part, "op_offset": r["op_offset"] - (starts[part] if not r["path"] else 0)}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, digest, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held = []
            try:
                for r in rows_of(path, digest, data or b""):
                    held.append(r)
                    if len(held) >= 20_000:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
            except (ValueError, TypeError, KeyError, RecursionError) as e:
                held.append({"path": path, "source_hash": digest, "kind": "refused", "ch": f"unreadable: {type(e).__name__}"})
            if held:
                yield pa.RecordBatch.from_pylist(held, _ARROW)


def content(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Rows of SCHEMA for the PDF files under path: pages, glyphs, images, paths, rulings, forms and refusals."""
    return scan(binary_documents(spark, path, pattern))


def scan(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA for files (path, source_hash, content)."""
    return files.select("path", "source_hash", "content").mapInArrow(_scan, SCHEMA)


def glyphs(rows: DataFrame) -> DataFrame:
    """The glyphs of content(), in the columns of the clustering operators."""
    return rows.where("kind = 'glyph'").select(
        "source_hash", "page", "part", "xobj_path", "ord", "op_offset", "ch", "x", "y", F.col("dx").alias("advance"), "em", F.col("font").alias("font_id"), "visible", F.col("fill").alias("fill_color"), "rise"
    )


def page_facts(rows: DataFrame) -> DataFrame:
    """(source_hash, page, visible, invisible, n_images, n_paths): what the page bucket is decided on."""
    return rows.where("page IS NOT NULL").groupBy("source_hash", "page").agg(
        F.count_if((F.col("kind") == "glyph") & F.col("visible")).alias("visible"), F.count_if((F.col("kind") == "glyph") & ~F.col("visible")).alias("invisible"),
        F.count_if(F.col("kind") == "image").alias("n_images"), F.count_if(F.col("kind") == "path").alias("n_paths"))
