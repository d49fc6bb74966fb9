"""Codes, characters and widths of PDF fonts, from what the font's dictionary tells and no guess.

A character comes from the font's ToUnicode map, else, for simple fonts, from the name that its encoding gives the
code; a composite font's code without a map has none. A symbolic font without an encoding has its own, which only
its program knows, so its characters are unknown.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

# Names of characters that no rule below tells, each before its character; and where the standard
# encoding departs from ASCII.
NAMES = """space \\u0020 exclam ! quotedbl " numbersign # dollar $ percent % ampersand & quotesingle ' parenleft ( parenright ) asterisk * plus + comma , hyphen - period . slash /
zero 0 one 1 two 2 three 3 four 4 five 5 six 6 seven 7 eight 8 nine 9 colon : semicolon ; less < equal = greater > question ? at @ bracketleft [ backslash \\ bracketright ]
asciicircum ^ underscore _ grave ` braceleft { bar | braceright } asciitilde ~ exclamdown ¡ cent ¢ sterling £ fraction ⁄ yen ¥ florin ƒ section § currency ¤ quotedblleft “ guillemotleft «
guilsinglleft ‹ guilsinglright › fi ﬁ fl ﬂ ff ﬀ ffi ﬃ ffl ﬄ endash – dagger † daggerdbl ‡ periodcentered · paragraph ¶ bullet • quotesinglbase ‚ quotedblbase „ quotedblright ” guillemotright »
ellipsis … perthousand ‰ questiondown ¿ acute ´ circumflex ˆ tilde ˜ macron ¯ breve ˘ dotaccent ˙ dieresis ¨ ring ˚ cedilla ¸ hungarumlaut ˝ ogonek ˛ caron ˇ emdash — quoteleft ‘ quoteright ’
AE Æ ordfeminine ª Lslash Ł Oslash Ø OE Œ ordmasculine º ae æ dotlessi ı lslash ł oslash ø oe œ germandbls ß Eth Ð eth ð Thorn Þ thorn þ Euro € copyright © registered ® trademark ™ degree °
plusminus ± multiply × divide ÷ minus − mu µ brokenbar ¦ logicalnot ¬ onesuperior ¹ twosuperior ² threesuperior ³ onehalf ½ onequarter ¼ threequarters ¾ nbspace \\u00a0 softhyphen \\u00ad""".split()
ACCENTS = {"grave": "\u0300", "acute": "\u0301", "circumflex": "\u0302", "tilde": "\u0303", "macron": "\u0304", "breve": "\u0306", "dotaccent": "\u0307", "dieresis": "\u0308", "ring": "\u030a", "hungarumlaut": "\u030b", "caron": "\u030c", "commaaccent": "\u0327", "cedilla": "\u0327", "ogonek": "\u0328"}
STANDARD = {0x27: "’", 0x60: "‘"} | dict(zip([*range(0xA1, 0xB0), 0xB1, 0xB2, 0xB3, 0xB4, *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, 0xE8, 0xE9, 0xEA, 0xEB, 0xF1, 0xF5, 0xF8, 0xF9, 0xFA, 0xFB],
    "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß", strict=True))
CODECS = {"/WinAnsiEncoding": "cp1252", "/MacRomanEncoding": "mac_roman"}
SYMBOLIC = 4


@cache
def _named() -> dict[str, str]:
    words = [w.encode().decode("unicode_escape") if w.startswith("\\u") else w for w in NAMES]
    return dict(zip(words[::2], words[1::2], strict=True))


@cache
def character(name: str) -> str | None:
    """The character or characters that a glyph's name stands for, null if it tells none."""
    base = name.partition(".")[0]
    if "_" in base:
        parts = [character(p) for p in base.split("_")]
        return None if None in parts else "".join(parts)
    if base in _named():
        return _named()[base]
    if len(base) == 1 and base.isalpha():
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return bytes.fromhex(m[1]).decode("utf-16-be", "ignore") or None
    if (m := re.fullmatch(r"u([0-9A-F]{4,6})", base)) and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    if base[1:] in ACCENTS and base[:1].isalpha():
        made = unicodedata.normalize("NFC", base[0] + ACCENTS[base[1:]])
        return made if len(made) == 1 else None
    return None


def base_encoding(name: str | None) -> dict[int, str]:
    """Code to character of a named encoding; the standard one for no name or one that is unknown."""
    if name in CODECS:
        return {c: t for c in range(32, 256) if (t := bytes([c]).decode(CODECS[name], "ignore"))}
    return {c: chr(c) for c in range(32, 127)} | STANDARD


def simple_encoding(get: Callable, font: dict) -> dict[int, str]:
    """Code to character of a simple font: its base encoding under its differences; only these, where the base is the program's."""
    encoding, descriptor = get(font.get("/Encoding")), get(font.get("/FontDescriptor")) or {}
    symbolic = bool(int(get(descriptor.get("/Flags")) or 0) & SYMBOLIC)
    if isinstance(encoding, str):
        return base_encoding(encoding)
    if not isinstance(encoding, dict):
        return {} if symbolic else base_encoding(None)
    base = get(encoding.get("/BaseEncoding"))
    out = base_encoding(base) if base or not symbolic else {}
    code = 0
    for item in get(encoding.get("/Differences")) or []:
        item = get(item)
        if isinstance(item, (int, float)):
            code = int(item)
        else:
            said = character(str(item).removeprefix("/"))
            out.pop(code, None)
            out |= {code: said} if said else {}
            code += 1
    return out


def unicode_map(tokens: Iterator[tuple[int, object]]) -> dict[bytes, str]:
    """Code, as bytes, to characters, of a ToUnicode map's tokens."""

    def text(b: bytes) -> str:
        return b.decode("utf-16-be", "ignore")

    out: dict[bytes, str] = {}
    held: list = []
    lists: list[list] = []
    for _, t in tokens:
        if t == "[" and not isinstance(t, bytes):
            lists.append([])
        elif t == "]" and lists:
            held.append(lists.pop())
        elif lists:
            lists[-1].append(t)
        elif isinstance(t, bytes):
            held.append(t)
        elif t == "endbfchar":
            out |= {a: text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(b, bytes)}
            held = []
        elif t == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                first, n = int.from_bytes(low, "big"), len(low)
                for k in range(min(int.from_bytes(high, "big") - first + 1, 1 << 16)):
                    if isinstance(to, list):
                        said = to[k] if k < len(to) and isinstance(to[k], bytes) else b""
                    else:
                        said = to[:-2] + ((int.from_bytes(to[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")
                    out[(first + k).to_bytes(n, "big")] = text(said)
            held = []
        elif isinstance(t, str) and t.startswith("begin"):
            held = []
    return {code: said for code, said in out.items() if said}


def code_widths(body: bytes) -> set[int]:
    """The numbers of bytes that a character map's codes have."""
    blocks = re.findall(rb"begincodespacerange(.*?)endcodespacerange", body, re.S)
    return {(len(re.sub(rb"\s", b"", h)) + 1) // 2 for b in blocks for h in re.findall(rb"<([0-9A-Fa-f\s]+)>", b)}


def cid_widths(items: list) -> dict[int, float]:
    """Code to width of a composite font's width array: lists from a code on, or one width for a range; what is cut short tells nothing."""
    out: dict[int, float] = {}
    i = 0
    while i + 1 < len(items):
        first, then = int(items[i]), items[i + 1]
        if isinstance(then, list):
            for k, w in enumerate(then):
                out.setdefault(first + k, float(w))
            i += 2
        elif i + 2 < len(items):
            for k in range(first, min(int(then), first + (1 << 16)) + 1):
                out.setdefault(k, float(items[i + 2]))
            i += 3
        else:
            break
    return out


class Font:
    """A font of a document: how strings fall into codes, and each code's character and width in thousandths of an em.

    get: resolves references; content: a stream's bytes; tokens: the syntax of these.
    """

    def __init__(self, get: Callable, content: Callable, tokens: Callable, font: dict):
        self.name = str(get(font.get("/BaseFont")) or get(font.get("/Name")) or "").lstrip("/")
        self.composite = get(font.get("/Subtype")) == "/Type0"
        self.n_bytes, self.missing = 1, 0.0
        self.map = self._read(lambda: unicode_map(tokens(content(get(font.get("/ToUnicode")))))) if font.get("/ToUnicode") else {}
        if self.composite:
            below = get((get(font.get("/DescendantFonts")) or [None])[0]) or {}
            encoding = get(font.get("/Encoding"))
            n = {2} if isinstance(encoding, str) and encoding.startswith("/Identity-") else set() if isinstance(encoding, str) or encoding is None else self._read(lambda: code_widths(content(encoding))) or set()
            self.n_bytes = n.pop() if len(n) == 1 else 0  # 0: strings can't be told apart into codes
            default = get(below.get("/DW"))
            self.missing = 1000.0 if default is None else float(default)
            known = self._read(lambda: cid_widths([get(v) if not isinstance(get(v), list) else [get(x) for x in get(v)] for v in get(below.get("/W")) or []]))
            self.widths = known if isinstance(encoding, str) else {}
            self.encoding: dict[int, str] = {}
            return
        self.encoding = simple_encoding(get, font)
        descriptor = get(font.get("/FontDescriptor")) or {}
        scale = 1.0
        if get(font.get("/Subtype")) == "/Type3":
            scale = float(get((get(font.get("/FontMatrix")) or [0.001])[0])) * 1000
        else:
            self.missing = float(get(descriptor.get("/MissingWidth")) or 500)
        first = int(get(font.get("/FirstChar")) or 0)
        self.widths = {first + k: float(get(w)) * scale for k, w in enumerate(get(font.get("/Widths")) or [])}

    @staticmethod
    def _read(what: Callable) -> dict | set:
        try:
            return what()
        except (ValueError, TypeError, AttributeError, OverflowError):
            return {}

    def codes(self, s: bytes) -> Iterator[tuple[int, int, str | None, float]]:
        """(offset, code, character, width) of each code of a string."""
        n = self.n_bytes
        if not n:
            raise ValueError("codes of unknown width")
        for at in range(0, len(s) - n + 1, n):
            raw = s[at : at + n]
            code = int.from_bytes(raw, "big")
            yield at, code, self.map.get(raw) or self.encoding.get(code), self.widths.get(code, self.missing)
