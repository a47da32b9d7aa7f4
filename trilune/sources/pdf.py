"""Text of a PDF file: objects, pages in order, content streams, fonts' code maps.

What is read: objects, also those in object streams, streams as they are or deflated, the tree of pages with what it hands down, and the
operators that show text and move the place where it is shown. Codes of a font become characters by its ToUnicode map, else by
its encoding with its differences. A move to another height begins a line; a gap of more than a fifth of a letter inside a line is
a blank. Encrypted files are an error, other filters give no text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass

#: Gap in thousandths of the font's size from which it is a blank.
GAP = 200
_TOKEN = re.compile(rb"(?:\s|%[^\r\n]*)*(<<|>>|[\[\]]|/[^\s()<>\[\]{}/%]*|<[0-9A-Fa-f\s]*>|\(|[+-]?(?:\d+\.?\d*|\.\d+)(?![^\s()<>\[\]{}/%])|[^\s()<>\[\]{}/%]+|[{}])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Names of marks over letters in glyph names such as eacute.
_MARKS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "ring": "̊", "cedilla": "̧", "caron": "̌"}


@dataclass(frozen=True)
class Ref:
    number: int


class Operator(bytes):
    """A word that is no value."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket was opened just before `at`, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal.group(), 8) & 255)
                at += octal.end()
            else:
                n = data[at : at + 1]
                at += 1
                out += b"" if n in b"\r\n" else _ESCAPES.get(n, n)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def values(data: bytes):
    """Values and operators one after the other; dictionaries, arrays and references whole."""
    stack: list[list] = [[]]
    marks: list[bytes] = []
    at = 0
    while m := _TOKEN.match(data, at):
        word, at = m.group(1), m.end()
        top = stack[-1]
        if word in (b"<<", b"["):
            stack.append([])
            marks.append(word)
        elif word in (b">>", b"]"):
            if len(stack) == 1:
                continue
            made = stack.pop()
            if marks.pop() == b"<<":
                made = {k: v for k, v in zip(made[::2], made[1::2], strict=False) if isinstance(k, str)}
            stack[-1].append(made)
        elif word == b"(":
            text, at = literal(data, at)
            top.append(text)
        elif word[:1] == b"<":
            digits = re.sub(rb"[<>\s]", b"", word)
            top.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif word[:1] == b"/":
            top.append(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x.group(1), 16)), word[1:].decode("latin-1")))
        elif word == b"R" and len(top) >= 2 and isinstance(top[-2], int):
            number = top[-2]
            del top[-2:]
            top.append(Ref(number))
        elif re.fullmatch(rb"[+-]?\d+", word):
            top.append(int(word))
        elif re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            top.append(float(word))
        else:
            top.append(Operator(word))
        if len(stack) == 1:
            yield from _complete(stack[0])


def _complete(row: list):
    """Hands on values, but for integers that a reference may still take up."""
    while row and not (len(row) <= 2 and all(isinstance(x, int) for x in row)):
        yield row.pop(0)


def one(data: bytes):
    return next((v for v in [*values(data + b" null ")] if not isinstance(v, Operator)), None)


class Document:
    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.raw: dict[int, tuple[bytes, bytes | None]] = {}
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, _, rest = m.group(2).partition(b"stream")
            has = rest and re.match(rb"\r?\n", rest)
            body = re.sub(rb"\r?\n?endstream\s*$", b"", rest[has.end() :]) if has else None
            self.raw[int(m.group(1))] = (head if has else m.group(2), body)
        for number in list(self.raw):
            kind = self.value(Ref(number))
            if isinstance(kind, dict) and kind.get("Type") == "ObjStm":
                inside, first = self.stream(number), kind.get("First", 0)
                pairs = [v for v in values(inside[:first] + b" null ") if isinstance(v, int)]
                starts = pairs[1::2]
                for n, a, b in zip(pairs[::2], starts, [*starts[1:], len(inside)], strict=False):
                    self.raw.setdefault(n, (inside[first + a : first + b], None))

    def value(self, x):
        """What a reference leads to; other values as they are."""
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            x = one(self.raw[x.number][0]) if x.number in self.raw else None
        return None

    def stream(self, number: int) -> bytes:
        head, body = self.raw.get(number, (b"", None))
        if body is None:
            return b""
        kind = one(head)
        filters = self.value(kind.get("Filter")) if isinstance(kind, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f not in ("FlateDecode", "Fl"):
                return b""
            body = zlib.decompressobj().decompress(body)
        return body

    def pages(self) -> list[dict]:
        """Pages in order, each with the resources that it has or inherits."""
        roots = [v for n in self.raw if isinstance(v := self.value(Ref(n)), dict) and v.get("Type") == "Catalog"]
        out: list[dict] = []

        def walk(node, handed, depth):
            node = self.value(node)
            if not isinstance(node, dict) or depth > 50:
                return
            resources = node.get("Resources", handed)
            kids = self.value(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        for root in roots[-1:]:
            walk(root.get("Pages"), None, 0)
        return out or [v for n in sorted(self.raw) if isinstance(v := self.value(Ref(n)), dict) and v.get("Type") == "Page"]


def glyph(name: str) -> str:
    """The character of a glyph's name."""
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m.group(1) or m.group(2), 16))
    for mark, sign in _MARKS.items():
        if name.endswith(mark) and len(name) == len(mark) + 1:
            return unicodedata.normalize("NFC", name[0] + sign)
    return {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "quoteright": "’", "endash": "–", "fi": "fi", "fl": "fl"}.get(name, "")


@dataclass
class Font:
    width: int  # bytes of a code
    codes: dict[int, str]

    def text(self, data: bytes) -> str:
        n = self.width
        return "".join(self.codes.get(int.from_bytes(data[i : i + n], "big"), "") for i in range(0, len(data), n))


def code_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and characters by code, of a ToUnicode map."""
    codes, width = {}, 0
    number, chars = lambda b: int.from_bytes(b, "big"), lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)end(?:bfchar|bfrange)", data, re.S):
        row = [v for v in values(body + b" null ") if not isinstance(v, Operator)]
        per = 2 if kind == b"bfchar" else 3
        for i in range(0, len(row) - per + 1, per):
            low, high, to = row[i], row[i + per - 2], row[i + per - 1]
            width = width or len(low)
            for k in range(number(high) - number(low) + 1 if per == 3 else 1):
                if isinstance(to, list):
                    codes[number(low) + k] = chars(to[k]) if k < len(to) else ""
                else:
                    codes[number(low) + k] = chars(to[:-2] + ((number(to[-2:]) + k) & 0xFFFF).to_bytes(2, "big"))
    return width or 1, codes


def font_of(doc: Document, font) -> Font:
    font = doc.value(font)
    font = font if isinstance(font, dict) else {}
    if isinstance(font.get("ToUnicode"), Ref):
        return Font(*code_map(doc.stream(font["ToUnicode"].number)))
    if font.get("Subtype") == "Type0":
        return Font(2, {})
    codes = {i: bytes([i]).decode("cp1252", "replace") for i in range(256)}
    encoding = doc.value(font.get("Encoding"))
    at = 0
    for x in doc.value(encoding.get("Differences")) or [] if isinstance(encoding, dict) else []:
        if isinstance(x, int):
            at = x
        elif isinstance(x, str):
            codes[at] = glyph(x)
            at += 1
    return Font(1, codes)


def page_text(doc: Document, page: dict) -> str:
    resources = doc.value(page.get("Resources")) or {}
    named = doc.value(resources.get("Font")) or {} if isinstance(resources, dict) else {}
    fonts = {n: font_of(doc, f) for n, f in named.items()}
    contents = page.get("Contents")
    contents = doc.value(contents) if isinstance(contents, Ref) and isinstance(doc.value(contents), list) else contents
    data = b"\n".join(doc.stream(c.number) for c in (contents if isinstance(contents, list) else [contents]) if isinstance(c, Ref))
    out, held, font, height = [""], [], Font(1, {i: chr(i) for i in range(256)}), None

    def line():
        if out[-1].strip():
            out.append("")

    def blank():
        if out[-1] and not out[-1].endswith(" "):
            out[-1] += " "

    def moved(y):
        nonlocal height
        blank() if y == height else line()
        height = y

    for v in values(data + b" null "):
        if not isinstance(v, Operator):
            held.append(v)
            continue
        numbers = [x for x in held if isinstance(x, int | float)]
        if v == b"Tf" and held:
            font = fonts.get(held[0], font)
        elif v in (b"Td", b"TD") and len(numbers) >= 2:
            moved(height if numbers[1] == 0 else (height or 0) + numbers[1])
        elif v == b"Tm" and len(numbers) >= 6:
            moved(numbers[5])
        elif v in (b"T*", b"BT"):
            line()
            height = None if v == b"BT" else height
        elif v in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytes):
            if v != b"Tj":
                line()
            out[-1] += font.text(held[-1])
        elif v == b"TJ" and held and isinstance(held[-1], list):
            for x in held[-1]:
                if isinstance(x, bytes):
                    out[-1] += font.text(x)
                elif isinstance(x, int | float) and x < -GAP:
                    blank()
        held = []
    return "\n".join(x.strip() for x in out if x.strip())


def text(data: bytes) -> str:
    """The text of all pages, a line per line shown."""
    doc = Document(data)
    return "\n".join(t for p in doc.pages() if (t := page_text(doc, p)))
