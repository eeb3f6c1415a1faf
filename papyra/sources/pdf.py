"""Text runs of PDF files: page tree, object streams, deflated contents and their text operators, with the standard library alone.

A file that can't be read is a ``PdfError``: no PDF, encrypted, a damaged stream, a filter other than FlateDecode, or contents
that inflate to more than ``MOST_BYTES`` (which bounds the work a hostile file can ask for). A file without a page tree is read as far as it goes: each
stream with text is a page.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

MOST_BYTES = 64 << 20
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(
    rb"[\x00\t\n\f\r ]+|%[^\r\n]*|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\f\r ()<>\[\]{}/%]|$))|/(?P<name>[^\x00\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<open><<|\[)|(?P<close>>>|\])|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<string>\()|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)|."
, re.S)
_IMAGE_END = re.compile(rb"\sEI(?=\s|$)")
_IN_STRING = re.compile(rb"[()\\]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


class Word(bytes):
    """An operator or keyword."""


class Name(bytes):
    pass


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins after the parenthesis before at, and where it ends."""
    out, depth = [], 1
    while m := _IN_STRING.search(data, at):
        out.append(data[at : m.start()])
        at = m.end()
        if m[0] == b"\\":
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
            elif data[at : at + 2] == b"\r\n":
                at += 2
            else:
                c = data[at : at + 1]
                out.append(b"" if c in (b"\n", b"\r") else _ESCAPES.get(c, c))
                at += 1
        else:
            depth += 1 if m[0] == b"(" else -1
            if not depth:
                return b"".join(out), at
            out.append(m[0])
    raise PdfError("a string without an end")


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Each token from at on, and where it ends; arrays and dictionaries as their brackets."""
    while m := _TOKEN.match(data, at):
        at, kind = m.end(), m.lastgroup
        if kind == "number":
            yield float(m["number"]), at
        elif kind == "name":
            yield Name(m["name"]), at
        elif kind == "string":
            text, at = literal(data, at)
            yield text, at
        elif kind == "hex":
            digits = b"".join(m["hex"].split())
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif kind in ("open", "close", "word"):
            yield Word(m[0]), at
            if m[0] == b"ID":  # an inline image's bytes are no tokens
                end = _IMAGE_END.search(data, at)
                at = end.end() if end else len(data)


def value(data: bytes, at: int = 0) -> object:
    """The object at this place: dict, list, number, string, Name, Word, or ("ref", number)."""
    stack: list[list] = [[]]
    for t, _ in tokens(data, at):
        if t in (b"<<", b"[") and isinstance(t, Word):
            stack.append([t])
            continue
        if t in (b">>", b"]") and isinstance(t, Word):
            if len(stack) == 1:
                break
            kind, *items = stack.pop()
            t = dict(zip(items[::2], items[1::2], strict=False)) if kind == b"<<" else items
        elif isinstance(t, Word) and t == b"R" and len(stack[-1]) >= 2 and isinstance(stack[-1][-2], float):
            t = ("ref", int(stack[-1][-2]))
            del stack[-1][-2:]
        elif isinstance(t, Word) and t in (b"stream", b"endobj"):
            break
        stack[-1].append(t)
        if len(stack) == 1 and isinstance(t, (dict, list)):
            return t
    return stack[0][0] if stack[0] else None


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise PdfError("not a PDF")
        self.left = MOST_BYTES
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            end = data.find(b"endobj", m.end())
            end = len(data) if end < 0 else end
            begin = _STREAM.search(data, m.end(), end)
            head = value(data[m.end() : begin.start() if begin else end])
            raw = None
            if begin:
                size = head.get(Name(b"Length")) if isinstance(head, dict) else None
                stop = begin.end() + int(size) if isinstance(size, float) and size >= 0 else -1
                if stop < 0 or not re.compile(rb"\s*endstream").match(data, stop):
                    stop = data.find(b"endstream", begin.end())
                    stop = len(data) if stop < 0 else stop
                raw = data[begin.end() : stop]
                end = max(end, stop)
            self.objects[int(m[1])] = (head, raw)
            at = end
        heads = [h for h, _ in self.objects.values() if isinstance(h, dict)]
        if b"/Encrypt" in data[data.rfind(b"trailer") :] or any(Name(b"Encrypt") in h for h in heads if h.get(Name(b"Type")) == b"XRef"):
            raise PdfError("encrypted")
        for number, (head, _) in list(self.objects.items()):
            if isinstance(head, dict) and head.get(Name(b"Type")) == b"ObjStm":
                body = self.stream(number)
                first, n = (int(head.get(Name(k), 0.0)) for k in (b"First", b"N"))
                places = [int(t) for t, _ in tokens(body[:first]) if isinstance(t, float)][: 2 * n]
                for inner, place in zip(places[::2], places[1::2], strict=False):
                    self.objects.setdefault(inner, (value(body, first + place), None))

    def get(self, x: object) -> object:
        for _ in range(32):
            if not (isinstance(x, tuple) and x[0] == "ref"):
                return x
            x = self.objects.get(x[1], (None, None))[0]
        raise PdfError("references without an end")

    def stream(self, number: int) -> bytes:
        """The inflated stream of an object."""
        head, raw = self.objects.get(number, (None, None))
        raw = raw or b""
        used = self.get(head.get(Name(b"Filter"))) if isinstance(head, dict) else None
        for f in used if isinstance(used, list) else [] if used is None else [used]:
            if f not in (b"FlateDecode", b"Fl"):
                raise PdfError(f"filter {f!r}")
            try:
                raw = zlib.decompressobj().decompress(raw, self.left + 1)
            except zlib.error as e:
                raise PdfError("a damaged stream") from e
        self.left -= len(raw)
        if self.left < 0:
            raise PdfError(f"contents of more than {MOST_BYTES} bytes")
        return raw

    def pages(self) -> list[tuple[float | None, float | None, bytes]]:
        """Width, height and contents of each page, in order."""
        roots = [h for h, _ in self.objects.values() if isinstance(h, dict) and h.get(Name(b"Type")) == b"Catalog"]
        out: list[tuple[float | None, float | None, bytes]] = []
        todo = [(roots[-1].get(Name(b"Pages")), None)] if roots else []
        seen: set[object] = set()
        while todo:
            at, box = todo.pop()
            node = self.get(at)
            if not isinstance(node, dict) or (isinstance(at, tuple) and at in seen):
                raise PdfError("a damaged page tree")
            seen.add(at if isinstance(at, tuple) else id(at))
            box = self.get(node.get(Name(b"MediaBox"))) or box
            kids = self.get(node.get(Name(b"Kids")))
            if isinstance(kids, list):
                todo += [(k, box) for k in reversed(kids)]
                continue
            inside = node.get(Name(b"Contents"))
            parts = self.get(inside) if isinstance(self.get(inside), list) else [inside]
            body = b"\n".join(self.stream(p[1]) for p in parts if isinstance(p, tuple))
            x0, y0, x1, y1 = [float(self.get(v)) for v in box] if isinstance(box, list) and len(box) == 4 else (None,) * 4
            out.append((None if x0 is None else abs(x1 - x0), None if y0 is None else abs(y1 - y0), body))
        if roots:
            return out
        bodies = [self.stream(n) for n, (_, raw) in self.objects.items() if raw is not None]
        return [(None, None, b) for b in bodies if b"BT" in b]


def runs(body: bytes) -> list[tuple[int, float, float, float, str]]:
    """Position among the page's runs, font size, x, y and text of each run of a page's contents that isn't blank.

    A run is the operand of Tj, at the place of the last Tm and in the size of the last Tf; one without either is left out.
    Td counts on pages without a Tm before it, from the beginning of its BT.
    """
    out, args = [], []
    size = x = y = None
    line, placed, n = (0.0, 0.0), False, 0
    for t, _ in tokens(body):
        if not isinstance(t, Word) or t in (b"[", b"]", b"<<", b">>"):
            args.append(t)
            continue
        numbers = [a for a in args if isinstance(a, float)]
        if t == b"BT":
            line = (0.0, 0.0)
        elif t == b"Tf" and numbers:
            size = numbers[-1]
        elif t == b"Tm" and len(numbers) >= 6:
            x, y, placed = numbers[-2], numbers[-1], True
        elif t in (b"Td", b"TD") and len(numbers) >= 2 and not placed:
            line = x, y = line[0] + numbers[-2], line[1] + numbers[-1]
        elif t == b"Tj" and args and type(args[-1]) is bytes:
            text = args[-1].decode("latin-1")
            if size is not None and x is not None:
                if text.strip():
                    out.append((n, size, x, y, text))
                n += 1
        args = []
    return out


def read(data: bytes) -> list[tuple[int, float | None, float | None, list[tuple[int, float, float, float, str]]]]:
    """Number (from 1), width, height and runs of each page; any failure is a PdfError."""
    try:
        return [(k, w, h, runs(body)) for k, (w, h, body) in enumerate(Pdf(data).pages(), 1)]
    except PdfError:
        raise
    except (ValueError, TypeError, AttributeError, RecursionError, KeyError, IndexError) as e:
        raise PdfError(f"failed to parse: {type(e).__name__}") from e
