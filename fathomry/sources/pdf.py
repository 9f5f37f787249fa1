"""The page count of a PDF as its page tree states it.

The count is found as a reader finds it: from the end of the file to the cross-reference sections (tables
and streams, the newest first), to the catalogue, to the root of the page tree and its ``/Count``. Objects that no
section names, such as pages that an update took out, don't count. Where this can't be followed (a damaged or
encrypted file), page objects are counted.
"""

from __future__ import annotations

import re
import zlib

_SPACE = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![A-Za-z])")
_NAME = re.compile(rb"/[^\x00\t\n\f\r ()<>\[\]{}/%]*")
_OBJECT = re.compile(rb"[\x00\t\n\f\r ]*(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj")
_STREAM = re.compile(rb"(?:[\x00\t\n\f\r ]|%[^\r\n]*)*stream\r?\n")
_ENTRY = re.compile(rb"[\r\n ]*(\d{1,10}) +(\d{1,5}) +([nf])")
_SECTION = re.compile(rb"[\x00\t\n\f\r ]*(\d+) +(\d+)[\x00\t\n\f\r ]+(?=\d+ +\d+ +[nf])")


class Reference(int):
    """The number of an object."""


def value_at(data: bytes, at: int):
    """(value, end) of what begins here: dictionaries, lists, names and strings (bytes), numbers, references, True, False, None."""
    at = _SPACE.match(data, at).end()
    two, one = data[at : at + 2], data[at : at + 1]
    if two == b"<<":
        out, at = {}, at + 2
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + 2] == b">>":
                return out, at + 2
            key, at = value_at(data, at)
            out[key], at = value_at(data, at)
    if one == b"[":
        items, at = [], at + 1
        while True:
            at = _SPACE.match(data, at).end()
            if data[at : at + 1] == b"]":
                return items, at + 1
            item, at = value_at(data, at)
            items.append(item)
    if one == b"/":
        m = _NAME.match(data, at)
        return m[0], m.end()
    if one == b"<":
        end = data.index(b">", at)
        return data[at + 1 : end], end + 1
    if one == b"(":
        depth, end = 1, at + 1
        while depth:
            c = data[end]
            depth += (c == 0x28) - (c == 0x29)
            end += 2 if c == 0x5C else 1
        return data[at + 1 : end - 1], end
    if m := _REFERENCE.match(data, at):
        return Reference(m[1]), m.end()
    if m := _NUMBER.match(data, at):
        return (float(m[0]) if b"." in m[0] else int(m[0])), m.end()
    for word, value in ((b"true", True), (b"false", False), (b"null", None)):
        if data.startswith(word, at):
            return value, at + len(word)
    raise ValueError("no value")


def unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of bytes as they were before a PNG filter, which each row names in front."""
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(columns):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 4:
                guess = left + up - corner
                add = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind]
            row[i] = (row[i] + add) & 255
        out += row
        above = row
    return bytes(out)


class Pdf:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer = data, {}, {}
        self._packed: dict[int, dict[int, int]] = {}
        todo, seen = [int(_NUMBER.match(data, _SPACE.match(data, data.rindex(b"startxref") + 9).end())[0])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            found = self._section(at)
            for k, v in found.items():
                self.trailer.setdefault(k, v)
            todo += [found[k] for k in (b"/XRefStm", b"/Prev") if k in found]

    def _section(self, at: int) -> dict:
        """The trailer of a cross-reference section; places that a newer one gave stay."""
        at = _SPACE.match(self.data, at).end()
        if not self.data.startswith(b"xref", at):
            return self._stream_section(at)
        at += 4
        while m := _SECTION.match(self.data, at) or re.compile(rb"[\x00\t\n\f\r ]*(\d+) +(0)(?=[\x00\t\n\f\r ])").match(self.data, at):
            first, n, at = int(m[1]), int(m[2]), m.end()
            for number in range(first, first + n):
                e = _ENTRY.match(self.data, at)
                self.places.setdefault(number, (1 if e[3] == b"n" else 0, int(e[1]), 0))
                at = e.end()
        return value_at(self.data, self.data.index(b"trailer", at) + 7)[0]

    def _stream_section(self, at: int) -> dict:
        about, rows = self._read(at)
        widths, index = about[b"/W"], about.get(b"/Index", [0, about[b"/Size"]])
        at, size = 0, sum(widths)
        for first, n in zip(index[::2], index[1::2]):
            for number in range(first, first + n):
                row, fields = rows[at : at + size], []
                for w in widths:
                    fields.append(int.from_bytes(row[:w], "big") if w else None)
                    row = row[w:]
                kind = 1 if fields[0] is None else fields[0]
                self.places.setdefault(number, (kind, fields[1] or 0, fields[2] or 0))
                at += size
        return about

    def _read(self, at: int):
        """An object's value and, if it is a stream, its decoded bytes."""
        m = _OBJECT.match(self.data, at)
        if not m:
            raise ValueError("no object here")
        value, end = value_at(self.data, m.end())
        if not (isinstance(value, dict) and (s := _STREAM.match(self.data, end))):
            return value, None
        length = self.get(value.get(b"/Length"))
        raw = self.data[s.end() : s.end() + length] if isinstance(length, int) else self.data[s.end() : self.data.index(b"endstream", s.end())]
        filters, options = value.get(b"/Filter", []), value.get(b"/DecodeParms")
        filters = filters if isinstance(filters, list) else [filters]
        if filters not in ([], [b"/FlateDecode"]):
            raise ValueError("another filter")
        options = self.get(options[0] if isinstance(options, list) else options) or {}
        if filters:
            raw = zlib.decompressobj().decompress(raw)
        if options.get(b"/Predictor", 1) >= 10:
            raw = unpredicted(raw, options.get(b"/Columns", 1) * options.get(b"/Colors", 1) * options.get(b"/BitsPerComponent", 8) // 8)
        return value, raw

    def get(self, value):
        """What a reference stands for; other values are themselves."""
        for _ in range(32):
            if not isinstance(value, Reference):
                return value
            kind, place, index = self.places.get(int(value), (0, 0, 0))
            if kind == 1:
                value = self._read(place)[0]
            elif kind == 2:
                about, raw = self._read(self.places[place][1])
                numbers = list(map(int, raw[: about[b"/First"]].split()))
                value = value_at(raw, about[b"/First"] + numbers[2 * index + 1])[0]
            else:
                return None
        raise ValueError("references in a circle")

    def pages(self) -> int:
        """``/Count`` of the page tree's root."""
        tree = self.get(self.get(self.trailer[b"/Root"])[b"/Pages"])
        n = self.get(tree[b"/Count"])
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("no count")
        return n


def page_objects(content: bytes) -> int:
    """Page objects, also those in compressed object streams, used or not; 0 where none can be read."""
    page = re.compile(rb"/Type\s*/Page(?![s\w])")
    n = len(page.findall(content))
    for m in re.finditer(rb"<<[^>]*/ObjStm[^>]*>>\s*stream\r?\n", content):
        try:
            n += len(page.findall(zlib.decompressobj().decompress(content[m.end() :])))
        except zlib.error:
            continue  # a filter other than Flate, or damage
    return n


def count_pages(content: bytes) -> int:
    """The pages that the page tree states; where it can't be read, the page objects."""
    try:
        return Pdf(content).pages()
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, RecursionError):
        return page_objects(content)
