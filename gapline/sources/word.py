"""Text of word-processor files: the parts of .docx files, and the piece table of .doc files, which are compound files.

Paragraphs, line and page breaks become line ends, tabs and cell ends tabs; of fields the result stays. A file that can't be read is an error with
its reason, for that file alone.
"""

from __future__ import annotations

import io
import struct
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE = 0xFFFFFFFA  # numbers from here on aren't sectors


def docx_text(contents: bytes) -> str:
    """The body's paragraphs, in order; deleted text and field codes are elements of other names."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(contents)) as z, z.open("word/document.xml") as f:
        for event, x in ElementTree.iterparse(f, events=("start", "end")):
            if event == "start":
                continue
            if x.tag == f"{W}t":
                out.append(x.text or "")
            elif x.tag == f"{W}tab":
                out.append("\t")
            elif x.tag in (f"{W}br", f"{W}cr", f"{W}p"):
                out.append("\n")
            elif x.tag == f"{W}noBreakHyphen":
                out.append("-")
            if x.tag == f"{W}p":
                x.clear()
    return "".join(out).removesuffix("\n")


class CompoundFile:
    """Streams by name: chains of sectors, as a table of next sectors tells them; small streams are chains of small sectors in the root's stream."""

    def __init__(self, contents: bytes):
        if contents[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.raw = contents
        self.size, self.small = (1 << x for x in struct.unpack_from("<HH", contents, 30))
        tables, first, _, self.least, small_first, small_n, more, more_n = struct.unpack_from("<8I", contents, 44)
        places = list(struct.unpack_from("<109I", contents, 76))
        for _ in range(more_n):
            part = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            places += part[:-1]
            more = part[-1]
        self.next = [n for p in places[:tables] for n in struct.unpack(f"<{self.size // 4}I", self._sector(p))]
        self.next_small = [n for (n,) in struct.iter_unpack("<I", self._chain(small_first))] if small_n else []
        self.entries: dict[str, tuple[int, int]] = {}
        entries, root = self._chain(first), (FREE, 0)
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            start, size = struct.unpack_from("<IQ", entries, at + 116)
            if kind == 5:
                root = start, size
            elif kind == 2:
                self.entries[entries[at : at + max(0, length - 2)].decode("utf-16-le")] = start, size & 0xFFFFFFFF
        self.shorts = self._chain(root[0])

    def _sector(self, n: int) -> bytes:
        part = self.raw[(n + 1) * self.size : (n + 2) * self.size]
        return part.ljust(self.size, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], 0
        while start < FREE:
            out.append(self._sector(start))
            start = self.next[start]
            seen += 1
            if seen > len(self.next):
                raise ValueError("a chain of sectors has no end")
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise ValueError(f"no stream {name}")
        start, size = self.entries[name]
        if size >= self.least:
            return self._chain(start)[:size]
        out = []
        while start < FREE and len(out) * self.small < size:
            out.append(self.shorts[start * self.small : (start + 1) * self.small])
            start = self.next_small[start]
        return b"".join(out)[:size]


def doc_text(contents: bytes) -> str:
    """The main text, piece by piece: each piece is in single bytes (windows-1252) or in UTF-16."""
    file = CompoundFile(contents)
    main = file.stream("WordDocument")
    ident, flags = struct.unpack_from("<H8xH", main, 0)
    if ident != 0xA5EC:
        raise ValueError("not a Word document of this kind")
    if flags & 0x0100:
        raise ValueError("the document is encrypted")
    (chars,) = struct.unpack_from("<i", main, 0x4C)
    begin, length = struct.unpack_from("<II", main, 0x1A2)
    clx = file.stream("1Table" if flags & 0x0200 else "0Table")[begin : begin + length]
    at = 0
    while at < len(clx) and clx[at] == 1:  # properties
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        raise ValueError("the document has no piece table")
    (size,) = struct.unpack_from("<I", clx, at + 1)
    table = clx[at + 5 : at + 5 + size]
    n = (len(table) - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", table, 0)
    out = []
    for k in range(n):
        (place,) = struct.unpack_from("<I", table, 4 * (n + 1) + 8 * k + 2)
        count = ends[k + 1] - ends[k]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(main[start : start + count].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * count].decode("utf-16-le", "replace"))
    return plain("".join(out)[:chars])


#: fixed values: marks in the text of .doc files
MARKS = {"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\t", "\x1e": "-", "\x1f": "", "\x01": "", "\x08": "", "\x02": "", "\x05": ""}


def plain(text: str) -> str:
    """Marks as line ends and tabs; of fields (begin, code, separator, result, end) the results."""
    out, codes = [], []
    for c in text:
        if c == "\x13":
            codes.append(True)
        elif c == "\x14" and codes:
            codes[-1] = False
        elif c == "\x15" and codes:
            codes.pop()
        elif not any(codes):
            out.append(MARKS.get(c, c))
    return "".join(out).removesuffix("\n")


def text_of(name: str, contents: bytes) -> str:
    """By the file's own first bytes, then by its name: .docx, .doc, else UTF-8 text."""
    if contents[:4] == b"PK\x03\x04":
        return docx_text(contents)
    if contents[:8] == MAGIC:
        return doc_text(contents)
    if name.lower().endswith((".doc", ".docx")):
        raise ValueError("neither a compound file nor a zip file")
    try:
        return contents.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise ValueError("not UTF-8") from None
