"""Compound files: mail messages, and the binary formats of Word, PowerPoint and Excel 97 to 2003."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
#: Sectors of the largest file that is read, and cells of the largest workbook.
SECTORS, CELLS = 1 << 22, 2_000_000
_END = 0xFFFFFFFC  # from here on a sector number has a meaning of its own


class Compound:
    """Streams of a compound file by their path, lower case."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a compound file")
        self.data, self.size, mini = data, 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        self.mini, (tables, first_dir) = mini, (struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0])
        self.cutoff, first_mini, _, first_more, more = struct.unpack_from("<5I", data, 56)
        chain = list(struct.unpack_from("<109I", data, 76))
        while first_more < _END and more and len(chain) < SECTORS:
            part = struct.unpack(f"<{self.size // 4}I", self._sector(first_more))
            chain += part[:-1]
            first_more, more = part[-1], more - 1
        self.next: list[int] = []
        for number in chain[:tables]:
            if number < _END:
                self.next += struct.unpack(f"<{self.size // 4}I", self._sector(number))
        raw = self._chained(first_mini)
        self.mini_next = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        entries = self._chained(first_dir)
        self.entries = [entries[at : at + 128] for at in range(0, len(entries) - 127, 128)]
        start, length = self._place(self.entries[0])
        self.small = self._chained(start)[:length]
        self.paths: dict[str, int] = {}
        self._walk(struct.unpack_from("<I", self.entries[0], 76)[0], "", 0)

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chained(self, number: int) -> bytes:
        out, steps = [], 0
        while number < _END and number < max(len(self.next), 1) and steps <= len(self.next):
            out.append(self._sector(number))
            number, steps = self.next[number] if number < len(self.next) else _END, steps + 1
        return b"".join(out)

    @staticmethod
    def _place(entry: bytes) -> tuple[int, int]:
        return struct.unpack_from("<I", entry, 116)[0], struct.unpack_from("<I", entry, 120)[0]

    def _walk(self, number: int, above: str, depth: int) -> None:
        """The entries of a folder, which are a tree."""
        pending, seen = [number], set()
        while pending:
            n = pending.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            length = max(0, struct.unpack_from("<H", e, 64)[0] - 2)
            name = above + e[:length].decode("utf-16-le", "replace").lower()
            left, right, child = struct.unpack_from("<3I", e, 68)
            pending += [left, right]
            if e[66] == 1 and depth < 8:
                self._walk(child, name + "/", depth + 1)
            elif e[66] == 2:
                self.paths[name] = n

    def read(self, path: str) -> bytes:
        """A stream's bytes, none if there is no such stream."""
        if path not in self.paths:
            return b""
        start, length = self._place(self.entries[self.paths[path]])
        if length >= self.cutoff:
            return self._chained(start)[:length]
        out, steps = [], 0
        while start < _END and start < len(self.mini_next) and steps <= len(self.mini_next):
            out.append(self.small[start * self.mini : (start + 1) * self.mini])
            start, steps = self.mini_next[start], steps + 1
        return b"".join(out)[:length]


def msg(data: bytes, html_text) -> Iterator[tuple[str, None, None, None]]:
    """Head and body of a saved message; its plain text before its page."""
    file = Compound(data)

    def value(tag: str) -> str:
        if raw := file.read(f"__substg1.0_{tag}001f"):
            return raw.decode("utf-16-le", "replace").rstrip("\0")
        return file.read(f"__substg1.0_{tag}001e").decode("cp1252", "replace").rstrip("\0")

    head = [f"{label}: {text}" for label, tag in (("Subject", "0037"), ("From", "0c1a"), ("To", "0e04")) if (text := value(tag).strip())]
    if m := re.search(r"^Date: *(.+)$", value("007d"), re.M):
        head.append(f"Date: {m[1].strip()}")
    body = value("1000").replace("\r\n", "\n").strip()
    if not body:
        body = html_text((file.read("__substg1.0_10130102") or value("1013").encode()).decode("utf-8", "replace")).strip()
    if head or body:
        yield "\n".join([*head, "", body]).strip(), None, None, None


def _plain(text: str) -> str:
    """Without fields' codes and control signs; cells and paragraphs become lines."""
    text = re.sub(r"\x13[^\x13\x14\x15]*\x14", "", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0e-\x1f]", "", re.sub(r"[\r\x07\x0b\x0c]", "\n", text))).strip()


def doc(data: bytes) -> Iterator[tuple[str, None, None, None]]:
    """The text of a document by its piece table."""
    file = Compound(data)
    main = file.read("worddocument")
    if len(main) < 0x1AA:
        raise ValueError("no document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x100:
        raise ValueError("encrypted")
    table = file.read("1table" if flags & 0x200 else "0table")
    at, size = struct.unpack_from("<2I", main, 0x1A2)
    most = struct.unpack_from("<I", main, 0x4C)[0]  # characters of the main text
    clx, pos = table[at : at + size], 0
    while pos < len(clx) and clx[pos] == 1:
        pos += 3 + struct.unpack_from("<H", clx, pos + 1)[0]
    if pos >= len(clx) or clx[pos] != 2:
        raise ValueError("no piece table")
    length = struct.unpack_from("<I", clx, pos + 1)[0]
    n = (length - 4) // 12
    places = struct.unpack_from(f"<{n + 1}I", clx, pos + 5)
    out = []
    for i in range(n):
        where = struct.unpack_from("<I", clx, pos + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        chars = min(places[i + 1], most) - places[i]
        if chars <= 0:
            break
        if where & 0x40000000:
            start = (where & 0x3FFFFFFF) // 2
            out.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    if text := _plain("".join(out)):
        yield text, None, None, None


def _records(data: bytes, at: int, end: int, depth: int = 0) -> Iterator[tuple[int, int, int]]:
    """Kind, begin and end of the records of a presentation, containers opened."""
    while at + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", data, at)
        at += 8
        yield kind, at, min(end, at + size)
        if head & 15 == 15 and depth < 32:
            yield from _records(data, at, min(end, at + size), depth + 1)
        at += size


def ppt(data: bytes) -> Iterator[tuple[str, int, None, None]]:
    """A block for each slide, in the order in which the list of slides holds their texts."""
    stream = Compound(data).read("powerpoint document")
    slides: list[list[str]] = []
    inside = 0
    for kind, at, end in _records(stream, 0, len(stream)):
        if kind == 0x0FF0:  # a list of slides; the first one is that of the slides themselves
            inside = end if not slides else inside
        elif kind == 0x03F3 and at < inside:  # begins a slide's texts
            slides.append([])
        elif kind in (0x0FA0, 0x0FA8) and at < inside and slides:
            slides[-1].append(stream[at:end].decode("utf-16-le" if kind == 0x0FA0 else "cp1252", "replace"))
    if not any(slides):  # texts that stand in the shapes only
        slides = [[stream[at:end].decode("utf-16-le" if kind == 0x0FA0 else "cp1252", "replace") for kind, at, end in _records(stream, 0, len(stream)) if kind in (0x0FA0, 0x0FA8)]]
    for number, texts in enumerate(slides, 1):
        if text := _plain("\n".join(texts)):
            yield text, number, None, None


def _shared_strings(parts: list[bytes]) -> list[str]:
    """Strings of a workbook; one may go on in the next record, whose first byte then says how wide it is."""
    out: list[str] = []
    total = struct.unpack_from("<I", parts[0], 4)[0]
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while len(got) < n and part < len(parts):
            piece = parts[part][at : at + n - len(got)]
            got, at = got + piece, at + len(piece)
            if at >= len(parts[part]) and len(got) < n:
                part, at = part + 1, 0
        return got.ljust(n, b"\0")

    for _ in range(total):
        if part >= len(parts) or (part == len(parts) - 1 and at >= len(parts[part])):
            break
        if at >= len(parts[part]):
            part, at = part + 1, 0
        chars, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while chars and part < len(parts):
            room = (len(parts[part]) - at) // (2 if wide else 1)
            n = min(chars, room)
            text += parts[part][at : at + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")
            at, chars = at + n * (2 if wide else 1), chars - n
            if chars:
                part, at = part + 1, 1
                wide = parts[part][0] & 1 if part < len(parts) and parts[part] else 0
        take(4 * runs + extra)
        out.append(text)
    return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def xls(data: bytes) -> Iterator[tuple[str, None, None, str]]:
    """A block for each sheet: cells joined by spaces, rows by lines, as they were last calculated."""
    file = Compound(data)
    stream = file.read("workbook") or file.read("book")
    at, records, sheets = 0, [], []
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        records.append((at, kind, stream[at + 4 : at + 4 + size]))
        at += 4 + size
    strings: list[str] = []
    for i, (_, kind, body) in enumerate(records):
        if kind == 0x002F:
            raise ValueError("encrypted")
        if kind == 0x0085 and len(body) > 8:
            wide = body[7] & 1
            sheets.append((struct.unpack_from("<I", body)[0], body[8 : 8 + body[6] * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1", "replace")))
        elif kind == 0x00FC and len(body) >= 8:
            more = i + 1
            while more < len(records) and records[more][1] == 0x003C:
                more += 1
            strings = _shared_strings([body, *(r[2] for r in records[i + 1 : more])])
    begins = {place: name for place, name in sheets}
    cells: dict[tuple[int, int], str] = {}
    name, total, pending = None, 0, None

    def block() -> Iterator[tuple[str, None, None, str]]:
        rows: dict[int, list[str]] = {}
        for (r, _), text in sorted(cells.items()):
            if text.strip():
                rows.setdefault(r, []).append(text.strip())
        if rows and name is not None:
            yield "\n".join(" ".join(v) for _, v in sorted(rows.items())), None, None, name

    for place, kind, body in records:
        if place in begins:
            yield from block()
            cells, name = {}, begins[place]
        if name is None or total > CELLS or len(body) < 6:
            continue
        r, c = struct.unpack_from("<HH", body)
        if kind == 0x00FD and len(body) >= 10:
            n = struct.unpack_from("<I", body, 6)[0]
            cells[r, c] = strings[n] if n < len(strings) else ""
        elif kind == 0x0203 and len(body) >= 14:
            cells[r, c] = _number(struct.unpack_from("<d", body, 6)[0])
        elif kind == 0x027E and len(body) >= 10:
            cells[r, c] = _number(_packed(struct.unpack_from("<I", body, 6)[0]))
        elif kind == 0x00BD:
            for k in range((len(body) - 6) // 6):
                cells[r, c + k] = _number(_packed(struct.unpack_from("<I", body, 6 + 6 * k)[0]))
        elif kind == 0x0204 and len(body) > 9:
            wide = body[8] & 1
            cells[r, c] = body[9:].decode("utf-16-le" if wide else "latin-1", "replace")
        elif kind == 0x0006 and len(body) >= 14:
            if body[12:14] == b"\xff\xff":
                pending = (r, c) if body[6] == 0 else None
                if body[6] == 1:
                    cells[r, c] = "TRUE" if body[8] else "FALSE"
            else:
                cells[r, c] = _number(struct.unpack_from("<d", body, 6)[0])
        elif kind == 0x0207 and pending and len(body) > 3:
            wide = body[2] & 1
            cells[pending], pending = body[3:].decode("utf-16-le" if wide else "latin-1", "replace"), None
        else:
            continue
        total += 1
    yield from block()


def _packed(n: int) -> float:
    """A number in thirty bits: a whole one or the upper half of a float, perhaps times a hundred."""
    x = float((n if n < 1 << 31 else n - (1 << 32)) >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return x / 100 if n & 1 else x
