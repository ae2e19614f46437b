"""PDF and compound files, made by hand."""

import struct
import zlib

import pytest

from heliograph.sources import extract, ole
from heliograph.sources.pdf import pdf


def made_pdf(*contents, packed=True):
    """Pages with a plain font F1 and a mapped one F2."""
    chart = b"begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00e9> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange endcmap"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 >>", 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>"}
    streams = {5: chart}
    for i, text in enumerate(contents):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        streams[11 + 2 * i] = text
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects[2] = b"<< /Type /Pages /Kids [%s] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % kids
    out = b"%PDF-1.4\n"
    for n, text in streams.items():
        raw = zlib.compress(text) if packed else text
        objects[n] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), b" /Filter /FlateDecode" if packed else b"", raw)
    for n, body in sorted(objects.items()):
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf(packed):
    one = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET"
    two = b"BT /F2 9 Tf <00100011001200010010> Tj ET"
    empty = b"0 0 m 10 10 l S"
    got = list(pdf(made_pdf(one, empty, two, packed=packed)))
    assert got == [("Hello (big) world\nsecond line", 1, None, None), ("abcéa", 3, None, None)]


def test_damaged_pdfs():
    good = made_pdf(b"BT /F1 12 Tf (fine) Tj ET", b"BT /F1 12 Tf (lost) Tj ET")
    second = good.index(b"stream\n", good.index(b"13 0 obj")) + 7
    assert [b[0] for b in pdf(good[:second] + b"garbage!" + good[second + 8 :])] == ["fine"]
    with pytest.raises(ValueError):
        list(pdf(b"no pdf"))
    with pytest.raises(ValueError):
        list(pdf(good + b"<< /Encrypt 9 0 R >>"))


def compound(streams):
    """A compound file of one folder; streams under 4,096 bytes are in the small stream."""
    small, mini_fat, places, big = b"", [], {}, []
    for name, body in streams.items():
        if len(body) < 4096:
            places[name] = (len(mini_fat), len(body))
            n = -(-len(body) // 64)
            mini_fat += [len(mini_fat) + i + 1 for i in range(n - 1)] + ([0xFFFFFFFE] if n else [])
            small += body.ljust(64 * n, b"\0")
        else:
            big.append(name)
    sectors, fat = [], []

    def put(body):
        body = body.ljust(-(-len(body) // 512) * 512, b"\0")
        first = len(sectors)
        n = len(body) // 512
        sectors.extend(body[i * 512 : i * 512 + 512] for i in range(n))
        fat.extend([first + i + 1 for i in range(n - 1)] + ([0xFFFFFFFE] if n else []))
        return first if n else 0xFFFFFFFE

    for name in big:
        places[name] = (put(streams[name]), len(streams[name]))
    small_at = put(small)
    mini_at = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini_fat else 0xFFFFFFFE
    names = list(streams)
    entry = lambda name, kind, right, child, start, size: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    dirs = entry("Root Entry", 5, 0xFFFFFFFF, 1, small_at, len(small))
    for i, name in enumerate(names, 1):
        dirs += entry(name, 2, i + 1 if i < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, *places[name])
    dir_at = put(dirs)
    fat_at = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = ole.MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIII", 0, 1, dir_at, 0, 4096)
    head += struct.pack("<IIII", mini_at, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    return head.ljust(512, b"\0") + b"".join(sectors) + table


def test_messages(spark):
    wide = lambda t: t.encode("utf-16-le")
    data = compound({"__substg1.0_0037001F": wide("Grüße"), "__substg1.0_0C1A001F": wide("Ann"), "__substg1.0_0E04001F": wide("Bob"), "__substg1.0_007D001F": wide("X: 1\r\nDate: Mon, 1 Jan 2024\r\n"), "__substg1.0_1000001F": wide("Hello\r\n" + "long line " * 600)})
    text = next(ole.msg(data, extract.html_text))[0]
    assert text.startswith("Subject: Grüße\nFrom: Ann\nTo: Bob\nDate: Mon, 1 Jan 2024\n\nHello\nlong line long") and len(text) > 6000
    page = compound({"__substg1.0_0037001E": b"Old", "__substg1.0_10130102": b"<p>from a page</p>"})
    assert next(ole.msg(page, extract.html_text))[0] == "Subject: Old\n\nfrom a page"
    files = spark.createDataFrame([("/a/m.msg", data), ("/a/bad.doc", b"junk"), ("/a/p.pdf", made_pdf(b"BT (x) Tj ET"))], "path string, content binary")
    got = {r.path: (r.text or r.error, r.page_number) for r in extract.extract(files).collect()}
    assert got["/a/m.msg"][0] == text and "ValueError" in got["/a/bad.doc"][0] and got["/a/p.pdf"] == ("x", 1)


def test_word():
    one, two = "Plain text\rwith \x13 HYPERLINK x\x14a link\x15", "ünïcode ✓"
    main = bytearray(4096)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<I", main, 0x4C, len(one) + len(two))
    first = len(main)
    main += one.encode("cp1252")
    second = len(main)
    main += two.encode("utf-16-le")
    pieces = struct.pack("<3I", 0, len(one), len(one) + len(two)) + struct.pack("<HIH", 0, first * 2 | 0x40000000, 0) + struct.pack("<HIH", 0, second, 0)
    clx = b"\x01\x02\x00zz\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 7, len(clx))
    data = compound({"WordDocument": bytes(main), "1Table": b"7bytes." + clx})
    assert list(ole.doc(data)) == [("Plain text\nwith a linkünïcode ✓", None, None, None)]


def test_slides():
    record = lambda kind, body, container=False: struct.pack("<HHI", 15 if container else 0, kind, len(body)) + body
    texts = record(0x03F3, bytes(20)) + record(0x0FA8, b"Title one") + record(0x0FA0, "Ünder it".encode("utf-16-le")) + record(0x03F3, bytes(20)) + record(0x0FA8, b"Second")
    stream = record(0x03E8, record(0x0FF0, texts, True) + record(0x0FF0, record(0x03F3, bytes(20)) + record(0x0FA8, b"Notes"), True), True)
    assert list(ole.ppt(compound({"PowerPoint Document": stream}))) == [("Title one\nÜnder it", 1, None, None), ("Second", 2, None, None)]


def test_sheets():
    record = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    string = lambda t, wide=False: struct.pack("<HB", len(t), wide) + t.encode("utf-16-le" if wide else "latin-1")
    split = struct.pack("<HB", 6, 0) + b"abc"  # goes on in the next record, there in wide characters
    table = record(0x00FC, struct.pack("<II", 3, 3) + string("name") + string("größe ✓", True) + split) + record(0x003C, b"\x01" + "déf".encode("utf-16-le"))
    cell = lambda r, c: struct.pack("<HHH", r, c, 0)
    sheet = record(0x0809, bytes(16)) + record(0x00FD, cell(0, 0) + struct.pack("<I", 0)) + record(0x00FD, cell(0, 1) + struct.pack("<I", 1)) + record(0x0203, cell(1, 1) + struct.pack("<d", 2.5))
    sheet += record(0x027E, cell(1, 0) + struct.pack("<I", (7 << 2) | 2)) + record(0x00BD, struct.pack("<HH", 2, 0) + struct.pack("<HI", 0, (1234 << 2) | 3) + struct.pack("<HI", 0, (-3 << 2 & 0xFFFFFFFF) | 2) + struct.pack("<H", 1))
    sheet += record(0x0006, cell(3, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(0x0207, string("made")) + record(0x00FD, cell(3, 1) + struct.pack("<I", 2)) + record(0x000A)
    head = lambda at: record(0x0809, bytes(16)) + record(0x0085, struct.pack("<IH", at, 0) + struct.pack("<BB", 5, 0) + b"Sheet") + table + record(0x000A)
    data = compound({"Workbook": head(len(head(0))) + sheet})
    assert list(ole.xls(data)) == [("name größe ✓\n7 2.5\n12.34 -3\nmade abcdéf", None, None, "Sheet")]
