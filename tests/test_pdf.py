"""PDF files made here: encoded fonts, spacing, nested pages, object streams."""

import zlib

import pytest

from trilune.sources import pdf
from trilune.sources.files import read_documents


def made(objects, packed=()):
    """A file of numbered objects; those in `packed` go into one object stream."""
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        if n not in packed:
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        bodies = [objects[n] for n in packed]
        starts = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
        head = b" ".join(b"%d %d" % (n, at) for n, at in zip(packed, starts, strict=True)) + b" "
        out += b"90 0 obj\n" + stream(head + b" ".join(bodies), b"/Type /ObjStm /N %d /First %d" % (len(packed), len(head))) + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(data, more=b"", plain=False):
    if not plain:
        data, more = zlib.compress(data), more + b" /Filter /FlateDecode"
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


CMAP = b"""/CIDInit /ProcSet findresource begin begincmap
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <0041> <0002> <00E9> endbfchar
2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<8BED> <6CD5>] endbfrange
1 beginbfchar <0003> <D835DCB3> endbfchar
endcmap"""

PAGES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Count 2 /Kids [3 0 R 4 0 R] /Resources << /Font << /F1 7 0 R /F#32 8 0 R >> >> >>",
    3: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R] >>",
    4: b"<< /Type /Page /Parent 2 0 R /Contents [10 0 R 11 0 R] >>",
    5: b"<< /Type /Page /Parent 3 0 R /Contents 9 0 R % a remark\n >>",
    6: stream(CMAP),
    7: b"<< /Type /Font /Subtype /Type1 /Encoding << /Type /Encoding /Differences [1 /eacute /space 65 /B] >> >>",
    8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>",
    9: stream(b"BT /F1 12 Tf 72 700 Td (A\\(b\\)) Tj 0 -14 Td [(C) -300 (d) 20 (\\145f)] TJ 40 0 Td (\\001x) Tj T* (next) Tj ET"),
    10: stream(b"BT /F2 10 Tf 1 0 0 1 72 600 Tm <00010002> Tj 1 0 0 1 99 600 Tm <00100011 0012> Tj"),
    11: stream(b"1 0 0 1 72 580 Tm [<0020> -10 <0021> -900 <0003>] TJ ET", plain=True),
}
WANT = "B(b)\nC def éx\nnext\nAé abc\n语法 \U0001d4b3"


@pytest.mark.parametrize("packed", [(), (1, 2, 3, 4, 5, 7, 8)])
def test_encoded_fonts_spacing_and_inherited_resources(packed):
    assert pdf.text(made(PAGES, packed)) == WANT


def test_values_of_every_kind():
    got = list(pdf.values(b"<< /A [1 -2.5 .5 (x\\)(y)) <4142> <414>] /B 3 0 R /C << /D true >> >> 7 8 BT (a\\\nb\\053) 1 0 R"))
    assert got[0] == {"A": [1, -2.5, 0.5, b"x)(y)", b"AB", b"A@"], "B": pdf.Ref(3), "C": {"D": b"true"}}
    assert got[1:] == [7, 8, b"BT", b"ab+", pdf.Ref(1)]


def test_files_that_are_no_plain_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(PAGES))
    (tmp_path / "b.pdf").write_bytes(made(PAGES).replace(b"trailer <<", b"trailer << /Encrypt 5 0 R"))
    (tmp_path / "c.pdf").write_bytes(b"hello")
    (tmp_path / "d.pdf").write_bytes(made({1: b"<< /Type /Catalog /Pages 1 0 R /Kids [1 0 R] >>"}))
    got = {r.filename: (r.text, r.error) for r in read_documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.pdf"] == (WANT, None)
    assert "encrypted" in got["b.pdf"][1] and "no PDF" in got["c.pdf"][1] and got["d.pdf"] == ("", "empty")
