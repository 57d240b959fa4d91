"""PDFs with tables and streams of references, objects in streams, updates, and broken ones."""

import random
import zlib

import pytest

from paperloom.operators import checks
from paperloom.sources import files as sources
from paperloom.sources import pdf

OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 >>",
    3: b"<< /Type /Page /Parent 2 0 R >>",
    4: b"<< /Type /Pages /Kids [5 0 R 6 0 R] /Count 2 /Parent 2 0 R >>",
    5: b"<< /Type /Page /Parent 4 0 R >> % a comment /Type /Page",
    6: b"<< /Type /Page /Parent 4 0 R >>",
    7: rb"<< /CreationDate (D:20240101120000+00'00') /ModDate (D:20240102\060000) /Producer (Paper\(Mill\) 1.0 \101\\) /Creator <476f6f64> >>",
}


def plain(objects=OBJECTS, info=7):
    out, places = b"%PDF-1.4\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in objects)
    return out + b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, info, start)


def updated(data, number, body, prev):
    """An update behind a file, with a table of its own."""
    at = len(data)
    out = data + b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    return out + b"xref\n%d 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Info %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (number, at, number, prev, start)


def compressed(predictor):
    """All objects in a stream, and references in another one."""
    heads, bodies = b"", b""
    for n, body in OBJECTS.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += body.split(b" %")[0] + b"\n"
    packed = zlib.compress(heads + bodies)
    out = b"%PDF-1.5\n"
    holder = len(out)
    out += b"10 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\r\n" % (len(OBJECTS), len(heads), len(packed)) + packed + b"\nendstream\nendobj\n"
    start = len(out)
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, 0, 10, i]) for i in range(len(OBJECTS))] + [bytes([0, 0, 0, 0])] * 2 + [bytes([1, *holder.to_bytes(2, "big"), 0]), bytes([1, *start.to_bytes(2, "big"), 0])]
    data, before = b"", bytes(4)
    for i, row in enumerate(rows):
        kind = (2, 1, 3, 4, 0)[i % 5] if predictor else None
        if kind is None:
            data += row
            continue
        guess = []
        for k in range(4):
            left, up, corner = (row[k - 1] if k else 0), before[k], (before[k - 1] if k else 0)
            p = left + up - corner
            guess.append((0, left, up, (left + up) // 2, min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2])[kind])
        data += bytes([kind]) + bytes((a - b) & 255 for a, b in zip(row, guess, strict=True))
        before = row
    data = zlib.compress(data)
    options = b" /DecodeParms << /Predictor 12 /Columns 4 >>" if predictor else b""
    out += b"11 0 obj\n<< /Type /XRef /W [1 2 1] /Size 12 /Root 1 0 R /Info 7 0 R /Filter /FlateDecode%s /Length %d >>\nstream\n" % (options, len(data)) + data + b"\nendstream\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF" % start


FACTS = (3, "D:20240101120000+00'00'", "D:202401020000", "Paper(Mill) 1.0 A\\")


@pytest.mark.parametrize("data", [plain(), compressed(False), compressed(True), plain().replace(b"startxref\n", b"startxref\n9"), compressed(True).replace(b"startxref\n", b"startxref\n9"), plain().split(b"xref\n0")[0] + b"trailer << /Info 7 0 R >>"])
def test_facts(data):
    assert sources.pdf_facts(data) == FACTS


def test_the_newest_update_counts():
    first = plain()
    data = updated(first, 8, b"<< /Producer (" + "Übung".encode("utf-16").replace(b"\xff\xfe", b"\xff\xfe") + b") /ModDate (D:20250101) >>", first.rindex(b"xref\n0"))
    assert sources.pdf_facts(data) == (3, None, "D:20250101", "Übung")
    # An older object that is replaced under its own number.
    data = updated(first, 7, b"<< /Creator (GIMP) >>", first.rindex(b"xref\n0"))
    assert sources.pdf_facts(data) == (3, None, None, "GIMP")
    secret = first.replace(b"/Info 7 0 R", b"/Info 7 0 R /Encrypt 5 0 R")
    assert sources.pdf_facts(secret) == (3, None, None, None)


def test_trees_that_go_in_circles_end():
    around = OBJECTS | {4: b"<< /Type /Pages /Kids [2 0 R 5 0 R] >>", 7: b"7 0 R"}
    assert sources.pdf_facts(plain(around)) == (2, None, None, None)
    assert sources.pdf_facts(b"%PDF" + b"[" * 5000) == (1, None, None, None)


def test_broken_bytes_stop_nothing(spark, tmp_path):
    rnd = random.Random(2)
    for k in range(300):
        data = bytearray(rnd.choice((plain(), compressed(True))))
        for _ in range(rnd.randint(1, 12)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        pages, *_ = sources.pdf_facts(bytes(data[: rnd.randint(1, len(data))]))
        assert pages >= 1
    (tmp_path / "a.pdf").write_bytes(compressed(True))
    (tmp_path / "b.pdf").write_bytes(b"%PDF nothing")
    got = {r["created"]: r for r in sources.metadata(sources.scan(spark, str(tmp_path))).collect()}
    row = next(r for c, r in got.items() if c)
    assert row["page_count"] == 3 and row["created"].hour == 12 and row["modified"].day == 2 and got[None]["page_count"] == 1
    assert checks.metadata_flags(sources.metadata(sources.scan(spark, str(tmp_path)))).count() == 0


def test_values():
    read = lambda b: pdf.Reader(b).value()
    assert read(b"[1 -2.5 /A#20b (x(y)z\\)\\\n!) <4a4> true null 3 0 R 3 0 RG]"[:-8] + b"]") == [1, -2.5, "A b", b"x(y)z)!", b"J@", True, None, 3]
    assert read(b"<</A<</B[/C]>>/D 1>>") == {"A": {"B": ["C"]}, "D": 1}


def test_a_stream_of_objects_is_opened_once(monkeypatch):
    """not once for every object in it."""
    from paperloom.plans.picture_queries import paper
    from paperloom.sources import files, pdf

    opened, content = [], pdf.Document.content
    monkeypatch.setattr(pdf.Document, "content", lambda self, stream: opened.append(str(stream.about["Type"])) or content(self, stream))
    assert files.pdf_facts(paper(5, "D:20240101", None, "Clerk \\(7\\)")) == (5, "D:20240101", None, "Clerk (7)")
    assert opened == ["XRef", "ObjStm"]
    assert pdf.Reader(b" % c\n<</A#42 1 0 R/ C[1 2 (a\\)\\101)]/D null>>").value() == {"AB": 1, "C": [1, 2, b"a)A"], "D": None}
