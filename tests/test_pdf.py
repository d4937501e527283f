"""Files of known text come back whole."""

import zlib

import pytest

from quern.operators import pdf
from quern.pdf_queries import made_pdf


def read(spark, *files):
    rows = [(str(k), f) for k, f in enumerate(files)]
    return {int(r.id): r for r in pdf.markdown(spark.createDataFrame(rows, "id string, content binary")).collect()}


def simple(code: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250] >>", more: bytes = b"", zipped: bool = False) -> bytes:
    raw = zlib.compress(code) if zipped else code
    head = b"/Filter /FlateDecode " if zipped else b""
    return b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 2 0 R] /Resources << /Font << /F 4 0 R >> /XObject << /X 6 0 R >> >> >> endobj\n3 0 obj << /Type /Page /Contents [5 0 R] >> endobj\n4 0 obj %s endobj\n5 0 obj << %s/Length %d >>\nstream\n%s\nendstream endobj\n%s\n" % (font, head, len(raw), raw, more)


def test_round_trip(spark):
    body = [(10.0, 50.0, 700.0 - 12 * k, f"line {k} of ordinary words, é ñ 漢 😀") for k in range(30)]
    pages = [[(20.0, 50.0, 780.0, "Big"), (15.0, 50.0, 750.0, "Middle"), (12.0, 50.0, 730.0, "Small"), *body], body]
    got = read(spark, made_pdf("Tïtle", pages), made_pdf(None, [[]]), made_pdf("Big", pages[:1]))
    text = "\n".join(t for *_, t in body)
    assert got[0].markdown == f"# Tïtle\n\n# Big\n## Middle\n### Small\n{text}\n\n---\n\n{text}" and got[0].pages == 2
    assert (got[1].markdown, got[1].error) == ("", None) and got[2].markdown.startswith("# Big\n## Middle")


@pytest.mark.parametrize("zipped", [False, True])
def test_operators(spark, zipped):
    code = rb"""BT /F 10 Tf 14 TL 50 700 Td (plain \(nested (brackets)\) \101\n) Tj T* [(ker) -100 (ned) -400 (apart)] TJ (next) ' 2 1 (spaced) "
      0 -14 TD (down) Tj ET q 1 0 0 1 0 -100 cm BT /F 10 Tf 1 0 0 1 50 700 Tm <6869> Tj ET Q BT /F 10 Tf 200 700 Td (right) Tj ET /X Do ( unfinished"""
    form = b"6 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -50] /Length 47 >>\nstream\nBT /F 10 Tf 1 0 0 1 50 600 Tm (form) Tj ET /X Do\nendstream endobj"
    got = read(spark, simple(code, more=form, zipped=zipped))
    assert got[0].error is None
    assert got[0].markdown.startswith("plain (nested (brackets)) A")
    for said in ("right", "kerned apart", "next", "spaced", "down", "hi", "form"):
        assert said in got[0].markdown
    assert got[0].markdown.index("down") < got[0].markdown.index("hi") < got[0].markdown.index("form")


def test_object_streams_and_ranges(spark):
    cmap = b"1 beginbfrange <01> <03> <0041> endbfrange 1 beginbfrange <04> <05> [<00660069> <00e9>] endbfrange"
    catalog, font = b"<< /Type /Catalog /Pages 2 0 R >> ", b"<< /Type /Font /ToUnicode 7 0 R >>"
    head = b"1 0 4 %d " % len(catalog)
    inner = head + catalog + font
    raw = zlib.compress(inner)
    more = b"8 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream endobj\n7 0 obj << /Length %d >>\nstream\n%s\nendstream endobj\n9 0 obj << /Type /XRef /Root 1 0 R >> endobj" % (len(head), len(raw), raw, len(cmap), cmap)
    file = simple(b"BT /F 10 Tf 50 700 Td <0102030405> Tj ET", more=more)
    file = file.replace(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", b"").replace(b"4 0 obj << /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250] >> endobj\n", b"")
    assert read(spark, file)[0].markdown == "ABCfié"


@pytest.mark.parametrize(
    "data, why",
    [(b"", "no PDF"), (None, "no PDF"), (b"<html>", "no PDF"), (b"%PDF-1.4 garbage << [ (", None), (b"%PDF-1.4\ntrailer << /Encrypt 5 0 R /Root 1 0 R >>", "encrypted"), (simple(b"x", more=b"").replace(b"/Length", b"/Filter /DCTDecode /Length"), "filter DCTDecode"), (simple(b"BT", zipped=True).replace(b"stream\nx", b"stream\ny"), "Error -3")],
)
def test_files_that_cannot_be_read(spark, data, why):
    row = read(spark, data)[0]
    assert row.markdown == "" and (row.error is None if why is None else row.error.startswith(why))


def test_operations_are_those_of_the_tokens():
    code = b"""q 1 0 0 1 0 -.5 cm BT /F1 10 Tf 1 0 0 1 5. 7 Tm <0102> Tj <3>Tj (a b) Tj (a\\)(b)) Tj [(a) -3 <41>] TJ % said ( Tj
      /A#20B 3 Tf true null x 1 2 R 12.5.3 w T* (next)' 1 2(c)" /X Do /N<</K[1 2]>>BDC ET Q 7 {} ] >> <41 42> Tj 1e5 d [(open) Tj"""
    want, held = [], []
    for value, _ in pdf.tokens(code):
        if isinstance(value, pdf.Word):
            want.append((value, held))
            held = []
        else:
            held.append(value)
    assert list(pdf.operations(code)) == want and len(want) > 15


def test_few_large_partitions_are_dealt_anew(spark):
    files = spark.createDataFrame([(str(k), made_pdf(f"T{k}", [[(10.0, 50.0, 700.0, f"text {k}")]])) for k in range(64)], "id string, content binary").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = pdf.markdown(files)
        assert found.rdd.getNumPartitions() > 1 and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r.markdown for r in found.collect()} == {f"# T{k}\n\ntext {k}" for k in range(64)}
