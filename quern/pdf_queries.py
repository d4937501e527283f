"""A query over PDF files that are made of the documents' texts, and what makes them."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import pdf
from quern.registry import query, table

WORDS, LINES = 12, 40


def made_pdf(title: str | None, pages: list[list[tuple[float, float, float, str]]]) -> bytes:
    """A file with a font of two-byte codes; pages hold (size, x, y, text)."""
    codes = sorted(set("".join(t for page in pages for *_, t in page)))
    number = {ord(c): k + 1 for k, c in enumerate(codes)}
    spelled = lambda c: c.encode("utf-16-be", "surrogatepass").hex()
    cmap = b"".join(b"%d beginbfchar\n" % len(codes[k : k + 100]) + b"".join(b"<%04x> <%s>\n" % (number[ord(c)], spelled(c).encode()) for c in codes[k : k + 100]) + b"endbfchar\n" for k in range(0, len(codes), 100))
    bodies = []
    for page in pages:
        said = [b"BT /F1 %g Tf 1 0 0 1 %g %g Tm <%s> Tj ET" % (size, x, y, spelled(t.translate(number)).encode()) for size, x, y, t in page]
        bodies.append(zlib.compress(b"\n".join(said), 1))
    out = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (7 + 2 * k) for k in range(len(pages))), len(pages))]
    out += [b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Made /DW 500 >>"]
    out += [b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream", b"<< /Title <%s> >>" % (b"feff" + title.encode("utf-16-be").hex().encode()) if title else b"<< >>"]
    for k, body in enumerate(bodies):
        out += [b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (8 + 2 * k), b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream"]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, x) for k, x in enumerate(out)) + b"trailer << /Root 1 0 R /Info 6 0 R >>\n%%EOF\n"


def _files(batches):
    for batch in batches:
        made = []
        for i, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = (text or "").encode().split()
            lines = [b" ".join(words[k : k + WORDS]).decode() for k in range(0, len(words), WORDS)]
            pages = [[(10.0, 50.0, 750.0 - 15 * k, t) for k, t in enumerate(lines[p : p + LINES])] for p in range(0, len(lines), LINES)] or [[]]
            pages[0] = [(15.0, 50.0, 790.0, f"Part {lang}"), *pages[0]]
            made.append(made_pdf(f"Nº {i}", pages))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(made, pa.binary())], names=["id", "content"])


_HEAD = "'## Part ' || lang"


@query(rf"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE length(text) >= 400
), l AS (SELECT doc_id, lang, list_transform(range(0, len(w), {WORDS}), lambda i: array_to_string(w[i + 1:i + {WORDS}], ' ')) AS l FROM w
), p AS (SELECT doc_id, l, list_transform(range(0, greatest(len(l), 1), {LINES}), lambda i: array_to_string(list_concat(CASE WHEN i = 0 THEN [{_HEAD}] ELSE [] END, l[i + 1:i + {LINES}]), chr(10))) AS p FROM l)
SELECT doc_id, len(p)::INTEGER AS pages, sha256('# Nº ' || doc_id || chr(10) || chr(10) || array_to_string(p, chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS digest FROM p""")
def pdf_markdown(spark, d):
    """Texts of 400 characters or more, so that their size is a page's usual one, as pages of forty lines under a heading, read back."""
    docs = table(spark, d, "documents").where("length(text) >= 400").select("doc_id", "lang", "text")
    found = pdf.markdown(docs.mapInArrow(_files, "id string, content binary"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "pages", F.sha2("markdown", 256).alias("digest"))
