import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from loomq.sources import office
from loomq.sources import word_merge as m

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def document(name, picture=b"", listed=False, footnote=False, header=True, style="Normal"):
    """A Word file as a word processor writes it: a header with a picture, a link, a list, a style and a section."""
    para = f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{name} text</w:t></w:r></w:p>'
    if listed:
        para += f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>{name} item</w:t></w:r></w:p>'
    link = f'<w:p><w:hyperlink r:id="rId8"><w:r><w:t>{name} link</w:t></w:r></w:hyperlink></w:p>'
    note = "<w:p><w:r><w:footnoteReference w:id='2'/></w:r></w:p>" if footnote else ""
    edge = '<w:headerReference w:type="default" r:id="rId7"/>' if header else ""
    body = f"<w:document {W}><w:body>{para}{link}{note}<w:sectPr>{edge}<w:pgSz w:w='100' w:h='200'/></w:sectPr></w:body></w:document>"
    rels = "".join(
        f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"{x}/>'
        for i, k, t, x in [
            ("rId1", "styles", "styles.xml", ""), ("rId7", "header", "header1.xml", ""), ("rId8", "hyperlink", f"http://x/{name}", ' TargetMode="External"'), *([("rId2", "numbering", "numbering.xml", "")] if listed else []),
        ]
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="r"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/header1.xml" ContentType="h"/></Types>')
        z.writestr("word/document.xml", body)
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="{style}"/><w:style w:styleId="Normal"/></w:styles>')
        z.writestr("word/header1.xml", f'<w:hdr {W}><w:p><w:r><w:t>{name} head</w:t><w:drawing r:embed="rId1"/></w:r></w:p></w:hdr>')
        z.writestr("word/_rels/header1.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{REL}/image" Target="media/image1.png"/></Relationships>')
        z.writestr("word/media/image1.png", picture or name.encode())
        if listed:
            z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"/><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
    return out.getvalue()


def sections(content):
    """For each section of a merged file its texts, its header's text and that header's picture."""
    p, found, texts = m.Package(content), [], []
    relations = p.relations(m.MAIN)

    def close(section):
        reference = section.find(m.W + "headerReference")
        name = relations[reference.get(m.R + "id")][1]
        text = "".join(t.text or "" for t in m.ET.fromstring(p.parts[name]).iter(m.W + "t"))
        picture = [p.parts[to] for _, to, _ in p.relations(name).values()]
        kind = section.find(m.W + "type")
        found.append((list(texts), text, picture, None if kind is None else kind.get(m.W + "val"), section.find(m.W + "footerReference") is not None))
        texts.clear()

    for e in p.body:
        texts.extend(t.text for t in e.iter(m.W + "t"))
        for section in [e] if e.tag == m.W + "sectPr" else e.iter(m.W + "sectPr"):
            close(section)
    return found


def test_documents_keep_their_own():
    content, n, warnings = m.merged_word([("a", document("a", listed=True)), ("b", document("b", listed=True, style="Fancy")), ("c", document("c", header=False))])
    assert n == 3 and not warnings
    got = sections(content)
    assert [s[0] for s in got] == [["a text", "a item", "a link"], ["b text", "b item", "b link"], ["c text", "c link"]]
    assert [(s[1], s[2]) for s in got] == [("a head", [b"a"]), ("b head", [b"b"]), ("", [])]
    assert [s[3] for s in got] == [None, "nextPage", "nextPage"] and [s[4] for s in got] == [False, True, True]
    p = m.Package(content)
    links = {e.get(m.R + "id"): "".join(t.text for t in e.iter(m.W + "t")) for e in p.body.iter(m.W + "hyperlink")}
    assert {p.relations(m.MAIN)[k][1]: t for k, t in links.items()} == {f"http://x/{x}": f"{x} link" for x in "abc"}
    lists = [e.get(m.W + "val") for e in p.body.iter(m.W + "numId")]
    known = {e.get(m.W + "numId"): e.find(m.W + "abstractNumId").get(m.W + "val") for e in m.ET.fromstring(p.parts[m.NUMBERING]).findall(m.W + "num")}
    assert len(set(lists)) == 2 and len({known[k] for k in lists}) == 2
    assert {s.get(m.W + "styleId") for s in m.ET.fromstring(p.parts[m.STYLES])} == {"Normal", "Fancy"}
    assert all(t in p.parts for part in p.parts for _, t, outside in (p.relations(part).values() if not part.endswith(".rels") else ()) if not outside)


def test_what_cannot_be_appended_is_left_out():
    content, n, warnings = m.merged_word([("a", document("a")), ("b", document("b", footnote=True)), ("c", document("c"))])
    assert n == 2 and len(warnings) == 1 and warnings[0].startswith("b: ") and [s[0][0] for s in sections(content)] == ["a text", "c text"]
    assert not any(b"b head" in data for data in m.Package(content).parts.values())
    with pytest.raises(ValueError, match="junk"):
        m.merged_word([("a", document("a")), ("junk", b"no file")])
    with pytest.raises(ValueError, match="nothing"):
        m.merged_word([])


@pytest.mark.parametrize(("batch", "batches"), [(100, 0), (3, 3)])
def test_merge_in_batches(spark, batch, batches):
    rows = [(f"{n}.docx", bytearray(document(f"d{n}", listed=n % 2 == 0)), n) for n in range(8)]
    df = spark.createDataFrame(rows, "path string, content binary, seq int").orderBy(F.col("seq").desc())
    merged = m.merge_word(df, "seq", batch).first()
    assert (merged["segments"], merged["files_processed"], merged["batches"], merged["warnings"]) == (8, 8, batches, [])
    assert [s[0][0] for s in sections(bytes(merged["content"]))] == [f"d{n} text" for n in range(8)]
    assert [s[1] for s in sections(bytes(merged["content"]))] == [f"d{n} head" for n in range(8)]
    paragraphs = office.read_word(spark.createDataFrame([("m", merged["content"])], "path string, content binary"))
    assert paragraphs.filter("error is null and part = 'body'").count() > 16
    with pytest.raises(Exception) as stopped:
        m.merge_word(df.withColumn("content", F.lit(b"junk")), "seq", batch).collect()
    assert re.match(r"\d\.docx: ", m.merge_error(stopped.value))
