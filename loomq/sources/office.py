"""Word and presentation files as tables, and back."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomq.functions.text import stripped
from loomq.session import expose_package

# Name spaces and the parts of the packages.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
WORD_PARTS = {"body": "word/document.xml", "header": "word/header2.xml", "footer": "word/footer1.xml"}
UNTRANSLATED_PLACEHOLDERS = ("ftr", "dt", "sldNum")
BODY_PROPERTIES = ("wrap", "lIns", "tIns", "rIns", "bIns", "vert", "anchor")

RUN = "struct<text:string,translatable:boolean,is_image:boolean,is_hyperlink:boolean,hyperlink_target:string,bold:boolean,italic:boolean,underline:boolean>"
PARAGRAPHS = f"path string, part string, para_index int, translatable boolean, section int, is_separator boolean, runs array<{RUN}>, error string"
CONTAINERS = (
    "path string, slide_path string, slide_number int, shape_id string, shape_name string, kind string, placeholder_type string, group_path array<string>, "
    "table_row int, table_col int, x long, y long, width long, height long, rotation long, autofit string, body map<string,string>, font_points double, "
    "paragraphs array<string>, translatable boolean, exclusion_reason string, error string"
)


def _on(properties: ET.Element | None, tag: str) -> bool:
    found = None if properties is None else properties.find(W + tag)
    return found is not None and (found.get(W + "val") or "true").lower() not in ("0", "false", "off", "none")


def _run_pieces(run: ET.Element) -> tuple[list[str], bool]:
    """A run's text between its breaks, and whether it shows an image.

    Markup compatibility gives a drawing twice; the second way, the fallback, doesn't count.
    """
    twice = {id(node) for fallback in run.iter(MC + "Fallback") for node in fallback.iter()}
    shown = [node for node in run.iter() if id(node) not in twice]
    text = "".join("\0" if node.tag == W + "br" else node.text or "" for node in shown if node.tag in (W + "t", W + "br"))
    return text.split("\0"), any(node.tag in (W + "drawing", W + "sym") for node in shown)


def _runs(paragraph: ET.Element, targets: dict[str, str], translatable: bool) -> list[dict]:
    found = []
    for child in paragraph:
        link = child.tag == W + "hyperlink"
        for run in child.findall(W + "r") if link else [child] if child.tag == W + "r" else []:
            look = run.find(W + "rPr")
            underline = None if look is None else look.find(W + "u")
            style = {
                "is_hyperlink": link, "hyperlink_target": targets.get(child.get(R + "id") or "") if link else None, "bold": _on(look, "b"), "italic": _on(look, "i"),
                "underline": underline is not None and (underline.get(W + "val") or "").lower() != "none",
            }
            pieces, image = _run_pieces(run)
            if image:
                found.append({"text": "", "translatable": False, "is_image": True, **style})
            for n, piece in enumerate(pieces):
                if n:
                    found.append({"text": "\n", "translatable": translatable, "is_image": False, **style})
                if piece:
                    found.append({"text": piece, "translatable": translatable, "is_image": False, **style})
    return found


def _is_separator(paragraph: ET.Element) -> bool:
    """Whether a paragraph draws a straight connector, the line below the first page's metadata."""
    return any(g.get("prst") == "straightConnector1" for g in paragraph.iter(A + "prstGeom"))


def word_rows(path: str, content: bytes, mask_metadata: bool) -> Iterator[dict]:
    """One row for each paragraph of a Word file. With mask_metadata what stands before a section's separator isn't
    translatable."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        for part, xml in WORD_PARTS.items():
            if xml not in names:
                if part == "body":
                    raise ValueError(f"no {xml}")
                continue
            links = f"word/_rels/{xml.rsplit('/', 1)[1]}.rels"
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read(links))} if links in names else {}
            root = ET.fromstring(archive.read(xml))
            holder = root.find(W + "body") if part == "body" else root
            paragraphs = holder.findall(W + "p")
            section, sections, separators = 0, [], []
            for p in paragraphs:
                sections.append(section)
                separators.append(_is_separator(p))
                section += p.find(f"{W}pPr/{W}sectPr") is not None
            first = {}
            for n, (s, line) in enumerate(zip(sections, separators)):
                if line:
                    first.setdefault(s, n)
            for n, p in enumerate(paragraphs):
                translatable = part == "body" and not (mask_metadata and n < first.get(sections[n], -1))
                yield {
                    "path": path, "part": part, "para_index": n, "translatable": translatable, "section": sections[n], "is_separator": separators[n],
                    "runs": _runs(p, targets, translatable), "error": None,
                }


def read_word(files: DataFrame, mask_metadata: bool = False) -> DataFrame:
    """Paragraphs of Word files (path, content). A file that can't be read is one row with its error."""
    expose_package(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += list(word_rows(path, bytes(content), mask_metadata))
                except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError) as error:
                    rows.append({"path": path, "part": "body", "runs": [], "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARAGRAPHS.split(", ")], dtype=object).astype({"para_index": "Int32", "section": "Int32"})

    return files.select("path", "content").mapInPandas(read, PARAGRAPHS)


def paragraph_text(runs: Column) -> Column:
    return stripped(F.replace(F.array_join(F.transform(runs, lambda r: r["text"]), ""), F.lit("\n"), F.lit(" ")))


def word_scopes(paragraphs: DataFrame) -> DataFrame:
    """path with the texts to search: ico_format (null without a separator), header, footer and full_text (header and
    body); paragraphs have to be read with mask_metadata."""
    lines = paragraphs.filter("error is null").withColumn("line", paragraph_text(F.col("runs"))).withColumn("side", F.when(F.col("part") == "header", 0).when(F.col("part") == "body", 1).otherwise(2))

    def joined(keep: Column) -> Column:
        entries = F.sort_array(F.collect_list(F.when(keep & (F.col("line") != ""), F.struct("side", "para_index", "line"))))
        return F.nullif(F.array_join(F.transform(entries, lambda e: e["line"]), "\n"), F.lit(""))

    header, body = F.col("part") == "header", F.col("part") == "body"
    has_line = F.coalesce(F.bool_or(body & F.col("is_separator")), F.lit(False))
    return lines.groupBy("path").agg(
        F.when(has_line, joined(header | (body & ~F.col("translatable")))).alias("ico_format"), joined(header).alias("header"),
        joined(F.col("part") == "footer").alias("footer"), joined(header | body).alias("full_text"),
    )


def word_bytes(parts: dict[str, list[str]]) -> bytes:
    """A small Word file from plain paragraphs of its parts; the text --- draws a separator."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for part, paragraphs in parts.items():
            root = ET.Element(W + {"body": "document", "header": "hdr", "footer": "ftr"}[part])
            holder = ET.SubElement(root, W + "body") if part == "body" else root
            for text in paragraphs:
                p = ET.SubElement(holder, W + "p")
                run = ET.SubElement(p, W + "r")
                if text == "---":
                    ET.SubElement(ET.SubElement(run, W + "drawing"), A + "prstGeom", {"prst": "straightConnector1"})
                else:
                    ET.SubElement(run, W + "t").text = text
            archive.writestr(WORD_PARTS[part], ET.tostring(root, "utf-8", xml_declaration=True))
    return out.getvalue()


def replaced_word(content: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    """A Word file with some paragraphs' texts replaced, everything else byte for byte as it was."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in source.infolist():
            data = source.read(info.filename)
            part = next((p for p, xml in WORD_PARTS.items() if xml == info.filename), None)
            own = {n: text for (p, n), text in texts.items() if p == part}
            if own:
                root = ET.fromstring(data)
                holder = root.find(W + "body") if part == "body" else root
                for n, p in enumerate(holder.findall(W + "p")):
                    if n in own:
                        for k, t in enumerate(p.iter(W + "t")):
                            t.text = own[n] if k == 0 else ""
                data = ET.tostring(root, "utf-8", xml_declaration=True)
            target.writestr(info, data)
    return out.getvalue()


# --- presentations ------------------------------------------------------------------------------------------------


def _box(transform: ET.Element | None) -> dict:
    """Place, size and rotation of a shape's own transform; a shape that takes its layout's has none."""
    off, ext = (None if transform is None else transform.find(A + tag) for tag in ("off", "ext"))
    number = lambda node, key: None if node is None or node.get(key) is None else int(node.get(key))
    return {"x": number(off, "x"), "y": number(off, "y"), "width": number(ext, "cx"), "height": number(ext, "cy"), "rotation": number(transform, "rot")}


def _identity(shape: ET.Element, otherwise: str) -> tuple[str, str]:
    """A shape's id and name; extension lists inside its name's element don't matter."""
    name = next(shape.iter(P + "cNvPr"), None)
    return ("", otherwise) if name is None else (name.get("id", ""), name.get("name", otherwise))


def _body(body: ET.Element) -> dict:
    sizes = [int(r.get("sz")) / 100 for r in body.iter(A + "rPr") if (r.get("sz") or "").isdigit()]
    own = body.find(A + "bodyPr")
    fit = [] if own is None else [c.tag[len(A):] for c in own if c.tag in (A + "noAutofit", A + "normAutofit", A + "spAutoFit")]
    return {
        "font_points": max(sizes, default=18.0), "paragraphs": ["".join(t.text or "" for t in p.iter(A + "t")) for p in body.findall(A + "p")],
        "autofit": fit[0] if fit else None, "body": {} if own is None else {k: own.get(k) for k in BODY_PROPERTIES if own.get(k) is not None},
    }


def _containers(tree: ET.Element, groups: tuple[str, ...] = ()) -> Iterator[dict]:
    """The text containers of a tree of shapes, those in groups and table cells too.

    Placeholders that the master fills are there, marked as not translatable. A cell has its table's box.
    """
    for shape in tree:
        if shape.tag == P + "grpSp":
            yield from _containers(shape, (*groups, ":".join(_identity(shape, "group"))))
        elif shape.tag == P + "sp" and (body := shape.find(P + "txBody")) is not None:
            holder = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            kind = None if holder is None else holder.get("type")
            free, (number, name) = kind not in UNTRANSLATED_PLACEHOLDERS, _identity(shape, "shape")
            yield {
                "shape_id": number, "shape_name": name, "kind": "text_box" if holder is None else "placeholder", "placeholder_type": kind, "group_path": list(groups),
                **_box(shape.find(f"{P}spPr/{A}xfrm")), **_body(body), "translatable": free, "exclusion_reason": None if free else f"protected_placeholder:{kind}",
            }
        elif shape.tag == P + "graphicFrame" and (table := next(shape.iter(A + "tbl"), None)) is not None:
            (number, name), box = _identity(shape, "table"), _box(shape.find(P + "xfrm"))
            for i, row in enumerate(table.findall(A + "tr")):
                for j, cell in enumerate(row.findall(A + "tc")):
                    if (body := cell.find(A + "txBody")) is not None:
                        place = {"shape_id": number, "shape_name": name, "kind": "table_cell", "group_path": list(groups), "table_row": i, "table_col": j}
                        yield place | box | _body(body) | {"translatable": True}


def slide_rows(path: str, content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        slides = [n for n in archive.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
        number = {n: int(re.sub(r"\D", "", n.rsplit("/", 1)[1][:-4]) or 0) for n in slides}
        for name in sorted(slides, key=lambda n: (number[n], n)):
            tree = ET.fromstring(archive.read(name)).find(f"{P}cSld/{P}spTree")
            for c in _containers(tree) if tree is not None else ():
                yield {"path": path, "slide_path": name, "slide_number": number[name], **c, "error": None}


def read_slides(files: DataFrame) -> DataFrame:
    """Text containers of presentations (path, content) in the slides' order; an unreadable file is one row."""
    expose_package(files.sparkSession)
    columns = [c.split()[0] for c in CONTAINERS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += list(slide_rows(path, bytes(content)))
                except (zipfile.BadZipFile, ET.ParseError, ValueError) as error:
                    rows.append({"path": path, "paragraphs": [], "error": f"{type(error).__name__}: {error}"})
            kinds = {c: "Int32" for c in ("slide_number", "table_row", "table_col")} | {c: "Int64" for c in ("x", "y", "width", "height", "rotation")}
            yield pd.DataFrame(rows, columns=columns, dtype=object).astype(kinds | {"font_points": "float64"})

    return files.select("path", "content").mapInPandas(read, CONTAINERS)


def slide_texts(root: ET.Element) -> list[list[ET.Element]]:
    """The text nodes of a slide by paragraph, in the order of _containers() and their paragraphs."""
    tree, found = root.find(f"{P}cSld/{P}spTree"), []

    def walk(parent: ET.Element) -> None:
        for shape in parent:
            if shape.tag == P + "grpSp":
                walk(shape)
            bodies = []
            if shape.tag == P + "sp":
                bodies = shape.findall(P + "txBody")
            elif shape.tag == P + "graphicFrame" and (table := next(shape.iter(A + "tbl"), None)) is not None:
                bodies = table.findall(f"{A}tr/{A}tc/{A}txBody")
            for body in bodies:
                found.extend([list(p.iter(A + "t")) for p in body.findall(A + "p")])

    if tree is not None:
        walk(tree)
    return found


def replaced_slides(content: bytes, texts: dict[tuple[str, int, int], str]) -> bytes:
    """A presentation with some run texts replaced: texts by slide path, paragraph of the slide and run of it.

    Without a replacement that fits the same bytes come back. Slides that change are written anew, every other part as
    it was. A place that the slide doesn't have is an error.
    """
    if not texts:
        return content
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        unknown = {slide for slide, _, _ in texts} - set(source.namelist())
        if unknown:
            raise ValueError(f"no {sorted(unknown)[0]}")
        for info in source.infolist():
            data = source.read(info.filename)
            own = {(p, r): text for (slide, p, r), text in texts.items() if slide == info.filename}
            if own:
                root = ET.fromstring(data)
                nodes = slide_texts(root)
                for (p, r), text in own.items():
                    if p >= len(nodes) or r >= len(nodes[p]):
                        raise ValueError(f"{info.filename} has no run {r} in paragraph {p}")
                    nodes[p][r].text = text
                data = ET.tostring(root, "utf-8", xml_declaration=True)
            target.writestr(info, data)
    return out.getvalue()


def saved_slides(files: DataFrame, texts: DataFrame) -> DataFrame:
    """path and content of presentations (path, content) with new texts (path, slide_path, paragraph, run, text) put in.

    A presentation without new texts keeps its bytes; one that can't be written has a null content and its error.
    """
    expose_package(files.sparkSession)
    entry = F.struct("slide_path", "paragraph", "run", "text")
    grouped = texts.groupBy("path").agg(F.collect_list(entry).alias("texts"))  # one file's runs

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, new in zip(batch["path"], batch["content"], batch["texts"]):
                wanted = {} if new is None else {(t["slide_path"], int(t["paragraph"]), int(t["run"])): t["text"] for t in new}
                try:
                    rows.append((path, replaced_slides(bytes(content), wanted), None))
                except (zipfile.BadZipFile, ET.ParseError, ValueError) as error:
                    rows.append((path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").join(grouped, "path", "left").mapInPandas(write, "path string, content binary, error string")


def structure_digest(files: DataFrame) -> DataFrame:
    """path, part and the SHA-256 of each part of a package, slides without their texts: equal if only texts changed."""
    expose_package(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for name in archive.namelist():
                        data = archive.read(name)
                        if name.startswith("ppt/slides/slide") and name.endswith(".xml"):
                            root = ET.fromstring(data)
                            for t in root.iter(A + "t"):
                                t.text = ""
                            data = ET.canonicalize(ET.tostring(root, "unicode"), with_comments=True).encode()
                        rows.append((path, name, data))
            yield pd.DataFrame(rows, columns=["path", "part", "data"])

    parts = files.select("path", "content").mapInPandas(read, "path string, part string, data binary")
    return parts.select("path", "part", F.sha2("data", 256).alias("sha256"))
