"""Merging Word files: every document keeps its sections, headers, footers, pictures, links, lists and styles.

A file is a package of parts that refer to each other by relationship ids. Appending a document copies the parts it
refers to under new names, gives their references new ids, and ends the section before with a section break, so that the
next document begins on a new page with its own page setup.
"""

from __future__ import annotations

import copy
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomq.operators.merge import BATCH
from loomq.operators.prefix import places
from loomq.session import expose_package, store
from loomq.sources.office import R, W

# Name spaces, relationship kinds and the main part.
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
KINDS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
MAIN, STYLES, NUMBERING = "word/document.xml", "word/styles.xml", "word/numbering.xml"
HEADER_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.{}+xml"
#: What an appended document may refer to only by ids that a copy doesn't translate.
NOT_COPIED = ("footnoteReference", "endnoteReference", "commentReference")


class Package:
    """The parts of a file, with the relationships of each."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            self.parts = {n: archive.read(n) for n in archive.namelist()}
        if MAIN not in self.parts:
            raise ValueError(f"no {MAIN}")
        _keep_prefixes(self.parts[MAIN])
        self.main = ET.fromstring(self.parts[MAIN])
        self.body = self.main.find(W + "body")
        types = ET.fromstring(self.parts.get("[Content_Types].xml", f'<Types xmlns="{TYPES[1:-1]}"/>'))
        self.defaults = {t.get("Extension").lower(): t.get("ContentType") for t in types.findall(TYPES + "Default")}
        self.overrides = {t.get("PartName").lstrip("/"): t.get("ContentType") for t in types.findall(TYPES + "Override")}

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """By id the kind, target (a part's name, or an address) and whether that is outside of the package."""
        data = self.parts.get(_rels(part))
        found = {}
        for r in ET.fromstring(data).findall(PACKAGE + "Relationship") if data else ():
            outside, target = r.get("TargetMode") == "External", r.get("Target")
            if not outside:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))
            found[r.get("Id")] = (r.get("Type"), target, outside)
        return found

    def relate(self, part: str, kind: str, target: str, outside: bool = False) -> str:
        """The id of a new relationship of a part."""
        known = self.relations(part)
        n = 1 + max((int(m[1]) for k in known if (m := re.fullmatch(r"rId(\d+)", k))), default=0)
        known[f"rId{n}"] = (kind, target, outside)
        root = ET.Element(PACKAGE + "Relationships")
        for key, (own, to, away) in known.items():
            mode = {"TargetMode": "External"} if away else {}
            ET.SubElement(root, PACKAGE + "Relationship", {"Id": key, "Type": own, "Target": to if away else "/" + to, **mode})
        self.parts[_rels(part)] = ET.tostring(root, "utf-8", xml_declaration=True)
        return f"rId{n}"

    def free_name(self, name: str) -> str:
        stem, end = posixpath.splitext(name)
        stem = re.sub(r"\d+$", "", stem)
        return next(c for n in range(1, len(self.parts) + 2) if (c := f"{stem}{n}{end}") not in self.parts)

    def type_of(self, part: str) -> str:
        return self.overrides.get(part) or self.defaults.get(posixpath.splitext(part)[1][1:].lower()) or "application/octet-stream"

    def bytes(self) -> bytes:
        types = ET.Element(TYPES + "Types")
        for extension, kind in self.defaults.items():
            ET.SubElement(types, TYPES + "Default", {"Extension": extension, "ContentType": kind})
        for part, kind in self.overrides.items():
            ET.SubElement(types, TYPES + "Override", {"PartName": "/" + part, "ContentType": kind})
        self.parts["[Content_Types].xml"] = ET.tostring(types, "utf-8", xml_declaration=True)
        self.parts[MAIN] = ET.tostring(self.main, "utf-8", xml_declaration=True)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name in sorted(self.parts, key=lambda n: (n != "[Content_Types].xml", n)):
                archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), self.parts[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def _rels(part: str) -> str:
    folder, name = posixpath.split(part)
    return f"{folder}/_rels/{name}.rels"


def _keep_prefixes(data: bytes) -> None:
    """Written parts keep the prefixes that attributes such as mc:Ignorable speak of."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), ["start-ns"]):
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)


def _copy_part(source: Package, target: Package, part: str, copied: dict[str, str]) -> str:
    """A part with all it refers to under new names; its own references keep their ids."""
    if part in copied:
        return copied[part]
    name = copied[part] = target.free_name(part)
    target.parts[name], target.overrides[name] = source.parts[part], source.type_of(part)
    relations = source.relations(part)
    if relations:
        root = ET.Element(PACKAGE + "Relationships")
        for key, (kind, to, outside) in relations.items():
            if not outside and to in source.parts:
                to = "/" + _copy_part(source, target, to, copied)
            mode = {"TargetMode": "External"} if outside else {}
            ET.SubElement(root, PACKAGE + "Relationship", {"Id": key, "Type": kind, "Target": to, **mode})
        target.parts[_rels(name)] = ET.tostring(root, "utf-8", xml_declaration=True)
    return name


def _add_styles(source: Package, target: Package) -> None:
    """Styles that the target has no style of that id for."""
    if STYLES not in source.parts:
        return
    if STYLES not in target.parts:
        target.parts[STYLES], target.overrides[STYLES] = source.parts[STYLES], source.type_of(STYLES)
        target.relate(MAIN, KINDS + "styles", STYLES)
        return
    for package in (source, target):
        _keep_prefixes(package.parts[STYLES])
    own = ET.fromstring(target.parts[STYLES])
    known = {s.get(W + "styleId") for s in own.findall(W + "style")}
    for style in ET.fromstring(source.parts[STYLES]).findall(W + "style"):
        if style.get(W + "styleId") not in known:
            style.attrib.pop(W + "default", None)
            own.append(style)
    target.parts[STYLES] = ET.tostring(own, "utf-8", xml_declaration=True)


def _add_lists(source: Package, target: Package, elements: list[ET.Element]) -> None:
    """Lists of the appended elements go on counting by themselves: their definitions get numbers of their own."""
    if NUMBERING not in source.parts:
        return
    _keep_prefixes(source.parts[NUMBERING])
    theirs = ET.fromstring(source.parts[NUMBERING])
    if NUMBERING not in target.parts:
        target.parts[NUMBERING], target.overrides[NUMBERING] = ET.tostring(ET.Element(W + "numbering")), source.type_of(NUMBERING)
        target.relate(MAIN, KINDS + "numbering", NUMBERING)
    own = ET.fromstring(target.parts[NUMBERING])
    numbers = lambda root, tag, key: [int(e.get(W + key)) for e in root.findall(W + tag)]
    first = {tag: 1 + max(numbers(own, tag, key), default=0) for tag, key in (("abstractNum", "abstractNumId"), ("num", "numId"))}
    after = len(own.findall(W + "abstractNum"))
    for shape in theirs.findall(W + "abstractNum"):
        shape.set(W + "abstractNumId", str(int(shape.get(W + "abstractNumId")) + first["abstractNum"]))
        own.insert(after, shape)  # definitions stand before their uses
        after += 1
    for num in theirs.findall(W + "num"):
        num.set(W + "numId", str(int(num.get(W + "numId")) + first["num"]))
        of = num.find(W + "abstractNumId")
        of.set(W + "val", str(int(of.get(W + "val")) + first["abstractNum"]))
        own.append(num)
    target.parts[NUMBERING] = ET.tostring(own, "utf-8", xml_declaration=True)
    for element in elements:
        for use in element.iter(W + "numId"):
            if int(use.get(W + "val")):  # 0 means no list
                use.set(W + "val", str(int(use.get(W + "val")) + first["num"]))


def _own_edges(target: Package, section: ET.Element) -> None:
    """A header and a footer, empty if it has none, so that a section doesn't take those of the one before."""
    for kind, tag in (("footer", "ftr"), ("header", "hdr")):
        if any(r.get(W + "type") == "default" for r in section.findall(f"{W}{kind}Reference")):
            continue
        name = target.free_name(f"word/{kind}.xml")
        root = ET.Element(W + tag)
        ET.SubElement(root, W + "p")
        target.parts[name], target.overrides[name] = ET.tostring(root, "utf-8", xml_declaration=True), HEADER_TYPE.format(kind)
        reference = ET.Element(f"{W}{kind}Reference", {W + "type": "default", R + "id": target.relate(MAIN, KINDS + kind, name)})
        section.insert(0 if kind == "header" else len(section.findall(W + "headerReference")), reference)


def _begin_page(section: ET.Element) -> None:
    kind = section.find(W + "type")
    if kind is None:
        before = [W + t for t in ("headerReference", "footerReference", "footnotePr", "endnotePr")]
        kind = ET.Element(W + "type")
        section.insert(sum(e.tag in before for e in section), kind)
    kind.set(W + "val", "nextPage")


def append_document(target: Package, source: Package) -> None:
    """Add a document behind what the target holds, as sections of its own. An error leaves the target's text as it was."""
    for tag in NOT_COPIED:
        if next(source.body.iter(W + tag), None) is not None:
            raise ValueError(f"{tag}s can't be appended")
    elements = [copy.deepcopy(e) for e in source.body]
    last = next((e for e in elements if e.tag == W + "sectPr"), None)
    ids, copied = {}, {}
    relations = source.relations(MAIN)
    used = {v for e in elements for x in e.iter() for k, v in x.attrib.items() if k.startswith(R) and v in relations}
    for key in sorted(used):
        kind, to, outside = relations[key]
        if not outside and to not in source.parts:
            raise ValueError(f"no {to}")
        ids[key] = target.relate(MAIN, kind, to if outside else _copy_part(source, target, to, copied), outside)
    for element in elements:
        for x in element.iter():
            for k, v in x.attrib.items():
                if k.startswith(R) and v in ids:
                    x.set(k, ids[v])
    _add_styles(source, target)
    _add_lists(source, target, elements)
    ending = target.body.find(W + "sectPr")
    if last is None:
        last = ET.Element(W + "sectPr")
        elements.append(last)
    first = next((s for e in elements for s in ([e] if e.tag == W + "sectPr" else e.iter(W + "sectPr"))), last)
    _own_edges(target, first)
    _begin_page(first)
    if ending is not None:
        target.body.remove(ending)
    closing = ET.SubElement(ET.SubElement(target.body, W + "p"), W + "pPr")
    closing.append(ending if ending is not None else ET.Element(W + "sectPr"))
    target.body.extend(elements)


def merged_word(named: list[tuple[str, bytes]]) -> tuple[bytes, int, list[str]]:
    """(file, documents in it, warnings) of documents in order.

    One that isn't a Word file is an error that names it; one that can't be appended is left out with a warning.
    """
    target, n, warnings = None, 0, []
    for name, content in named:
        try:
            package = Package(content)
        except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError) as error:
            raise ValueError(f"{name}: {error}") from error
        if target is None:
            target, n = package, 1
            continue
        before, rels = list(target.body), dict(target.parts)
        try:
            append_document(target, package)
            n += 1
        except (ValueError, KeyError, ET.ParseError) as error:
            target.body[:], target.parts = before, rels
            warnings.append(f"{name}: {error}")
    if target is None:
        raise ValueError("nothing to merge")
    return target.bytes(), n, warnings


_CHUNK = "batch long, content binary, segments long, warnings array<string>"


def merge_word(files: DataFrame, order: str, batch: int = BATCH) -> DataFrame:
    """content, segments, files_processed, batches and warnings of all files (path, content) merged in an order, one row.

    Up to batch files are merged in one step. More are merged in batches, which are spread over the cluster and written,
    and then their results; no task holds more than a batch of files, and the last one the results of all.
    """
    spark: SparkSession = files.sparkSession
    expose_package(spark)
    placed = places(files.select("path", "content", order), [F.col(order), F.col("path")], "__place")
    total = placed.count()
    if not total:
        raise ValueError("nothing to merge")
    distinct = files.select("path").distinct().count()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__place")
        content, n, warnings = merged_word([(p, bytes(c)) for p, c in zip(rows["path"], rows["content"])])
        return pd.DataFrame([(key[0], content, n, warnings)], columns=["batch", "content", "segments", "warnings"])

    number = ((F.col("__place") - 1) / batch).cast("long")
    chunks = placed.withColumn("batch", number).groupBy("batch").applyInPandas(merge, _CHUNK)
    batches = -(-total // batch) if total > batch else 0
    if not batches:
        whole = chunks
    else:
        chunks = store(chunks, "word-batches")

        def join(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = pd.concat(list(rows)).sort_values("batch")
            if len(found):
                content, _, more = merged_word([(f"batch {b}", bytes(c)) for b, c in zip(found["batch"], found["content"])])
                warnings = [w for own in found["warnings"] for w in own] + more
                yield pd.DataFrame([(0, content, int(found["segments"].sum()), warnings)], columns=["batch", "content", "segments", "warnings"])

        whole = chunks.coalesce(1).mapInPandas(join, _CHUNK)
    return whole.select("content", "segments", F.lit(distinct).cast("long").alias("files_processed"), F.lit(batches).cast("long").alias("batches"), "warnings")


def merge_error(error: Exception) -> str:
    """What a merge says about the file that stopped it, without the frames of its workers."""
    found = re.findall(r"ValueError: ([^\n]+)", str(error))
    return found[-1] if found else str(error).split("\n", 1)[0]
