"""DOCX and EPUB files as tables, and tables as such files, with the standard library's zip and XML.

Readers parse one file a row inside Arrow batches and keep positions explicit; writers build
one file a group and return its bytes as a column, which any sink can store.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"
OPF = "{http://www.idpf.org/2007/opf}"
NCX = "{http://www.daisy.org/z3986/2005/ncx/}"
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,style:string,font_name:string,font_size:double,font_color:string>"
PARAGRAPHS = f"path string, pos long, origin string, style string, text string, runs array<{RUN}>"
SPANS = "array<struct<href:string,runs:array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,image:string>>>>"
BLOCKS = f"path string, pos long, kind string, style string, text string, spans {SPANS}, rows array<array<{SPANS}>>, images array<struct<name:string,mime:string,content:binary>>"
PROPERTIES = "path string, title string, author string"
ITEMS = "path string, item_id string, href string, media_type string, content binary"
SPINE = "path string, pos long, item_id string"
TOC = "path string, pos long, title string, href string"

#: What a document without these properties is called.
NO_TITLE, NO_AUTHOR = "Untitled Book", "Unknown Author"


def read_files(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    """path, content of the files whose names fit the pattern; editors' lock files (~) and files of no bytes are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.where(~F.startswith(name, F.lit("~"))).select("path", "content")


#: What a broken file raises while it is opened or parsed.
BROKEN = (zipfile.BadZipFile, ET.ParseError, zlib.error, LookupError, AttributeError, TypeError, ValueError, StopIteration, EOFError, OSError, RuntimeError)
ERRORS = "path string, stage string, error string"


def _map(files: DataFrame, rows_of, schema: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *r) for r in rows_of(zipfile.ZipFile(io.BytesIO(content)))]
                except BROKEN:  # a broken file has no rows; failed_files gives the error of this very parse
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def failed_files(files: DataFrame, *stages: str) -> DataFrame:
    """path, stage, error: what stands in the way of a file's rows, one row for each stage that fails.

    Stages are names of readers in this module, by default those of the file's kind by its
    suffix. Before them, "open" is a file that is no zip, and "member" one with a part that
    can't be unpacked; later stages of the file are tried all the same.
    """

    def problems(path: str, content: bytes) -> Iterator[tuple[str, str]]:
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
        except BROKEN as e:
            yield "open", f"{type(e).__name__}: {e}"
            return
        try:
            if bad := z.testzip():
                yield "member", f"bad checksum of {bad}"
        except BROKEN as e:
            yield "member", f"{type(e).__name__}: {e}"
        kind = path.rpartition(".")[2].lower()
        for stage in stages or [s for s in READERS if s.startswith(kind)]:
            try:
                READERS[stage](z)
            except BROKEN as e:
                yield stage, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(path, *p) for path, content in zip(batch["path"], batch["content"], strict=True) for p in problems(path, content)]
            yield pd.DataFrame(found, columns=["path", "stage", "error"], dtype=object)

    return files.mapInPandas(run, ERRORS)


def _flag(properties: ET.Element | None, name: str) -> bool | None:
    """True, False, or None where the style decides."""
    e = properties.find(f"{W}{name}") if properties is not None else None
    return None if e is None else e.get(f"{W}val", "true") not in ("0", "false", "none")


def _value(properties: ET.Element | None, name: str, attribute: str = "val") -> str | None:
    e = properties.find(f"{W}{name}") if properties is not None else None
    return None if e is None else e.get(f"{W}{attribute}")


_TEXTS = (f"{W}t", f"{W}tab", f"{W}br")


def _run_texts(r: ET.Element) -> list[str]:
    return [{f"{W}t": e.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(e.tag, "") for e in r]


def _all_paragraphs(document: ET.Element) -> list[ET.Element]:
    body = document.find(f"{W}body")
    return body.findall(f"{W}p") + [p for t in body.findall(f"{W}tbl") for p in t.iter(f"{W}p")]


def _run(r: ET.Element) -> dict:
    p = r.find(f"{W}rPr")
    size = _value(p, "sz")
    return {"text": "".join(_run_texts(r)), "bold": _flag(p, "b"), "italic": _flag(p, "i"), "underline": _flag(p, "u"), "style": _value(p, "rStyle"), "font_name": _value(p, "rFonts", "ascii"), "font_size": float(size) / 2 if size else None, "font_color": _value(p, "color")}


def _styles(z: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in z.namelist():
        return {}
    root = ET.fromstring(z.read("word/styles.xml"))
    return {s.get(f"{W}styleId"): n.get(f"{W}val", "") for s in root.iter(f"{W}style") if (n := s.find(f"{W}name")) is not None}


def _paragraph(p: ET.Element, styles: dict[str, str]) -> tuple[str, str, list[dict]]:
    style = _value(p.find(f"{W}pPr"), "pStyle")
    name = styles.get(style, style or "Normal")
    # built-in heading names are stored in lower case
    name = name[0].upper() + name[1:] if name.startswith("heading ") else name
    runs = [_run(r) for r in p.iter(f"{W}r")]
    return name, "".join(r["text"] for r in runs), runs


def _paragraph_rows(z: zipfile.ZipFile) -> list[tuple]:
    body, styles = ET.fromstring(z.read("word/document.xml")).find(f"{W}body"), _styles(z)
    found = [("body", p) for p in body.findall(f"{W}p")] + [("table", p) for t in body.findall(f"{W}tbl") for p in t.iter(f"{W}p")]
    return [(pos, origin, *_paragraph(p, styles)) for pos, (origin, p) in enumerate(found)]


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """path, pos, origin, style, text, runs: body paragraphs in order, then those of table cells (row by row)."""
    return _map(files, _paragraph_rows, PARAGRAPHS)


def _block_rows(z: zipfile.ZipFile) -> list[tuple]:
    body, styles = ET.fromstring(z.read("word/document.xml")).find(f"{W}body"), _styles(z)
    targets = {}
    if "word/_rels/document.xml.rels" in z.namelist():
        targets = {e.get("Id"): e.get("Target") for e in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    images: list[dict] = []

    def span_run(r: ET.Element) -> dict:
        run = {k: v for k, v in _run(r).items() if k in ("text", "bold", "italic", "underline")} | {"image": None}
        blip = next(r.iter(f"{A}blip"), None)
        if blip is not None and (target := targets.get(blip.get(f"{R}embed"))):
            data = z.read(posixpath.normpath(posixpath.join("word", target)))
            kind = target.rpartition(".")[2].lower().replace("jpeg", "jpg")
            run["image"] = f"image_{hashlib.sha256(data).hexdigest()[:8]}.{kind}"
            images.append({"name": run["image"], "mime": f"image/{kind.replace('jpg', 'jpeg')}", "content": data})
        return run

    def spans(p: ET.Element) -> list[dict]:
        out = []
        for child in p:
            if child.tag == f"{W}r":
                out.append({"href": None, "runs": [span_run(child)]})
            elif child.tag == f"{W}hyperlink":
                out.append({"href": targets.get(child.get(f"{R}id"), "#"), "runs": [span_run(r) for r in child.findall(f"{W}r")]})
        return out

    out = []
    for pos, e in enumerate(x for x in body if x.tag in (f"{W}p", f"{W}tbl")):
        images = []
        if e.tag == f"{W}tbl":
            cells = [[[s for p in c.findall(f"{W}p") for s in spans(p)] for c in r.findall(f"{W}tc")] for r in e.findall(f"{W}tr")]
            out.append((pos, "tbl", None, "", [], cells, images))
        else:
            style, text, _ = _paragraph(e, styles)
            out.append((pos, "p", style, text, spans(e), [], images))
    return out


def docx_blocks(files: DataFrame) -> DataFrame:
    """path, pos, kind (p or tbl), style, text, spans, rows, images: the body's blocks in true order.

    A span is a plain stretch of runs (href null) or a hyperlink (# where its target is
    missing). rows holds a table's cells as spans. A run's first image stands for the run; its
    name is made from its content, so that it is the same every time.
    """
    return _map(files, _block_rows, BLOCKS)


def _property_rows(z: zipfile.ZipFile) -> list[tuple]:
    core = ET.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else ET.Element("none")
    return [(core.findtext(f"{DC}title") or NO_TITLE, core.findtext(f"{DC}creator") or NO_AUTHOR)]


def docx_properties(files: DataFrame) -> DataFrame:
    """path, title, author, with defaults for missing or empty ones."""
    return _map(files, _property_rows, PROPERTIES)


def _package(z: zipfile.ZipFile) -> tuple[ET.Element, str]:
    where = next(ET.fromstring(z.read("META-INF/container.xml")).iter(f"{CONTAINER}rootfile")).get("full-path")
    return ET.fromstring(z.read(where)), posixpath.dirname(where)


def _item_rows(z: zipfile.ZipFile) -> list[tuple]:
    package, base = _package(z)
    names = set(z.namelist())
    return [(i.get("id"), i.get("href"), i.get("media-type"), z.read(at) if (at := posixpath.normpath(posixpath.join(base, i.get("href")))) in names else None) for i in package.iter(f"{OPF}item")]


def epub_items(files: DataFrame) -> DataFrame:
    """path, item_id, href, media_type, content: the manifest; items without a file have null content."""
    return _map(files, _item_rows, ITEMS)


def _spine_rows(z: zipfile.ZipFile) -> list[tuple]:
    return [(n, i.get("idref")) for n, i in enumerate(_package(z)[0].iter(f"{OPF}itemref"))]


def epub_spine(files: DataFrame) -> DataFrame:
    """path, pos, item_id in reading order."""
    return _map(files, _spine_rows, SPINE)


def _toc_rows(z: zipfile.ZipFile) -> list[tuple]:
    package, base = _package(z)
    ncx = next((i.get("href") for i in package.iter(f"{OPF}item") if i.get("media-type") == "application/x-dtbncx+xml"), None)
    if ncx is None:
        return []
    top = ET.fromstring(z.read(posixpath.normpath(posixpath.join(base, ncx)))).find(f"{NCX}navMap")
    points = []
    for p in top.findall(f"{NCX}navPoint"):
        points += p.findall(f"{NCX}navPoint") or [p]
    return [(n, "".join(p.find(f"{NCX}navLabel").itertext()).strip(), p.find(f"{NCX}content").get("src")) for n, p in enumerate(points)]


def epub_toc(files: DataFrame) -> DataFrame:
    """path, pos, title, href: top-level entries and those directly below one; deeper ones are left out."""
    return _map(files, _toc_rows, TOC)


#: The parse of each reader, by the name of the reader.
READERS = {"docx_paragraphs": _paragraph_rows, "docx_blocks": _block_rows, "docx_properties": _property_rows, "epub_items": _item_rows, "epub_spine": _spine_rows, "epub_toc": _toc_rows}


def decode_text(files: DataFrame, encoding: str = "cp437", content: str = "content") -> DataFrame:
    """files with text: content in an encoding that the engine's own decode doesn't know; bytes that don't fit are replaced."""

    @F.pandas_udf("string")
    def text(c: pd.Series) -> pd.Series:
        return c.map(lambda b: None if b is None else bytes(b).decode(encoding, "replace"))

    return files.withColumn("text", text(content))


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_DOC_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'


def _zip(entries: list[tuple[str, bytes, bool]]) -> bytes:
    """Equal entries give equal bytes: times are fixed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, packed in entries:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


def build_docx(paragraphs: list[tuple[str, list[dict]]]) -> bytes:
    """A document of (style, runs); styles that aren't headings or titles become Normal."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    names = ["Normal", "Title", "Subtitle", *(f"Heading {i}" for i in range(1, 10))]
    body = []
    for style, runs in paragraphs:
        style = style if style in names else "Normal"
        cells = []
        for r in runs:
            flags = "".join(f'<w:{tag} w:val="{"single" if tag == "u" and r.get(key) else "none" if tag == "u" else int(bool(r.get(key)))}"/>' for key, tag in (("bold", "b"), ("italic", "i"), ("underline", "u")) if r.get(key) is not None)
            font = f"<w:rFonts w:ascii={quoteattr(r['font_name'])} w:hAnsi={quoteattr(r['font_name'])}/>" if r.get("font_name") else ""
            colour = f"<w:color w:val={quoteattr(r['font_color'])}/>" if r.get("font_color") else ""
            size = f'<w:sz w:val="{int(r["font_size"] * 2)}"/>' if r.get("font_size") and r["font_size"] == r["font_size"] else ""
            cells.append(f'<w:r><w:rPr>{font}{flags}{colour}{size}</w:rPr><w:t xml:space="preserve">{escape(r.get("text") or "")}</w:t></w:r>')
        body.append(f'<w:p><w:pPr><w:pStyle w:val="{style.replace(" ", "")}"/></w:pPr>{"".join(cells)}</w:p>')
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{n.replace(" ", "")}"><w:name w:val="{n}"/></w:style>' for n in names)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    return _zip([("[Content_Types].xml", _TYPES.encode(), True), ("_rels/.rels", _RELS.encode(), True), ("word/_rels/document.xml.rels", _DOC_RELS.encode(), True), ("word/styles.xml", f"{head}<w:styles {w}>{styles}</w:styles>".encode(), True), ("word/document.xml", f"{head}<w:document {w}><w:body>{''.join(body)}</w:body></w:document>".encode(), True)])


def to_docx(paragraphs: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys..., content: one document a group, e.g. a part of a split; columns style and runs are its paragraphs."""
    schema = ", ".join(f"{k} {t}" for k, t in paragraphs.select(*keys).dtypes) + ", content binary"

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(pos)
        rows = [(s, [r if isinstance(r, dict) else r.asDict() for r in runs]) for s, runs in zip(ordered["style"], ordered["runs"], strict=True)]
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), build_docx(rows)]], columns=[*keys, "content"])

    return paragraphs.groupBy(*keys).applyInPandas(build, schema)


#: The style sheet of a built book.
CSS = "body { font-family: serif; } h1 { text-align: center; } a { color: #0000EE; }"


def build_epub(title: str, author: str, chapters: list[tuple[str, str]], images: list[tuple[str, str, bytes]] = (), css: str = CSS, cover: bytes | None = None) -> bytes:
    """A book of (title, XHTML body) chapters with manifest, spine, NCX and navigation document; of images with one name the first counts.

    cover is a PNG or JPEG image, which gets a page of its own before all others.
    """
    names = [f"chap_{i}.xhtml" for i in range(len(chapters))]
    pictures = {name: (mime, data) for name, mime, data in reversed(images)}
    page = lambda t, b: f'<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(t)}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>{b}</body></html>'
    manifest = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    manifest += "".join(f'<item id="img{i}" href="images/{n}" media-type="{mime}"/>' for i, (n, (mime, _)) in enumerate(sorted(pictures.items())))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    front, cover_files = "", []
    if cover is not None:
        kind = "png" if bytes(cover[:4]) == b"\x89PNG" else "jpeg"
        manifest += f'<item id="cover-image" href="cover.{kind}" media-type="image/{kind}" properties="cover-image"/><item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>'
        front = '<itemref idref="cover"/>'
        cover_files = [("EPUB/cover.xhtml", page("Cover", f'<img src="cover.{kind}" alt="Cover"/>').encode(), True), (f"EPUB/cover.{kind}", bytes(cover), False)]
    opf = f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{hashlib.sha256((title + author).encode()).hexdigest()[:32]}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>{manifest}</manifest><spine toc="ncx">{front}<itemref idref="nav"/>{spine}</spine></package>'
    points = "".join(f'<navPoint id="n{i}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, ((t, _), n) in enumerate(zip(chapters, names, strict=True)))
    ncx = f'<?xml version="1.0" encoding="UTF-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'
    nav = page(title, '<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for (t, _), n in zip(chapters, names, strict=True)) + "</ol></nav>")
    container = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    files = [("mimetype", b"application/epub+zip", False), ("META-INF/container.xml", container.encode(), True), ("EPUB/content.opf", opf.encode(), True), ("EPUB/toc.ncx", ncx.encode(), True), ("EPUB/nav.xhtml", nav.encode(), True), ("EPUB/style.css", css.encode(), True)]
    stored = [(f"EPUB/images/{n}", bytes(data), False) for n, (_, data) in sorted(pictures.items())]
    return _zip([*files, *cover_files, *((f"EPUB/{n}", page(t, b).encode(), True) for (t, b), n in zip(chapters, names, strict=True)), *stored])


def to_epub(chapters: DataFrame, book: str = "book_id", order: str = "chap_id") -> DataFrame:
    """book, content: one e-book a group of chapters; book_title, author, title, html and, if there, images and cover (of its first chapter) are its parts."""
    kind = chapters.select(book).dtypes[0][1]

    def build(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        images = [(i["name"], i["mime"], i["content"]) for own in g["images"] for i in own] if "images" in g.columns else []
        cover = g["cover"].iloc[0] if "cover" in g.columns else None
        data = build_epub(g["book_title"].iloc[0] or NO_TITLE, g["author"].iloc[0] or NO_AUTHOR, list(zip(g["title"], g["html"], strict=True)), images, cover=cover)
        return pd.DataFrame([[g[book].iloc[0], data]], columns=[book, "content"])

    return chapters.groupBy(book).applyInPandas(build, f"{book} {kind}, content binary")


def edit_docx(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content: the documents with new run texts, all other parts and formats as they were.

    files has path and content; edits has path, pos (of docx_paragraphs) and texts (array<string>, one
    for each run): extra texts join the last run, runs without one become empty. A document
    without edits comes out byte by byte the same; one that can't be parsed has null content.
    """
    by_path = edits.groupBy("path").agg(F.collect_list(F.struct("pos", "texts")).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, own in zip(batch["content"], batch["edits"], strict=True):
                try:
                    out.append(content if own is None else _edited(content, {e["pos"]: list(e["texts"]) for e in own}))
                except BROKEN:
                    out.append(None)
            yield pd.DataFrame({"path": batch["path"], "content": out})

    return files.select("path", "content").join(by_path, "path", "left").mapInPandas(run, "path string, content binary")


def _edited(content: bytes, edits: dict[int, list[str]]) -> bytes:
    z = zipfile.ZipFile(io.BytesIO(content))
    source = z.read("word/document.xml")
    spaces = dict(pair for _, pair in ET.iterparse(io.BytesIO(source), events=["start-ns"]))
    for prefix, uri in spaces.items():
        if prefix and not (prefix.startswith("ns") and prefix[2:].isdigit()):
            ET.register_namespace(prefix, uri)
    root = ET.fromstring(source)
    for pos, p in enumerate(_all_paragraphs(root)):
        runs = list(p.iter(f"{W}r"))
        if pos not in edits or not runs:
            continue
        texts = (edits[pos] + [""] * len(runs))[: len(runs) - 1] + ["".join(edits[pos][len(runs) - 1 :])]
        for r, t in zip(runs, texts, strict=True):
            if "".join(_run_texts(r)) == t:
                continue
            for e in [e for e in r if e.tag in _TEXTS]:
                r.remove(e)
            own = ET.SubElement(r, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
            own.text = t
    body = ET.tostring(root, encoding="UTF-8", xml_declaration=True)
    # prefixes that only attribute values name, such as those to ignore, have to stay declared
    start = body.index(b"<", body.index(b"?>"))
    head = body[start : body.index(b">", start)]
    lost = "".join(f" xmlns:{k}={quoteattr(u)}" for k, u in spaces.items() if k and f"xmlns:{k}=".encode() not in head)
    at = start + len(head.split(b" ")[0].rstrip(b"/"))
    body = body[:at] + lost.encode() + body[at:]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as new:
        for info in z.infolist():
            new.writestr(info, body if info.filename == "word/document.xml" else z.read(info.filename), info.compress_type)
    return out.getvalue()


def save_files(files: DataFrame, name: str, content: str = "content") -> int:
    """Write each row's bytes to the path or URI in column `name`, on the executors; the number of files written.

    A file is written beside its place and then moved there, so an old one is whole until the
    new one is, and a repeated task does no harm. The places must be reachable from every
    executor by a file system that pyarrow knows. Rows without name or content are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, data in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
                beside = f"{at}.{uuid.uuid4().hex}"
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(beside) as out:
                    out.write(data)
                store.move(beside, at)
            yield pd.DataFrame({"n": [len(batch)]})

    some = files.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).where("name IS NOT NULL AND content IS NOT NULL")
    return some.mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
