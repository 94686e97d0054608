import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.services import external, pages_without_language, paragraph_edits, remove_language, stop_word_language, with_error
from textloom.functions import html
from textloom.operators import chapters, report
from textloom.plans import crawl
from textloom.sources import containers, http, images
from textloom.sources.lines import read_texts, write_texts
from textloom.streaming import poll


def run(text, **flags):
    keys = ("bold", "italic", "underline", "style", "font_name", "font_size", "font_color")
    return {"text": text} | {k: flags.get(k) for k in keys}


def test_docx_round_trip(spark, tmp_path):
    data = containers.build_docx([("Heading 1", [run("One", bold=True)]), ("Odd", [run("a", italic=False), run(" & b", font_size=11.5, font_color="FF0000")])])
    (tmp_path / "x.docx").write_bytes(data)
    (tmp_path / "~$x.docx").write_bytes(b"lock")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    files = containers.read_files(spark, str(tmp_path), "*.docx")
    rows = containers.docx_paragraphs(files).orderBy("pos").collect()
    assert [(r.style, r.text, r.origin) for r in rows] == [("Heading 1", "One", "body"), ("Normal", "a & b", "body")]
    assert rows[0].runs[0].bold is True and rows[0].runs[0].italic is None
    assert rows[1].runs[0].italic is False and rows[1].runs[1].font_size == 11.5 and rows[1].runs[1].font_color == "FF0000"
    assert [r.path.rpartition("/")[2] for r in containers.failed_files(files).collect()] == ["bad.docx"]
    again = containers.to_docx(containers.docx_paragraphs(files), ["path"]).first().content
    assert bytes(again) == data
    assert containers.docx_properties(files).first()[1:] == ("Untitled Book", "Unknown Author")
    assert [b.kind for b in containers.docx_blocks(files).collect()] == ["p", "p"]


def test_epub_round_trip(spark, tmp_path):
    chapters = spark.createDataFrame([(1, 2, "B & C", "<p>two words</p>", "T", "A"), (1, 1, "A", "<h1>A</h1><p>x</p>", "T", "A")], "book_id long, chap_id long, title string, html string, book_title string, author string")
    out = containers.to_epub(chapters).withColumn("name", F.lit(f"{tmp_path}/b.epub"))
    assert containers.save_files(out, "name") == 1
    files = containers.read_files(spark, str(tmp_path), "*.epub")
    toc = containers.epub_toc(files).orderBy("pos").collect()
    assert [(r.title, r.href) for r in toc] == [("A", "chap_0.xhtml"), ("B & C", "chap_1.xhtml")]
    items, spine = containers.epub_items(files), containers.epub_spine(files)
    read = spine.join(items, ["path", "item_id"]).where("media_type = 'application/xhtml+xml'").withColumn("html", F.col("content").cast("string"))
    counted = report.chapter_counts(read, "pos", by=["path"])
    assert [r.number for r in counted.orderBy("pos").collect()] == [1, 2, 3]
    text = report.report(counted, "href", "path").first().text.split("\n")
    assert text[2] == "-" * 96 and text[-2] == "Total Chapters Analyzed: 3" and len(text) == 9


def test_cp437(spark):
    df = spark.createDataFrame([(bytearray(b"caf\x82"),), (None,)], "content binary")
    assert [r.text for r in containers.decode_text(df).collect()] == ["café", None]


def test_texts(spark, tmp_path):
    write_texts(spark.createDataFrame([("a", "x\ny\n")], "doc_id string, text string"), str(tmp_path / "out"))
    assert read_texts(spark, str(tmp_path / "out/doc_id=a")).first().text == "x\ny\n"


def test_blur(spark, tmp_path):
    (tmp_path / "flat.pgm").write_bytes(b"P5 4 4 255\n" + bytes([9] * 16))
    (tmp_path / "sharp.pgm").write_bytes(b"P5 4 4 255\n" + bytes([0, 255] * 8))
    found = images.deletion_manifest(images.read_grey(containers.read_files(spark, str(tmp_path), "*.pgm"))).collect()
    assert [r.path.rpartition("/")[2] for r in found] == ["flat.pgm"]


def test_poll(spark, tmp_path):
    (tmp_path / "in").mkdir()
    snapshot = {"centers": [{"name": "A", "address": "x", "sessions": [{"available_capacity": 1, "min_age_limit": 18, "vaccine": "V"}, {"available_capacity": 1, "min_age_limit": 60, "vaccine": "V"}]}]}
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(snapshot))
    seen = []
    poll.poll(spark, str(tmp_path / "in"), 30, str(tmp_path / "state"), lambda df, _: seen.extend(df.collect()), once=True).awaitTermination()
    assert [(r.center, r.slots) for r in seen] == [("A", 1), ("A", 1)]


@pytest.mark.parametrize("pairs, want", [([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], [1, 2, 3, 4, 5, 6]), ([(1, 2), (2, 1)], [1, 2]), ([(7, 8)], [1])])
def test_walk(spark, pairs, want):
    edges = spark.createDataFrame(pairs, "src long, dst long")
    starts = spark.createDataFrame([(1,)], "start long")
    got = [(r.step, r.node) for r in crawl.walk(edges, starts).orderBy("step").collect()]
    assert got == list(enumerate(want))
    if pairs != [(1, 2), (2, 1)]:
        assert sorted((r.step, r.node) for r in crawl.walk_recursive(edges, starts).collect()) == got


def test_walk_has_no_step_limit_of_its_own(spark):
    n = (1 << 20) + 2
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    starts = spark.createDataFrame([(0,)], "start long")
    assert tuple(crawl.walk(edges, starts).selectExpr("count(*)", "max(step)", "count_if(step = node)").first()) == (n + 1, n, n + 1)
    assert sorted((r.step, r.node) for r in crawl.walk(edges.where("src < 9"), starts, max_steps=3).collect()) == [(k, k) for k in range(4)]


def test_services(spark):
    df = spark.createDataFrame([("The cat is on the roof. Le chat est dans la maison!",), ("",)], "t string")
    assert [r[0] for r in df.select(remove_language(F.col("t"), "fr")).collect()] == ["The cat is on the roof . !", ""]
    assert df.select(stop_word_language(F.lit("und das ist gut"))).first()[0] == "de"

    def broken(t):
        raise RuntimeError(t)

    assert df.select(external(broken)(F.col("t"))).first()[0].startswith("The cat")
    found = [r.x for r in spark.createDataFrame([("a",), (" ",), (None,)], "t string").select(with_error(broken)(F.col("t")).alias("x")).collect()]
    assert [(x.value, x.error) for x in found] == [("a", "RuntimeError: a"), (" ", None), (None, None)]
    assert df.limit(1).select(with_error(str.upper)(F.lit("a"))).first()[0].value == "A"


def test_document_to_book(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    para = lambda style, inner: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{inner}</w:p>'
    text = lambda t, flags="": f"<w:r><w:rPr>{flags}</w:rPr><w:t>{t}</w:t></w:r>"
    body = para("Normal", text("front")) + para("Heading 1", text("One")) + para("Normal", "") + para("Normal", text("a &lt;", "<w:b/>") + '<w:hyperlink r:id="r9">' + text("link") + "</w:hyperlink>")
    body += para("Normal", '<w:r><a:blip r:embed="r2"/></w:r>') + para("Normal", "") + "<w:tbl><w:tr><w:tc>" + para("Normal", text("cell")) + "</w:tc></w:tr></w:tbl>" + para("Heading 1", text("Empty")) + para("heading 10", text("Last")) + para("List Bullet", text("x"))
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r2" Target="media/i.jpeg"/></Relationships>'
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
        z.writestr("word/media/i.jpeg", b"pixels")
    files = containers.read_files(spark, str(tmp_path), "*.docx")
    out = chapters.book(containers.docx_blocks(files), containers.docx_properties(files)).orderBy("chap_id").collect()
    assert [(r.chap_id, r.title) for r in out] == [(0, "Front Matter"), (1, "One"), (2, "Last")]
    name = out[1].images[0].name
    assert out[1].html == f'<h1>One</h1>\n<p><b>a &lt;</b><a href="#">link</a></p>\n<p><img src="images/{name}" alt="image" style="max-width:100%; height:auto;" /></p>\n<p></p>\n{html.TABLE_TAG}<tr>{html.CELL_TAG}cell</td></tr></table>'
    assert out[2].html == "<h1>Last</h1><li>x</li>" and out[0].book_title == "Untitled Book"
    books = containers.to_epub(chapters.book(containers.docx_blocks(files), containers.docx_properties(files)), "path").withColumnRenamed("path", "p").withColumn("path", F.lit("b"))
    items = {r.href: r.media_type for r in containers.epub_items(books).collect()}
    assert items[f"images/{name}"] == "image/jpeg" and "chap_2.xhtml" in items


def test_fetch(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"centers": []}')
    urls = [f"file://{tmp_path}/a.json", f"file://{tmp_path}/missing.json"]
    rows = {r.url: r for r in http.fetch_pages(spark, urls, slices=2).collect()}
    assert bytes(rows[urls[0]].content) == b'{"centers": []}' and rows[urls[1]].content is None and rows[urls[1]].error
    assert http.fetch_snapshots(spark, urls, poll.CENTERS).count() == 2
    (tmp_path / "c.json").write_text('{\n"pincode": "1",\n"age_limit": 18}')
    assert http.read_config(spark, f"file://{tmp_path}/c.json", http.POLL_CONFIG) == {"pincode": "1", "age_limit": 18, "check_interval_minutes": None}


def test_every_broken_file_has_an_error(spark, tmp_path):
    import zipfile

    whole = containers.build_docx([("Normal", [run("a")])])
    (tmp_path / "good.docx").write_bytes(whole)
    with zipfile.ZipFile(tmp_path / "none.docx", "w") as z:
        z.writestr("other.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "xml.docx", "w") as z:
        z.writestr("word/document.xml", "<a>")
    with zipfile.ZipFile(tmp_path / "body.docx", "w") as z:
        z.writestr("word/document.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "member.docx", "w") as z:
        z.writestr("word/document.xml", "<a>some words that are stored</a>")
    broken = (tmp_path / "member.docx").read_bytes().replace(b"some words", b"SOME words", 1)
    (tmp_path / "member.docx").write_bytes(broken)
    (tmp_path / "text.docx").write_bytes(b"no zip")
    files = containers.read_files(spark, str(tmp_path), "*.docx")
    failed = containers.failed_files(files, "docx_paragraphs").collect()
    assert {(r.path.rpartition("/")[2], r.stage) for r in failed} == {("none.docx", "docx_paragraphs"), ("xml.docx", "docx_paragraphs"), ("body.docx", "docx_paragraphs"), ("member.docx", "member"), ("member.docx", "docx_paragraphs"), ("text.docx", "open")}
    assert all(r.error for r in failed)
    rows = {r.path.rpartition("/")[2] for r in containers.docx_paragraphs(files).collect()}
    assert rows == {"good.docx"}  # every file has rows or an error
    assert {r.stage for r in containers.failed_files(files).where("path LIKE '%none.docx'").collect()} == {"docx_paragraphs", "docx_blocks"}


def test_edit_in_place(spark, tmp_path):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'
    body = '<w:p w:rsid="1"><w:pPr><w:pStyle w:val="Own"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>one</w:t></w:r><w:r><w:t>two</w:t><w:drawing/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>last</w:t></w:r></w:p><w:sectPr/>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", "<h/>")
    (tmp_path / "same.docx").write_bytes(containers.build_docx([("Normal", [run("a")])]))
    files = containers.read_files(spark, str(tmp_path), "*.docx")
    path = files.where("path LIKE '%d.docx'").first().path
    edits = spark.createDataFrame([(path, 0, ["X & Y", "two", "!"]), (path, 2, ["CELL"])], "path string, pos long, texts array<string>")
    out = containers.edit_docx(files, edits)
    texts = [(r.style, r.text) for r in containers.docx_paragraphs(out).where("path LIKE '%d.docx'").orderBy("pos").collect()]
    assert texts == [("Own", "X & Ytwo!"), ("Normal", "last"), ("Normal", "CELL")]
    new = zipfile.ZipFile(io.BytesIO(out.where("path LIKE '%d.docx'").first().content))
    xml = new.read("word/document.xml").decode()
    assert new.read("word/header1.xml") == b"<h/>" and "<w:drawing" in xml and "<w:b" in xml and "<w:sectPr" in xml and 'w:rsid="1"' in xml and 'xmlns:w14=' in xml and 'mc:Ignorable="w14"' in xml
    assert bytes(out.where("path LIKE '%same.docx'").first().content) == (tmp_path / "same.docx").read_bytes()
    # written over the old files, on the executors
    assert containers.save_files(out.withColumn("to", F.regexp_replace("path", "^file:", "")), "to") == 2
    again = containers.read_files(spark, str(tmp_path), "*.docx")
    assert containers.docx_paragraphs(again).where("text = 'CELL'").count() == 1 and len(list(tmp_path.iterdir())) == 2


@pytest.mark.parametrize("rule", crawl.SITES, ids=[r[0] for r in crawl.SITES])
def test_site_rules(spark, rule):
    """A page made from a site's rule gives its title, its container and its next page; a page without them the fallbacks."""
    r = dict(zip(crawl.FIELDS, rule, strict=True))
    attr = lambda a, v: f' {a}="{v}"' if a else ""
    taken = f' {r["title_take"]}="The Title">x' if r["title_take"] != "text" else ">The Title"
    title = f'<{r["title_tag"]}{attr(r["title_attr"], r["title_value"])}{taken}</{r["title_tag"]}>'
    if r["title_scope"]:
        title = f'<{r["title_tag"]}>other</{r["title_tag"]}><div class="{r["title_scope"]}">{title}</div>'
    href = {"number": "/c/8.html", "slashes": "/a/b/8"}.get(r["url_mode"], "http://site/c/8" if r["url_mode"] == "absolute" else "/c/8")
    href = href if r["must_contain"] in href else href + r["must_contain"]
    label = {"next": "Next"}.get(r["next_label"], r["next_label"] or "on")
    label = next((k for k, v in crawl.NEXT_LABELS.items() if v == "next"), label) if r["next_label"] == "next" else label
    link = f'<a{attr(r["next_attr"], r["next_value"])} href="{href}">{label}</a>'
    inner = f'<p>words</p><a href="/ad">ad</a>'
    outer = f'<{r["container_tag"]}{attr(r["container_attr"], r["container_value"])}>{{}}</{r["container_tag"]}>'
    if r["next_scope"] and r["next_scope"] == r["container_value"]:
        body = outer.format(inner + link)
    else:
        body = outer.format(inner) + (f'<div class="{r["next_scope"]}">{link}</div>' if r["next_scope"] else link)
    rows = [(r["site"], "http://site/c/7.html", f"<html>{title}{body}</html>", "http://site"), (r["site"], "http://site/x", "<html><title>Page</title></html>", "http://site")]
    got = crawl.extract(spark.createDataFrame(rows, "site string, url string, html string, root string")).orderBy(F.col("url").desc()).collect()
    page, bare = sorted(got, key=lambda x: x.url != "http://site/c/7.html")
    assert page.title == "The Title"
    assert page.content == f"<h1>The Title</h1>{outer.format('<p>words</p>')}"
    assert page.next_url == (href if r["url_mode"] == "absolute" else f"http://site{href}")
    assert bare.title == "Page" and bare.content is None and bare.next_url is None


def test_no_shared_folder_on_a_cluster(spark):
    """A session of a cluster without spark.checkpoint.dir is refused."""
    from textloom.sources import shared

    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        _jvm, _jsc = spark._jvm, spark._jsc
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_path(Session, "x")
    Session.conf = Conf(**{"spark.master": "local[4]"})
    assert shared.shared_path(Session, "x").startswith(shared.LOCAL_FALLBACK)


def test_glossary_of_many_keys(spark):
    """A trie of the keys finds what trying all keys by length finds."""
    import random
    import re

    from textloom.operators.glossary_replace import glossary_hits, glossary_replace, token_pattern

    rng = random.Random(3)
    keys = sorted({"".join(rng.choices("ab.c+", k=rng.randint(1, 6))) for _ in range(400)})
    texts = ["".join(rng.choices("ab.c+ d", k=60)) for _ in range(40)]
    plain = re.compile("|".join(map(re.escape, sorted(keys, key=len, reverse=True))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    glossary = {k: f"<{i}>" for i, k in enumerate(keys)}
    rows = df.select("id", glossary_replace(F.col("t"), glossary).alias("out"), glossary_hits(F.col("t"), glossary).alias("n")).collect()
    assert {r.id: (r.out, r.n) for r in rows} == {i: plain.subn(lambda m: f" {glossary[m[0]]} ", t) for i, t in enumerate(texts)}
    assert len(token_pattern([f"key{i}" for i in range(1000)])) < 8000


def test_png(spark):
    """All five row filters, grey, colour, palette and alpha, against the pixels that were packed."""
    import random
    import struct
    import zlib

    rng = random.Random(1)

    def png(width, height, kind, rows, palette=b""):
        step = images._SAMPLES[kind]
        packed, above = b"", [0] * (width * step)
        for y, row in enumerate(rows):
            f, out = y % 5, []
            for i, v in enumerate(row):
                a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
            packed, above = packed + bytes([f, *out]), row
        chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(packed)) + chunk(b"IEND", b"")

    grey = lambda r, g, b: float((299 * r + 587 * g + 114 * b + 500) // 1000)
    files, want = [], {}
    for kind, step in images._SAMPLES.items():
        rows = [[rng.randrange(4 if kind == 3 else 256) for _ in range(7 * step)] for _ in range(11)]
        palette = bytes(rng.randrange(256) for _ in range(12)) if kind == 3 else b""
        files.append((str(kind), bytearray(png(7, 11, kind, rows, palette))))
        pixel = lambda row, x: tuple(palette[3 * row[x] : 3 * row[x] + 3]) if kind == 3 else tuple(row[x * step : x * step + step])  # noqa: B023, E731
        want[str(kind)] = [[grey(*p[:3]) if len(p := pixel(row, x)) >= 3 else float(p[0]) for x in range(7)] for row in rows]
    files += [("jpeg", bytearray(b"\xff\xd8\xff")), ("cut", files[0][1][:60]), ("none", None)]
    got = {r.path: r.pixels for r in images.read_grey(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == want | {"jpeg": None, "cut": None, "none": None}


def test_language_and_grammar_over_whole_files(spark, tmp_path):
    pages = spark.createDataFrame([("p", "<p>The cat is on the roof. <b>Le chat est dans la maison</b></p><script>le la les</script>"), ("q", None)], "path string, html string")
    assert [r.html for r in pages_without_language(pages, "fr").orderBy("path").collect()] == ["<p>The cat is on the roof .<b></b></p><script>le la les</script>", None]
    (tmp_path / "x.docx").write_bytes(containers.build_docx([("Normal", [run("teh "), run("end")]), ("Normal", [run("fine")]), ("Normal", [run(" ")])]))
    files = containers.read_files(spark, str(tmp_path), "*.docx")
    edits = paragraph_edits(containers.docx_paragraphs(files), external(lambda t: t.replace("teh", "the")))
    assert [(r.pos, r.texts) for r in edits.collect()] == [(0, ["the end"])]
    assert [r.text for r in containers.docx_paragraphs(containers.edit_docx(files, edits)).orderBy("pos").collect()] == ["the end", "fine", " "]


def test_cover(spark):
    rows = spark.createDataFrame([(1, 0, "A", "<p>x</p>", "T", "A", bytearray(b"\x89PNG1")), (2, 0, "A", "<p>x</p>", "T", "A", None)], "book_id long, chap_id long, title string, html string, book_title string, author string, cover binary")
    books = containers.to_epub(rows).withColumn("path", F.col("book_id").cast("string"))
    items = {(r.path, r.href): r.content for r in containers.epub_items(books).collect()}
    assert bytes(items["1", "cover.png"]) == b"\x89PNG1" and ("2", "cover.xhtml") not in items
    spine = [r.item_id for r in containers.epub_spine(books.where("path = '1'")).orderBy("pos").collect()]
    assert spine == ["cover", "nav", "c0"]


@pytest.mark.parametrize("kind", ["join", "reflow"])
def test_stream_scans_equal_the_batch_ones(spark, sf_dir, tmp_path, kind):
    """Lines that arrive in three batches: state is carried from one to the next."""
    from textloom.operators import sequence
    from textloom.sources.lines import to_lines
    from textloom.streaming import lines as streams

    rows = to_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("line").alias("text"))
    top = rows.groupBy("doc_id").agg(F.max("pos").alias("_top"))
    rows = rows.join(top, "doc_id").select("doc_id", "pos", "text", (F.col("pos") == F.col("_top")).alias("end"))
    head = F.col("pos") % 7 == 3
    for k in range(3):
        part = rows.where((F.col("pos") * 3 / 9).cast("int") == k) if k < 2 else rows.where((F.col("pos") * 3 / 9).cast("int") >= 2)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    out = streams.join_until_terminator(source, head, "end") if kind == "join" else streams.reflow_groups(source, 4, head, "end")
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select(*out.columns).collect()))
    want = sequence.join_until_terminator(rows, head) if kind == "join" else sequence.reflow_groups(rows, 4, head)
    assert got == sorted(map(tuple, want.select(*out.columns).collect())) and len(got) > 100
