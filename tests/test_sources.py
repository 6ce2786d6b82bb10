import io
import zipfile

from pyspark.sql import functions as F

from folio.plans import book
from folio.sources import files
from folio.streaming import limiter

BOOK = "# One\n\nText `x = 1` and 3.2.1 ![f](images/f.png)\n\n# Two\n\n- item\n"


def test_epub_round_trip(spark, tmp_path):
    data = files.write_epub("Title & co", BOOK, {"f.png": b"PNG", "unused.png": b"x"})
    assert data == files.write_epub("Title & co", BOOK, {"f.png": b"PNG"})
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and "OEBPS/ch0001.xhtml" in z.namelist() and b"rtl" in z.read("OEBPS/book.opf")
    (tmp_path / "b.epub").write_bytes(data)
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "n.md").write_bytes(b"\xef\xbb\xbf# A\r\n\xff")
    (tmp_path / "p.html").write_text("<p>x</p>")
    found = files.files(spark, str(tmp_path))
    assert {r.kind for r in found.collect()} == {"epub", "markdown", "html"}
    assert files.texts(found).first().markdown == "# A\r\n�"
    rows = files.epubs(found).collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.image is not None for r in rows) == 1
    (back,) = files.epub_markdown(found).collect()
    assert back.title == "Title & co" and back.language == "ar" and "# One" in back.markdown and back.markdown.index("# One") < back.markdown.index("# Two") and "images/f.png" in back.markdown


def test_inline_images(spark):
    df = spark.createDataFrame([(1, "a ![x](data:image/jpeg;base64,QUI=) b ![y](data:image/svg+xml;base64,QQ==)"), (2, "none")], "doc_id long, markdown string")
    text, images = files.inline_images(df)
    assert {r.doc_id: r.markdown for r in text.collect()} == {1: "a ![x](images/img-0001.jpg) b ![y](images/img-0002.svg)", 2: "none"}
    assert {(r.name, bytes(r.content)) for r in images.collect()} == {("img-0001.jpg", b"AB"), ("img-0002.svg", b"A")}


def test_a_run_and_its_resumption(spark, tmp_path):
    docs = spark.createDataFrame([(1, "T", BOOK), (2, "U", "")], "doc_id long, title string, markdown string")
    out = book.translate_books(spark, docs, str(tmp_path / "work"))
    report, empty = out["report"].orderBy("doc_id").collect()
    assert (empty.total, empty.summary) == (0, "0/0")
    assert (report.total, report.translated, report.failed, report.problems) == (4, 4, 0, 0)
    text = out["books"].filter("doc_id = 1").first().markdown
    assert "3.2.1 and `x = 1` Text" in text
    assert out["epubs"].filter("error is null").count() == 2
    before = (tmp_path / "work" / "segments" / "_SUCCESS").stat().st_mtime_ns
    book.translate_books(spark, docs, str(tmp_path / "work"))
    assert (tmp_path / "work" / "segments" / "_SUCCESS").stat().st_mtime_ns == before
    book.translate_books(spark, docs, str(tmp_path / "work"), book.Options(force=True))
    assert (tmp_path / "work" / "segments" / "_SUCCESS").stat().st_mtime_ns > before


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, i not in (0, 1)) for i in range(30)], "engine string, seq long, ok boolean").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = limiter.rates(stream, 8.0).writeStream.outputMode("update").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.engine, r.rate, r.n) for r in spark.table("rates").collect()] == [("a", 4.0, 30)]
    seen = []
    limiter.books(spark, str(tmp_path / "in"), "engine string, seq long, ok boolean", str(tmp_path / "ck"), lambda df, n: seen.append(df.agg(F.count("*")).first()[0])).awaitTermination(120)
    assert sum(seen) == 30
