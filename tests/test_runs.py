"""Whole runs, files, engines without a network, settings and the queue of jobs."""

import io
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import __main__ as cli
from folio.functions import text as T
from folio.operators import engines, translate
from folio.plans import book, jobs, settings
from folio.sources import backends, files, sinks

BOOK = "# Kalman Filter\n\nuses of the Kalman Filter: `x = 1` and 3.2.1 ![f](images/f.png)\n\n![](images/none.png)\n\n# Two\n\n- drop `code` here\n- bad line\n"


@translate.register
class Odd(translate.Engine):
    """Fails on some texts, loses a placeholder in others, and counts what it is asked for in a file."""

    name, mask_style, batch_size, supports_glossary = "odd", "curly", 3, True

    def __init__(self, log: str = "", glossary=None):
        self.log, self.glossary = log, glossary or {}

    def translate(self, text):
        with open(self.log, "a") as f:
            f.write(text.replace("\n", " ") + "\n")
        if "bad" in text:
            raise ValueError("refused")
        return text.replace("{{v0}}", "") if "drop" in text else f"T{len(self.glossary)} {text}"


def asked(path):
    return path.read_text().splitlines() if path.exists() else []


def test_a_run_ends_in_files_and_learns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "My: Book", BOOK), (2, "Empty", "")], "doc_id long, title string, markdown string")
    images = spark.createDataFrame([(1, "f.png", b"PNG"), (2, "u.png", b"U")], "doc_id long, name string, content binary")
    log, out, cache, stages = tmp_path / "log", tmp_path / "out", str(tmp_path / "cache"), []
    options = book.Options("odd", {"log": str(log)}, glossary_min_count=2, protect_glossary_terms=True, pdf=True, css="p { color: red }")
    got = book.translate_books(spark, docs, str(tmp_path / "w1"), options, cache, str(out), images, progress=lambda *a: stages.append(a))
    assert [s[0] for s in stages] == ["glossary", "blocks", "segments", "translated", "placed", "books", "done"]
    assert [(r.term, r.translation) for r in got["glossary"].filter("doc_id = 1").collect()] == [("Kalman Filter", "T0 Kalman Filter")]
    report = {r.doc_id: r for r in got["report"].collect()}
    assert (report[1].total, report[1].translated, report[1].failed, report[1].problems, report[1].summary) == (4, 2, 2, 1, "2/4")
    assert [(f.kind, f.note) for f in report[1].failures] == [("list_item", "placeholders lost or invented"), ("list_item", "refused")]
    assert report[2].total == 0 and any("none.png" in w for w in report[1].warnings) and any(w.startswith("PDF") for w in report[1].warnings)
    # A heading that is a protected term as a whole is not asked for; the term is a placeholder in the text.
    seg = got["segments"].filter("doc_id = 1").orderBy("seg_no").collect()
    assert seg[0].masked.startswith("uses of the {{v0}}: {{v1}}") and seg[0].placeholders[0] == "Kalman Filter"
    files_ = {r.name: r for r in got["files"].collect()}
    assert set(files_) == {"My_Book-1.md", "My_Book-1.html", "My_Book-1.epub", "My_Book-1-report.json", "Empty-2.md", "Empty-2.html", "Empty-2.epub", "Empty-2-report.json", "images/1/f.png", "images/2/u.png"}
    text = (out / "My_Book-1.md").read_text()
    assert "T1 uses of the Kalman Filter: `x = 1` and 3.2.1" in text and "- drop `code` here" in text and "- bad line" in text
    page = (out / "My_Book-1.html").read_text()
    assert page.startswith("<!doctype html>") and "<title>My: Book</title>" in page and "color: red" in page
    with zipfile.ZipFile(io.BytesIO((out / "My_Book-1.epub").read_bytes())) as z:
        assert "OEBPS/images/f.png" in z.namelist()
    assert json.loads((out / "My_Book-1-report.json").read_text())["summary"] == "2/4"
    # A second run elsewhere asks only for what failed before, and writes only files that changed in size.
    before = len(asked(log))
    again = book.translate_books(spark, docs, str(tmp_path / "w2"), options, cache, str(out), images)
    assert {t for t in asked(log)[before:]} == {"Kalman Filter", "bad line"}
    assert sum(r.cached for r in again["report"].collect()) == 3
    assert not any(r.written for r in again["files"].collect() if "report" not in r.name)
    # The same work folder is not worked on again; being told to stop ends a run between stages.
    before = len(asked(log))
    book.translate_books(spark, docs, str(tmp_path / "w2"), options, cache)
    assert len(asked(log)) == before

    def stop(stage, done, total):
        if stage == "segments":
            raise jobs.Cancelled(stage)

    with pytest.raises(jobs.Cancelled):
        book.translate_books(spark, docs, str(tmp_path / "w3"), options, progress=stop)
    assert (tmp_path / "w3" / "blocks" / "_SUCCESS").exists() and not (tmp_path / "w3" / "segments").exists()


def test_cache_versions_and_null_keys_neither_double_nor_lose_segments(spark):
    schema = "doc_id long, seg_no int, block_no int, kind string, source string, masked string, placeholders array<string>"
    own = spark.createDataFrame([(1, 0, 0, "p", "a", "a", []), (1, 1, 1, "p", "b", "b", []), (None, 0, 0, "p", "c", "c", []), (2, None, 0, "p", "d", "d", [])], schema)
    cache = spark.createDataFrame([("reversing", "{}", "a", "old", 1), ("reversing", "{}", "a", "new", 2), ("reversing", "{}", "b", "x", 3)], book.CACHE)
    got = sorted((r.masked, r.translation, r.hit) for r in translate.translate_many(own, translate.Reversing(), cache).collect())
    assert got == [("a", "new", True), ("b", "x", True), ("c", "c", False), ("d", "d", False)]


def test_retries_and_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limiter = translate.Limiter(2.0, lambda: now[0], sleep)
    for _ in range(6):
        limiter.acquire()
    assert now[0] == pytest.approx(2.0)
    limiter.told(False)
    assert limiter.rate == 1.0
    for _ in range(20):
        limiter.told(True)
    assert limiter.rate == 1.5
    engine, waits, calls = translate.Reversing(), [], []
    engine.attempts, engine.first_wait, engine.most_wait = 4, 2.0, 5.0

    def request(x):
        calls.append(x)
        if len(calls) < 4:
            raise translate.PassingError("later")
        return x

    assert engine.asked(request, 7, sleep=waits.append) == 7 and waits == [2.0, 4.0, 5.0]
    calls.clear()
    engine.attempts = 2
    with pytest.raises(translate.PassingError):
        engine.asked(request, 7, sleep=waits.append)


def test_engines_without_a_network():
    seen = []

    def get(url, body, headers):
        seen.append(url)
        return '<div class="result-container">a &amp; b\x07</div>' if "ok" in url else "<p>nothing</p>"

    web = engines.Web("en", get=get)
    assert web.translate("ok") == "a & b" and "sl=en&tl=ar&q=ok" in seen[0]
    with pytest.raises(translate.SlowDown):
        web.translate("none")
    with pytest.raises(ValueError):
        web.translate("x" * 5001)
    posts = []

    def post(url, body, headers):
        asked_ = json.loads(body)
        posts.append(asked_)
        if "temperature" in asked_:
            raise ValueError('HTTP 400: {"error": "temperature is not supported"}')
        text = asked_["messages"][1]["content"]
        answer = "<think>x</think>" + ("```json\n" + json.dumps([t.upper() for t in json.loads(text.partition("\n")[2])]) + "\n```" if "JSON array" in text else text.upper())
        return json.dumps({"choices": [{"message": {"content": answer}}]})

    chat = engines.Chat("en", key="k", glossary={"term": "T", "absent": "A"}, effort="low", post=post)
    assert chat.run(["a term", "b"]) == [("A TERM", ""), ("B", "")]
    assert [("temperature" in p) for p in posts] == [True, False] and posts[1]["reasoning_effort"] == "low"
    assert "- term = T" in posts[1]["messages"][0]["content"] and "absent" not in posts[1]["messages"][0]["content"]
    assert chat.run(["one"]) == [("ONE", "")] and chat.cache_params()["glossary"] == {"term": "T", "absent": "A"}
    with pytest.raises(translate.ConfigurationError):
        engines.DeepSeek(effort="low")
    with pytest.raises(translate.ConfigurationError):
        engines.DeepSeek(post=post).run(["x"])
    assert translate.engine("COMPATIBLE")(post=post).run(["x", "y"]) == [("X", ""), ("Y", "")]


def test_backends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backends, "SLOTS", {k: list(v) for k, v in backends.SLOTS.items()})
    with pytest.raises(ValueError):
        backends.pick("pdf", "unknown")
    with pytest.raises(backends.MissingDependency):
        backends.pick("pdf", "marker")
    backends.register("pdf", backends.Backend("plain", "", lambda data, pages: data.decode() if pages is None else data.decode()[pages[0] :], "markdown"))
    backends.register("pdf", backends.Backend("spans", "", lambda data, pages: [(0, 0, 0, data.decode(), 9.0, 0.0, 0.0, 50.0, 9.0, "Serif", 0)], "spans"))
    backends.register("ocr", backends.Backend("fake", "", lambda data: [(data.decode(), [[0.0, 1.0], [5.0, 1.0], [5.0, 3.0], [0.0, 3.0]], 0.9)]))
    assert backends.pick("pdf").name == "plain"
    (tmp_path / "a.pdf").write_bytes(b"text")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    found = files.files(spark, str(tmp_path))
    got = {r.title: r for r in backends.pdf_markdown(found, backends.pick("pdf", "plain")).collect()}
    assert got["a"].markdown == "text" and got["b"].error
    spans = {r.path[-5:]: r for r in backends.pdf_spans(found, backends.pick("pdf", "spans")).collect()}
    assert spans["a.pdf"].text == "text" and spans["a.pdf"].page_no == 0 and spans["b.pdf"].error and spans["b.pdf"].text is None
    images = spark.createDataFrame([(1, 0, b"seen"), (1, 1, b"\xff")], "doc_id long, page_no int, content binary")
    assert [(r.page_no, r.text, r.quad[2]) for r in backends.recognised(images, backends.pick("ocr", "fake")).collect()] == [(0, "seen", [5.0, 3.0])]
    pages = spark.createDataFrame([(1, "<p>x</p>")], "doc_id long, html string")
    assert backends.pdf_bytes(pages).first().error and backends.pdf_bytes(pages).first().pdf is None
    backends.register("pdf_out", backends.Backend("fake", "", lambda html: html.encode()))
    assert bytes(backends.pdf_bytes(pages).first().pdf) == b"<p>x</p>"
    sizes = spark.createDataFrame([(47, 100), (48, 48)], "w int, h int").select(backends.is_picture(F.col("w"), F.col("h")).alias("ok"))
    assert [r.ok for r in sizes.collect()] == [False, True]


def test_settings(tmp_path):
    path = str(tmp_path / "sub" / "s.json")
    assert settings.load(path) == {}
    settings.save(path, {"engine": "odd", "unknown": 1})
    assert settings.load(path) == {"engine": "odd", "unknown": 1} and settings.known(book.Options, settings.load(path)) == {"engine": "odd"}
    names = {"a": "A", "b": "B", "c": None, "d": "D"}
    assert settings.resolve(names, {"a": 1, "b": 1, "c": 1}, {"b": 2, "c": 2}, {"a": None, "c": 3}, {"A": "env", "C": "no"}) == {"a": "env", "b": 2, "c": 3, "d": None}
    (tmp_path / "bad.json").write_text("[1]")
    assert settings.load(str(tmp_path / "bad.json")) == {}


def test_jobs_wait_for_a_slot_and_end_as_told(spark):
    go, ran = threading.Event(), []

    def run(job):
        job.progress("first", 0, 2)
        go.wait(20)
        job.progress("second", 1, 2)
        ran.append(job.path)
        if "bad" in job.path:
            raise ValueError("broken")
        return job.path

    queue = jobs.Jobs(spark, run, slots=1)
    first, second, third, bad = (queue.submit(f"mem://{x}") for x in ("a", "b", "c", "bad"))
    with pytest.raises(jobs.Duplicate):
        queue.submit("mem://a")
    assert (first.state, second.state) == ("running", "waiting")
    queue.cancel(third)
    go.set()
    queue.wait()
    assert [j.state for j in (first, second, third, bad)] == ["done", "done", "cancelled", "failed"] and bad.error == "broken"
    assert ran == ["mem://a", "mem://b", "mem://bad"] and queue.results[0] == "mem://a" and queue.get(1) is second and queue.get(9) is None
    assert [x[1] for x in first.log] == ["first", "second"] and first.seconds is not None
    go.clear()
    again = queue.submit("mem://a")
    queue.cancel(again)
    go.set()
    queue.wait()
    assert again.state == "cancelled"


def test_files_are_published_once(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", b"12"), ("y.txt", b"3"), ("../../../proc/z", b"4")], "name string, content binary")
    first = {r.name: r for r in sinks.publish(rows, str(tmp_path / "o")).collect()}
    assert first["a/x.txt"].written and first["y.txt"].bytes == 1 and first["../../../proc/z"].error
    assert not any(r.written for r in sinks.publish(rows.filter("name <> '../../../proc/z'"), str(tmp_path / "o")).collect())
    assert sorted(p.name for p in (tmp_path / "o").rglob("*") if p.is_file()) == ["x.txt", "y.txt"]


def test_small_texts(spark):
    row = spark.range(1).select(
        T.clamp_pages(F.expr("array(0, 3, 9, -1)"), F.lit(4)).alias("pages"), T.clamp_pages(F.lit(None).cast("array<int>"), F.lit(2)).alias("every"),
        T.restore_escaped(F.lit(r"see \$O\(n \\log n\)\$ and a\_b, a_c"), F.expr(r"array('$O(n \\log n)$', 'a_b', 'a_c', '')")).alias("text"),
        T.result_container(F.lit('<div class="t0">x &lt; y</div>')).alias("found"), T.result_container(F.lit("<p>")).alias("none"),
        T.summary(F.lit(3), F.lit(2), F.lit(7)).alias("summary"), T.file_label(F.lit("/a/b.epub")).alias("file"),
        F.array(*[T.plural_class(F.lit(n)) for n in (0, 1, 2, 3, 110, 11, 199, 100, 102)]).alias("plural"), F.array(*[T.duration(F.lit(s)) for s in (3.9, 123, 3723)]).alias("time"),
    ).first()
    assert (row.pages.kept, row.pages.dropped, row.every.kept) == ([0, 3], [9, -1], [0, 1])
    assert row.text == r"see $O(n \log n)$ and a_b, a_c" and row.found == "x < y" and row.none is None and row.summary == "5/7"
    assert row.file == "b‎.epub" and row.plural == ["zero", "one", "two", "few", "few", "many", "many", "other", "other"] and row.time == ["0:03", "2:03", "1:02:03"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nsome words\n")
    (tmp_path / "in" / "b.html").write_text("<h1>B</h1><p>other words</p>")
    (tmp_path / "in" / "c.xyz").write_text("?")
    assert cli.main(["engines"]) == 0 and "deepseek" in capsys.readouterr().out
    assert cli.main(["check"]) == 0 and "missing pymupdf" in capsys.readouterr().out
    assert cli.main(["inspect", str(tmp_path / "in")]) == 1 and "unknown kind" in capsys.readouterr().out
    assert cli.main(["translate", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--cache", str(tmp_path / "cache")]) == 0
    assert {p.suffix for p in (tmp_path / "out").iterdir() if p.is_file()} == {".md", ".html", ".epub", ".json"}
    assert "words some" in next((tmp_path / "out").glob("a-*.md")).read_text()
