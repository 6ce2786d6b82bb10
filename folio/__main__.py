"""python -m folio inspect|engines|check|translate: what a source is, what can run, and a whole run."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import engines, segments, translate
from .plans import book, jobs, settings
from .sources import backends, files

assert engines  # registers the engines


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, title, bytes, error of the files under ``path``; an unknown suffix is an error of its row."""
    found = files.files(spark, path)
    return found.select("path", "kind", "title", F.length("content").alias("bytes"), F.when(F.col("kind").isNull(), "unknown kind of file").when(F.length("content") == 0, "empty file").alias("error"))


def available() -> list[tuple[str, str, str]]:
    """(kind, name, state) of engines and backends."""
    out = [("engine", n, "ok") for n in sorted(translate.ENGINES)]
    return out + [(kind, b.name, "ok" if b.available else f"missing {b.module}") for kind, slot in sorted(backends.SLOTS.items()) for b in slot]


def markdown_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, markdown, path of all text, HTML, EPUB and, with a backend, PDF files under ``path``. doc_id is a hash of the path."""
    found = files.files(spark, path)
    html = segments.html_pages_to_markdown(files.html_files(found).withColumn("key", F.struct("path", "title")), "key", "html").select("doc_id.path", "doc_id.title", "markdown")
    out = files.texts(found).unionByName(html).unionByName(files.epub_markdown(found).select("path", "title", "markdown"))
    if not found.filter("kind = 'pdf'").isEmpty():
        backend = backends.pick("pdf")
        if backend.gives == "markdown":
            out = out.unionByName(backends.pdf_markdown(found, backend).filter("error is null").select("path", "title", "markdown"))
    return out.withColumn("doc_id", F.xxhash64("path"))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folio")
    parser.add_argument("task", choices=("inspect", "engines", "check", "translate"))
    parser.add_argument("path", nargs="?")
    parser.add_argument("--out")
    parser.add_argument("--work")
    parser.add_argument("--cache")
    parser.add_argument("--settings", default="")
    parser.add_argument("--engine")
    parser.add_argument("--css")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--bilingual", action="store_true")
    own = parser.parse_args(arguments)
    if own.task in ("engines", "check"):
        for kind, name, state in available():
            if own.task == "check" or kind == "engine":
                print(f"{kind}\t{name}\t{state}")
        return 0
    if not own.path:
        parser.error("a path is needed")
    spark = SparkSession.builder.getOrCreate()
    if own.task == "inspect":
        found = inspect(spark, own.path).orderBy("path").toLocalIterator()
        bad = 0
        for r in found:
            print("\t".join(str(x) for x in (r.path, r.kind, r.title, r.bytes, r.error or "")))
            bad += r.error is not None
        return 1 if bad else 0
    stored = settings.load(own.settings) if own.settings else {}
    value = settings.resolve({"engine": "FOLIO_ENGINE", "css": None}, {"engine": "reversing", "css": ""}, stored, {"engine": own.engine, "css": own.css})
    options = book.Options(**(settings.known(book.Options, stored) | value | {"force": own.force, "bilingual": own.bilingual}))
    out = own.out or own.path.rstrip("/") + "-out"
    queue = jobs.Jobs(spark, lambda job: book.translate_books(spark, markdown_of(spark, own.path), own.work or f"{out}/work", options, own.cache, out, progress=job.progress))
    job = queue.submit(own.path)
    queue.wait()
    if job.state != "done":
        print(job.error, file=sys.stderr)
        return 1
    for r in queue.results[job.number]["report"].orderBy("title").toLocalIterator():
        print(f"{r.title}\t{r.summary}\t{'; '.join(r.warnings)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
