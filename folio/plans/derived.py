"""Queries on inputs that the tables do not hold: positioned text, scans, Markdown, figures and books are derived from
whole texts inside a query, by rules simple enough that plain SQL can say what must come out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions import text as T
from ..functions.rules import LEGEND_TITLE, POSITIONS, RULES, re2
from ..operators import figures, glossary, layout, ordered, scan, segments, translate
from ..sources import files
from . import book
from .queries import _spread, _sql, _t, query

_WORDS = "words AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^a-zA-Z ]', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)"


def _words(spark, sf_dir):
    """doc_id and w, all words of ASCII letters of a text."""
    docs = _spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z ]", " "), " ", -1), lambda x: x != "").alias("w"))


def _word_lines(spark, sf_dir, size):
    """doc_id, l, words: lines of ``size`` words, the last one shorter."""
    own = _words(spark, sf_dir).filter("size(w) > 0")
    lines = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(w) - 1) div {size} as int)")), lambda i: F.slice("w", i * size + 1, size))
    return own.select("doc_id", F.posexplode(lines).alias("l", "words"))


def _word_lines_sql(size):
    return _WORDS + f", lines AS (SELECT doc_id, unnest(range((len(w) + {size - 1}) // {size})) AS l, w FROM words WHERE len(w) > 0), cut AS (SELECT doc_id, l, w[l * {size} + 1 : l * {size} + {size}] AS words FROM lines)"


# Masking: a text in which every rule fires.
_ALL = "'See `c' || doc_id || '`, ![i](a/' || doc_id || '.png), [^n' || doc_id || '], [t](u' || doc_id || ') and [t][r' || doc_id || '] at <http://h.org/' || doc_id || '> in <b>bold</b>: $$x_' || doc_id || '$$ \\[q' || doc_id || '\\] \\(r' || doc_id || '\\) $a+' || doc_id || '$, www.h' || doc_id || '.org or me' || doc_id || '@mail.org; 3.' || doc_id || '.1, A.' || doc_id || ', snake_' || doc_id || ', O(n' || doc_id || ') by the Kalman Filter, not Kalman Filters. ' || coalesce(text, '')"
_TERMS = ("Kalman", "Kalman Filter")
_WITH_TERMS = _sql("(?s)\\b(?:Kalman Filter|Kalman)\\b|" + re2().removeprefix("(?s)"))
_ALL_RULE = "CASE WHEN lit IN ('Kalman', 'Kalman Filter') THEN 'glossary' " + " ".join(f"WHEN regexp_full_match(lit, {_sql('(?s)' + r.plain)}) THEN '{r.name}'" for r in RULES) + " END"


def _all_kinds(spark, sf_dir):
    # The backslashes of Spark's SQL strings are doubled.
    return _spread(_t(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(_ALL.replace("\\", "\\\\")).alias("body"))


@query(f"WITH t AS (SELECT {_ALL} AS body FROM documents), l AS (SELECT unnest(regexp_extract_all(body, {_WITH_TERMS})) AS lit FROM t) SELECT {_ALL_RULE} AS rule, count(*) AS n, count(DISTINCT lit) AS n_distinct FROM l GROUP BY 1")
def rules_of_all_kinds(spark, sf_dir):
    lits = _all_kinds(spark, sf_dir).select(F.explode(M.literals(F.col("body"), _TERMS)).alias("lit")).groupBy("lit").agg(F.count("*").alias("k"))
    rule = F.when(F.col("lit").isin(*_TERMS), "glossary").otherwise(M.rule_of(F.col("lit")))
    return lits.groupBy(rule.alias("rule")).agg(F.sum("k").alias("n"), F.count("*").alias("n_distinct"))


@query(f"""WITH t AS (SELECT doc_id, {_ALL} AS body FROM documents), l AS (SELECT doc_id, regexp_extract_all(body, {_WITH_TERMS}) AS lits, regexp_split_to_array(body, {_WITH_TERMS}) AS parts FROM t)
SELECT doc_id, md5(array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(lits) THEN '[[' || (i + 6) || ']]' ELSE '' END), '')) AS masked_md5, len(lits) AS n_literals FROM l""")
def masks_square_with_terms(spark, sf_dir):
    """The other style, numbers from 7 on, and terms of each row's own."""
    terms = F.array(*map(F.lit, reversed(_TERMS)))
    own = _all_kinds(spark, sf_dir).select("doc_id", M.protected(F.col("body"), terms).alias("cut"))
    return own.select("doc_id", F.md5(M.mask_of(F.col("cut"), "square", 7).cast("binary")).alias("masked_md5"), F.size(M.literals_of(F.col("cut"))).cast("long").alias("n_literals"))


# Layout: spans of six words a line, forty lines a page; every seventh word in a code face.
_SPAN = "doc_id, CAST(i // 240 AS INT) AS page_no, CAST((i % 240) // 6 AS INT) AS line_no, i % 6 AS pos, i % 7 = 3 AS mono, word"


@query(f"""WITH {_WORDS}, spans AS (SELECT {_SPAN} FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM words)),
made AS (SELECT doc_id, page_no, line_no, string_agg(CASE WHEN mono THEN '`' || word || '`' ELSE word END, ' ' ORDER BY pos) AS text, string_agg(word, ' ' ORDER BY pos) AS raw,
  coalesce(sum(length(word)) FILTER (mono), 0) * 1.0 / sum(length(word)) >= 0.6 AS is_code, max(72 + 60 * pos + 5.0 * least(length(word), 11)) AS x1 FROM spans GROUP BY 1, 2, 3)
SELECT doc_id, page_no, line_no, text, raw, is_code, 72.0::DOUBLE AS x0, CAST(x1 AS DOUBLE) AS x1, CAST(100 + 14 * line_no AS DOUBLE) AS y0, 10.0::DOUBLE AS size FROM made""")
def layout_lines(spark, sf_dir):
    words = _words(spark, sf_dir).select("doc_id", F.posexplode("w").alias("i", "text"))
    x0, line = 72 + 60 * (F.col("i") % 6), F.expr("cast((i % 240) div 6 as int)")
    spans = words.select(
        "doc_id", F.expr("cast(i div 240 as int)").alias("page_no"), line.alias("line_no"), (F.col("i") % 6).alias("span_no"), "text", F.lit(10.0).alias("size"), x0.cast("double").alias("x0"),
        (100 + 14 * line).cast("double").alias("y0"), (x0 + 5 * F.least(F.length("text"), F.lit(11))).cast("double").alias("x1"), (110 + 14 * line).cast("double").alias("y1"),
        F.when(F.col("i") % 7 == 3, "Courier New").otherwise("Serif").alias("font"), F.lit(0).alias("flags"),
    )
    dims = spans.select("doc_id", "page_no", F.lit(504.0).alias("width"), F.lit(900.0).alias("height")).distinct()
    return layout.lines(spans, dims).select("doc_id", "page_no", "line_no", "text", "raw", "is_code", "x0", "x1", "y0", "size")


@query(f"""WITH {_WORDS}, spans AS (SELECT doc_id, CAST(i // 120 AS INT) AS page_no, (i % 120) // 60 AS col, (i % 60) // 3 AS line, i % 3 AS pos, word FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM words)),
made AS (SELECT doc_id, page_no, col, line, string_agg(word, ' ' ORDER BY pos) AS text FROM spans GROUP BY 1, 2, 3, 4),
pages AS (SELECT doc_id, page_no, count(*) FILTER (col = 1) AS behind, max(line) FILTER (col = 1) AS last FROM made GROUP BY 1, 2),
parted AS (SELECT m.doc_id, m.page_no, col * 100 + line AS place, text, false AS fielded FROM made m JOIN pages p USING (doc_id, page_no) WHERE behind >= 3 OR behind = 0
  UNION ALL SELECT a.doc_id, a.page_no, a.line, a.text || coalesce('  ' || b.text, ''), b.text IS NOT NULL FROM made a JOIN pages p USING (doc_id, page_no) LEFT JOIN made b ON b.doc_id = a.doc_id AND b.page_no = a.page_no AND b.line = a.line AND b.col = 1 WHERE a.col = 0 AND behind BETWEEN 1 AND 2)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY place) - 1 AS INT) AS line_no, text, fielded FROM parted""")
def layout_columns(spark, sf_dir):
    """Two columns of twenty lines of three words; where the second has under three lines they are one line's pieces."""
    words = _words(spark, sf_dir).select("doc_id", F.posexplode("w").alias("i", "text"))
    col, line = F.expr("(i % 120) div 60"), F.expr("cast((i % 60) div 3 as int)")
    x0 = F.when(col == 1, 290).otherwise(40) + 60 * (F.col("i") % 3)
    spans = words.select(
        "doc_id", F.expr("cast(i div 120 as int)").alias("page_no"), (line * 2 + col).cast("int").alias("line_no"), (F.col("i") % 3).alias("span_no"), "text", F.lit(10.0).alias("size"), x0.cast("double").alias("x0"),
        (100 + 14 * line).cast("double").alias("y0"), (x0 + 5 * F.least(F.length("text"), F.lit(11))).cast("double").alias("x1"), (110 + 14 * line).cast("double").alias("y1"), F.lit("Serif").alias("font"), F.lit(0).alias("flags"),
    )
    dims = spans.select("doc_id", "page_no", F.lit(504.0).alias("width"), F.lit(900.0).alias("height")).distinct()
    return layout.lines(spans, dims).select("doc_id", "page_no", "line_no", "text", "fielded")


# Pages of forty lines: by place in eight, two of text, a heading, one of text, a bullet, two of code, one of text;
# a running head and a page number on each page, a figure under its first heading.
_KIND = "CASE l % 8 WHEN 2 THEN 'heading' WHEN 4 THEN 'list_item' WHEN 5 THEN 'code' WHEN 6 THEN 'code' ELSE 'paragraph' END"


@query(rf"""WITH {_word_lines_sql(6)}, placed AS (SELECT doc_id, CAST(l // 40 AS INT) AS page_no, l % 40 AS l, array_to_string(words, ' ') AS line FROM cut),
kinds AS (SELECT *, {_KIND} AS kind, CASE WHEN l % 8 IN (7, 0, 1) THEN 8 * ((l + 1) // 8) - 1 WHEN l % 8 = 6 THEN l - 1 ELSE l END AS head FROM placed),
pages AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM kinds GROUP BY 1),
parts AS (SELECT doc_id, page_no, head * 1.0 AS place, kind, CASE kind WHEN 'heading' THEN '# Heading ' || min(l) WHEN 'list_item' THEN '- ' || min(line) WHEN 'code' THEN '```' || chr(10) || string_agg(line, chr(10) ORDER BY l) || chr(10) || '```' ELSE string_agg(line, ' ' ORDER BY l) END AS markdown FROM kinds GROUP BY doc_id, page_no, head, kind
  UNION ALL SELECT doc_id, page_no, 2.5, 'extra', '![](images/p' || page_no || '.png)' FROM kinds GROUP BY 1, 2
  UNION ALL SELECT k.doc_id, page_no, -9, 'paragraph', 'Book head ' || page_no FROM (SELECT DISTINCT doc_id, page_no FROM kinds) k JOIN pages p USING (doc_id) WHERE pages < 3),
gate AS (SELECT doc_id, count(*) FILTER (markdown LIKE '#%') < greatest(3, pages // 40) AS few FROM parts JOIN pages USING (doc_id) GROUP BY doc_id, pages),
final AS (SELECT doc_id, page_no, place, few AND regexp_matches(markdown, '(?i)^(chapter|part|appendix|section|book|walk)\s+(\d{{1,3}}|[ivxlcdm]{{1,7}}|one|two|three|four|five|six|seven|eight|nine|ten)\b') AND length(markdown) < 90 AS up, kind, markdown FROM parts JOIN gate USING (doc_id))
SELECT doc_id, count(*) AS n_parts, count(*) FILTER (kind = 'heading' OR up) AS headings, count(*) FILTER (kind = 'code') AS codes, md5(string_agg(CASE WHEN up THEN '# ' ELSE '' END || markdown, chr(10) || chr(10) ORDER BY page_no, place)) AS markdown_md5 FROM final GROUP BY doc_id""")
def assembled_pages(spark, sf_dir):
    found = ordered.stored(_word_lines(spark, sf_dir, 6).select("doc_id", F.expr("cast(l div 40 as int)").alias("page_no"), (F.col("l") % 40).cast("int").alias("line_no"), F.array_join("words", " ").alias("words")))
    place = F.col("line_no") % 8
    text = F.when(place == 2, F.concat(F.lit("Heading "), F.col("line_no").cast("string"))).when(place == 4, F.concat(F.lit("• "), F.col("words"))).otherwise(F.col("words"))
    row = lambda text, y, size, code: [text.alias("text"), text.alias("raw"), size.alias("size"), F.lit(False).alias("bold"), F.lit(72.0).alias("x0"), y.cast("double").alias("y0"), F.lit(400.0).alias("x1"), (y + 10).cast("double").alias("y1"), F.lit(False).alias("fielded"), code.alias("is_code"), F.lit(False).alias("bare_number")]
    lines = found.select("doc_id", "page_no", "line_no", *row(text, 100 + 14 * F.col("line_no"), F.when(place == 2, 20.0).otherwise(10.0), place.isin(5, 6)))
    pages = found.select("doc_id", "page_no").distinct()
    heads = pages.select("doc_id", "page_no", F.lit(-1).alias("line_no"), *row(F.concat(F.lit("Book head "), F.col("page_no").cast("string")), F.lit(20), F.lit(10.0), F.lit(False)))
    feet = pages.select("doc_id", "page_no", F.lit(99).alias("line_no"), *row(F.col("page_no").cast("string"), F.lit(850), F.lit(10.0), F.lit(False)))
    dims = pages.select("doc_id", "page_no", F.lit(504.0).alias("width"), F.lit(900.0).alias("height"))
    extras = pages.select("doc_id", "page_no", F.lit(129.0).alias("y"), F.concat(F.lit("![](images/p"), F.col("page_no").cast("string"), F.lit(".png)")).alias("markdown"))
    parts = ordered.stored(layout.assemble(lines.unionByName(heads).unionByName(feet), dims, extras))
    counts = parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "code").alias("codes"))
    return counts.join(layout.documents(parts), "doc_id").select("doc_id", "n_parts", "headings", "codes", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


# Scans: recognised lines of eight words, fifty a page, of several heights; every eleventh is a scanner's brand.
_HEIGHT = "CASE (doc_id + l) % 7 WHEN 0 THEN 12 WHEN 1 THEN 10 WHEN 2 THEN 14 WHEN 3 THEN 18 WHEN 4 THEN 30 WHEN 5 THEN 10 ELSE 60 END"


@query(f"""WITH {_word_lines_sql(8)}, ocr AS (SELECT doc_id, CAST(l // 50 AS INT) AS page_no, CAST(l % 50 AS INT) AS line_no, CASE WHEN l % 11 = 10 THEN ' CamScanner ' ELSE array_to_string(words, ' ') END AS text, {_HEIGHT} AS h, (l % 10) / 10.0 AS confidence FROM cut),
good AS (SELECT * FROM ocr WHERE confidence >= 0.5 AND NOT regexp_matches(trim(text), '(?i)anyscanner|camscanner|tapscanner|scanner\\s*pro|genius\\s*scan|adobe\\s*scan|^scan$|^cs$')),
of_book AS (SELECT doc_id, list_sort(list(h))[count(*) // 2 + 1] AS book FROM good GROUP BY 1), of_page AS (SELECT doc_id, page_no, list_sort(list(h))[count(*) // 2 + 1] AS own, count(*) AS n FROM good WHERE length(text) > 40 GROUP BY 1, 2),
rated AS (SELECT g.*, h * 1.0 / CASE WHEN n >= 3 THEN own ELSE book END AS ratio FROM good g JOIN of_book USING (doc_id) LEFT JOIN of_page p ON p.doc_id = g.doc_id AND p.page_no = g.page_no)
SELECT doc_id, page_no, line_no, text, CASE WHEN length(text) > 80 THEN 10.0 WHEN ratio < 1.25 THEN 10.0 WHEN ratio < 1.6 THEN 13.5 WHEN ratio < 2.2 THEN 18.0 ELSE 26.0 END::DOUBLE AS size, CAST(40 * line_no / 2.0 AS DOUBLE) AS y0, CAST((40 * line_no + h) / 2.0 AS DOUBLE) AS y1 FROM rated WHERE ratio <= 4""")
def scanned_lines(spark, sf_dir):
    own = _word_lines(spark, sf_dir, 8)
    line = F.col("l") % 50
    ocr = own.select(
        "doc_id", F.expr("cast(l div 50 as int)").alias("page_no"), line.cast("int").alias("ocr_no"), F.when(F.col("l") % 11 == 10, " CamScanner ").otherwise(F.array_join("words", " ")).alias("text"),
        F.lit(50.0).alias("x0"), (40 * line).cast("double").alias("y0"), F.lit(600.0).alias("x1"), (40 * line + F.expr(_HEIGHT)).cast("double").alias("y1"), ((F.col("l") % 10) / 10).alias("confidence"),
    )
    found = scan.sized_lines(scan.usable(ocr), 2.0)
    return found.select("doc_id", "page_no", "line_no", "text", F.round("size", 6).alias("size"), "y0", "y1")


_PLACE_NAMES = {k: POSITIONS[k] for k in ("top-left", "bottom-right")}


#: Pages drawn at a time: rasters are far larger than what they are drawn from, so a batch of the one is many of the other.
_PAGES = 16


def _drawn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for a in range(0, len(frame), _PAGES):
            part = frame.slice(a, _PAGES)
            out = []
            for i in part["doc_id"].to_pylist():
                grey = np.full((400, 300), 255, np.uint8)
                grey[120:221, 60 + i % 20 : 201] = 0
                out.append(grey.tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "grey"])


@query(f"""SELECT page_id AS doc_id, 3 AS page_no, 'p0003f00' AS id, 1 AS tier, CAST(60 + page_id % 20 AS DOUBLE) AS x0, 120.0::DOUBLE AS y0, 200.0::DOUBLE AS x1, 220.0::DOUBLE AS y1, 220.0::DOUBLE AS anchor, '1,3,2' AS lines,
'![](images/p0003f00.png)' || chr(10) || chr(10) || {_sql(f"> **{LEGEND_TITLE}**")} || chr(10) || '>' || chr(10) || {_sql(f"> - {_PLACE_NAMES['top-left']}: ")} || 'LEFT' || page_id || chr(10) || {_sql(f"> - {_PLACE_NAMES['bottom-right']}: ")} || 'RIGHT' || page_id AS markdown, 1 AS body_lines FROM pages""")
def scanned_figures(spark, sf_dir):
    """A page with a line of prose and a dark box with two labels and an axis tick."""
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("doc_id"), F.lit(3).alias("page_no"))

    rasters = _spread(pages).select("doc_id", "page_no", F.lit(300).alias("width"), F.lit(400).alias("height")).mapInArrow(_drawn, "doc_id long, page_no int, width int, height int, grey binary")
    left = (60 + F.col("doc_id") % 20).cast("double")
    line = lambda n, text, x0, y0, x1, y1: F.struct(F.lit(n).alias("ocr_no"), text.alias("text"), x0.cast("double").alias("x0"), F.lit(float(y0)).alias("y0"), x1.cast("double").alias("x1"), F.lit(float(y1)).alias("y1"), F.lit(0.9).alias("confidence"))
    key = F.col("doc_id").cast("string")
    ocr = pages.select("doc_id", "page_no", F.explode(F.array(
        line(0, F.lit("a line of prose that is longer than forty characters"), F.lit(20), 20, F.lit(280), 30), line(1, F.concat(F.lit("LEFT"), key), left + 5, 130, left + 30, 140),
        line(2, F.concat(F.lit("RIGHT"), key), F.lit(170), 200, F.lit(195), 210), line(3, F.lit("12.5"), F.lit(100), 160, F.lit(115), 168),
    )).alias("o")).select("doc_id", "page_no", "o.*")
    found = ordered.stored(scan.figures(rasters, ocr, 1.0))
    texts = scan.extras(found).select("doc_id", "page_no", "markdown")
    rest = scan.body_flow(ocr, found, 1.0).groupBy("doc_id").agg(F.count("*").cast("int").alias("body_lines"))
    return found.join(texts, ["doc_id", "page_no"]).join(rest, "doc_id").select("doc_id", "page_no", "id", "tier", "x0", "y0", "x1", "y1", "anchor", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "markdown", "body_lines")


@query(f"""WITH l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE {_sql(f"> **{LEGEND_TITLE}**")} || chr(10) || '>' || chr(10) || {_sql(f"> - {_PLACE_NAMES['top-left']}: ")} || 'First ' || page_id || chr(10) || {_sql(f"> - {_PLACE_NAMES['bottom-right']}: ")} || 'Second' END AS legend FROM pages)
SELECT page_id AS doc_id, 'fig0000,fig0001' AS ids, 'Before' || chr(10) || '![x](f' || page_id || '.png)' || coalesce(chr(10) || chr(10) || legend || chr(10), '') || chr(10) || 'See ![y](g.png) inline' || chr(10) || '  ![](g.png) ' AS markdown FROM l""")
def figure_legends(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("doc_id"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".png"))
    docs = pages.select("doc_id", F.concat(F.lit("Before\n![x]("), name, F.lit(")\nSee ![y](g.png) inline\n  ![](g.png) ")).alias("markdown"))
    label = lambda target, text, pos, y: F.struct(target.alias("target"), text.alias("text"), F.lit(pos).alias("pos"), F.lit(1.0).alias("x0"), F.lit(y).alias("y0"))
    # The second label comes first; one label alone, as of g.png, makes no legend.
    labels = pages.select("doc_id", F.explode(F.filter(F.array(label(name, F.lit("Second"), "bottom-right", 9.0), label(name, F.concat(F.lit("First "), F.col("doc_id").cast("string")), "top-left", 2.0), label(F.lit("g.png"), F.lit("only one label"), "top-left", 1.0)), lambda x: (F.col("doc_id") % 3 != 0) | (x["target"] == "g.png"))).alias("x")).select("doc_id", "x.*")
    ids = figures.found(docs).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return figures.annotate(docs, labels).join(ids, "doc_id").select("doc_id", "ids", "markdown")


# Markdown of six kinds of blocks in turn, a line of words each.
_JOINED = "array_to_string(words, ' ')"
_HALF = "array_to_string(words[1:3], ' ')"
_REST = "array_to_string(words[4:6], ' ')"


def _book_markdown(spark, sf_dir):
    """doc_id, title, markdown: a block a line of six words. A word is a run of letters, so lines are found in a text as it is."""
    docs = _spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.regexp_extract_all(F.regexp_replace("text", "[^a-zA-Z]+", " "), F.lit("(?:[a-zA-Z]+ ){0,5}[a-zA-Z]+"), F.lit(0))
    own = docs.select("doc_id", lines.alias("lines")).filter("size(lines) > 0")

    def block(line, i):
        half = F.substring_index(line, " ", 3)
        table = F.concat(F.lit("| "), half, F.lit(" | 5 |\n| --- | --- |\n| "), F.ltrim(F.substr(line, F.length(half) + 1)), F.lit(" | `x` |"))
        return F.when(i % 6 == 0, F.concat(F.lit("# "), line)).when(i % 6 == 1, F.concat(line, F.lit(" `c"), i.cast("string"), F.lit("` end"))).when(i % 6 == 2, F.concat(F.lit("- "), line)).when(i % 6 == 3, F.concat(F.lit("> "), line)).when(i % 6 == 4, table).otherwise(F.concat(F.lit("```\n"), line, F.lit("\n```")))

    # A document is one row, as a rule: only where rows share a number are they put together, line by line.
    if _t(spark, sf_dir, "documents").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        parts = own.select("doc_id", F.transform("lines", lambda line, i: F.struct(i.alias("l"), block(line, i).alias("b"))).alias("b"))
        held = parts.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("b"))).alias("b")).select("doc_id", F.array_join("b.b", "\n\n").alias("markdown"))
    else:
        held = own.select("doc_id", F.array_join(F.transform("lines", block), "\n\n").alias("markdown"))
    return held.select("doc_id", F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), "markdown")


_SEGMENTS = _word_lines_sql(6) + f""", found AS (SELECT doc_id, l, 0 AS cell, CASE l % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list_item' ELSE 'blockquote' END AS kind, {_JOINED} AS body, CASE WHEN l % 6 = 1 THEN '`c' || l || '`' END AS code FROM cut WHERE l % 6 < 4
UNION ALL SELECT doc_id, l, 0, 'table_cell', {_HALF}, NULL FROM cut WHERE l % 6 = 4 UNION ALL SELECT doc_id, l, 1, 'table_cell', {_REST}, NULL FROM cut WHERE l % 6 = 4 AND len(words) > 3)"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l, cell) - 1 AS INT) AS seg_no, kind, body || coalesce(' ' || code || ' end', '') AS source, body || CASE WHEN code IS NULL THEN '' ELSE ' {{{{v0}}}} end' END AS masked, coalesce(code, '') AS literals FROM found")
def segments_of_books(spark, sf_dir):
    found = segments.segments(segments.blocks(_book_markdown(spark, sf_dir)))
    return found.select("doc_id", "seg_no", "kind", "source", "masked", F.array_join("placeholders", "|").alias("literals"))


# Replies of the reversing engine, put back and rendered.
_BACK = "array_to_string(list_reverse(string_split({}, ' ')), ' ')"
_RUN_BACK = _BACK.format(_JOINED)


@query(f"""WITH {_word_lines_sql(6)}, blocks AS (SELECT doc_id, l,
  CASE l % 6 WHEN 0 THEN '# ' || {_RUN_BACK} WHEN 1 THEN 'end `c' || l || '` ' || {_RUN_BACK} WHEN 2 THEN '- ' || {_RUN_BACK} WHEN 3 THEN '> ' || {_RUN_BACK}
    WHEN 4 THEN '| ' || {_BACK.format(_HALF)} || ' | 5 |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_BACK.format(_REST)} || ' | `x` |' ELSE '```' || chr(10) || {_JOINED} || chr(10) || '```' END AS markdown,
  CASE l % 6 WHEN 0 THEN '<div class="chapter-open"><h1><bdi>' || {_RUN_BACK} || '</bdi></h1></div>' WHEN 1 THEN '<p><bdi>end</bdi> <code>c' || l || '</code> <bdi>' || {_RUN_BACK} || '</bdi></p>'
    WHEN 2 THEN '<ul><li>' || chr(10) || '<p><bdi>' || {_RUN_BACK} || '</bdi></p>' || chr(10) || '</li></ul>' WHEN 3 THEN '<blockquote>' || chr(10) || '<p><bdi>' || {_RUN_BACK} || '</bdi></p>' || chr(10) || '</blockquote>'
    WHEN 4 THEN '<div class="table-wrap"><table><tr><th><bdi>' || {_BACK.format(_HALF)} || '</bdi></th><th>5</th></tr><tr><td>' || CASE WHEN len(words) > 3 THEN '<bdi>' || {_BACK.format(_REST)} || '</bdi>' ELSE '' END || '</td><td><code>x</code></td></tr></table></div>'
    ELSE '<pre><code>' || {_JOINED} || '</code></pre>' END AS html FROM cut)
SELECT doc_id, md5(string_agg(markdown, chr(10) || chr(10) ORDER BY l)) AS markdown_md5, md5(rtrim(string_agg(html, chr(10) ORDER BY l), chr(10))) AS html_md5 FROM blocks GROUP BY doc_id""")
def translated_books(spark, sf_dir):
    made = segments.translated(_book_markdown(spark, sf_dir), translate.Reversing())
    return made.select("doc_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"), F.md5(F.regexp_replace("html", r"\n+\z", "").cast("binary")).alias("html_md5"))


@query(f"""WITH {_SEGMENTS}, said AS (SELECT doc_id, CASE WHEN code IS NULL THEN body ELSE body || ' {{{{v0}}}} end' END AS masked FROM found), cache AS (SELECT DISTINCT masked FROM said WHERE length(masked) % 3 = 0)
SELECT doc_id, count(*) AS n, count(c.masked) AS hits, md5(string_agg(DISTINCT CASE WHEN c.masked IS NULL THEN {_BACK.format('s.masked')} ELSE upper(s.masked) END, '|' ORDER BY CASE WHEN c.masked IS NULL THEN {_BACK.format('s.masked')} ELSE upper(s.masked) END)) AS replies_md5 FROM said s LEFT JOIN cache c ON c.masked = s.masked GROUP BY doc_id""")
def cached_replies(spark, sf_dir):
    """A third of the texts are in the cache, in two versions of which the newer counts; the rest are asked for."""
    # Made for the cache and for the requests: kept between the two it would take more room than all the rest may.
    own = segments.segments(segments.blocks(_book_markdown(spark, sf_dir)), in_order=True).select("doc_id", "seg_no", "masked")
    keys = own.select("masked").distinct().filter("length(masked) % 3 = 0").select(F.lit("reversing").alias("engine"), F.lit("{}").alias("params"), F.col("masked").alias("original"))
    cache = keys.select("*", F.lit("old").alias("translation"), F.lit(1).alias("version")).unionByName(keys.select("*", F.upper("original").alias("translation"), F.lit(2).alias("version")))
    done = translate.translate_many(own, translate.Reversing(), cache)
    return done.select("doc_id", "hit", "translation").mapInArrow(_counted, "doc_id long, n long, hits long, replies_md5 string")


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each document, whose rows stand together as ``translate_many`` leaves those of an engine that does not wait."""
    key, n, hits, said, out = None, 0, 0, set(), []

    def made() -> tuple:
        return key, n, hits, hashlib.md5("|".join(sorted(said)).encode()).hexdigest()

    def batch() -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("n", pa.int64()), ("hits", pa.int64()), ("replies_md5", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out, strict=True), kinds, strict=True)], [name for name, _ in kinds])

    for frame in frames:
        for d, hit, text in zip(*[frame[c].to_pylist() for c in ("doc_id", "hit", "translation")], strict=True):
            if n and d != key:
                out.append(made())
                n, hits, said = 0, 0, set()
            key, n, hits = d, n + 1, hits + hit
            if text is not None:
                said.add(text)
        if out:
            yield batch()
            out = []
    if n:
        out = [made()]
        yield batch()


@query(f"WITH {_SEGMENTS} SELECT doc_id, 'Book ' || doc_id AS title, count(*) AS total, count(*) AS translated, 0::BIGINT AS failed, 0::BIGINT AS problems, count(*) || '/' || count(*) AS summary FROM found GROUP BY doc_id")
def book_reports(spark, sf_dir):
    """Whole runs, stage by stage, in a folder of their own beside the checkpoints."""
    docs = _book_markdown(spark, sf_dir)
    ordered.stored(docs.limit(0))  # sets the folder where none is set
    done = book.translate_books(spark, docs, f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}", book.Options(epub=False))
    return done["report"].select("doc_id", "title", "total", "translated", "failed", "problems", "summary")


@query("SELECT page_id AS doc_id, spine_no, 'OEBPS/ch' || lpad(CAST(spine_no AS VARCHAR), 4, '0') || '.xhtml' AS name, CASE spine_no WHEN 0 THEN 'Title ' || page_id || ' - 0' ELSE 'Part ' || spine_no END AS title, 'Book & ' || page_id AS book, 'ar' AS language FROM (SELECT page_id, CAST(unnest(range(0, 2 + page_id % 3)) AS INT) AS spine_no FROM pages)".replace("'Title ' || page_id || ' - 0'", "'Book &amp; ' || page_id || ' - 0'"))
def epub_chapters(spark, sf_dir):
    """Books written as EPUB and read again: a preamble and one to three chapters."""
    part = lambda n: F.concat(F.lit("# Part "), n.cast("string"), F.lit("\n\nwords "), F.col("page_id").cast("string"))
    parts = F.concat(F.array(F.lit("before all")), F.transform(F.sequence(F.lit(1), (F.col("page_id") % 3 + 1).cast("int")), part))
    docs = _spread(_t(spark, sf_dir, "pages").select("page_id")).select(F.col("page_id").cast("long").alias("doc_id"), F.concat(F.lit("Book & "), F.col("page_id").cast("string")).alias("title"), F.array_join(parts, "\n\n").alias("markdown"))
    made = ordered.stored(files.epub_bytes(docs))
    found = files.epubs(made.select(F.col("doc_id").cast("string").alias("path"), F.lit("epub").alias("kind"), F.lit("none").alias("title"), F.col("epub").alias("content")))
    return found.select(F.col("path").cast("long").alias("doc_id"), "spine_no", "name", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("title").alias("book"), "language")


_DATA = "'a ![x](data:image/jpeg;base64,' || {b} || ') b ![y](data:image/svg+xml;base64,' || {b} || ') c ![z](http://h/z.png) ![w](w.png)'"


@query("SELECT page_id AS doc_id, 'a ![x](images/img-0001.jpg) b ![y](images/img-0002.svg) c ![z](http://h/z.png) ![w](w.png)' AS markdown, 'img-0001.jpg,img-0002.svg' AS names, '2' || url AS content, 'images/img-0001.jpg,images/img-0002.svg,w.png' AS targets FROM pages")
def inline_images(spark, sf_dir):
    docs = _t(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("doc_id"), F.expr(_DATA.format(b="base64(cast(url as binary))")).alias("markdown"))
    text, images = files.inline_images(docs)
    held = images.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names"), F.concat(F.count("*").cast("string"), F.min(F.col("content").cast("string"))).alias("content"))
    return text.join(held, "doc_id").select("doc_id", "markdown", "names", "content", F.array_join(T.image_targets(F.col("markdown")), ",").alias("targets"))


@query("""WITH g AS (SELECT n_regionkey AS book, n_name AS term, CASE WHEN n_nationkey % 4 = 0 THEN n_name WHEN n_nationkey % 4 = 1 THEN ' ' ELSE lower(n_name) END AS translation FROM nation),
own AS (SELECT n_regionkey AS book, n_name AS term, 'own ' || n_nationkey AS translation FROM nation WHERE n_nationkey % 5 = 0),
merged AS (SELECT g.book, g.term, coalesce(o.translation, g.translation) AS translation FROM g LEFT JOIN own o ON o.term = g.term), good AS (SELECT * FROM merged WHERE trim(translation) <> '' AND trim(translation) <> term)
SELECT book, '{' || string_agg('"' || term || '":"' || translation || '"', ',' ORDER BY term) || '}' AS json, string_agg('- ' || term || ' = ' || translation, chr(10) ORDER BY term) AS block, count(*) AS n FROM good GROUP BY book""")
def glossary_files(spark, sf_dir):
    """Built terms and a reader's own, as a file's JSON and read again, and as lines for a prompt."""
    rows = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("book"), F.col("n_name").alias("term"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).when(F.col("n_nationkey") % 4 == 1, " ").otherwise(F.lower("n_name")).alias("translation"), "n_nationkey")
    own = rows.filter("n_nationkey % 5 = 0").select("term", F.concat(F.lit("own "), F.col("n_nationkey").cast("string")).alias("translation"))
    good = glossary.usable(glossary.merge(rows.select("term", "translation"), own)).join(rows.select("book", "term"), "term")
    held = good.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("term", "translation"))).alias("m"))
    saved = held.select("book", glossary.save(F.col("m")).alias("json")).withColumn("back", F.array_sort(F.map_entries(glossary.load(F.col("json")))))
    pairs = F.transform("back", lambda e: F.struct(e["key"].alias("term"), e["value"].alias("translation")))
    return saved.select("book", "json", glossary.prompt_block(pairs).alias("block"), F.size("back").cast("long").alias("n"))


_SPEC = "CASE o_orderkey % 4 WHEN 0 THEN o_custkey % 9 + 1 || '-' || (o_custkey % 9 + 3) || ', ' || (o_custkey % 5 + 1) WHEN 1 THEN o_custkey % 7 + 1 || '-' WHEN 2 THEN '0,2-2' ELSE 'x' END"


@query(f"""WITH s AS (SELECT o_orderkey, {_SPEC} AS spec, o_custkey % 9 + 1 AS a, o_custkey % 5 + 1 AS b, o_orderkey % 4 AS k FROM orders),
p AS (SELECT o_orderkey, spec, CASE k WHEN 0 THEN list_sort(list_distinct([a - 1, a, a + 1, b - 1])) WHEN 2 THEN [1] END AS pages FROM s)
SELECT o_orderkey, array_to_string(pages, ',') AS pages, array_to_string(list_filter(CASE WHEN pages IS NULL THEN range(0, 6) ELSE pages END, lambda x: x < 6), ',') AS kept, array_to_string(list_filter(coalesce(pages, []), lambda x: x >= 6), ',') AS dropped FROM p""")
def page_specs(spark, sf_dir):
    """Ranges, open and malformed ones, and what a book of six pages has of them."""
    own = _t(spark, sf_dir, "orders").select("o_orderkey", T.page_list(F.expr(_SPEC)).alias("pages"))
    cut = own.withColumn("c", T.clamp_pages(F.col("pages"), F.lit(6)))
    return cut.select("o_orderkey", F.array_join("pages", ",").alias("pages"), F.array_join("c.kept", ",").alias("kept"), F.array_join("c.dropped", ",").alias("dropped"))


@query(r"""WITH t AS (SELECT c_custkey AS n, c_custkey % 4 AS k, repeat('`', CAST(c_custkey % 6 AS INT)) AS ticks FROM customer)
SELECT n, '- item ' || n AS bullet, repeat('`', CAST(greatest(3, n % 6 + 1) AS INT)) || chr(10) || 'x' || ticks || 'y' || chr(10) || repeat('`', CAST(greatest(3, n % 6 + 1) AS INT)) AS fenced,
  CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS chapter, k = 2 AS watermark, 'book' || n || '-' || left(sha1('/d/book' || n || '.md'), 10) AS work_key,
  '<div class="table-wrap"><table><tr><td>' || n || '</td></tr></table></div>' AS wrapped, 'x < ' || n || ' & y' AS result, '$O(n \log ' || n || ')$ and a_b' AS literal,
  CASE WHEN n = 0 THEN 'zero' WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'two' WHEN n % 100 BETWEEN 3 AND 10 THEN 'few' WHEN n % 100 >= 11 THEN 'many' ELSE 'other' END AS plural,
  CASE WHEN n >= 3600 THEN n // 3600 || ':' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(n // 60 AS VARCHAR) END || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') AS duration FROM t""")
def text_rules(spark, sf_dir):
    n = F.col("n")
    k, s = n % 4, n.cast("string")
    chapter = F.when(k == 0, F.concat(F.lit("Chapter "), F.pmod(n, F.lit(100)).cast("string"), F.lit(": a title"))).when(k == 1, F.concat(F.lit("Chapter "), s, F.lit(" ends here."))).when(k == 2, F.lit("appendix iv")).otherwise(F.lit("the chapter 1"))
    mark = F.when(k == 2, "made with Genius  Scan").otherwise("a scanner of texts")
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n")).select(
        "n", T.bullet(F.concat(F.lit("  • item "), s)).alias("bullet"), T.fenced(F.concat(F.lit("x"), F.repeat(F.lit("`"), (n % 6).cast("int")), F.lit("y"))).alias("fenced"), T.is_chapter_line(chapter).alias("chapter"), T.is_watermark(mark).alias("watermark"),
        T.work_key(F.concat(F.lit("/d/book"), s, F.lit(".md"))).alias("work_key"), T.wrap_tables(F.concat(F.lit("<table><tr><td>"), s, F.lit("</td></tr></table>"))).alias("wrapped"),
        T.result_container(F.concat(F.lit('<p><div class="result-container">x &lt; '), s, F.lit(" &amp; y</div>"))).alias("result"),
        T.restore_escaped(F.concat(F.lit(r"\$O\(n \\log "), s, F.lit(r"\)\$ and a\_b")), F.array(F.lit("a_b"), F.concat(F.lit(r"$O(n \log "), s, F.lit(")$")))).alias("literal"),
        T.plural_class(n).alias("plural"), T.duration(n).alias("duration"),
    )


@query("SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY event_id LIMIT 4")
def waiting_slots(spark, sf_dir):
    """The next jobs of a queue with four slots."""
    jobs = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("waiting").alias("state"))
    return translate.slots(jobs, 4, "event_id").select("event_id")
