"""Text rules of extraction and rendering as column expressions."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rules import AXIS_TICK, CHAPTER_LINE, LEGEND_TITLE, POSITIONS, WATERMARK


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\uFEFF", "")


def furniture_key(line: Column) -> Column:
    """What running heads of different pages share: no digits, one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\d+", ""), r"(?U)\s+", " ")))


#: Stands between lines while they are joined.
_BREAK = "\x01"


def join_lines(lines: Column) -> Column:
    """An array of lines as a paragraph: a hyphen behind a word character at a line's end joins it to the next.
    The control character U+0001 inside a line counts as a space.
    """
    text = F.array_join(F.transform(lines, lambda line: F.replace(line, F.lit(_BREAK), F.lit(" "))), _BREAK)
    joined = F.regexp_replace(text, rf"(?U)(?<=\w)(?:[-‐]{_BREAK})+", "")
    return strip(F.regexp_replace(F.replace(joined, F.lit(_BREAK), F.lit(" ")), r"(?U)\s{2,}", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def no_control(text: Column) -> Column:
    r"""Without characters of category C, but for line breaks and tabs."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def html_prepare(html: Column) -> Column:
    """Ruby readings dropped, ruby bases kept, line breaks as spaces."""
    for pattern, new in ((r"(?is)<rt\b[^>]*>.*?</rt>", ""), (r"(?is)<rp\b[^>]*>.*?</rp>", ""), (r"(?i)</?(?:ruby|rb)\b[^>]*>", ""), (r"(?i)<br\s*/?>", " ")):
        html = F.regexp_replace(html, pattern, new)
    return html


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: An image whose target is a file: the part before, and the file's name.
FILE_IMAGE = r"(!\[[^\]\n]*\])\((?!https?://|data:)(?:[^)\n]*/)?([^)/\n]+)\)"


def local_images(markdown: Column) -> Column:
    """Image targets that are files, as images/<base name>; links to elsewhere and inline data stay."""
    return F.regexp_replace(markdown, FILE_IMAGE, "$1(images/$2)")


def image_targets(markdown: Column) -> Column:
    """Distinct local targets, sorted."""
    found = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: ~t.rlike("^(?:https?://|data:)"))))


def standalone_images(markdown: Column) -> Column:
    """Targets of images that have a line of their own."""
    return F.regexp_extract_all(markdown, F.lit(r"(?md)^[ \t]*!\[[^\]\n]*\]\(([^)\n]+)\)[ \t]*$"), F.lit(1))


def is_watermark(line: Column) -> Column:
    return line.rlike("(?i)" + WATERMARK)


def is_axis_tick(text: Column) -> Column:
    return text.rlike("(?U)" + AXIS_TICK)


def is_chapter_line(text: Column) -> Column:
    """A short line that names a chapter and is no sentence."""
    return text.rlike("(?i)" + CHAPTER_LINE) & (F.length(text) < 90) & ~text.rlike(r"^[#>*\-`|]") & ~text.rlike(r"[.!?،؛؟]\s*$")


def longest_ticks(code: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), lambda x: F.length(x))), F.lit(0))


def fenced(code: Column) -> Column:
    """A code block whose fence is longer than any run of ticks in it."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_ticks(code) + 1))
    return F.concat(fence, F.lit("\n"), code, F.lit("\n"), fence)


def bullet(line: Column) -> Column:
    """A list item's glyph as a Markdown marker."""
    return F.regexp_replace(line, r"^\s*[•◦▪●‣■▸–∙·]\s*", "- ")


def is_bullet(line: Column) -> Column:
    return line.rlike(r"^\s*[•◦▪●‣■▸–∙·]")


def position_label(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Third of the frame that a box's centre is in, by row and column."""
    cx, cy = (x0 + x1) / 2 / F.greatest(width, F.lit(1.0)), (y0 + y1) / 2 / F.greatest(height, F.lit(1.0))
    row = F.when(cy < 1 / 3, "top").when(cy < 2 / 3, "middle").otherwise("bottom")
    col = F.when(cx < 1 / 3, "left").when(cx < 2 / 3, "centre").otherwise("right")
    return F.concat_ws("-", row, col)


def position_name(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair])
    return F.coalesce(names[label], label)


def legend(entries: Column) -> Column:
    """A figure's labels (array of text, pos) as a Markdown quote."""
    items = F.transform(entries, lambda e: F.concat(F.lit("> - "), position_name(e["pos"]), F.lit(": "), e["text"]))
    return F.concat(F.lit(f"> **{LEGEND_TITLE}**\n>\n"), F.array_join(items, "\n"))


def wrap_tables(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)(<table\b.*?</table>)", '<div class="table-wrap">$1</div>')


def tag_figure_keys(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?i)<blockquote>\s*(<p>\s*<strong>{LEGEND_TITLE}</strong>)", '<blockquote class="figure-key">$1')


def without_thinking(reply: Column) -> Column:
    return F.regexp_replace(reply, r"(?s)\A\s*<think>.*?</think>\s*", "")


def without_fence(reply: Column) -> Column:
    found = F.regexp_extract(reply, r"(?s)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z", 1)
    return F.when(found != "", found).otherwise(reply)


def parse_array(reply: Column, expected: Column) -> Column:
    """A JSON array of exactly ``expected`` items as strings; null if the reply is anything else."""
    items = F.from_json(without_fence(without_thinking(reply)), "array<string>")
    return F.when(F.size(items) == expected, items)


def chapters(markdown: Column, level: int = 1) -> Column:
    """Array of (title, markdown): cut before headings of ``level``; text before the first has no title."""
    head = rf"(?md)^{'#' * level} +"
    parts = F.filter(F.transform(F.split(markdown, rf"(?md)(?=^{'#' * level} +\S)"), strip), lambda p: p != "")
    title = lambda p: F.when(p.rlike(head + r"\S"), strip(F.regexp_extract(p, head + r"(.+?)[ \t]*$", 1))).otherwise("")
    return F.transform(parts, lambda p: F.struct(title(p).alias("title"), p.alias("markdown")))


def page_numbers(spec: str) -> list[int]:
    """'1-3,7' as pages from 0, ascending and distinct. An open or malformed range is an error."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        if not low.strip().isdigit() or (dash and not high.strip().isdigit()):
            raise ValueError(f"not a page range: {part!r}")
        out.update(range(int(low) - 1, int(high) if dash else int(low)))
    return sorted(p for p in out if p >= 0)


def page_list(spec: Column) -> Column:
    """``page_numbers`` of a column. Malformed parts give null."""
    ok = spec.rlike(r"^\s*\d+\s*(?:-\s*\d+\s*)?(?:,\s*\d+\s*(?:-\s*\d+\s*)?)*$")
    ends = F.transform(F.split(spec, ","), lambda p: F.struct(F.trim(F.substring_index(p, "-", 1)).cast("int").alias("a"), F.trim(F.substring_index(p, "-", -1)).cast("int").alias("b")))
    runs = F.transform(F.filter(ends, lambda e: e["a"] <= e["b"]), lambda e: F.sequence(e["a"] - 1, e["b"] - 1))
    return F.when(ok, F.array_sort(F.filter(F.array_distinct(F.flatten(runs)), lambda p: p >= 0)))


def work_key(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.concat(F.substring(stem, 1, 60), F.lit("-"), F.left(F.sha1(path.cast("binary")), F.lit(10)))


def clamp_pages(pages: Column, n_pages: Column) -> Column:
    """(kept, dropped): wanted pages from 0 that the document has, and those outside. Null: all pages."""
    every = F.when(n_pages > 0, F.sequence(F.lit(0), n_pages.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    wanted = F.coalesce(pages, every)
    return F.struct(F.filter(wanted, lambda p: (p >= 0) & (p < n_pages)).alias("kept"), F.filter(wanted, lambda p: (p < 0) | (p >= n_pages)).alias("dropped"))


# Characters that Markdown may escape with a backslash.
ESCAPABLE = "\\\\`*_{}\\[\\]()#+\\-.!<>|~\"'$&:;=?@^/,"


def restore_escaped(markdown: Column, found: Column) -> Column:
    """``markdown`` with the backslashes gone that a renderer put into literals (an array): the longest first. A literal that
    stands anywhere as it is, is left alone.
    """
    longest = F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = lambda x: F.regexp_replace(x, f"([{ESCAPABLE}])", r"\\\\?\\Q$1\\E")
    plain = lambda x: F.regexp_replace(x, r"([\\$])", r"\\$1")
    return F.aggregate(longest, markdown, lambda text, x: F.when(F.contains(text, x), text).otherwise(F.regexp_replace(text, pattern(x), plain(x))))


# Fixed value: the element of a web engine's answer that holds the translation.
RESULT = r'(?s)class="(?:t0|result-container)">(.*?)<'


def result_container(page: Column) -> Column:
    """What the first result element of a web engine's answer holds, entities resolved. Null: there is none."""
    return unescape_html(F.nullif(F.regexp_extract(page, RESULT, 1), F.lit("")))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(_html.unescape, na_action="ignore")


def summary(translated: Column, cached: Column, total: Column) -> Column:
    return F.concat_ws("/", (translated + cached).cast("string"), total.cast("string"))


def plural_class(n: Column) -> Column:
    """Which of Arabic's six forms a number takes."""
    rest = F.pmod(n, F.lit(100))
    return F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(rest.between(3, 10), "few").when(rest.between(11, 99), "many").otherwise("other")


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, from the first that is not zero: 1:02:03, 2:03 or 0:03."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600).cast("long"), F.pmod(F.floor(whole / 60), F.lit(60)).cast("int"), F.pmod(whole, F.lit(60)).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def file_label(path: Column) -> Column:
    """A file's name for a right-to-left line: a left-to-right mark stands before its suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(\.[^.]*)$", "\u200e$1")
