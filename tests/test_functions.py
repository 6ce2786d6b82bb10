"""Text rules against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.functions import blocks as B
from folio.functions import masking as M
from folio.functions import text as T
from folio.functions.rules import RULES, STYLES

CASES = [
    ("Use `x = 1` and [the page](http://a.b/c) in 3.2.1.", ["`x = 1`", "](http://a.b/c)", "3.2.1"]),
    ("It costs $5 and $10 today.", []),
    ("There are 12 apples and 7 pears.", []),
    ("O(1) is less than O(n log n); f (x) is not.", ["O(1)", "O(n log n)"]),
    ("See Figure (a) and note (below).", []),
    ("Sections D.1 and A.2.3 say $a+b$ and $$x\ny$$.", ["D.1", "A.2.3", "$a+b$", "$$x\ny$$"]),
    ("![i](a.png) [^n] [t][r] <http://x.y> <b>z</b> \\[q\\] \\(r\\)", ["![i](a.png)", "[^n]", "][r]", "<http://x.y>", "<b>", "</b>", "\\[q\\]", "\\(r\\)"]),
    ("mail me@x.org at www.x.org/a_b or some_name", ["me@x.org", "www.x.org/a_b", "some_name"]),
    ("", []),
]


def column(spark, rows, schema, **outs):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in outs.items()]).collect()


def test_masks_and_restores(spark):
    got = column(spark, [(t,) for t, _ in CASES], "t string", t=F.col("t"), lits=M.literals(F.col("t")), back=M.restore(M.mask(F.col("t")), M.literals(F.col("t"))), sq=M.mask(F.col("t"), "square"))
    for (text, want), row in zip(CASES, got, strict=True):
        assert row.lits == want and row.back == text
        assert row.sq.count("[[") - text.count("[[") == len(want)


@pytest.mark.parametrize(("reply", "missing", "unexpected"), [("b {{v1}} a {{v0}}", [], []), ("only {{v1}}", [0], []), ("{{v0}} {{v0}} {{v1}}", [], [0]), ("{{v0}} {{v1}} {{v9}}", [], [9]), ("{{ v0 }} {{1}}", [], []), (None, None, None)])
def test_checks_of_replies(spark, reply, missing, unexpected):
    (row,) = column(spark, [(reply, ["A", "B"])], "r string, l array<string>", m=M.missing(F.col("r"), F.col("l")), u=M.unexpected(F.col("r"), F.col("l")), t=M.restore(F.col("r"), F.col("l")))
    assert (row.m, row.u) == (missing, unexpected)
    if reply and "9" in reply:
        assert row.t == "A B {{v9}}"


def test_protected_terms_come_first(spark):
    (row,) = column(spark, [("The Kalman Filter, not Kalman Filters.",)], "t string", l=M.literals(F.col("t"), ["Kalman", "Kalman Filter"]))
    assert row.l == ["Kalman Filter", "Kalman"]


def test_random_texts_agree_with_python(spark):
    r = random.Random(1)
    rule = re.compile("(?s)" + "|".join(f"(?:{x.java})" for x in RULES))
    texts = ["".join(r.choice(["a", "B", " ", "$", "`", "[", "]", "(", ")", "!", "_", ".", "1", "é", "\n", "<", ">", "http://", "www.", "@", "\\", "Ω", "٣", "+", "-", "ab", "\x01"]) for _ in range(40)) for _ in range(3000)]
    got = column(spark, [(t,) for t in texts], "t string", l=M.literals(F.col("t")), m=M.mask(F.col("t")), b=M.restore(M.mask(F.col("t")), M.literals(F.col("t"))))
    assert [x.l for x in got] == [[m[0] for m in rule.finditer(t)] for t in texts]
    assert [x.m for x in got] == ["".join(f"{p}{{{{v{i}}}}}" for i, p in enumerate(rule.split(t)[:-1])) + rule.split(t)[-1] for t in texts]
    assert [x.b for x in got] == texts


def test_lines_join(spark):
    rows = [(["a frag-", "ment of", "  text "],), (["re‐", "do"],), ([],), (["x -", "y"],)]
    assert [x.j for x in column(spark, rows, "l array<string>", j=T.join_lines(F.col("l")))] == ["a fragment of text", "redo", "", "x - y"]
    r = random.Random(2)
    many = [["".join(r.choice("aé- ‐1") for _ in range(r.randrange(4))) for _ in range(r.randrange(7))] for _ in range(2000)]

    def plain(lines):
        out = ""
        for line in lines:
            out = line if not out else out[:-1] + line if re.search(r"\w[-‐]\Z", out) else f"{out} {line}"
        return re.sub(r"\s{2,}", " ", out).strip()

    assert [x.j for x in column(spark, [(m,) for m in many], "l array<string>", j=T.join_lines(F.col("l")))] == [plain(m) for m in many]


def test_small_rules(spark):
    (row,) = column(
        spark, [("﻿A\x00b\tc\n", "Page 12  of BOOK", "![a](x/y.png) ![b](http://h/z.png)", "<ruby>漢<rt>k</rt></ruby><br/>x", "See ```` here")], "a string, b string, c string, d string, e string",
        bom=T.without_bom(F.col("a")), ctl=T.no_control(F.col("a")), key=T.furniture_key(F.col("b")), img=T.local_images(F.col("c")), html=T.html_prepare(F.col("d")), fence=T.fenced(F.col("e")), pages=T.page_list(F.lit("1-3, 2,8")), bad=T.page_list(F.lit("5-")),
        chapter=T.is_chapter_line(F.lit("Chapter IV The end")), sentence=T.is_chapter_line(F.lit("Chapter 4 ends here.")), array=T.parse_array(F.lit('<think>a</think>```json\n["x", 1]\n```'), F.lit(2)), short=T.parse_array(F.lit('["x"]'), F.lit(2)), targets=T.image_targets(F.col("c")),
    )
    assert row.bom == "A\x00b\tc\n" and row.ctl == "Ab\tc\n" and row.key == "page of book"
    assert row.img == "![a](images/y.png) ![b](http://h/z.png)" and row.html == "漢 x" and row.fence == "`````\nSee ```` here\n`````"
    assert row.pages == [0, 1, 2, 7] == T.page_numbers("1-3, 2,8") and row.bad is None
    assert row.chapter and not row.sentence and row.array == ["x", "1"] and row.short is None and row.targets == ["x/y.png"]
    with pytest.raises(ValueError):
        T.page_numbers("5-")


def test_chapters(spark):
    md = "intro\n\n# One\ntext\n## Sub\n# Two\nmore"
    (row,) = column(spark, [(md,)], "m string", c=T.chapters(F.col("m")))
    assert [(x.title, x.markdown) for x in row.c] == [("", "intro"), ("One", "# One\ntext\n## Sub"), ("Two", "# Two\nmore")]


BOOK = "# Title\n\nText with $x$ and 3.2.1 and `code`.\n\n- one *two*\n- [three](u)\n\n> quoted `q`\n\n| a | b |\n| --- | --- |\n| c | 5 |\n\n```python\nx = 1\n```\n\n![](f.png)"


def test_blocks():
    found = B.parse(BOOK)
    assert [B.kind_of(b) for b in found if b.kind in ("heading", "paragraph", "table_cell")] == ["heading", "paragraph", "list_item", "list_item", "blockquote", "table_cell", "table_cell", "table_cell", "table_cell", "paragraph"]
    again = B.parse(B.to_markdown(found))
    assert [(b.kind, b.content, b.level, b.parents) for b in again] == [(b.kind, b.content, b.level, b.parents) for b in found]
    html = B.to_html(found)
    assert "<h1>Title</h1>" in html and "<ul><li>\n<p>one <em>two</em></p>\n</li>\n<li>" in html and "<th>a</th>" in html and "<td>5</td>" in html and html.count("<ul>") == html.count("</ul>") == 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab #->|`*\n1.=[]:\t"), max_size=60))
def test_blocks_never_fail(text):
    B.to_html(B.parse(text))
    B.to_markdown(B.parse(text))


def test_more_kinds_of_blocks():
    md = "Title\n=====\n\nTwo\nlines\n---\n\n    x = `1`\n\n    y\n\nSee [the Page][p], [P] and [no such].\n\n[p]: http://h/x 'T'\n- |\n-"
    found = B.parse(md)
    assert [(b.kind, b.level, b.content) for b in found[:3]] == [("heading", 1, "Title"), ("heading", 2, "Two lines"), ("code", 3, "x = `1`\n\ny")]
    assert [b.kind for b in found[3:5]] == ["paragraph", "definition"]
    html = B.to_html(found)
    assert '<a href="http://h/x">the Page</a>, <a href="http://h/x">P</a> and [no such].' in html and "http://h/x 'T'" not in html
    assert B.to_markdown(found).startswith("# Title\n\n## Two lines\n\n```\nx = `1`\n\ny\n```\n\nSee [the Page][p]") and "[p]: http://h/x 'T'" in B.to_markdown(found)


def test_html_to_markdown():
    html = "<html><head><style>x{}</style></head><body><h2>A &amp; B</h2><p>One <b>two</b> <a href='u'>l</a></p><script>no()</script><ul><li>x</li><li>y</li></ul><table><tr><th>p</th></tr><tr><td>q</td></tr></table><blockquote><p>z</p></blockquote></body>"
    text = B.html_to_markdown(html)
    assert text.startswith("## A & B\n\nOne **two** [l](u)") and "- x\n- y" in text and "| p |\n| --- |\n| q |" in text and "> z" in text and "no()" not in text and "x{}" not in text


def test_latin_runs():
    assert B.isolate_latin('<p class="x">نص London EC1. و &quot; <code>ab</code> 12</p>') == '<p class="x">نص <bdi>London EC1</bdi>. و &quot; <code>ab</code> 12</p>'
    assert B.isolate_latin("a<b>c</b>d & e &amp;f <PRE>g<i>h</i></pre>1 2<code>open x") == "<bdi>a</bdi><b><bdi>c</bdi></b><bdi>d & e</bdi> &amp;<bdi>f</bdi> <PRE>g<i>h</i></pre>1 2<code>open x"
    assert B.group_openings("<h2>a</h2>\n<h1>b</h1>\n<p>c</p>").startswith('<div class="chapter-open"><h2>a</h2>\n<h1>b</h1></div>\n<p>')


def test_styles_read_what_they_write():
    for before, behind, pattern in STYLES.values():
        assert re.fullmatch(pattern, f"{before}17{behind}")[1] == "17"
