"""Queries over the driver's tables and, where SQL can say the same, their SQL.

The tables hold no Markdown, so Markdown inputs are derived inside a query, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masking as M
from ..functions import text as T
from ..functions.rules import AXIS_TICK, RULES, STOPWORDS, TERM, WATERMARK, re2
from ..operators import corpus, ordered, segments, translate


#: Bytes of a table below which its file may be one split, which would leave other cores idle.
SMALL_TABLE = 64 << 20


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A small table dealt over all cores, for what costs far more by row than a shuffle; a large one has splits enough and stays."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_TABLE else df


def _sql(text: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _cut(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, cut (``masking.pieces`` by the rules) and lits: the pattern passes over a text once."""
    return _spread(df.select(key, text)).select(key, M.protected(F.col(text)).alias("cut")).withColumn("lits", M.literals_of(F.col("cut")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _masked(key: str, text: str, table: str) -> str:
    rules = _sql(re2())
    return f"""WITH lits AS (SELECT {key}, {text} AS body, regexp_extract_all({text}, {rules}) AS lits, regexp_split_to_array({text}, {rules}) AS parts FROM {table}),
masked AS (SELECT *, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(lits) THEN '{{{{v' || (i - 1) || '}}}}' ELSE '' END), '') AS masked FROM lits)
"""


@query(_masked("doc_id", "text", "documents") + "SELECT doc_id, masked, len(lits) AS n_literals, array_to_string(lits, chr(31)) AS literals FROM masked")
def mask_documents(spark, sf_dir):
    own = _cut(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return own.select("doc_id", M.mask_of(F.col("cut")).alias("masked"), F.size("lits").cast("long").alias("n_literals"), F.array_join("lits", "\x1f").alias("literals"))


@query(_masked("page_id", "html", "pages") + "SELECT page_id, md5(masked) AS masked_md5, len(lits) AS n_literals FROM masked")
def mask_pages(spark, sf_dir):
    own = _cut(_t(spark, sf_dir, "pages"), "page_id", "html")
    return own.select("page_id", F.md5(M.mask_of(F.col("cut")).cast("binary")).alias("masked_md5"), F.size("lits").cast("long").alias("n_literals"))


_RULE = "CASE " + " ".join(f"WHEN regexp_full_match(lit, {_sql('(?s)' + r.plain)}) THEN '{r.name}'" for r in RULES) + " END"


@query(f"WITH l AS (SELECT unnest(regexp_extract_all(text, {_sql(re2())})) AS lit FROM documents UNION ALL SELECT unnest(regexp_extract_all(html, {_sql(re2())})) FROM pages) SELECT {_RULE} AS rule, count(*) AS n, count(DISTINCT lit) AS n_distinct FROM l GROUP BY 1")
def rule_counts(spark, sf_dir):
    both = _spread(_t(spark, sf_dir, "documents").select("text")).unionByName(_spread(_t(spark, sf_dir, "pages").select(F.col("html").alias("text"))))
    lits = both.select(F.explode(M.literals(F.col("text"))).alias("lit"))
    # Distinct literals first: the rules are then tried once for each.
    return lits.groupBy("lit").agg(F.count("*").alias("k")).groupBy(M.rule_of(F.col("lit")).alias("rule")).agg(F.sum("k").alias("n"), F.count("*").alias("n_distinct"))


@query(
    _masked("doc_id", "text", "documents")
    + r""", reply AS (SELECT doc_id, lits, CASE doc_id % 3 WHEN 0 THEN masked WHEN 1 THEN replace(masked, '{{v0}}', '') || ' {{ v9999 }}' ELSE masked || ' {{v0}}' END AS reply FROM masked),
ids AS (SELECT *, list_transform(regexp_extract_all(reply, '\{\{\s*[vV]?\s*(\d{1,4})\s*\}\}', 1), lambda x: CAST(x AS INT)) AS ids FROM reply)
SELECT doc_id, array_to_string(list_sort(list_filter(range(len(lits)), lambda i: NOT list_contains(ids, CAST(i AS INT)))), ',') AS missing,
  array_to_string(list_sort(list_distinct(list_filter(ids, lambda i: i >= len(lits) OR len(list_filter(ids, lambda j: j = i)) > 1))), ',') AS unexpected FROM ids"""
)
def restore_checks(spark, sf_dir):
    docs = _cut(_t(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", M.mask_of(F.col("cut")).alias("masked"), "lits")
    third = F.col("doc_id") % 3
    reply = F.when(third == 0, F.col("masked")).when(third == 1, F.concat(F.replace("masked", F.lit("{{v0}}"), F.lit("")), F.lit(" {{ v9999 }}"))).otherwise(F.concat("masked", F.lit(" {{v0}}")))
    docs = docs.withColumn("reply", reply)
    return docs.select("doc_id", F.array_join(M.missing(F.col("reply"), F.col("lits")), ",").alias("missing"), F.array_join(M.unexpected(F.col("reply"), F.col("lits")), ",").alias("unexpected"))


@query("SELECT doc_id, md5(text) AS restored_md5 FROM documents")
def restore_round_trip(spark, sf_dir):
    own = _cut(_t(spark, sf_dir, "documents"), "doc_id", "text")
    return own.select("doc_id", F.md5(M.restore(M.mask_of(F.col("cut")), F.col("lits")).cast("binary")).alias("restored_md5"))


@query(_masked("doc_id, line_no", "line", "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))") + r"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(body, '\p{L}')) AS with_letters, count(*) FILTER (NOT regexp_matches(regexp_replace(masked, '\{\{\s*[vV]?\s*(\d{1,4})\s*\}\}', '', 'g'), '\p{L}')) AS nothing_to_translate FROM masked GROUP BY doc_id")
def translatable_lines(spark, sf_dir):
    found = corpus.lines(_spread(_t(spark, sf_dir, "documents"))).select("doc_id", "line", M.mask(F.col("line")).alias("masked"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(M.has_letters(F.col("line"))).alias("with_letters"), F.count_if(M.only_protected(F.col("masked"))).alias("nothing_to_translate"))


# RE2's \b knows ASCII alone: other letters are made word characters first.
_PROSE = r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), '[^\P{L}\x00-\x7F]', '_', 'g')"
_PLACES = f"""terms AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS term FROM (SELECT doc_id, regexp_extract_all({_PROSE}, {_sql(TERM)}) AS l FROM documents)),
places AS (SELECT * FROM terms WHERE term NOT IN ({", ".join(map(_sql, STOPWORDS))}))"""


@query(f"WITH {_PLACES} SELECT term, count(*) AS n FROM places GROUP BY term HAVING count(*) >= 4 ORDER BY n DESC, min((doc_id, place)) LIMIT 80")
def glossary_terms(spark, sf_dir):
    return corpus.terms(_spread(_t(spark, sf_dir, "documents")))


@query(f"WITH {_PLACES} SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(place)) AS rank FROM places GROUP BY doc_id, term HAVING count(*) >= 2 QUALIFY rank <= 5")
def glossary_by_document(spark, sf_dir):
    return corpus.terms_by_document(_spread(_t(spark, sf_dir, "documents")), 2, 5).withColumn("rank", F.col("rank").cast("long"))


_LINES = "lines AS (SELECT source, doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line, len(l) AS n FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"
_KEYED = _LINES + r", keyed AS (SELECT *, line_no < 2 OR line_no >= n - 2 AS in_band, lower(trim(regexp_replace(regexp_replace(line, '\d+', '', 'g'), '\s+', ' ', 'g'))) AS line_key FROM lines)"
_RUNNING = _KEYED + ", pages AS (SELECT source, count(DISTINCT doc_id) AS all_pages FROM documents GROUP BY source), running AS (SELECT source, line_key, count(DISTINCT doc_id) AS pages FROM keyed JOIN pages USING (source) WHERE in_band AND line_key <> '' GROUP BY source, line_key, all_pages HAVING count(DISTINCT doc_id) >= greatest(3, floor(0.01 * all_pages)))"


def _page_lines(spark, sf_dir):
    docs = _spread(_t(spark, sf_dir, "documents").select("source", "doc_id", "text")).select("source", "doc_id", F.split("text", "\n", -1).alias("l"))
    found = docs.select("source", "doc_id", F.size("l").alias("n"), F.posexplode("l").alias("line_no", "line"))
    return found.withColumn("in_band", (F.col("line_no") < 2) | (F.col("line_no") >= F.col("n") - 2))


@query(f"WITH {_RUNNING} SELECT source, line_key, pages FROM running")
def running_lines(spark, sf_dir):
    return corpus.running_lines(_page_lines(spark, sf_dir), 0.01, 3, "source", "doc_id")


@query(f"WITH {_RUNNING} SELECT k.doc_id, count(*) AS kept, CAST(sum(length(line)) AS BIGINT) AS chars FROM keyed k WHERE NOT (in_band AND line_key = '') AND NOT (in_band AND EXISTS (SELECT 1 FROM running r WHERE r.source = k.source AND r.line_key = k.line_key)) GROUP BY k.doc_id")
def body_lines(spark, sf_dir):
    kept = corpus.without_running_lines(_page_lines(spark, sf_dir), 0.01, 3, "source", "doc_id")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.length("line")).alias("chars"))


@query(r"""WITH RECURSIVE cut AS (SELECT doc_id, list_filter(string_split(text, '. '), lambda p: p <> '') AS l FROM documents),
marked AS (SELECT doc_id, list_transform(l, lambda p, i: CASE WHEN i % 3 = 0 THEN p || '-' ELSE p END) AS l FROM cut),
joined AS (SELECT doc_id, list_transform(l, lambda p, i: CASE WHEN i = len(l) THEN p WHEN regexp_matches(p, '[\p{L}\p{N}_]-$') THEN left(p, length(p) - 1) ELSE p || ' ' END) AS l FROM marked)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(l, ''), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS paragraph_md5 FROM joined""")
def joined_paragraphs(spark, sf_dir):
    parts = F.filter(F.split("text", r"\. ", -1), lambda p: p != "")
    marked = F.transform(parts, lambda p, i: F.when((i + 1) % 3 == 0, F.concat(p, F.lit("-"))).otherwise(p))
    return _spread(_t(spark, sf_dir, "documents")).select("doc_id", F.md5(T.join_lines(marked).cast("binary")).alias("paragraph_md5"))


@query(f"WITH {_LINES} SELECT source, list_sort(list(length(line)))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM lines GROUP BY source")
def line_medians(spark, sf_dir):
    return corpus.upper_medians(_page_lines(spark, sf_dir).select("source", F.length("line").cast("long").alias("size")), ["source"], "size")


@query(f"WITH {_LINES}, sums AS (SELECT source, CAST(round_even(length(line) / 4.0, 0) AS BIGINT) AS size, sum(length(line)) AS w, min(doc_id * 1000000 + line_no) AS f FROM lines GROUP BY 1, 2) SELECT source, arg_max(size, (w, -f)) AS mode, CAST(max(w) AS BIGINT) AS weight FROM sums GROUP BY source")
def body_sizes(spark, sf_dir):
    sized = _page_lines(spark, sf_dir).withColumns({"size": F.bround(F.length("line") / 4).cast("long"), "w": F.length("line"), "ord": F.col("doc_id") * 1000000 + F.col("line_no")})
    return corpus.weighted_mode(sized, ["source"], "size", "w", "ord")


@query(f"""WITH {_LINES}, sized AS (SELECT source, doc_id, line_no, line, length(line) / 10.0 AS size FROM lines),
big AS (SELECT DISTINCT source, round_even(size, 0) AS big FROM sized WHERE round_even(size, 0) > 20.5), ranked AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY big DESC) AS rank FROM big)
SELECT s.source, CASE WHEN length(line) > 120 OR rank IS NULL THEN 0 ELSE least(rank, 6) END AS level, count(*) AS n FROM sized s LEFT JOIN ranked r ON s.source = r.source AND round_even(s.size, 0) = r.big GROUP BY 1, 2""")
def heading_levels(spark, sf_dir):
    sized = _page_lines(spark, sf_dir).select("source", F.col("line").alias("text"), (F.length("line") / 10.0).alias("size"), F.lit(20.0).alias("body"))
    return corpus.heading_levels(sized, "source", "size", "body").groupBy("source", F.col("level").cast("long").alias("level")).agg(F.count("*").alias("n"))


_ROWS = "rows AS (SELECT source, doc_id, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)"


@query(f"""WITH RECURSIVE {_ROWS}, fold AS (
SELECT source, rn, doc_id, 0 AS batch_no, 1 AS held, size AS chars FROM rows WHERE rn = 1
UNION ALL SELECT r.source, r.rn, r.doc_id, f.batch_no + CASE WHEN f.held >= 20 OR f.chars + r.size > 6000 THEN 1 ELSE 0 END,
  CASE WHEN f.held >= 20 OR f.chars + r.size > 6000 THEN 1 ELSE f.held + 1 END, CASE WHEN f.held >= 20 OR f.chars + r.size > 6000 THEN r.size ELSE f.chars + r.size END
FROM fold f JOIN rows r ON r.source = f.source AND r.rn = f.rn + 1)
SELECT source, doc_id, CAST(batch_no AS INT) AS batch_no FROM fold""")
def request_batches(spark, sf_dir):
    return translate.batches(_t(spark, sf_dir, "documents"), "source", "doc_id", "text")


_CACHE = "cache AS (SELECT DISTINCT 'e' AS engine, '{}' AS params, text AS original, upper(text) AS translation FROM documents WHERE lang = 'en')"


@query(f"WITH {_CACHE} SELECT d.lang, count(*) FILTER (translation IS NOT NULL) AS hits, count(*) FILTER (translation IS NULL) AS misses FROM documents d LEFT JOIN cache c ON c.original = d.text GROUP BY d.lang")
def cache_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    cache = docs.filter("lang = 'en'").select(F.lit("e").alias("engine"), F.lit("{}").alias("params"), F.col("text").alias("original"), F.upper("text").alias("translation")).distinct()
    found = translate.cache_lookup(docs.select("lang", F.lit("e").alias("engine"), F.lit("{}").alias("params"), F.col("text").alias("original")), cache)
    return found.groupBy("lang").agg(F.count_if(F.col("translation").isNotNull()).alias("hits"), F.count_if(F.col("translation").isNull()).alias("misses"))


@query("SELECT event_type AS engine, '{}' AS params, CAST(user_id AS VARCHAR) AS original, arg_max(CAST(event_id AS VARCHAR), event_id) AS translation, max(event_id) AS version FROM events GROUP BY 1, 3")
def cache_upserts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.lit("{}").alias("params"), F.col("user_id").cast("string").alias("original"), F.col("event_id").cast("string").alias("translation"), F.col("event_id").alias("version"))
    return translate.cache_upsert(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"))


@query(r"""WITH pages_ AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, count(*) OVER (PARTITION BY source) AS n, text FROM documents)
SELECT source, n AS n_pages, round(avg(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 4) AS chars_per_page, avg(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) < 120 AS needs_ocr
FROM pages_ WHERE page_no % greatest(1, n // 12) = 0 AND page_no // greatest(1, n // 12) < 12 GROUP BY source, n""")
def source_density(spark, sf_dir):
    return corpus.density(_t(spark, sf_dir, "documents"), "source", "doc_id").withColumn("chars_per_page", F.round("chars_per_page", 4))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<rt\b[^>]*>.*?</rt>', '', 'g'), '(?is)<rp\b[^>]*>.*?</rp>', '', 'g'), '(?i)</?(?:ruby|rb)\b[^>]*>', '', 'g'), '(?i)<br\s*/?>', ' ', 'g')) AS prepared_md5,
length(regexp_replace(html, '[^\P{C}\n\t]', '', 'g')) AS visible, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped_md5 FROM pages""")
def page_cleanup(spark, sf_dir):
    html = F.col("html")
    return _spread(_t(spark, sf_dir, "pages")).select("page_id", F.md5(T.html_prepare(html).cast("binary")).alias("prepared_md5"), F.length(T.no_control(html)).cast("long").alias("visible"), F.md5(T.escape_html(html).cast("binary")).alias("escaped_md5"))


_IMAGES = "'See ![fig](' || CASE page_id % 4 WHEN 0 THEN url || '/a.png' WHEN 1 THEN '../deep/x' || page_id || '.png' WHEN 2 THEN 'b.jpg' ELSE 'data:image/png;base64,AA' END || ').'"


@query(f"SELECT page_id, CASE WHEN page_id % 4 IN (0, 3) THEN {_IMAGES} WHEN page_id % 4 = 1 THEN 'See ![fig](images/x' || page_id || '.png).' ELSE 'See ![fig](images/b.jpg).' END AS markdown FROM pages")
def image_paths(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", T.local_images(F.expr(_IMAGES)).alias("markdown"))


@query(r"""WITH md AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) BETWEEN 1 AND 40 THEN '# ' || l ELSE l END) AS l FROM documents),
placed AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM md), part AS (SELECT *, sum(CASE WHEN line LIKE '# %' AND trim(line) <> '#' AND regexp_matches(line, '^# +\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM placed)
SELECT doc_id, CAST(part AS BIGINT) - min(CAST(part AS BIGINT)) OVER (PARTITION BY doc_id) AS chapter, CASE WHEN part = 0 THEN '' ELSE regexp_replace(first_line, '^# +|\s+$', '', 'g') END AS title, length(body) AS chars
FROM (SELECT doc_id, part, min_by(line, i) AS first_line, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM part GROUP BY doc_id, part) WHERE body <> ''""")
def chapter_parts(spark, sf_dir):
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.when(F.length(line).between(1, 40), F.concat(F.lit("# "), line)).otherwise(line))
    docs = _spread(_t(spark, sf_dir, "documents")).select("doc_id", T.chapters(F.array_join(lines, "\n")).alias("parts"))
    return docs.select("doc_id", F.posexplode("parts").alias("chapter", "p")).select("doc_id", F.col("chapter").cast("long").alias("chapter"), "p.title", F.length("p.markdown").cast("long").alias("chars"))


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 1 THEN NULL ELSE count(*) END AS n_items, CASE WHEN conv_id % 3 = 1 THEN NULL ELSE md5(string_agg(text, '|' ORDER BY turn)) END AS items_md5 FROM conversations GROUP BY conv_id""")
def reply_arrays(spark, sf_dir):
    held = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = F.col("t.text")
    reply = F.when(F.col("conv_id") % 3 == 0, F.to_json(texts)).otherwise(F.concat(F.lit("<think>\nx</think>```json\n"), F.to_json(texts), F.lit("\n```")))
    items = T.parse_array(reply, F.size("t") + F.when(F.col("conv_id") % 3 == 1, 1).otherwise(0))
    return held.select("conv_id", items.alias("items")).select("conv_id", F.when(F.col("items").isNotNull(), F.size("items")).cast("long").alias("n_items"), F.md5(F.array_join("items", "|").cast("binary")).alias("items_md5"))


_EVENTS = "e AS (SELECT user_id, event_type <> 'error' AS ok, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS}, fold AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(8.0 AS DOUBLE) AS rate, 0 AS good FROM e GROUP BY user_id
UNION ALL SELECT e.user_id, e.rn, CASE WHEN NOT ok THEN greatest(0.8::DOUBLE, rate * 0.5::DOUBLE) WHEN rate >= 8 OR good + 1 < 20 THEN rate ELSE least(8.0::DOUBLE, rate + 2.0::DOUBLE) END,
 CASE WHEN NOT ok THEN 0 WHEN rate >= 8 THEN good WHEN good + 1 >= 20 THEN 0 ELSE good + 1 END FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, arg_max(rate, rn) AS rate, max(rn) AS n FROM fold GROUP BY user_id""")
def limiter_rates(spark, sf_dir):
    outcomes = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    return translate.rates(outcomes, "user_id", ["ts", "event_id"], "ok", 8.0)


@query(f"""WITH RECURSIVE {_EVENTS.replace("epoch(ts)", "floor(epoch(ts))")}, fold AS (SELECT user_id, rn, CAST(0 AS DOUBLE) AS tokens, CAST(t AS DOUBLE) AS go FROM e WHERE rn = 1
UNION ALL SELECT user_id, rn, CASE WHEN have >= 1 THEN have - 1 ELSE 0 END, CASE WHEN have >= 1 THEN now ELSE now + (1 - have) / 0.5::DOUBLE END
 FROM (SELECT e.user_id, e.rn, greatest(e.t, f.go) AS now, least(1.0::DOUBLE, f.tokens + (greatest(e.t, f.go) - f.go) * 0.5::DOUBLE) AS have FROM fold f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, count(*) AS n, round(max(go), 3) AS last_at FROM fold GROUP BY user_id""")
def bucket_admissions(spark, sf_dir):
    requests = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.unix_timestamp("ts").cast("double").alias("t"))
    found = translate.admissions(requests, "user_id", ["ts", "event_id"], "t", 0.5)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("go"), 3).alias("last_at"))


_BOX = {"x0": "l_partkey % 900", "y0": "l_suppkey * 7 % 1300", "x1": "l_partkey % 900 + l_quantity", "y1": "l_suppkey * 7 % 1300 + 12"}


@query(f"""WITH b AS (SELECT ({_BOX['x0']} + {_BOX['x1']}) / 2.0 / 950 AS cx, ({_BOX['y0']} + {_BOX['y1']}) / 2.0 / 1320 AS cy FROM lineitem)
SELECT CASE WHEN cy < 1/3.0::DOUBLE THEN 'top' WHEN cy < 2/3.0::DOUBLE THEN 'middle' ELSE 'bottom' END || '-' || CASE WHEN cx < 1/3.0::DOUBLE THEN 'left' WHEN cx < 2/3.0::DOUBLE THEN 'centre' ELSE 'right' END AS position, count(*) AS n FROM b GROUP BY 1""")
def label_positions(spark, sf_dir):
    c = {k: F.expr(v) for k, v in _BOX.items()}
    label = T.position_label(c["x0"], c["y0"], c["x1"], c["y1"], F.lit(950.0), F.lit(1320.0))
    return _t(spark, sf_dir, "lineitem").groupBy(label.alias("position")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_LINES} SELECT source, count(*) FILTER (regexp_matches(line, {_sql("(?i)" + WATERMARK)})) AS watermarks, count(*) FILTER (regexp_matches(line, {_sql(AXIS_TICK)})) AS ticks, count(*) AS n FROM lines GROUP BY source""")
def scan_noise(spark, sf_dir):
    line = F.col("line")
    return _page_lines(spark, sf_dir).groupBy("source").agg(F.count_if(T.is_watermark(line)).alias("watermarks"), F.count_if(T.is_axis_tick(line)).alias("ticks"), F.count("*").alias("n"))


@query("SELECT o_orderkey % 100 AS book, list_aggregate(list_sort(list_distinct(list(CAST(o_custkey % 50 AS BIGINT)))), 'string_agg', ',') AS pages FROM orders GROUP BY 1")
def page_ranges(spark, sf_dir):
    specs = _t(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 100).alias("book")).agg(F.array_join(F.collect_set((F.col("o_custkey") % 50 + 1).cast("string")), ", ").alias("spec"))
    return specs.select("book", F.array_join(T.page_list(F.col("spec")), ",").alias("pages"))


@query("WITH s AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE text END AS translation FROM documents) SELECT lang, count(*) AS total, count(translation) AS translated, count(*) - count(translation) AS failed, string_agg(CASE WHEN translation IS NULL THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id) AS failures FROM s GROUP BY lang")
def translation_report(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("translation", F.when(F.col("doc_id") % 10 != 3, F.col("text")))
    rows = docs.select("lang", F.col("doc_id").alias("seg_no"), F.lit("paragraph").alias("kind"), F.coalesce(translate.status(F.col("translation")), F.lit("failed")).alias("status"), F.lit(False).alias("hit"), F.lit("").alias("note"))
    found = translate.report(rows, "lang")
    return found.select("lang", "total", "translated", "failed", F.array_join(F.transform("failures", lambda f: f["seg_no"].cast("string")), ",").alias("failures"))



@query()
def page_segments(spark, sf_dir):
    """Pages to Markdown to segments, counted by kind: the parser has no SQL."""
    found = segments.segments(segments.html_blocks(_spread(_t(spark, sf_dir, "pages").select("page_id", "html")), "page_id", "html"))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.size("placeholders")).cast("long").alias("n_placeholders"), F.sum(F.length("source")).cast("long").alias("chars"))


@query()
def translated_pages(spark, sf_dir):
    """Pages translated by a repeatable engine and rendered again."""
    of = segments.html_blocks(_spread(_t(spark, sf_dir, "pages").select("page_id", "html")), "page_id", "html")
    of = ordered.stored(of)  # read by the segments and by what puts them back
    own = segments.segments(of)
    done = translate.translate_many(own, translate.Reversing())
    pages = segments.rendered(segments.apply(of, done))
    return pages.select("doc_id", F.length("markdown").alias("markdown_chars"), F.length("html").alias("html_chars"), F.size(F.regexp_extract_all("html", F.lit("<bdi>"), F.lit(0))).alias("isolated"))
