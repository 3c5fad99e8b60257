"""The named queries as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

_CLEAN = (
    r"trim(regexp_replace(regexp_replace(regexp_replace({0}, 'http\S+|www\.\S+', '', 'g'), "
    r"'[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
)


def _clean(column: str) -> str:
    return _CLEAN.format(column)


ARTICLES = f"""
articles AS (
  SELECT d.doc_id AS id, substring(d.text, 1, 100) AS title,
         'doc://' || d.source || '/' || d.doc_id AS url, d.source,
         CAST(NULL AS VARCHAR) AS summary, d.text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS crawled_at,
         l.toxic = 1 AS is_fake, {_clean("d.text")} AS normalized_content
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
prepared AS (
  SELECT id, source, content, normalized_content, crawled_at,
         coalesce(CAST(is_fake AS INTEGER), -1) AS is_fake,
         CAST(length(normalized_content) AS INTEGER) AS text_length,
         CAST(len(list_filter(string_split(normalized_content, ' '), lambda x: x <> '')) AS INTEGER)
           AS word_count
  FROM articles),
labelled AS (
  SELECT id AS doc_id, title, source, normalized_content AS text, CAST(is_fake AS INTEGER) AS is_fake
  FROM articles WHERE is_fake IS NOT NULL AND trim(normalized_content) <> ''),
unlabelled AS (
  SELECT id AS doc_id, normalized_content AS text FROM articles WHERE is_fake IS NULL),
every_doc AS (SELECT id AS doc_id, normalized_content AS text FROM articles),
fakes AS (SELECT doc_id FROM labels WHERE toxic = 1)"""

RECRAWLED = """
recrawled AS (
  SELECT id AS sequence, title, url, source, summary, content, crawled_at, is_fake FROM articles
  UNION ALL
  SELECT id + 1000000000, title, url, CASE WHEN is_fake THEN '' ELSE source END, 'again ' || source,
         content, crawled_at, is_fake FROM articles),
staged AS (
  SELECT sequence, title, url, nullif(source, '') AS source, summary, content, crawled_at, is_fake
  FROM recrawled)"""


def _articles(select: str, *more: str) -> str:
    return f"WITH {', '.join((ARTICLES, *more))} {select}"


def _tokens(name: str, docs: str) -> str:
    """Retrieval terms of ``docs``: doc_id, term, tf."""
    return f"""
{name} AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM {docs})
  WHERE term <> '' GROUP BY doc_id, term)"""


def _grams(name: str, docs: str) -> str:
    """Uni- and bigrams of ``docs``: doc_id, term, tf."""
    return rf"""
{name}_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM {docs}),
{name} AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(w) AS term FROM {name}_words
    UNION ALL
    SELECT doc_id, p[1] || ' ' || p[2]
    FROM (SELECT doc_id, unnest(list_zip(w[1:len(w)-1], w[2:len(w)])) AS p FROM {name}_words)
    WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL)
  GROUP BY doc_id, term)"""


def _vocabulary(name: str, terms: str, docs: str, size: str) -> str:
    return f"""
{name} AS (
  SELECT term, df, cf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id FROM (
    SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {terms} GROUP BY term
    HAVING count(*) >= 2 AND count(*) <= floor((SELECT count(*) FROM {docs}) * 0.95)
    ORDER BY cf DESC, term LIMIT {size}))"""


def _postings(vocab: str, terms: str, docs: str, name: str = "postings", factor: str = "1.0") -> str:
    """BM25 weights of ``docs`` over a vocabulary, with the statistics of ``docs``."""
    return f"""
{name}_tf AS (SELECT t.doc_id, t.term, t.tf FROM {terms} t JOIN {vocab} v ON t.term = v.term),
{name}_n AS (SELECT count(*) AS n FROM {docs}),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_avg AS (SELECT (SELECT sum(tf) FROM {name}_tf) / n AS average FROM {name}_n),
{name} AS (
  SELECT p.doc_id, p.term, p.tf,
         ln(1 + (n - df + 0.5) / (df + 0.5)) * {factor} * p.tf
           / (p.tf + 1.5 * (1 - 0.75 + 0.75 * dl / average)) AS weight
  FROM {name}_tf p JOIN {name}_df d ON p.term = d.term
  JOIN (SELECT doc_id, sum(tf) AS dl FROM {name}_tf GROUP BY doc_id) l ON p.doc_id = l.doc_id,
  {name}_n, {name}_avg)"""


_ROUNDED = "SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, round(weight, 6) AS weight FROM "

_INDEX = (
    _tokens("terms", "labelled"),
    _vocabulary("vocab", "terms", "labelled", "5000"),
    _postings("vocab", "terms", "labelled"),
)
_INDEX_ALL = (
    _tokens("terms", "every_doc"),
    _vocabulary("vocab", "terms", "every_doc", "5000"),
    _postings("vocab", "terms", "every_doc"),
)

_HITS = (
    *_INDEX,
    _tokens("asked", "unlabelled"),
    """
scored AS (
  SELECT a.doc_id AS query_id, p.doc_id, round(sum(a.tf * p.weight), 6) AS score
  FROM asked a JOIN postings p ON a.term = p.term GROUP BY a.doc_id, p.doc_id),
hits AS (
  SELECT query_id, doc_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0 QUALIFY rank <= 10)""",
)

_VOTES = """
SELECT query_id,
       CASE WHEN NOT has_terms THEN 'UNKNOWN' WHEN p >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS prediction,
       CASE WHEN has_terms THEN round(abs(p - 0.5) * 2, 6) ELSE 0.0 END AS confidence,
       p AS fake_probability,
       CASE WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'medium' ELSE 'high' END AS risk,
       similar_fake, similar_real
FROM (
  SELECT u.doc_id AS query_id, u.doc_id IN (SELECT a.doc_id FROM asked a JOIN vocab v ON a.term = v.term)
           AS has_terms,
         round(coalesce(CASE WHEN sum(h.score) > 0 THEN
           sum(CASE WHEN l.is_fake = 1 THEN h.score ELSE 0.0 END) / sum(h.score) END, 0.5), 6) AS p,
         count(*) FILTER (l.is_fake = 1) AS similar_fake, count(*) FILTER (l.is_fake = 0) AS similar_real
  FROM unlabelled u LEFT JOIN hits h ON h.query_id = u.doc_id
  LEFT JOIN labelled l ON l.doc_id = h.doc_id GROUP BY u.doc_id)"""


def _tfidf(size: int) -> tuple[str, ...]:
    return (
        _grams("grams", "every_doc"),
        _vocabulary("vocab", "grams", "every_doc", str(size)),
        """
raw AS (
  SELECT g.doc_id, g.term, g.tf,
         g.tf * (ln((1.0 + (SELECT count(*) FROM every_doc)) / (1 + v.df)) + 1) AS w
  FROM grams g JOIN vocab v ON g.term = v.term),
tfidf AS (
  SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)""",
    )


def _top_terms(cells: str, *ctes: str) -> str:
    return _articles(
        f"""
SELECT is_fake, CASE is_fake WHEN 0 THEN 'Real News' WHEN 1 THEN 'Fake News' ELSE 'Unlabeled' END AS label,
       term, mean_weight,
       CAST(row_number() OVER (PARTITION BY is_fake ORDER BY mean_weight DESC, term) AS INTEGER) AS rank
FROM (
  SELECT p.is_fake, c.term, round(sum(c.weight) / any_value(s.n), 6) AS mean_weight
  FROM {cells} c JOIN prepared p ON c.doc_id = p.id
  JOIN (SELECT is_fake, count(*) AS n FROM prepared GROUP BY is_fake) s ON p.is_fake = s.is_fake
  GROUP BY p.is_fake, c.term)
QUALIFY rank <= 20""",
        *ctes,
    )


def _cloud(label: str, where: str, text: str = "content", *more: str) -> str:
    left_out = " AND lower(regexp_replace(w, '''[sS]$', '')) NOT IN (SELECT lower(term) FROM stopwords)" if more else ""
    return _articles(
        rf"""
SELECT label, word, n, CAST(rank AS INTEGER) AS rank,
       round(n / max(n) OVER (PARTITION BY label), 6) AS weight
FROM (
  SELECT label, word, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, word) AS rank
  FROM (
    SELECT label, key, first(word ORDER BY n DESC, word) AS word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT label, key, word, sum(n) AS n FROM merged GROUP BY label, key, word)
    GROUP BY label, key)
  QUALIFY rank <= 200)""",
        *more,
        rf"""
found AS (
  SELECT {label} AS label,
         unnest(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']*')) AS w
  FROM prepared WHERE {where}),
spelled AS (
  SELECT label, regexp_replace(w, '''[sS]$', '') AS word, count(*) AS n FROM found
  WHERE NOT regexp_full_match(regexp_replace(w, '''[sS]$', ''), '\p{{Nd}}+'){left_out} GROUP BY ALL),
merged AS (
  SELECT s.label, coalesce(k.key, lower(s.word)) AS key,
         CASE WHEN k.key IS NULL THEN s.word ELSE left(s.word, length(s.word) - 1) END AS word, s.n
  FROM spelled s LEFT JOIN (SELECT DISTINCT label, lower(word) AS key FROM spelled) k
    ON s.label = k.label AND k.key || 's' = lower(s.word) AND NOT ends_with(k.key, 's')
       AND length(k.key) > 0)""",
    )


def _ngram_counts(low: int, high: int) -> str:
    parts = []
    for n in range(low, high + 1):
        gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
        parts.append(
            f"SELECT is_fake, {gram} AS ngram FROM "
            f"(SELECT is_fake, w, unnest(range(1, len(w) - {n - 2})) AS i FROM split_words)"
        )
    return rf"""
split_words AS (
  SELECT is_fake, regexp_extract_all(lower(normalized_content), '[\p{{L}}\p{{N}}_]{{2,}}') AS w
  FROM prepared),
gram_rows AS ({" UNION ALL ".join(parts)})"""


def _top_grams(low: int, high: int, top: int) -> str:
    return _articles(
        f"SELECT ngram, count(*) AS n FROM gram_rows GROUP BY ngram ORDER BY n DESC, ngram LIMIT {top}",
        _ngram_counts(low, high),
    )


_STOPWORDS = f"""
stopwords AS (
  SELECT term FROM (SELECT unnest(string_split({_clean("text")}, ' ')) AS term FROM benchmark)
  WHERE term <> '' GROUP BY term ORDER BY count(*) DESC, term LIMIT 50),
stop_list AS (SELECT list(term) AS listed FROM stopwords)"""

_WITHOUT = """
  array_to_string(list_filter(string_split(text, ' '),
    lambda w: w <> '' AND NOT list_contains(listed, w)), ' ')"""


# every_doc with its compounds joined, by a lexicon of its own runs of words
_SEGMENTS = """
split_words AS (
  SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM every_doc),
lexicon AS (
  SELECT gram FROM (
    SELECT doc_id, w[i] || '_' || w[i + 1] AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM split_words)
    UNION ALL
    SELECT doc_id, w[i] || '_' || w[i + 1] || '_' || w[i + 2]
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split_words))
  GROUP BY gram HAVING count(DISTINCT doc_id) >= 5),
places AS (
  SELECT doc_id, i, w[i] AS one, w[i] || '_' || w[i + 1] AS two,
         w[i] || '_' || w[i + 1] || '_' || w[i + 2] AS three,
         w[i] || '_' || w[i + 1] || '_' || w[i + 2] || '_' || w[i + 3] AS four
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM split_words)),
longest AS (
  SELECT p.doc_id, p.i, coalesce(d.gram, c.gram, b.gram, p.one) AS word,
         CASE WHEN d.gram IS NOT NULL THEN 4 WHEN c.gram IS NOT NULL THEN 3
              WHEN b.gram IS NOT NULL THEN 2 ELSE 1 END AS size
  FROM places p LEFT JOIN lexicon b ON b.gram = p.two LEFT JOIN lexicon c ON c.gram = p.three
  LEFT JOIN lexicon d ON d.gram = p.four),
walk AS (
  SELECT doc_id, i, size, word FROM longest WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, l.size, l.word
  FROM walk k JOIN longest l ON l.doc_id = k.doc_id AND l.i = k.i + k.size),
segmented AS (
  SELECT e.doc_id, coalesce(string_agg(k.word, ' ' ORDER BY k.i), '') AS text
  FROM every_doc e LEFT JOIN walk k ON k.doc_id = e.doc_id GROUP BY e.doc_id)"""


# the same tables, but for texts that are segmented and without stopwords
_NORMAL_ARTICLES = ", ".join(
    (
        ARTICLES[: ARTICLES.index("prepared AS (")].strip().rstrip(",").replace("articles AS (", "cleaned_articles AS (", 1),
        "every_doc AS (SELECT id AS doc_id, normalized_content AS text FROM cleaned_articles)",
        _SEGMENTS,
        _STOPWORDS,
        f"""
normal AS (SELECT doc_id, {_WITHOUT} AS text FROM segmented, stop_list),
articles AS (
  SELECT c.* REPLACE (n.text AS normalized_content) FROM cleaned_articles c JOIN normal n ON n.doc_id = c.id)""",
        ARTICLES[ARTICLES.index("labelled AS (") : ARTICLES.index("every_doc AS (")].strip().rstrip(","),
    )
)


def _joined(label: str, where: str) -> str:
    return _articles(
        f"""
SELECT {label} AS label, id // 64 AS part, string_agg(normalized_content, ' ' ORDER BY id) AS text
FROM prepared WHERE {where} GROUP BY ALL"""
    )


_LENGTHS = """
  SELECT '{0}' AS measure, count({1}) AS "count", round(avg({1}), 6) AS mean,
         round(stddev_samp({1}), 6) AS std, min({1}) AS "min", quantile_cont({1}, 0.25) AS q25,
         quantile_cont({1}, 0.5) AS q50, quantile_cont({1}, 0.75) AS q75, max({1}) AS "max"
  FROM prepared"""

_PAGE_TEXT = r"""
parts AS (
  SELECT page_id, url, unnest(list_transform(p, lambda x: regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(string_split(x, '</p>')[1], '<[^>]*>', '', 'g'),
           '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g'))) AS text,
         generate_subscripts(p, 1) AS place
  FROM (SELECT page_id, url, string_split(
          regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:] AS p FROM pages)),
titles AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(
           regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'))
         AS title FROM pages)"""


def _merged(upsert: bool) -> str:
    pick = lambda c: f"CASE WHEN b.url IS NULL THEN a.{c} ELSE b.{c} END AS {c}" if upsert else f"a.{c}"
    given = ", ".join(pick(c) for c in ("source", "summary", "crawled_at", "is_fake"))
    return _articles(
        f"""
SELECT a.id, a.title, a.url, {given}
FROM target a LEFT JOIN batch b ON a.url = b.url AND a.title = b.title
UNION ALL
SELECT (SELECT max(id) FROM target) + row_number() OVER (ORDER BY b.url, b.title), b.title, b.url,
       b.source, b.summary, b.crawled_at, b.is_fake
FROM batch b WHERE NOT EXISTS (SELECT 1 FROM target a WHERE a.url = b.url AND a.title = b.title)""",
        RECRAWLED,
        """
target AS (SELECT * FROM articles WHERE is_fake IS NOT NULL AND trim(normalized_content) <> ''),
batch AS (SELECT * FROM staged
          QUALIFY row_number() OVER (PARTITION BY url, title ORDER BY sequence DESC) = 1)""",
    )


_ADDED = _articles(
    _ROUNDED + "grown",
    _tokens("terms", "labelled"),
    _vocabulary("vocab", "terms", "labelled", "5000"),
    _tokens("all_terms", "every_doc"),
    _postings("vocab", "all_terms", "every_doc", "grown"),
)

_REMOVED = _articles(
    _ROUNDED + "postings",
    _tokens("terms", "every_doc"),
    _vocabulary("vocab", "terms", "every_doc", "5000"),
    "remaining AS (SELECT * FROM every_doc WHERE doc_id NOT IN (SELECT doc_id FROM fakes))",
    _tokens("remaining_terms", "remaining"),
    _postings("vocab", "remaining_terms", "remaining"),
)


ORACLE: dict[str, str] = {
    "read_articles_filtered": _articles(
        """
SELECT id, title, url, source, content, crawled_at, is_fake FROM articles
WHERE crawled_at >= TIMESTAMP '2024-01-02' AND crawled_at <= TIMESTAMP '2024-12-31 23:59:59.999999'
  AND source IN ('src1', 'src3', 'src5', 'src7', 'src11') AND is_fake = false"""
    ),
    "scan_by_id": _articles("SELECT id, title, url, source, crawled_at, is_fake FROM articles ORDER BY id"),
    "csv_roundtrip": _articles(
        """
SELECT nullif(title, '') AS title, nullif(url, '') AS url, nullif(source, '') AS source, summary,
       nullif(content, '') AS content, CAST(NULL AS TIMESTAMP) AS published_at, crawled_at, is_fake,
       nullif(normalized_content, '') AS normalized_content FROM articles"""
    ),
    "stage_rows": _articles(
        """
SELECT sequence, nullif(title, '') AS title, url, source, summary, nullif(content, '') AS content, is_fake
FROM staged""",
        RECRAWLED,
    ),
    "labeled_articles": _articles(
        "SELECT doc_id AS id, source, text AS normalized_content, is_fake FROM labelled"
    ),
    "upsert_articles": _merged(True),
    "insert_ignore_articles": _merged(False),
    "dedup_url_title": _articles(
        """
SELECT sequence, url, title, source, summary FROM recrawled
QUALIFY row_number() OVER (PARTITION BY url, title ORDER BY sequence DESC) = 1""",
        RECRAWLED,
    ),
    "dedup_keep_last": _articles(
        """
SELECT sequence, title, content, is_fake FROM (
  SELECT id AS sequence, title, content, CAST(is_fake AS INTEGER) AS is_fake FROM articles
  WHERE is_fake IS NOT NULL AND trim(normalized_content) <> ''
  UNION ALL SELECT id + 1000000000, title, content, NULL FROM articles)
WHERE content IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY title, content ORDER BY sequence DESC) = 1"""
    ),
    "dedup_keep_first": _articles(
        """
SELECT id, url, content FROM articles
QUALIFY row_number() OVER (PARTITION BY content ORDER BY id) = 1"""
    ),
    "skip_known_urls": _articles(
        """
SELECT a.id, a.url, a.title FROM articles a
WHERE NOT EXISTS (SELECT 1 FROM articles k WHERE k.url = a.url AND k.is_fake IS NOT NULL
                  AND trim(k.normalized_content) <> '')"""
    ),
    "tag_by_source": """
SELECT d.doc_id, r.source, r.is_fake, TIMESTAMP '2025-01-07 08:05:09' AS crawled_at
FROM documents d JOIN (
  SELECT d.lang, 'site ' || d.lang AS source, coalesce(bool_or(l.toxic = 1), false) AS is_fake
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang) r ON d.lang = r.lang""",
    "parse_published_at": """
SELECT event_id,
       CASE event_type WHEN 'click' THEN date_trunc('minute', ts) WHEN 'error' THEN NULL
            ELSE date_trunc('second', ts) END AS published_at,
       CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE date_trunc('second', ts) END AS cast_time
FROM events""",
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "remove_stopwords": _articles(f"SELECT doc_id, {_WITHOUT} AS text FROM every_doc, stop_list", _STOPWORDS),
    "normalize_text": f"""
WITH {_STOPWORDS}, cleaned AS (
  SELECT conv_id * 1000 + turn AS doc_id, {_clean("text")} AS text FROM conversations)
SELECT doc_id, {_WITHOUT} AS text FROM cleaned, stop_list""",
    "segment_words": f"WITH RECURSIVE {ARTICLES}, {_SEGMENTS} SELECT doc_id, text FROM segmented",
    "normalize_segmented": f"WITH RECURSIVE {ARTICLES}, {_SEGMENTS}, {_STOPWORDS} "
    f"SELECT doc_id, {_WITHOUT} AS text FROM segmented, stop_list",
    "extract_page_fields": f"""
WITH {_PAGE_TEXT}
SELECT t.page_id, t.title, t.url, p.text AS summary, CAST(NULL AS VARCHAR) AS date_text
FROM titles t LEFT JOIN parts p ON t.page_id = p.page_id AND p.place = 1
WHERE t.title <> '' AND t.url <> ''""",
    "extract_page_content": f"""
WITH {_PAGE_TEXT}
SELECT g.page_id, coalesce(string_agg(p.text, chr(10) ORDER BY p.place) FILTER (p.text <> ''), '') AS content
FROM pages g LEFT JOIN parts p ON g.page_id = p.page_id GROUP BY g.page_id""",
    "extract_sites": f"""
WITH {_PAGE_TEXT},
sites AS (
  SELECT page_id, CASE regexp_extract(url, '^https?://(blog|m)\\.', 1) WHEN '' THEN 'other'
           ELSE regexp_extract(url, '^https?://(blog|m)\\.', 1) END AS site,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 90061) AS at
  FROM pages),
contents AS (
  SELECT page_id, string_agg(text, chr(10) ORDER BY place) FILTER (text <> '') AS content,
         max(text) FILTER (place = 1) AS lead
  FROM parts GROUP BY page_id)
SELECT s.page_id, s.site, t.title, CASE WHEN s.site = 'blog' THEN c.lead END AS summary,
       CASE WHEN s.site <> 'other' THEN coalesce(c.content, '') END AS content,
       CASE s.site WHEN 'blog' THEN date_trunc('minute', s.at) WHEN 'm' THEN s.at END AS published_at,
       CAST(NULL AS VARCHAR) AS error
FROM sites s JOIN titles t ON t.page_id = s.page_id LEFT JOIN contents c ON c.page_id = s.page_id""",
    "prepare_for_analysis": _articles(
        """
SELECT id, text_length, word_count, CAST(year(crawled_at) AS INTEGER) AS year,
       CAST(month(crawled_at) AS INTEGER) AS month, CAST(day(crawled_at) AS INTEGER) AS day,
       dayname(crawled_at) AS day_of_week, is_fake FROM prepared"""
    ),
    "load_for_analysis": _articles(
        """
SELECT id, source, crawled_at, is_fake, word_count, text_length FROM prepared
WHERE crawled_at >= TIMESTAMP '2024-01-03 12:00:00' AND source IN ('src2', 'src4')"""
    ),
    "summary_stats": _articles(
        """
SELECT count(id) AS total_articles, count(*) FILTER (is_fake) AS fake_news,
       count(*) FILTER (NOT is_fake) AS real_news, count(DISTINCT source) AS num_sources FROM articles"""
    ),
    "date_range": _articles("SELECT min(crawled_at) AS min_date, max(crawled_at) AS max_date FROM articles"),
    "distinct_sources": "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source",
    "filter_options": _articles(
        """
SELECT (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM articles)) AS sources,
       min(crawled_at) AS min_date, max(crawled_at) AS max_date FROM articles"""
    ),
    "label_counts": _articles(
        "SELECT is_fake, count(*) AS n FROM articles WHERE is_fake IS NOT NULL GROUP BY is_fake"
    ),
    "source_counts": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source",
    "daily_counts": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1",
    "length_describe": _articles(
        f"{_LENGTHS.format('words', 'word_count')} UNION ALL {_LENGTHS.format('chars', 'text_length')}"
    ),
    "running_lengths": _articles(
        f"{_LENGTHS.format('words', 'word_count')} UNION ALL {_LENGTHS.format('chars', 'text_length')}"
    ),
    "running_summary": _articles(
        """
SELECT count(*) AS total_articles, count(*) FILTER (is_fake) AS fake_news, count(*) FILTER (NOT is_fake) AS real_news,
       count(DISTINCT source) AS num_sources, min(crawled_at) AS min_date, max(crawled_at) AS max_date FROM articles"""
    ),
    "source_label_crosstab": _articles(
        """
SELECT source, count(*) FILTER (is_fake = -1) AS unlabelled, count(*) FILTER (is_fake = 0) AS real,
       count(*) FILTER (is_fake = 1) AS fake FROM prepared WHERE source IS NOT NULL GROUP BY source"""
    ),
    "length_histogram": _articles(
        """
SELECT is_fake, CAST(least((word_count - low) * 50 // greatest(high - low, 1), 49) AS INTEGER) AS bin,
       count(*) AS n
FROM prepared, (SELECT min(word_count) AS low, max(word_count) AS high FROM prepared) GROUP BY ALL"""
    ),
    "length_kde": _articles(
        """
SELECT s.is_fake, CAST(g.point AS INTEGER) AS point,
       round(s.low + g.point * (s.high - s.low) / 199, 6) AS x,
       round(sum(exp(-pow((s.low + g.point * (s.high - s.low) / 199 - p.word_count) / s.h, 2) / 2))
             * any_value(s.width) / any_value(s.h) / sqrt(2 * pi()), 6) AS density
FROM (
  SELECT is_fake, min(word_count) AS low, max(word_count) AS high,
         stddev_samp(word_count) * pow(count(*), -0.2) AS h,
         (SELECT (max(word_count) - min(word_count)) / 50 FROM prepared) AS width
  FROM prepared GROUP BY is_fake HAVING max(word_count) > min(word_count)) s
JOIN prepared p ON p.is_fake = s.is_fake, (SELECT unnest(range(200)) AS point) g
GROUP BY s.is_fake, g.point, s.low, s.high"""
    ),
    "concat_text_by_label": _joined("CAST(is_fake AS VARCHAR)", "is_fake <> -1"),
    "concat_text_all": _joined("'all'", "true"),
    "word_frequencies": _cloud("'all'", "true"),
    "word_frequencies_by_label": _cloud("CAST(is_fake AS VARCHAR)", "is_fake <> -1"),
    "word_frequencies_normalized": _cloud("'all'", "true", "normalized_content", _STOPWORDS),
    "top_unigrams": _top_grams(1, 1, 30),
    "top_bigrams": _top_grams(2, 2, 30),
    "top_one_to_three_grams": _top_grams(1, 3, 100),
    "ngrams_by_label": _articles(
        """
SELECT is_fake, ngram, n,
       CAST(row_number() OVER (PARTITION BY is_fake ORDER BY n DESC, ngram) AS INTEGER) AS rank
FROM (SELECT is_fake, ngram, count(*) AS n FROM gram_rows GROUP BY is_fake, ngram)
QUALIFY rank <= 15""",
        _ngram_counts(1, 2),
    ),
    "term_stats": _articles(
        "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM terms GROUP BY term",
        _tokens("terms", "every_doc"),
    ),
    "auto_max_features": _articles(
        "SELECT CAST(least(3000, floor(avg(word_count) * 1.5)) AS INTEGER) AS max_features FROM prepared"
    ),
    "tfidf_vectors": _articles(_ROUNDED + "tfidf", *_tfidf(2000)),
    "bm25_vectors": _articles(
        _ROUNDED + "postings",
        _grams("grams", "every_doc"),
        _vocabulary(
            "vocab",
            "grams",
            "every_doc",
            "(SELECT CAST(least(3000, floor(avg(word_count) * 1.5)) AS BIGINT) FROM prepared)",
        ),
        _postings("vocab", "grams", "every_doc", factor="2.5"),
    ),
    "top_weighted_terms_tfidf": _top_terms("tfidf", *_tfidf(5000)),
    "top_weighted_terms_bm25": _top_terms("postings", *_INDEX_ALL),
    "matrix_stats": _articles(
        """
SELECT n AS n_rows, v AS n_cols, nnz, round(1 - nnz / (n * v), 6) AS sparsity
FROM (SELECT (SELECT count(*) FROM every_doc) AS n, (SELECT count(*) FROM vocab) AS v,
             (SELECT count(*) FROM postings) AS nnz)""",
        *_INDEX_ALL,
    ),
    "bm25_vocab": _articles("SELECT term_id, term, df, cf FROM vocab", *_INDEX),
    "bm25_postings": _articles(_ROUNDED + "postings", *_INDEX),
    "doc_lengths": _articles(
        """
SELECT l.doc_id, coalesce(d.dl, 0) AS doc_length, round(average, 6) AS average_length
FROM labelled l LEFT JOIN (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM postings_tf GROUP BY doc_id) d
  ON l.doc_id = d.doc_id, postings_avg""",
        *_INDEX,
    ),
    "bm25_query_topk": _articles("SELECT query_id, doc_id, rank, score FROM hits", *_HITS),
    "bm25_self_topk": _articles(
        """
SELECT query_id, doc_id, score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
FROM (SELECT a.doc_id AS query_id, p.doc_id, round(sum(a.tf * p.weight), 6) AS score
      FROM postings_tf a JOIN postings p ON a.term = p.term GROUP BY a.doc_id, p.doc_id)
WHERE score > 0 QUALIFY rank <= 10""",
        *_INDEX_ALL,
    ),
    "bm25_transform_new": _articles(
        """
SELECT a.doc_id, a.term, CAST(a.tf AS INTEGER) AS tf,
       round(ln(1 + (n - v.df + 0.5) / (v.df + 0.5)) * a.tf
             / (a.tf + 1.5 * (1 - 0.75 + 0.75 * sum(a.tf) OVER (PARTITION BY a.doc_id) / average)), 6) AS weight
FROM asked a JOIN vocab v ON a.term = v.term, postings_n, postings_avg""",
        *_INDEX,
        _tokens("asked", "unlabelled"),
    ),
    "index_save_load": _articles(_ROUNDED + "postings", *_INDEX),
    "index_add_documents": _ADDED,
    "index_add_rebuild": _articles(_ROUNDED + "postings", *_INDEX_ALL),
    "index_remove_documents": _REMOVED,
    "index_store_remove": _REMOVED,
    "index_lookup": _articles(
        "SELECT doc_id, text FROM every_doc WHERE doc_id IN (SELECT doc_id FROM fakes)"
    ),
    "index_lookup_embeddings": _articles(
        _ROUNDED + "postings WHERE doc_id IN (SELECT doc_id FROM fakes)", *_INDEX_ALL
    ),
    "detect_vote": _articles(_VOTES, *_HITS),
    "detect_normalized": f"WITH RECURSIVE {_NORMAL_ARTICLES}, {', '.join(_HITS)} {_VOTES}",
    "detect_similar_articles": _articles(
        """
SELECT h.query_id, h.rank, h.doc_id, coalesce(substring(l.title, 1, 100), 'N/A') AS title,
       coalesce(l.source, 'Unknown') AS source, l.is_fake AS label,
       CASE WHEN l.is_fake = 1 THEN 'FAKE' ELSE 'REAL' END AS label_text, h.score AS similarity_score
FROM hits h JOIN labelled l ON l.doc_id = h.doc_id""",
        *_HITS,
    ),
    "hybrid_interpret": """
SELECT doc_id, CASE WHEN complete THEN toxic ELSE 0 END AS label,
       CASE WHEN NOT complete THEN 'Unknown' WHEN toxic = 1 THEN 'Fake' ELSE 'Real' END AS label_text,
       CASE WHEN complete THEN round(abs(p - 0.5) * 2, 3) ELSE 0.0 END AS confidence,
       CASE WHEN answered THEN p ELSE 0.5 END AS fake_probability,
       CASE WHEN complete THEN round(1 - p, 3) ELSE 0.5 END AS real_probability,
       CASE WHEN NOT answered THEN 'medium' WHEN p < 0.3 THEN 'low' WHEN p < 0.7 THEN 'medium'
            ELSE 'high' END AS risk
FROM (SELECT d.doc_id, l.toxic, l.toxic IS NOT NULL AS answered,
             l.toxic IS NOT NULL AND l.quality = 1 AS complete,
             round((d.n_chars % 1000) / 1000.0, 3) AS p
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "knn_graph_cosine": """
SELECT vec_id, neighbour_id, cosine,
       CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour_id) AS INTEGER) AS rank
FROM (SELECT a.vec_id, b.vec_id AS neighbour_id,
             round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
               AS cosine
      FROM embeddings a, embeddings b)
QUALIFY rank <= 15""",
    "stream_upsert": _articles(
        """
SELECT CASE WHEN id % 5 = 0 THEN 'again ' || title ELSE title END AS title, url, source,
       CASE WHEN id % 3 = 0 THEN 'changed' END AS summary,
       CAST(1 + CAST(id % 6 = 0 AS INTEGER) + CAST(id % 5 = 0 AS INTEGER) AS BIGINT) AS n_changes
FROM articles WHERE title <> ''"""
    ),
    "stream_ingest": """
SELECT substring(text, 1, 100) AS title, 'doc://' || md5(text) AS url, source, text AS content,
       CAST(0 AS BIGINT) AS batch
FROM documents WHERE substring(text, 1, 100) <> ''
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""",
    "stream_index_update": _ADDED,
}
