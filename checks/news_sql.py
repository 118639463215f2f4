"""SQL of the news tables."""

from __future__ import annotations

from tickerloom.functions.text import NAME_SUFFIXES

# White space as Python sees it, for RE2.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

NEWS = """news AS (SELECT doc_id AS news_id, 'http://x/' || doc_id AS url,
  CAST(DATE '1995-01-02' + CAST(doc_id % 2500 AS INTEGER) AS DATE) AS news_date, 'tradingview' AS website,
  source AS provider, text AS content, lang FROM documents)"""

COMPANY = """company AS (SELECT s_suppkey AS company_id, CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, s_acctbal,
  s_nationkey FROM supplier)"""

BRIDGE = """bridge AS (SELECT DISTINCT news_id, company_id FROM (
  SELECT doc_id AS news_id, doc_id % (SELECT count(*) FROM supplier) AS company_id FROM documents
  UNION ALL SELECT doc_id, (doc_id * 31 + 7) % (SELECT count(*) FROM supplier) FROM documents)
  WHERE company_id IN (SELECT s_suppkey FROM supplier))"""


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sentences(text: str = "content") -> str:
    """List of stripped sentences; dots that touch a digit are masked first."""
    masked = rf"regexp_replace(regexp_replace({text}, '([0-9])\.', '\1' || chr(1), 'g'), '\.([0-9])', chr(1) || '\1', 'g')"
    return (
        rf"list_transform(string_split_regex({masked}, '[.\n]'), lambda x: {strip('replace(x, chr(1), chr(46))')})"
    )


def split_sentences(minimum: int) -> str:
    return f"list_filter({sentences()}, lambda x: length(x) >= {minimum})"


SENTENCES = f"""sl AS (SELECT news_id, list_filter({split_sentences(3)}, lambda x: length(x) > 15) AS l FROM news),
sentences AS (SELECT news_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM sl)"""

LABELLED = """scored_s AS (SELECT *, 'LABEL_' || (CAST('0x' || substr(md5(sentence), 1, 2) AS INTEGER) % 3) AS label,
  CAST('0x' || substr(md5(sentence), 3, 2) AS INTEGER) / 255.0::DOUBLE AS score FROM sentences),
weighed AS (SELECT *, CASE label WHEN 'LABEL_2' THEN 1 WHEN 'LABEL_0' THEN -1 ELSE 0 END AS w FROM scored_s)"""

CLASS = """CASE WHEN news_ratio > 0.15 THEN 2 WHEN news_ratio > 0.05 THEN 1 WHEN news_ratio < -0.15 THEN -2
  WHEN news_ratio < -0.05 THEN -1 ELSE 0 END"""

ARTICLE = f"""ratio AS (SELECT news_id, coalesce(sum(w * score) / nullif(count(*) FILTER (WHERE w <> 0), 0), 0) AS news_ratio
  FROM weighed GROUP BY news_id),
scored AS (SELECT n.*, coalesce(r.news_ratio, 0) AS news_ratio, coalesce({CLASS.replace('news_ratio', 'r.news_ratio')}, 0) AS news_type
  FROM news n LEFT JOIN ratio r USING (news_id))"""

DAILY = """daily AS (SELECT c.code AS symbol, n.news_date AS date, avg(n.news_ratio) AS avg_sentiment,
  count(n.news_id) AS news_count FROM scored n JOIN bridge USING (news_id) JOIN company c USING (company_id) GROUP BY 1, 2)"""

SCORED = ",\n".join([NEWS, COMPANY, BRIDGE, SENTENCES, LABELLED, ARTICLE, DAILY])


def upper(x: str) -> str:
    """Upper case with the sharp s written out, as full case mapping does."""
    return f"upper(replace({x}, 'ß', 'ss'))"


def clean_name(x: str) -> str:
    out = upper(x)
    for suffix in NAME_SUFFIXES:
        out = f"regexp_replace({out}, '{suffix}', '', 'g')"
    return strip(f"regexp_replace({out}, '{WS}+', ' ', 'g')")


def word_list(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda x: x <> '')"


LISTED = f"""items AS (SELECT item_id, {word_list(upper('text'))} AS w FROM benchmark),
codes AS (SELECT item_id, regexp_extract(w[1], '([\\p{{L}}\\p{{N}}_]+)', 1) AS code, array_to_string(w[1:2], ' ') AS name FROM items),
listed AS (SELECT code, arg_min(name, item_id) AS name FROM codes WHERE code <> '' GROUP BY code)"""

ARTICLES = f"articles AS (SELECT doc_id AS news_id, {upper('text')} AS content FROM documents)"

EXACT = r"""tokens AS (SELECT DISTINCT news_id, unnest(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS word FROM articles),
exact AS (SELECT news_id, code, name FROM tokens JOIN listed ON word = upper(code))"""

# Each accented capital becomes one unused letter: the score here compares bytes.
ONE_BYTE = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜ', 'abcdefghij')"

FUZZY = f"""needles AS (SELECT *, len({word_list('cleaned_name')}) AS n FROM (SELECT code, name, {clean_name('name')} AS cleaned_name FROM listed)),
usable AS (SELECT * FROM needles WHERE n > 1 OR (n = 1 AND length(cleaned_name) >= 5)),
word_lists AS (SELECT news_id, {word_list('content')} AS w FROM articles),
sizes AS (SELECT DISTINCT n FROM usable),
runs AS (SELECT DISTINCT n, news_id, array_to_string(w[i:i + n - 1], ' ') AS run
  FROM (SELECT news_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM word_lists, sizes)),
best AS (SELECT run, r.n, code, jaro_winkler_similarity({ONE_BYTE.format('cleaned_name')}, {ONE_BYTE.format('run')}) AS s
  FROM (SELECT DISTINCT n, run FROM runs) r JOIN usable USING (n)),
fuzzy AS (SELECT news_id, u.code, u.name, u.cleaned_name, round(max(s), 4) AS score
  FROM runs JOIN best USING (n, run) JOIN usable u ON u.code = best.code
  WHERE s >= 0.88 AND (news_id, u.code) NOT IN (SELECT (news_id, code) FROM exact) GROUP BY ALL)"""
