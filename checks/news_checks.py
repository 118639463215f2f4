"""Queries over articles: text functions, matching, scores, stored tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks import datasets as d
from checks.market import rounds
from checks.news_sql import (
    ARTICLES, BRIDGE, COMPANY, EXACT, FUZZY, LISTED, NEWS, SCORED, SENTENCES, clean_name, sentences,
)
from checks.sqltools import BARS, rounded, with_
from tickerloom.functions import html, jaro, scores, sector, text
from tickerloom.operators import explore, matching, sentiment, upsert
from tickerloom.plans import news as plan
from tickerloom.session import use_checkpoint_dir
from tickerloom.sources import articles as store
from tickerloom.sources import company as companies
from tickerloom.sources import headlines, tables

QUERIES, ORACLES = {}, {}
c = F.col


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def docs(s, p):
    return d.table(s, p, "documents")


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# -- text functions ---------------------------------------------------------------------

add(
    "clean_company_names",
    lambda s, p: docs(s, p).select("doc_id", text.clean_company_name(c("text")).alias("name")),
    f"SELECT doc_id, {clean_name('text')} AS name FROM documents",
)
add(
    "split_sentences",
    lambda s, p: d.news(s, p).select("news_id", F.posexplode(text.sentences(c("content"))).alias("pos", "sentence")),
    with_(NEWS, f"l AS (SELECT news_id, list_filter({sentences()}, lambda x: length(x) >= 3) AS l FROM news)",
          select="SELECT news_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM l"),
)
add(
    "scored_sentences",
    lambda s, p: sentiment.article_sentences(d.news(s, p)),
    with_(NEWS, SENTENCES, select="SELECT * FROM sentences"),
)
PROVIDER = """(SELECT page_id, url, instr(url, 'www.') AS w, instr(url, '.com') AS e FROM pages)"""
for _strict in (False, True):
    add(
        "provider_strict" if _strict else "provider_from_text",
        lambda s, p, st=_strict: d.table(s, p, "pages").select("page_id", text.provider(c("url"), st).alias("provider")),
        f"""SELECT page_id, CASE WHEN e > 0 AND w + 3 < e - 1 AND length(substr(url, w + 4, e - w - 4)) BETWEEN 1 AND 15
        {"AND w > 0" if _strict else ""} THEN substr(url, w + 4, e - w - 4) ELSE 'undetermined' END AS provider FROM {PROVIDER}""",
    )
add(
    "provider_fallback",
    lambda s, p: d.table(s, p, "pages").select(
        "page_id",
        text.provider_or_id(
            text.provider(c("url"), True), F.concat(F.lit("Src-"), c("page_id").cast("string"), F.lit(". Co"))
        ).alias("provider"),
    ),
    f"""SELECT page_id, CASE WHEN e > 0 AND w + 3 < e - 1 AND length(substr(url, w + 4, e - w - 4)) BETWEEN 1 AND 15
    AND w > 0 THEN substr(url, w + 4, e - w - 4) ELSE 'src' || page_id || 'co' END AS provider FROM {PROVIDER}""",
)
_ts = {
    0: ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    1: ("yyyy-MM-dd'T'HH:mm:ss'Z'"),
    2: ("yyyy-MM-dd'T'HH:mm:ss"),
    3: ("E, dd MMM yyyy HH:mm:ss 'GMT'"),
    4: ("yyyy/MM/dd HH:mm"),
}


def event_dates(s, p):
    ev = d.table(s, p, "events")
    written = F.coalesce(*[F.when(c("event_id") % 5 == k, F.date_format("ts", f)) for k, f in _ts.items()])
    return ev.select("event_id", text.news_date(written, F.lit("2000-01-01").cast("date")).alias("day"))


add(
    "published_dates",
    event_dates,
    "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN DATE '2000-01-01' ELSE CAST(ts AS DATE) END AS day FROM events",
)
add(
    "epoch_dates",
    lambda s, p: d.table(s, p, "events").select(
        "event_id",
        text.date_label(
            text.epoch_date(
                F.when(c("event_id") % 7 != 0, F.unix_timestamp(c("ts").cast("timestamp"))).otherwise(0),
                F.lit("2000-01-01").cast("date"),
            )
        ).alias("label"),
    ),
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '2000.01.01' ELSE strftime(ts, '%Y.%m.%d') END AS label FROM events""",
)
add(
    "disclaimer_removed",
    lambda s, p: docs(s, p).select(
        "doc_id",
        text.strip_disclaimer(
            F.when(c("lang") == "en", F.concat("text", F.lit(text.LEGAL_DISCLAIMER), c("source"))).otherwise(c("text"))
        ).alias("content"),
    ),
    "SELECT doc_id, CASE WHEN lang = 'en' THEN text || source ELSE text END AS content FROM documents",
)
add(
    "fallback_content",
    lambda s, p: docs(s, p).select(
        "doc_id",
        text.fallback_content(
            c("text"), F.when(c("lang") != "en", c("source")).otherwise(""), F.when(c("lang") != "fr", c("lang"))
        ).alias("content"),
    ),
    """SELECT doc_id, text || CASE WHEN lang <> 'en' THEN chr(10) || 'Kaynak: ' || source ELSE '' END
    || CASE WHEN lang <> 'fr' THEN chr(10) || 'Link: ' || lang ELSE '' END AS content FROM documents""",
)


def packed_files(s, p):
    part = docs(s, p).select(
        F.floor(c("doc_id") / 10).alias("path"), F.struct("doc_id", text.packed(c("text")).alias("t")).alias("r")
    )
    files = part.groupBy("path").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return files.select("path", F.array_join(F.transform("rs", lambda r: r["t"]), "").alias("value"))


add(
    "split_stored_files",
    lambda s, p: store.split_files(packed_files(s, p)),
    r"""WITH x AS (SELECT doc_id // 10 AS path, string_agg(text || chr(10) || repeat('_', 50) || chr(10), '' ORDER BY doc_id) AS v
    FROM documents GROUP BY 1), y AS (SELECT path, string_split_regex(v, '_{50}') AS l FROM x)
    SELECT path, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS content FROM y""",
)


def sector_sql(x="text"):
    low = f"lower({x})"
    whens = [f"WHEN contains({low}, {q(n.lower())}) OR contains({q(n.lower())}, {low}) THEN {q(n)}" for n in sector.SECTORS]
    whens += [f"WHEN contains({low}, {q(k)}) THEN {q(n)}" for k, n in sector.KEYWORDS.items()]
    return f"CASE {' '.join(whens)} ELSE {q(sector.DEFAULT_SECTOR)} END"


SECTOR_ID = "CASE sector " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(sector.SECTORS)) + " ELSE 26 END"
add(
    "fuzzy_sector",
    lambda s, p: docs(s, p)
    .select("doc_id", sector.fuzzy_sector(c("text")).alias("sector"))
    .withColumn("sector_id", sector.sector_id(c("sector"))),
    f"WITH x AS (SELECT doc_id, {sector_sql()} AS sector FROM documents) SELECT doc_id, sector, CAST({SECTOR_ID} AS INTEGER) AS sector_id FROM x",
)
RAW_SECTOR = "CASE WHEN s_suppkey % 3 = 0 THEN 'Bankacılık' WHEN s_suppkey % 3 = 1 THEN 'petro grubu' ELSE s_name END"


def replies(s, p):
    sup = d.table(s, p, "supplier")
    raw = (
        F.when(c("s_suppkey") % 3 == 0, "Bankacılık").when(c("s_suppkey") % 3 == 1, "petro grubu").otherwise(c("s_name"))
    )
    item = F.struct(c("s_suppkey").cast("string").alias("code"), raw.alias("sector"))
    lists = sup.groupBy(F.floor(c("s_suppkey") / 15).alias("batch")).agg(F.to_json(F.collect_list(item)).alias("j"))
    fenced = F.concat(F.lit("```json\n"), c("j"), F.lit("\n```"))
    wrapped = F.concat(F.lit('{"n": 1, "companies": '), c("j"), F.lit("}"))
    return lists.select(
        "batch", F.when(c("batch") % 3 == 0, fenced).when(c("batch") % 3 == 1, wrapped).otherwise(c("j")).alias("reply")
    )


add(
    "sector_replies",
    lambda s, p: replies(s, p)
    .select(F.inline(sector.reply_items(c("reply"))))
    .withColumn("sector_id", sector.sector_id(c("sector"))),
    f"""WITH x AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, {RAW_SECTOR} AS raw FROM supplier),
    y AS (SELECT code, {sector_sql('raw')} AS sector FROM x)
    SELECT code, sector, CAST({SECTOR_ID} AS INTEGER) AS sector_id FROM y""",
)
add(
    "sentiment_label_ids",
    lambda s, p: d.table(s, p, "events").select(
        "event_id",
        scores.sentiment_id(F.when(c("value") > 50, "positive").when(c("value") > 10, "neutral").otherwise(c("event_type"))).alias("label"),
    ),
    "SELECT event_id, CASE WHEN value > 50 THEN 2 WHEN value > 10 THEN 1 END AS label FROM events",
)
add(
    "normalised_tickers",
    lambda s, p: docs(s, p).select("doc_id", text.ticker(F.concat(F.lit(" \t"), c("lang"), F.lit("\n"))).alias("symbol")),
    "SELECT doc_id, upper(lang) || '.IS' AS symbol FROM documents",
)
add(
    "display_texts",
    lambda s, p: docs(s, p).select(
        "doc_id",
        text.display_text(c("text")).alias("shown"),
        text.percent(c("n_chars") / F.lit(65536.0)).alias("pct"),
        scores.label_name(F.concat(F.lit("LABEL_"), (c("doc_id") % 4).cast("string"))).alias("label"),
    ),
    """SELECT doc_id, CASE WHEN length(text) > 75 THEN text[1:75] || '...' ELSE text END AS shown,
    printf('%%%.2f', n_chars / 65536.0 * 100) AS pct,
    CASE doc_id % 4 WHEN 0 THEN '🔴 Negatif' WHEN 1 THEN '🟡 Nötr' WHEN 2 THEN '🟢 Pozitif' ELSE 'LABEL_3' END AS label FROM documents""",
)
PAIR = {"p_partkey": None, "score": 6}
add(
    "jaro_winkler_scores",
    lambda s, p: rounds(
        d.table(s, p, "part").withColumn("score", jaro.jaro_winkler(c("p_name"), F.lower(c("p_type")))), PAIR
    ),
    f"SELECT {rounded(PAIR)} FROM (SELECT p_partkey, jaro_winkler_similarity(p_name, lower(p_type)) AS score FROM part)",
)


def article_pages(s, p):
    """The given pages with the elements news pages have."""
    h = F.regexp_replace("html", r"<h1>", '<div class="title-a block-b">')
    h = F.regexp_replace(h, r"</h1>", "</div>")
    h = F.regexp_replace(h, r"<article>", '<time datetime="2024-03-01T10:00:00Z"></time><div class="body-x content-y">')
    return d.table(s, p, "pages").select("page_id", "url", F.regexp_replace(h, r"</article>", "</div>").alias("html"))


add(
    "page_fields",
    lambda s, p: article_pages(s, p)
    .select("page_id", html.article(c("html")).alias("f"))
    .select("page_id", "f.*", html.article_text(c("f")).alias("content")),
)
add(
    "page_links",
    lambda s, p: d.table(s, p, "pages").select(
        "page_id", F.posexplode(html.links(c("html"), "http://x", "/")).alias("pos", "url")
    ),
    r"""WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]+)"', 1), lambda x: x LIKE '/%' AND x <> '/') AS h FROM pages),
    e AS (SELECT page_id, unnest(h) AS u, unnest(range(len(h))) AS i FROM l),
    f AS (SELECT page_id, u, min(i) AS i FROM e GROUP BY 1, 2)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, 'http://x' || u AS url FROM f""",
)
add(
    "distinct_links_in_order",
    lambda s, p: explore.ordered_distinct(
        d.table(s, p, "pages").select(
            F.posexplode(html.links(c("html"), "http://x", "/")).alias("i", "url"), "page_id"
        ).select("url", (c("page_id") * 1000 + c("i")).alias("pos")),
        "url", "pos",
    ),
    r"""WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]+)"', 1), lambda x: x LIKE '/%' AND x <> '/') AS h FROM pages),
    e AS (SELECT page_id, unnest(h) AS u, unnest(range(len(h))) AS i FROM l),
    f AS (SELECT page_id, u, min(i) AS i FROM e GROUP BY 1, 2),
    g AS (SELECT page_id, u, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS i FROM f)
    SELECT 'http://x' || u AS url, min(page_id * 1000 + i) AS pos FROM g GROUP BY 1""",
)

# -- headlines -----------------------------------------------------------------------------


def headline_replies(s, p):
    x = docs(s, p)
    item = F.struct(
        c("doc_id").cast("string").alias("id"),
        c("text").alias("title"),
        c("source").alias("provider"),
        F.when(c("doc_id") % 3 != 0, F.upper("source")).alias("source"),
        F.when(c("doc_id") % 7 != 0, F.lit(789000000) + c("doc_id") * 3600).otherwise(0).alias("published"),
        F.when(c("lang") != "de", F.concat(F.lit("/news/"), c("doc_id").cast("string"))).alias("storyPath"),
    )
    return x.groupBy(F.floor(c("doc_id") / 50).alias("batch")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json")
    )


add(
    "headline_rows",
    lambda s, p: headlines.headline_rows(
        headlines.from_json_text(headline_replies(s, p)), F.lit("2000-01-01").cast("date"), "http://x"
    ),
    """SELECT 'http://x/news/' || doc_id AS url, text AS title,
    CASE WHEN doc_id % 3 <> 0 THEN upper(source) ELSE source END AS provider, source AS provider_id,
    CASE WHEN doc_id % 7 <> 0 THEN 789000000 + doc_id * 3600 ELSE 0 END AS published,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(make_timestamp((789000000 + doc_id * 3600) * 1000000), '%Y.%m.%d')
    ELSE '2000.01.01' END AS date_label, '' AS link FROM documents WHERE lang <> 'de'""",
)

# -- scores ------------------------------------------------------------------------------------

RATIO = {"news_id": None, "news_ratio": 6, "news_type": None}
add(
    "article_scores",
    lambda s, p: rounds(d.scored_news(s, p), RATIO),
    with_(SCORED, select=f"SELECT {rounded(RATIO)} FROM scored"),
)
add(
    "article_class_names",
    lambda s, p: d.scored_news(s, p).select("news_id", scores.class_name(c("news_type")).alias("label")),
    with_(SCORED, select="SELECT news_id, CASE news_type "
          + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in scores.CLASS_NAMES.items()) + " END AS label FROM scored"),
)
DAY = {"symbol": None, "date": None, "avg_sentiment": 6, "news_count": None}
add("daily_sentiment", lambda s, p: rounds(d.daily(s, p), DAY), with_(SCORED, select=f"SELECT {rounded(DAY)} FROM daily"))
add(
    "daily_mean_score",
    lambda s, p: rounds(
        d.scored_news(s, p).groupBy(c("news_date").alias("date")).agg(F.avg("news_ratio").alias("score")),
        {"date": None, "score": 6},
    ),
    with_(SCORED, select="SELECT news_date AS date, round(avg(news_ratio), 6) + 0.0 AS score FROM scored GROUP BY 1"),
)
add(
    "news_of_companies",
    lambda s, p: sentiment.news_of_companies(d.news(s, p), d.bridge(s, p), d.company(s, p)).select(
        "code", "news_id", "news_date", "provider"
    ),
    with_(NEWS, COMPANY, BRIDGE,
          select="SELECT code, news_id, news_date, provider FROM news JOIN bridge USING (news_id) JOIN company USING (company_id)"),
)
JS = {"symbol": None, "date": None, "avg_sentiment": 6, "news_count": None}
add(
    "bars_with_sentiment",
    lambda s, p: rounds(sentiment.join_sentiment(d.bars(s, p), d.daily(s, p)), JS),
    with_(BARS, SCORED, """j AS (SELECT b.symbol, b.date, coalesce(avg_sentiment, 0) AS avg_sentiment,
          coalesce(news_count, 0) AS news_count FROM bars b LEFT JOIN daily USING (symbol, date))""",
          select=f"SELECT {rounded(JS)} FROM j"),
)

# -- matching --------------------------------------------------------------------------------------

MATCH = ["news_id", "code", "name", "cleaned_name", "match_type", "score"]
EXACT_ROWS = "SELECT news_id, code, name, CAST(NULL AS VARCHAR) AS cleaned_name, 'exact_kod' AS match_type, CAST(NULL AS DOUBLE) AS score FROM exact"
FUZZY_ROWS = "SELECT news_id, code, name, cleaned_name, 'fuzzy_name' AS match_type, score FROM fuzzy"
MATCH_SQL = (LISTED, ARTICLES, EXACT, FUZZY)
add(
    "match_exact_codes",
    lambda s, p: matching.exact_matches(d.upper_articles(s, p), d.listed(s, p)),
    with_(LISTED, ARTICLES, EXACT, select=EXACT_ROWS),
)
add(
    "match_fuzzy_names",
    lambda s, p: matching.fuzzy_matches(
        d.upper_articles(s, p), d.listed(s, p), exclude=matching.exact_matches(d.upper_articles(s, p), d.listed(s, p))
    ),
    with_(*MATCH_SQL, select=FUZZY_ROWS),
)
add(
    "match_ordered",
    lambda s, p: matching.ordered_matches(matching.match_articles(d.upper_articles(s, p), d.listed(s, p))),
    with_(*MATCH_SQL, f"m AS ({EXACT_ROWS} UNION ALL {FUZZY_ROWS})",
          select="""SELECT *, CAST(row_number() OVER (PARTITION BY news_id ORDER BY match_type, score DESC NULLS LAST, code) AS INTEGER)
          AS rank FROM m"""),
)
add(
    "matched_articles",
    lambda s, p: plan.with_matches(
        d.upper_articles(s, p), matching.exact_matches(d.upper_articles(s, p), d.listed(s, p))
    ).select("news_id"),
    with_(LISTED, ARTICLES, EXACT, select="SELECT DISTINCT news_id FROM exact"),
)
add(
    "match_code_names",
    lambda s, p: matching.with_company_name(
        matching.exact_matches(d.upper_articles(s, p), d.listed(s, p)).select("news_id", "code"),
        matching.exact_matches(d.upper_articles(s, p), d.listed(s, p)).filter(F.length("name") > 8),
    ),
    with_(LISTED, ARTICLES, EXACT,
          select="SELECT news_id, code, CASE WHEN length(name) > 8 THEN name ELSE code END AS name FROM exact"),
)
add(
    "match_code_map",
    lambda s, p: matching.code_to_name(matching.exact_matches(d.upper_articles(s, p), d.listed(s, p))).select(
        "news_id", F.array_join(F.array_sort(F.map_keys("code_to_name")), ",").alias("codes")
    ),
    with_(LISTED, ARTICLES, EXACT, select="SELECT news_id, string_agg(code, ',' ORDER BY code) AS codes FROM exact GROUP BY 1"),
)

# -- stored tables -------------------------------------------------------------------------------------

add(
    "recent_news",
    lambda s, p: plan.recent(d.news(s, p), dt.date(1995, 5, 1)).select("news_id", "news_date"),
    with_(NEWS, select="SELECT news_id, news_date FROM news WHERE news_date >= DATE '1995-04-21'"),
)


def incoming_companies(s, p):
    return d.table(s, p, "customer").select(
        c("c_custkey").alias("seq"), F.floor(c("c_custkey") / 3).cast("string").alias("code"), c("c_name").alias("name")
    )


add(
    "upsert_companies",
    lambda s, p: upsert.upsert_company(d.company(s, p).select("company_id", "code", "name"), incoming_companies(s, p)),
    with_(
        COMPANY,
        "inc AS (SELECT c_custkey AS seq, CAST(c_custkey // 3 AS VARCHAR) AS code, c_name AS name FROM customer)",
        "last AS (SELECT code, arg_max(name, seq) AS name, min(seq) AS seq FROM inc GROUP BY code)",
        select="""SELECT company_id, code, coalesce(l.name, c.name) AS name FROM company c LEFT JOIN last l USING (code)
        UNION ALL SELECT (SELECT max(company_id) FROM company) + row_number() OVER (ORDER BY seq), code, name FROM last
        WHERE code NOT IN (SELECT code FROM company)""",
    ),
)


def incoming_news(s, p):
    return d.news(s, p).withColumn("seq", c("news_id")).withColumn(
        "url",
        F.when(c("lang") != "fr", F.concat(F.lit("http://x/"), (F.floor(c("news_id") / 2) * 2).cast("string"))),
    )


add(
    "insert_new_articles",
    lambda s, p: upsert.insert_news(
        d.news(s, p).filter(c("lang") == "en").select("news_id", "url", "content"),
        incoming_news(s, p).select("seq", "url", "content"),
    ),
    with_(
        NEWS,
        "old AS (SELECT news_id, url, content FROM news WHERE lang = 'en')",
        """inc AS (SELECT news_id AS seq, CASE WHEN lang <> 'fr' THEN 'http://x/' || (news_id // 2 * 2) ELSE '' END AS url, content FROM news)""",
        "one AS (SELECT url, min(seq) AS seq, arg_min(content, seq) AS content FROM inc GROUP BY url)",
        select="""SELECT * FROM old UNION ALL SELECT (SELECT max(news_id) FROM old) + row_number() OVER (ORDER BY seq), url, content
        FROM one WHERE url NOT IN (SELECT url FROM old)""",
    ),
)
add(
    "link_articles",
    lambda s, p: upsert.link_news(
        d.bridge(s, p),
        docs(s, p).select(c("doc_id").alias("news_id"), (c("doc_id") * 31 % d.company(s, p).agg(F.count("*")).scalar()).alias("company_id")),
    ),
    with_(BRIDGE, select="""SELECT news_id, company_id FROM bridge UNION SELECT doc_id, doc_id * 31 % (SELECT count(*) FROM supplier) FROM documents"""),
)
add(
    "cascade_links",
    lambda s, p: upsert.cascade(
        d.bridge(s, p), d.news(s, p).filter(c("lang") != "fr"), d.company(s, p).filter(c("s_acctbal") >= 0)
    ),
    with_(NEWS, COMPANY, BRIDGE, select="""SELECT news_id, company_id FROM bridge WHERE news_id IN (SELECT news_id FROM news
    WHERE lang <> 'fr') AND company_id IN (SELECT company_id FROM company WHERE s_acctbal >= 0)"""),
)


def sector_updates(s, p):
    return d.table(s, p, "nation").select(
        (c("n_nationkey") * 5).cast("string").alias("code"),
        c("n_name").alias("sector"),
        c("n_regionkey").alias("sector_id"),
    )


def evolved(s, p):
    base = d.company(s, p).select("company_id", "code", "name")
    return tables.ensure_columns(base, {"sector": sector.DEFAULT_SECTOR, "sector_id": sector.DEFAULT_SECTOR_ID})


UPD = "upd AS (SELECT CAST(n_nationkey * 5 AS VARCHAR) AS code, n_name, n_regionkey FROM nation)"
add(
    "add_missing_columns",
    evolved,
    with_(COMPANY, select="SELECT company_id, code, name, 'Diğer Sanayi' AS sector, 26 AS sector_id FROM company"),
)
add(
    "update_sectors",
    lambda s, p: upsert.update_by_key(evolved(s, p), sector_updates(s, p), "code"),
    with_(COMPANY, UPD, select="""SELECT company_id, code, name, coalesce(n_name, 'Diğer Sanayi') AS sector,
    coalesce(n_regionkey, 26) AS sector_id FROM company LEFT JOIN upd USING (code)"""),
)
add(
    "update_status",
    lambda s, p: upsert.update_status(evolved(s, p), sector_updates(s, p), "code").select("code", "status"),
    with_(COMPANY, UPD, select="""SELECT code, CASE WHEN code IN (SELECT code FROM company) THEN 'matched' ELSE 'unmatched' END
    AS status FROM upd"""),
)
add(
    "companies_without_sector",
    lambda s, p: companies.missing_sector(
        upsert.update_by_key(evolved(s, p), sector_updates(s, p), "code"), sector.DEFAULT_SECTOR
    ).select("code", "name"),
    with_(COMPANY, UPD, select="SELECT code, name FROM company WHERE code NOT IN (SELECT code FROM upd)"),
)
add(
    "company_lookup",
    lambda s, p: companies.company_id_of(d.company(s, p), "7"),
    with_(COMPANY, select="SELECT company_id FROM company WHERE code = '7'"),
)
add("company_codes", lambda s, p: companies.codes(d.company(s, p)), with_(COMPANY, select="SELECT code FROM company"))
SF = {"sector": None, "count": None, "share": 6}
add(
    "sector_frequencies",
    lambda s, p: rounds(
        explore.frequencies(docs(s, p).select(sector.fuzzy_sector(c("text")).alias("sector")), "sector"), SF
    ),
    f"""WITH x AS (SELECT {sector_sql()} AS sector FROM documents) SELECT {rounded(SF)} FROM
    (SELECT sector, count(*) AS "count", count(*) / sum(count(*)) OVER () AS share FROM x GROUP BY sector)""",
)


def stored_texts(s, p):
    return docs(s, p).select(
        c("doc_id").alias("seq"),
        (c("doc_id") % 2).cast("string").alias("news_date"),
        c("lang").alias("provider"),
        c("text").alias("content"),
    )


def with_endings(s, p):
    """The texts, then the last 40 characters of each as an article of its own."""
    base = stored_texts(s, p)
    tails = base.filter(F.length("content") > 40).withColumns(
        {"content": F.substring(c("content"), -40, 40), "seq": c("seq") + 1_000_000_000}
    )
    return base.unionByName(tails)


add(
    "new_texts_only",
    lambda s, p: upsert.drop_stored_texts(with_endings(s, p)),
    """WITH a AS (SELECT doc_id AS seq, CAST(doc_id % 2 AS VARCHAR) AS news_date, lang AS provider, text AS content FROM documents
    UNION ALL SELECT doc_id + 1000000000, CAST(doc_id % 2 AS VARCHAR), lang, right(text, 40) FROM documents WHERE length(text) > 40)
    SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.news_date = a.news_date AND b.provider = a.provider
    AND b.seq < a.seq AND suffix(b.content, a.content))""",
)


def folder(spark, name):
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_articles(s, p):
    path = folder(s, "articles")
    store.write_articles(d.news(s, p).select("news_id", "url", "news_date", "provider", "content"), path)
    return store.read_articles(s, path).select(
        "news_id", "url", c("news_date").cast("date").alias("news_date"), "provider", "content"
    )


add("stored_articles", stored_articles, with_(NEWS, select="SELECT news_id, url, news_date, provider, content FROM news"))


def macro_cache(s, p):
    path = folder(s, "macro")
    tables.write_cache(d.macro_long(s, p, "o_orderstatus").select("series", "date"), path)
    return tables.read_cache(s, path)


add(
    "macro_cache",
    macro_cache,
    "SELECT DISTINCT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS date FROM orders",
)


def labelled_file(s, p):
    path = folder(s, "labelled")
    rows = docs(s, p).join(d.table(s, p, "labels"), "doc_id").select("text", c("quality").cast("string").alias("label"))
    store.write_labelled(rows, path)
    return s.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


add(
    "labelled_csv",
    labelled_file,
    "SELECT text, CAST(quality AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id)",
)
