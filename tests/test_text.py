"""Text, score, sector, page and similarity functions on hand rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import html, jaro, scores, sector, text
from tickerloom.operators import sentiment
from tickerloom.sources import macro

c = F.col


def values(spark, column, *inputs, schema="x string"):
    df = spark.createDataFrame([(i,) if not isinstance(i, tuple) else i for i in inputs], schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


def test_company_names(spark):
    assert values(spark, text.clean_company_name(c("x")), "VESTEL A.Ş.", "Türk Hava Yolları A.Ş.", " sise  cam san. ") == [
        "STEL", "TÜRK HAVA YOLLARI", "SISE CAM",
    ]
    assert values(spark, text.clean_company_name(c("x"), word_boundary=True), "VESTEL A.Ş.") == ["VESTEL"]


def test_sentences(spark):
    assert values(spark, text.sentences(c("x"), 1), "a 3.5 b. c") == [["a 3.5 b", "c"]]
    assert values(spark, text.scored_sentences(c("x")), "short one.\n this sentence is long enough  . ab") == [
        ["this sentence is long enough"]
    ]


def test_sentences_like_regex(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 19..\n \x1c") for _ in range(60)) for _ in range(200)]
    want = [
        [s.strip() for s in re.split(r"(?<![0-9])\.(?![0-9])|\n", t) if s and len(s.strip()) > 2] for t in texts
    ]
    assert values(spark, text.sentences(c("x")), *texts) == want


def test_provider(spark):
    texts = ["abcdef.com", "see www.kap.com now", "no mark", "www.averyveryverylongname.com", ".com www.x"]
    assert values(spark, text.provider(c("x")), *texts) == ["def", "kap", "undetermined", "undetermined", "undetermined"]
    assert values(spark, text.provider(c("x"), strict=True), "abcdef.com") == ["undetermined"]
    assert values(spark, text.provider_or_id(F.lit("undetermined"), c("x")), "The-Block. Co", "x" * 21) == [
        "theblockco", "undetermined",
    ]


def test_dates(spark):
    inputs = [
        "Sun, 01 Mar 2026 11:24:00 GMT", "2026-03-01T11:24:00.123Z", "2026-03-01T11:24:00Z", "2026-03-01T11:24:00",
        "yesterday", None,
    ]
    got = values(spark, text.news_date(c("x"), F.lit("2000-01-01").cast("date")), *[(i,) for i in inputs])
    assert got == [dt.date(2026, 3, 1)] * 4 + [dt.date(2000, 1, 1)] * 2
    day = F.lit("2000-01-01").cast("date")
    label = text.date_label(text.epoch_date(c("x"), day, "Europe/Istanbul"))
    assert values(spark, label, 1772398800, 0, schema="x bigint") == ["2026.03.02", "2000.01.01"]


def test_scores(spark):
    got = values(spark, scores.score_class(c("x")), 0.16, 0.15, 0.05, -0.05, -0.16, schema="x double")
    assert got == [2, 1, 0, 0, -2]
    got = values(spark, scores.signal(c("x")), 0.65, 0.55, 0.5, 0.45, 0.35, schema="x double")
    assert got == [2, 1, 0, -1, -2]


def test_all_neutral_article_scores_zero(spark):
    rows = [(1, "LABEL_1", 0.9), (1, "LABEL_1", 0.8), (2, "LABEL_2", 0.6), (2, "LABEL_0", 0.2), (2, "LABEL_1", 0.9)]
    got = sentiment.article_scores(spark.createDataFrame(rows, "news_id long, label string, score double"))
    assert {r.news_id: (round(r.news_ratio, 9), r.news_type) for r in got.collect()} == {1: (0.0, 0), 2: (0.2, 2)}


def test_external_scorer_runs_per_batch(spark):
    def load():
        return lambda lines: (["LABEL_2" if "good" in s else "LABEL_0" for s in lines], [0.5] * len(lines))

    rows = spark.createDataFrame([(1, 0, "good news"), (1, 1, "bad")], "news_id long, pos int, sentence string")
    got = sentiment.udf_scorer(load)(rows).orderBy("pos").collect()
    assert [r.label for r in got] == ["LABEL_2", "LABEL_0"]


def test_sectors(spark):
    got = values(spark, sector.fuzzy_sector(c("x")), "BANKA ve kredi", "Teknoloji & Yazılım hizmeti", "cam", "xyz", "")
    assert got == ["Bankacılık", "Teknoloji & Yazılım", "Cam", "Diğer Sanayi", "Bankacılık"]
    assert values(spark, sector.sector_id(c("x")), "Kimya", "nope") == [25, 26]
    replies = [
        '```json\n[{"code": "A", "sector": "Kimya"}]\n```',
        '{"n": 1, "list": [{"code": "B", "sector": "demir işleri"}]}',
        '[{"code": "C"}]',
        "sorry",
    ]
    got = values(spark, sector.reply_items(c("x")), *replies)
    assert [None if g is None else [tuple(i) for i in g] for g in got] == [
        [("A", "Kimya")], [("B", "Demir Çelik & Metal")], [("C", "Diğer Sanayi")], None,
    ]


PAGE = """<html><head><meta property="og:title" content="Meta title"><meta property="og:description" content="Meta body">
<script type="application/ld+json">{"dateCreated": "2026-03-01T10:00:00Z"}</script></head><body>
<div class="x title-a block-b"> The <b>title</b> </div>
<div class="body-c content-d"><p>One &amp; two</p><div>three<script>var a;</script></div></div>
<div class="grid-z"><a href="/news/1/">a</a><a href="/other">b</a><a href="/news/1/">c</a></div>
<a href="/news/2/">outside</a></body></html>"""


def test_page_fields_and_fallbacks():
    assert html.article_fields(PAGE) == ("Thetitle", "One & two\nthree", "2026-03-01T10:00:00Z")
    bare = PAGE.replace("title-a", "t").replace("body-c", "b")
    assert html.article_fields(bare)[:2] == ("Meta title", "Meta body")
    timed = PAGE.replace("<body>", '<body><time></time><relative-time event-time="2025-01-01T00:00:00Z"></relative-time>')
    assert html.article_fields(timed)[2] == "2025-01-01T00:00:00Z"
    assert html.article_fields("<p>nothing</p>") == (None, "", None)


def test_page_columns(spark):
    got = values(spark, html.article_text(html.article(c("x"))), PAGE, "<p>none</p>")
    assert got == ["Thetitle\nOne & two\nthree", None]
    links = html.links(c("x"), "http://s")
    assert values(spark, links, PAGE, PAGE.replace("grid-z", "g")) == [
        ["http://s/news/1/"], ["http://s/news/1/", "http://s/news/2/"],
    ]


def test_links_inside_the_grid(spark):
    """Nested divs, quotes, entities, scripts and comments, a grid that does not end, and no page."""
    pages = [
        "<div class='grid-a'><div><A HREF=\"/news/1\">x</A></div><div class=grid-b><a href=/news/2>y</a></div></div><a href='/news/3'>z</a>",
        '<div class="grid-a"></div><a href="/news/1">x</a>',
        '<!-- <div class="grid-a"> --><script>"<a href=\'/news/9\'>"</script><a class="b" href="/news/?a=1&amp;b=2">x</a><a>none</a>',
        '<div class="x grid-a"><a href="/news/1">x</a></div><div class="grid-a"><a href="/news/4">x</a>',
        "", None,
    ]
    assert values(spark, html.links(c("x"), "s"), *pages) == [["s/news/1", "s/news/2"], [], ["s/news/?a=1&b=2"], ["s/news/4"], [], []]
    plan = spark.createDataFrame([("",)], "x string").select(html.links(c("x"), "s"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_jaro_winkler(a, b):
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, seq_a = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                seq_a.append(ch)
                break
    m = len(seq_a)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(seq_a, [ch for ch, u in zip(b, used) if u])) // 2
    s = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return s + min(p, 4) * 0.1 * (1 - s) if s > 0.7 else s


def test_similarity_of_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ABCÇĞ 😀") for _ in range(rng.randint(1, 12)))
    pairs = [(word(), word()) for _ in range(3000)] + [("MARTHA", "MARHTA"), ("DIXON", "DICKSONX")]
    got = jaro.similarity(*zip(*pairs))
    for (a, b), s in zip(pairs, got):
        assert s == pytest.approx(plain_jaro_winkler(a, b), abs=1e-12)
    assert values(spark, jaro.jaro_winkler(c("a"), c("b")), ("MARTHA", "MARHTA"), ("", "A"), (None, "A"), schema="a string, b string") == [
        pytest.approx(0.961111, abs=1e-6), 0.0, 0.0,
    ]


def test_macro_replies(spark):
    raw = spark.createDataFrame(
        [('{"items": [{"Tarih": "31-01-2020", "A": "1.5", "B": "ND", "C": null}, {"Tarih": "bad", "A": 2}]}',),
         ('{"items": [{"Tarih": "2020-3", "A": "NaN", "B": null, "C": null}]}',)],
        "json string",
    )
    got = macro.parse_macro(raw, ["A", "B", "C"], {"A": "a"})
    assert got.columns == ["date", "a"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(dt.date(2020, 1, 31), 1.5), (None, 2.0), (dt.date(2020, 3, 1), None)], key=str
    )


def test_percent_rounds_halves_to_even_and_keeps_nulls(spark):
    got = values(spark, text.percent(c("x")), 0.03125, 0.09375, 0.1234, 12.5, 0.0, None, schema="x double")
    assert got == ["%3.12", "%9.38", "%12.34", "%1250.00", "%0.00", None]
