"""Matching, stored tables and the article pipeline against brute force."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import plain_jaro_winkler

from tickerloom.functions import jaro
from tickerloom.operators import matching, ranks, sentiment, upsert
from tickerloom.plans import news as plan
from tickerloom.sources import articles as store
from tickerloom.sources import company as companies
from tickerloom.sources import headlines, tables
from tickerloom.streaming import news as stream

c = F.col
SUFFIXES = ["A\\.Ş\\.?", "A\\.S\\.?", "LTD\\.?", "ŞTİ\\.?", "TİC\\.?", "SAN\\.?", "VE", "İŞL\\.?", "PAZ\\.?"]


def clean(name):
    name = name.upper()
    for s in SUFFIXES:
        name = re.sub(s, "", name)
    return re.sub(r"\s+", " ", name).strip()


def brute_matches(texts, listed, threshold=0.88):
    out = set()
    for i, t in texts:
        exact = {k for k, _ in listed if re.search(r"\b" + re.escape(k.strip().upper()) + r"\b", t)}
        out |= {(i, k, "exact_kod", None) for k in exact}
        tokens = t.upper().split()
        for k, name in listed:
            needle = clean(name)
            words = needle.split()
            if k in exact or not words or (len(words) == 1 and len(words[0]) < 5):
                continue
            runs = [" ".join(tokens[j : j + len(words)]) for j in range(len(tokens) - len(words) + 1)]
            best = max([plain_jaro_winkler(needle, r) for r in runs], default=0)
            if best >= threshold:
                out.add((i, k, "fuzzy_name", round(best, 4)))
    return out


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["TURK", "HAVA", "YOLLARI", "SİŞE", "CAM", "Koç", "holding", "a.b", "ÇELİK", "THYAO", "ANADOLU", "grubu"]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w[:i] + w[i + 1 :] or w, w[:i] + "X" + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])

    listed = [("THYAO", "Türk Hava Yolları A.Ş."), ("A.B", "ANADOLU GRUBU"), ("KOÇ", "Koç Holding"), ("xs", "ABCD")]
    listed += [(f"C{i}", " ".join(rng.sample(vocabulary, rng.randint(1, 3)))) for i in range(12)]
    texts = [(i, " ".join(typo(rng.choice(vocabulary)) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    texts += [(100, "x A.B, y"), (101, "thyao"), (102, "THYAOX KOÇ"), (103, "TÜRK HAVA YOLLARI")]
    return texts, listed


def test_matching_equals_brute_force(spark):
    texts, listed = random_case(3)
    articles = spark.createDataFrame(texts, "news_id long, content string").repartition(4)
    listing = spark.createDataFrame(listed, "code string, name string")
    got = matching.match_articles(articles, listing).collect()
    assert {(r.news_id, r.code, r.match_type, r.score) for r in got} == brute_matches(texts, listed)
    assert len(got) == len({(r.news_id, r.code) for r in got})


def test_bound_loses_no_pair(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ABCDE ") for _ in range(rng.randint(3, 12)))
    pairs = [(w, "".join(rng.sample(w, len(w))) if i % 3 else w[1:] + "Z") for i, w in enumerate(word() for _ in range(3000))]
    df = spark.createDataFrame(pairs, "cleaned_name string, shingle string").withColumns(
        {
            "_mask": matching.letters(c("cleaned_name")), "_smask": matching.letters(c("shingle")),
            "_len": F.length("cleaned_name"), "_slen": F.length("shingle"),
        }
    )
    kept = {(r[0], r[1]) for r in df.filter(matching.possible(0.88)).select("cleaned_name", "shingle").collect()}
    hits = {p for p in pairs if plain_jaro_winkler(*p) >= 0.88}
    assert hits and hits <= kept and len(kept) < len(set(pairs))


def test_matching_plan_has_no_cross_join(spark, tmp_path):
    texts, listed = random_case(6)
    spark.createDataFrame(texts, "news_id long, content string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(listed, "code string, name string").write.parquet(str(tmp_path / "c"))
    articles, listing = (spark.read.parquet(str(tmp_path / n)) for n in "ac")
    for df in (matching.exact_matches(articles, listing), matching.fuzzy_matches(articles, listing)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text and "BroadcastHashJoin" in text


def test_order_of_matches(spark):
    rows = [(1, "B", "fuzzy_name", 0.9), (1, "A", "fuzzy_name", 0.95), (1, "Z", "exact_kod", None)]
    got = matching.ordered_matches(spark.createDataFrame(rows, "news_id int, code string, match_type string, score double"))
    assert [r.code for r in got.orderBy("rank").collect()] == ["Z", "A", "B"]


# -- stored tables -----------------------------------------------------------------------

COMPANY = "company_id bigint, code string, name string"


def test_company_upsert_keeps_ids_and_is_idempotent(spark):
    stored = spark.createDataFrame([(4, "A", "old"), (9, "B", "b")], COMPANY)
    incoming = spark.createDataFrame([(1, "N2", "x"), (2, "A", "mid"), (3, "A", "new"), (4, "N1", "y")], "seq int, code string, name string")
    once = upsert.upsert_company(stored, incoming)
    want = {(4, "A", "new"), (9, "B", "b"), (10, "N2", "x"), (11, "N1", "y")}
    assert set(map(tuple, once.collect())) == want
    assert set(map(tuple, upsert.upsert_company(once, incoming).collect())) == want


def test_number_rows_is_dense_and_ordered(spark):
    rows = spark.range(0, 5000).select((c("id") * 7919 % 100003).alias("seq")).repartition(7)
    got = ranks.number_rows(rows, "n", start=10).orderBy("seq").collect()
    assert [r.n for r in got] == list(range(11, 5011))


def test_ingest_stream_runs_the_article_pipeline(spark, tmp_path):
    day = dt.date(2024, 1, 5)
    schema = "seq int, url string, news_date date, provider string, content string"
    line = "One long enough sentence about {} in the market."
    files = [
        [(1, "u1", day, "p", line.format("AAA")), (2, "u2", day, "p", line.format("nobody")), (3, "u1", day, "q", line.format("BBB"))],
        [(4, "u4", day, "p", line.format("AAA")), (5, "u5", day, "p", line.format("BBB AAA")), (6, "u6", dt.date(2023, 1, 1), "p", line.format("CCC"))],
        [(7, "u1", day, "r", line.format("CCC")), (8, None, day, "p", line.format("CCC AAA"))],
    ]
    companies_ = spark.createDataFrame([("BBB", "Bbb"), ("AAA", "Aaa"), ("CCC", "Ccc")], "code string, name string")
    plain = lambda df: df.withColumns({"label": F.lit("LABEL_2"), "score": F.lit(0.5)})
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.article_stream(spark, str(tmp_path / "in"), schema, 1)
        write = plan.ingest(str(tmp_path / "out"), companies_, plain, dt.date(2024, 1, 10), F.lit("2024-01-10").cast("timestamp"))
        stream.start_ingest(source, write, str(tmp_path / "state"), every=None).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/news"))
    # u2 matches nobody, u4's text is stored, u6 is too old, the second u1 and the third u1 are known urls.
    assert {(r.news_id, r.url, r.news_ratio) for r in got.collect()} == {(1, "u1", 0.5), (2, "u5", 0.5), (3, "", 0.5)}
    ids = {r.code: r.company_id for r in spark.read.parquet(str(tmp_path / "out/company")).filter("batch = 2").collect()}
    assert ids == {"AAA": 1, "BBB": 2, "CCC": 3}
    links = {(r.news_id, r.company_id) for r in spark.read.parquet(str(tmp_path / "out/links")).collect()}
    assert links == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 3)}
    # A repeated batch replaces itself.
    write(spark.createDataFrame(files[2], schema), 2)
    assert spark.read.parquet(str(tmp_path / "out/news")).count() == 3


def test_ids_do_not_depend_on_the_spread(spark):
    rows = [(i // 7, f"C{i * 37 % 100:03d}", f"n{i}") for i in range(100)]
    stored = spark.createDataFrame([(4, "C001", "old")], COMPANY)
    incoming = spark.createDataFrame(rows, "seq int, code string, name string")
    results = []
    for parts in (3, 8, 13):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(tuple, upsert.upsert_company(stored, incoming.repartition(parts)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] == results[2]
    order = [r[1] for r in results[0] if r[0] > 4]
    first = {code: seq for seq, code, _ in rows}
    assert order == sorted(order, key=lambda code: (first[code], code)) and [r[0] for r in results[0]] == list(range(4, 104))


def test_buckets_keep_the_order(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 2.0, -1.0, 1e-300, -1e300, 2.0**53] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(3000)]
    values += [float(v) for v in range(1, 3000)] + [2.0**k - d for k in range(1, 40) for d in (0, 2.0**-13, 1e-9)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = sorted((r.x, r.b) for r in df.select("x", ranks.bucket(c("x")).alias("b")).collect())
    assert [b for _, b in got] == sorted(b for _, b in got)


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    news = spark.createDataFrame([(5, "u1")], "news_id bigint, url string")
    batch = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u2")], "seq int, url string")
    tables.append_rows(news, str(tmp_path / "news"))
    fresh = upsert.new_news(spark.read.parquet(str(tmp_path / "news")), batch)
    assert [tuple(r) for r in fresh.select("news_id", "url").collect()] == [(6, "u2")]
    tables.append_rows(fresh.select("news_id", "url"), str(tmp_path / "news"))
    assert spark.read.parquet(str(tmp_path / "news")).count() == 2
    links = spark.createDataFrame([(1, 1)], "news_id bigint, company_id bigint")
    more = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "news_id bigint, company_id bigint")
    assert [tuple(r) for r in upsert.new_links(links, more).collect()] == [(1, 2)]
    days = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    schema = "company_id bigint, signal int, probability double, model_version string, model_auc double, created_at timestamp, prediction_date date"
    stored = spark.createDataFrame([(k, 0, 0.5, "v", None, dt.datetime(2024, 1, 1), day) for day in days for k in (1, 2)], schema)
    path = str(tmp_path / "predictions")
    stored.write.partitionBy("prediction_date").parquet(path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "predictions").glob("*/part-*")}
    incoming = spark.createDataFrame([(1, "A", days[1], 2, 0.7, "v", 0.6)], "seq int, code string, prediction_date date, signal int, probability double, model_version string, model_auc double")
    company = spark.createDataFrame([(1, "A", "a")], COMPANY)
    table = spark.read.parquet(path)
    changed = upsert.changed_predictions(table, incoming, company, F.lit("2024-01-05").cast("timestamp"))
    tables.replace_partitions(changed, path, "prediction_date")
    got = {(r.company_id, r.prediction_date): r.signal for r in spark.read.parquet(path).collect()}
    assert got == {(k, day): 2 if (k, day) == (1, days[1]) else 0 for day in days for k in (1, 2)}
    kept = {f for f in before if f.exists() and f.stat().st_mtime_ns == before[f]}
    assert kept == {f for f in before if "2024-01-02" not in str(f)}


def test_duplicate_and_missing_urls(spark):
    stored = spark.createDataFrame([(5, "u1", "kept")], "news_id bigint, url string, content string")
    rows = [(1, "u1", "dup"), (2, "u2", "first"), (3, "u2", "second"), (4, None, "empty"), (5, "", "empty2")]
    got = upsert.insert_news(stored, spark.createDataFrame(rows, "seq int, url string, content string"))
    assert set(map(tuple, got.collect())) == {(5, "u1", "kept"), (6, "u2", "first"), (7, "", "empty")}
    again = upsert.insert_news(got, spark.createDataFrame(rows, "seq int, url string, content string"))
    assert again.count() == 3


def test_prediction_upsert(spark):
    schema = (
        "company_id bigint, prediction_date date, signal int, probability double, model_version string, "
        "model_auc double, created_at timestamp"
    )
    day, old = dt.date(2024, 1, 2), dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([(1, day, 0, 0.5, "nn_v1", None, old)], schema)
    rows = [(1, "A", day, 1, 0.6, "nn_v1", 0.7), (2, "A", day, 2, 0.7, "nn_v1", 0.7), (3, "?", day, 2, 0.7, "nn_v1", 0.7)]
    incoming = spark.createDataFrame(
        rows, "seq int, code string, prediction_date date, signal int, probability double, model_version string, model_auc double"
    )
    company = spark.createDataFrame([(1, "A", "a")], COMPANY)
    got = upsert.upsert_prediction(stored, incoming, company, F.lit("2024-01-05").cast("timestamp")).collect()
    assert [(r.signal, r.probability, r.created_at) for r in got] == [(2, 0.7, dt.datetime(2024, 1, 5))]


def test_stored_texts_like_a_growing_file(spark):
    rng = random.Random(7)
    rows, line = [], "\n" + "_" * 50 + "\n"
    for i in range(400):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        rows.append((i, "d", rng.choice("pq"), text))
    files, kept = {"p": "", "q": ""}, []
    for i, _, p, t in rows:
        if t + line not in files[p]:
            files[p] += t + line
            kept.append(i)
    df = spark.createDataFrame(rows, "seq int, news_date string, provider string, content string").repartition(3)
    assert sorted(r.seq for r in upsert.drop_stored_texts(df).collect()) == kept


def test_article_folders_and_text_files(spark, tmp_path):
    rows = [(i, f"u{i}", dt.date(2024, 1, 1 + i % 2), f"p{i % 3}", f"line {i}\nnext") for i in range(30)]
    df = spark.createDataFrame(rows, "news_id long, url string, news_date date, provider string, content string")
    store.write_articles(df, str(tmp_path / "s"))
    back = store.read_articles(spark, str(tmp_path / "s")).select(df.columns)
    assert back.exceptAll(df).isEmpty() and back.count() == 30
    (tmp_path / "f.txt").write_text("one\n" + "_" * 50 + "\ntwo\n" + "_" * 50 + "\n")
    parts = store.split_files(store.read_text_files(spark, str(tmp_path / "f.txt"))).orderBy("pos").collect()
    assert [r.content.strip() for r in parts] == ["one", "two", ""]


def test_company_list_and_tables(spark, tmp_path):
    (tmp_path / "list.csv").write_text("note,,\n,,\nNo,Kod,Şirket Ünvanı\n1,AAA,Aaa A.Ş.\n2,HEDEF,Hedef\n3,BBB,\n")
    got = companies.read_company_list(spark, str(tmp_path / "list.csv")).collect()
    assert [tuple(r) for r in got] == [("AAA", "Aaa A.Ş.")]
    assert tables.read_cache(spark, str(tmp_path / "none")) is None
    path = tables.replace_table(spark.range(3), str(tmp_path / "t"), "1")
    assert spark.read.parquet(path).count() == 3


def test_headline_files(spark, tmp_path):
    (tmp_path / "h.json").write_text(
        '{"items": [{"id": "1", "title": "T", "provider": "p", "published": 0, "storyPath": "/news/1/"}, {"id": "2", "title": "x"}]}'
    )
    got = headlines.headline_rows(headlines.read_headlines(spark, str(tmp_path / "h.json")), F.lit("2024-01-02").cast("date"))
    assert [(r.url, r.provider, r.date_label, r.link) for r in got.collect()] == [
        ("https://tr.tradingview.com/news/1/", "p", "2024.01.02", "")
    ]


def test_extracted_articles(spark):
    page = '<div class="title-a block-b">Head</div><div class="body-a content-b">Text www.kap.com</div><time datetime="2024-01-05T08:00:00Z"></time>'
    rows = [(1, "u1", "t1", "src", "pid", "2024.01.04", "", page), (2, "u2", "t2", "Src", "A.B-c", "2024.01.04", "l", "<p></p>")]
    df = spark.createDataFrame(
        rows, "seq int, url string, title string, provider string, provider_id string, date_label string, link string, html string"
    )
    got = plan.extract_articles(df, F.lit("2024-02-01").cast("date")).orderBy("seq").collect()
    assert [(r.news_date, r.provider, r.content) for r in got] == [
        (dt.date(2024, 1, 5), "kap", "Head\nText www.kap.com"),
        (dt.date(2024, 1, 4), "abc", "t2\nKaynak: Src\nLink: l"),
    ]


def scorer(sentences):
    good = c("sentence").contains("good")
    return sentences.withColumns({"label": F.when(good, "LABEL_2").otherwise("LABEL_0"), "score": F.lit(0.5)})


def test_article_pipeline(spark, tmp_path):
    day = dt.date(2024, 1, 20)
    rows = [
        (1, "u1", day, "p", "AAA has good news for all"),
        (2, "u1", day, "p", "BBB same url, dropped with its links"),
        (3, "u3", day, "p", "nobody is named in this text"),
        (4, "u4", dt.date(2024, 1, 9), "p", "AAA too old for this run of news"),
        (5, "u5", dt.date(2024, 1, 10), "p", "AAA and CCC in a rather bad mood"),
    ]
    articles = spark.createDataFrame(rows, "seq long, url string, news_date date, provider string, content string")
    listing = spark.createDataFrame([("AAA", "Aaaaa"), ("BBB", "Bbbbb"), ("CCC", "Ccccc")], "code string, name string")
    empty = plan.Store(
        spark.createDataFrame([], COMPANY),
        spark.createDataFrame([], "news_id bigint, url string, news_date date, news_type int, news_ratio double"),
        spark.createDataFrame([], "news_id bigint, company_id bigint"),
    )
    out = plan.process_news(articles, listing, scorer, empty, day, F.lit("2024-01-20").cast("timestamp"), str(tmp_path))
    assert {(r.url, r.news_type, r.news_ratio) for r in out.news.collect()} == {("u1", 2, 0.5), ("u5", -2, -0.5)}
    linked = out.news.join(out.bridge, "news_id").join(out.company, "company_id")
    assert {(r.url, r.code) for r in linked.collect()} == {("u1", "AAA"), ("u5", "AAA"), ("u5", "CCC")}


def test_weekend_news_is_not_on_bars(spark, make_bars):
    bars = make_bars([1, 2])
    daily = spark.createDataFrame(
        [("A", dt.date(2020, 1, 1), 0.4, 2), ("A", dt.date(2020, 1, 5), 0.9, 1)],
        "symbol string, date date, avg_sentiment double, news_count long",
    )
    got = sentiment.add_sentiment(bars, daily).orderBy("date").collect()
    assert [(r.avg_sentiment, r.news_count, r.sentiment_7d) for r in got] == [(0.4, 2, 0.0), (0.0, 0, 0.0)]


def test_fuzzy_matching_shuffles_no_word_runs(spark, tmp_path):
    """What is shuffled is an article once, the names once a group, and matches; it grew with all runs of all words."""
    texts, listed = random_case(6)
    spark.createDataFrame(texts, "news_id long, content string").write.parquet(str(tmp_path / "a"))
    articles = spark.read.parquet(str(tmp_path / "a"))
    plan = matching.fuzzy_matches(articles, spark.createDataFrame(listed, "code string, name string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" in plan and "shingle" not in plan and plan.count("Generate") == 1


def test_fuzzy_matching_of_many_groups_and_odd_rows(spark, monkeypatch):
    """Repeated ids, null and empty texts, names that clean to the same, no name, no article."""
    monkeypatch.setattr(matching, "GROUP", 3)
    texts, listed = random_case(8)
    listed = [*listed, ("TWIN", "KOÇ HOLDİNG A.Ş."), ("TWIN2", "KOÇ HOLDİNG")]
    rows = [*texts, (200, None), (201, ""), (202, "KOÇ  HOLDİNGX"), (202, "a KOÇ HOLDİNG b")]
    articles = spark.createDataFrame(rows, "news_id long, content string")
    listing = spark.createDataFrame(listed, "code string, name string")
    got = {(r.news_id, r.code): r.score for r in matching.fuzzy_matches(articles, listing).collect()}
    assert got[202, "TWIN"] == got[202, "TWIN2"] == 1.0 and not {200, 201} & {i for i, _ in got}
    exact = matching.exact_matches(articles.filter("news_id < 200"), listing)
    some = matching.fuzzy_matches(articles.filter("news_id < 200"), listing, exclude=exact).collect()
    assert {(r.news_id, r.code, r.score) for r in some} == {(i, k, s) for i, k, kind, s in brute_matches(texts, listed) if kind == "fuzzy_name"}
    assert matching.fuzzy_matches(articles.limit(0), listing).count() == matching.fuzzy_matches(articles, listing.limit(0)).count() == 0


def test_matches_are_not_sent_to_the_driver(spark, tmp_path):
    """A million matches are files of some kilobytes, far below the limit for a broadcast."""
    spark.range(1_000_000).select((F.col("id") % 5).alias("news_id"), F.lit("A").alias("code")).write.parquet(str(tmp_path / "m"))
    spark.range(10).select(F.col("id").alias("news_id")).write.parquet(str(tmp_path / "a"))
    articles, matches = (spark.read.parquet(str(tmp_path / n)) for n in "am")
    kept = plan.with_matches(articles, matches)
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 5


def test_bounds_from_words_lose_no_run():
    """Runs are bounded by the characters of their words; odd letters, many equal ones, short first words, three words."""
    rng = np.random.default_rng(12)
    known = ["A", "AB", "ABBBBBBBC", "ÇELİK", "ÇELIK", "XXXXXXXXX", "XXXXXXX", "HOLDING", "HOLDİNG", "T", "T\U0001f600T", "ABABABABAB", "ZORLU"]
    for n, count in ((1, 13), (2, 150), (3, 400)):
        ids = [np.arange(13)] if n == 1 else list(rng.integers(0, 13, (n, count)))
        texts = [" ".join(known[i] for i in row) for row in zip(*ids)]
        names = list(dict.fromkeys(texts))[::3] + [x[:-1] + "Q" for x in texts[::7] if len(x) > 1]
        runs = matching._Runs(np.array(ids), known, matching._planes(known), matching._starts(known))
        for threshold in (0.7, 0.88):
            got = {(int(a), int(b)): s for a, b, s in zip(*matching._close_pairs(names, runs, threshold))}
            want = {}
            for k, name in enumerate(names):
                for i, s in enumerate(jaro.similarity([name] * len(texts), texts)):
                    if s >= threshold:
                        want[k, i] = s
            assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)
