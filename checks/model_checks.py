"""Queries over predictions: scaling, splits, scores, models, trades, streams."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks import datasets as d
from checks.market import TARGET, keyed, rounds
from checks.news_sql import ARTICLE, COMPANY, EXACT, FUZZY, LABELLED, LISTED, SENTENCES, upper
from checks.sqltools import BARS, rounded, with_
from tickerloom.functions import numeric, scores
from tickerloom.operators import evaluation, explore, indicators, ledger, models, sentiment, upsert
from tickerloom.plans import features, news, trading
from tickerloom.session import use_checkpoint_dir
from tickerloom.sources import tables
from tickerloom.streaming import news as stream

QUERIES, ORACLES = {}, {}
c = F.col
DAY = dt.date(2000, 6, 30)
DAY_SQL = "DATE '2000-06-30'"


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def folder(spark, name):
    return f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- scaling, splits, scores -----------------------------------------------------------

Z = keyed("close", "volume", k=5)


def zsql(n):
    w = "OVER (PARTITION BY symbol)"
    return f"({n} - avg({n}) {w}) / CASE WHEN stddev_pop({n}) {w} = 0 THEN 1 ELSE stddev_pop({n}) {w} END AS {n}"


add(
    "standardised_features",
    lambda s, p: rounds(evaluation.standardize(d.bars(s, p).select("symbol", "date", "close", "volume"), ["close", "volume"]), Z),
    with_(BARS, f"x AS (SELECT symbol, date, {zsql('close')}, {zsql('volume')} FROM bars)", select=f"SELECT {rounded(Z)} FROM x"),
)
LAB = f"lab AS (SELECT *, {TARGET} AS target FROM bars)"


def labelled(s, p):
    return indicators.add_target(d.bars(s, p)).withColumns(
        {
            "score": (c("close") - c("open")) / c("open"),
            "pred": (c("close") > c("open")).cast("int"),
        }
    )


LAB2 = f"lab AS (SELECT *, {TARGET} AS target, (close - open) / open AS score, CAST(close > open AS INTEGER) AS pred FROM bars)"
add(
    "stratified_split",
    lambda s, p: evaluation.stratified_split(labelled(s, p), ["symbol", "date"]).select("symbol", "date", "target", "is_valid"),
    with_(BARS, LAB, select="""SELECT symbol, date, target, row_number() OVER (PARTITION BY symbol, target
    ORDER BY md5(symbol || '|' || CAST(date AS VARCHAR) || '|42'), symbol, date)
    <= round(count(*) OVER (PARTITION BY symbol, target) * 0.1::DOUBLE) AS is_valid FROM lab"""),
)
add(
    "time_split",
    lambda s, p: evaluation.time_split(d.bars(s, p)).select("symbol", "date", "is_valid"),
    with_(BARS, select="""SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC)
    <= round(count(*) OVER (PARTITION BY symbol) * 0.1::DOUBLE) AS is_valid FROM bars"""),
)
CW = {"symbol": None, "pos_weight": 6}
add(
    "class_weights",
    lambda s, p: rounds(evaluation.class_weight(labelled(s, p)), CW),
    with_(BARS, LAB, select=f"""SELECT {rounded(CW)} FROM (SELECT symbol, count(*) FILTER (WHERE target = 0)
    / greatest(count(*) FILTER (WHERE target = 1), 1) AS pos_weight FROM lab GROUP BY symbol)"""),
)


def auc_sql(by):
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return (
        f"""r AS (SELECT {keys}target, rank() OVER ({part} ORDER BY score)
        + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2 AS rk FROM lab),
        a AS (SELECT {keys}sum(rk) FILTER (WHERE target = 1) AS r1, count(*) FILTER (WHERE target = 1) AS n_pos,
        count(*) FILTER (WHERE target = 0) AS n_neg FROM r {"GROUP BY " + by if by else ""})""",
        f"""SELECT {keys}n_pos, n_neg, round(coalesce((r1 - n_pos * (n_pos + 1) / 2) / nullif(n_pos * n_neg, 0), 0.5), 6) + 0.0 AS auc FROM a""",
    )


for _by in ("symbol", ""):
    _cte, _sel = auc_sql(_by)
    add(
        "roc_auc_per_symbol" if _by else "roc_auc_overall",
        lambda s, p, by=_by: rounds(
            evaluation.roc_auc(labelled(s, p), "target", "score", [by] if by else None),
            {**({by: None} if by else {}), "n_pos": None, "n_neg": None, "auc": 6},
        ),
        with_(BARS, LAB2, _cte, select=_sel),
    )
add(
    "confusion_matrix",
    lambda s, p: evaluation.confusion(labelled(s, p), "target", "pred"),
    with_(BARS, LAB2, select='SELECT target AS label, pred, count(*) AS "count" FROM lab GROUP BY 1, 2'),
)
REPORT = """rep AS (SELECT l.label, h / nullif(s.said, 0) AS precision, h / nullif(l.support, 0) AS recall, l.support FROM
  (SELECT target AS label, count(*) AS support, count(*) FILTER (WHERE target = pred) AS h FROM lab GROUP BY 1) l
  LEFT JOIN (SELECT pred AS label, count(*) AS said FROM lab GROUP BY 1) s USING (label)),
f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM rep)"""
REP = {"label": None, "precision": 6, "recall": 6, "f1": 6, "support": None}
add(
    "class_report",
    lambda s, p: rounds(evaluation.class_report(labelled(s, p), "target", "pred"), REP),
    with_(BARS, LAB2, REPORT, select=f"SELECT {rounded(REP)} FROM f"),
)
WR = {n: 6 for n in ("accuracy", "precision", "recall", "f1")}
add(
    "weighted_report",
    lambda s, p: rounds(evaluation.weighted_report(labelled(s, p), "target", "pred"), WR),
    with_(
        BARS, LAB2, REPORT,
        """w AS (SELECT sum(recall * support) / sum(support) AS recall, sum(precision * support) / sum(support) AS precision,
        sum(f1 * support) / sum(support) AS f1 FROM f)""",
        "x AS (SELECT *, (SELECT avg(CAST(target = pred AS INTEGER)) FROM lab) AS accuracy FROM w)",
        select=f"SELECT {rounded(WR)} FROM x",
    ),
)
SIG = {"symbol": None, "date": None, "p": 6, "signal": None, "action": None}


def signals(s, p):
    x = d.bars(s, p).withColumn("p", numeric.sigmoid(10 * (c("close") - c("open")) / c("open")))
    x = x.withColumn("signal", scores.signal(c("p")))
    return rounds(x.withColumn("action", scores.action(c("signal"))), SIG)


add(
    "signals_from_probability",
    signals,
    with_(
        BARS,
        "x AS (SELECT symbol, date, 1 / (1 + exp(-(10 * (close - open) / open))) AS p FROM bars)",
        """y AS (SELECT *, CASE WHEN p >= 0.65 THEN 2 WHEN p >= 0.55 THEN 1 WHEN p <= 0.35 THEN -2 WHEN p <= 0.45 THEN -1
        ELSE 0 END AS signal FROM x)""",
        "z AS (SELECT *, CASE WHEN signal > 0 THEN 'buy' WHEN signal < 0 THEN 'sell' ELSE 'hold' END AS action FROM y)",
        select=f"SELECT {rounded(SIG)} FROM z",
    ),
)

# -- predictions ---------------------------------------------------------------------------

SIGNAL = """CASE WHEN probability >= 0.65 THEN 2 WHEN probability >= 0.55 THEN 1 WHEN probability <= 0.35 THEN -2
  WHEN probability <= 0.45 THEN -1 ELSE 0 END AS signal"""
PRED = f"""pr0 AS (SELECT CAST(symbol AS BIGINT) AS company_id, date AS prediction_date, 0.5 + 2 * (close - open) / open AS probability,
  'nn_v1' AS model_version, date AS created_at FROM bars),
pred AS (SELECT *, {SIGNAL} FROM pr0)"""
add(
    "predictions_of_day",
    lambda s, p: ledger.predictions_on(d.predictions(s, p), d.company(s, p), DAY).select("code", "signal", "probability"),
    with_(BARS, COMPANY, PRED, select=f"""SELECT code, signal, probability FROM pred JOIN company USING (company_id)
    WHERE prediction_date = {DAY_SQL} AND model_version = 'nn_v1'"""),
)


def incoming(s, p):
    o = d.table(s, p, "orders")
    prob = c("o_totalprice") / 500000
    return o.select(
        c("o_orderkey").alias("seq"),
        c("o_custkey").cast("string").alias("code"),
        c("o_orderdate").cast("date").alias("prediction_date"),
        scores.signal(prob).alias("signal"),
        prob.alias("probability"),
        F.lit("nn_v1").alias("model_version"),
        F.lit(0.6).alias("model_auc"),
    )


add(
    "upsert_predictions",
    lambda s, p: upsert.upsert_prediction(
        d.predictions(s, p), incoming(s, p), d.company(s, p), F.lit("2002-01-01").cast("timestamp")
    ).withColumn("created_at", c("created_at").cast("date")),
    with_(
        BARS, COMPANY, PRED,
        f"""inc AS (SELECT company_id, CAST(o_orderdate AS DATE) AS prediction_date, o_totalprice / 500000 AS probability, o_orderkey
        FROM orders JOIN company ON code = CAST(o_custkey AS VARCHAR)),
        newest AS (SELECT company_id, prediction_date, arg_max(probability, o_orderkey) AS probability FROM inc GROUP BY 1, 2),
        neu AS (SELECT *, {SIGNAL} FROM newest)""",
        select="""SELECT company_id, prediction_date, signal, probability, 'nn_v1' AS model_version, 0.6::DOUBLE AS model_auc,
        DATE '2002-01-01' AS created_at FROM neu
        UNION ALL SELECT company_id, prediction_date, signal, probability, model_version, NULL, created_at FROM pred
        WHERE (company_id, prediction_date) NOT IN (SELECT (company_id, prediction_date) FROM neu)""",
    ),
)


def coded(s, p):
    return d.predictions(s, p).select(
        c("company_id").cast("string").alias("code"), c("prediction_date").alias("date"), "signal", "probability"
    )


add(
    "trade_intents",
    lambda s, p: ledger.trade_intents(coded(s, p)).select("date", "seq", "symbol", "action", "signal"),
    with_(BARS, PRED, select="""SELECT prediction_date AS date, CAST(row_number() OVER (PARTITION BY prediction_date ORDER BY signal > 0,
    CASE WHEN signal > 0 THEN -signal ELSE signal END, probability DESC, CAST(company_id AS VARCHAR)) AS INTEGER) AS seq,
    company_id || '.IS' AS symbol, CASE WHEN signal > 0 THEN 'buy' ELSE 'sell' END AS action, signal FROM pred WHERE signal <> 0"""),
)
add(
    "signal_counts",
    lambda s, p: ledger.signal_counts(coded(s, p)),
    with_(BARS, PRED, select="""SELECT prediction_date AS date, count(*) FILTER (WHERE signal > 0) AS buys,
    count(*) FILTER (WHERE signal < 0) AS sells, count(*) FILTER (WHERE signal = 0) AS holds FROM pred GROUP BY 1"""),
)
add(
    "latest_prices",
    lambda s, p: ledger.latest_price(d.bars(s, p), DAY),
    with_(BARS, select=f"""SELECT symbol, arg_max(close, date) AS price FROM bars
    WHERE date >= {DAY_SQL} - 5 AND date <= {DAY_SQL} GROUP BY symbol"""),
)
add(
    "trade_sizes",
    lambda s, p: d.bars(s, p).select(
        "symbol", "date",
        ledger.units_by_count(c("volume") * 100, c("close")).alias("by_count"),
        ledger.units_by_budget(c("volume") * 1000, c("close")).alias("by_budget"),
        ledger.units_to_sell(c("volume").cast("bigint"), F.lit(20).cast("bigint")).alias("to_sell"),
    ),
    with_(BARS, select="""SELECT symbol, date, CAST(least(4, floor(volume * 100 / close)) AS BIGINT) AS by_count,
    CAST(least(floor(10000 / close), floor(volume * 1000 / close)) AS BIGINT) AS by_budget,
    least(20, CAST(volume AS BIGINT)) AS to_sell FROM bars"""),
)


def holdings(s, p):
    sup = d.table(s, p, "supplier")
    return sup.select(
        c("s_nationkey").cast("string").alias("wallet"),
        c("s_suppkey").cast("string").alias("symbol"),
        (c("s_suppkey") % 7 + 1).alias("units"),
    )


def cash(s, p):
    return d.table(s, p, "nation").select(
        c("n_nationkey").cast("string").alias("wallet"), F.lit(100000.0).alias("money")
    )


VAL = {"wallet": None, "money": 2, "portfolio_value": 3, "total": 3}
add(
    "portfolio_values",
    lambda s, p: rounds(ledger.valuation(cash(s, p), holdings(s, p), ledger.latest_price(d.bars(s, p), DAY)), VAL),
    with_(
        BARS,
        f"""pr AS (SELECT symbol, arg_max(close, date) AS price FROM bars WHERE date >= {DAY_SQL} - 5 AND date <= {DAY_SQL} GROUP BY symbol),
        h AS (SELECT s_nationkey, sum((s_suppkey % 7 + 1) * price) AS v FROM supplier LEFT JOIN pr ON symbol = CAST(s_suppkey AS VARCHAR) GROUP BY 1),
        x AS (SELECT CAST(n_nationkey AS VARCHAR) AS wallet, 100000.0::DOUBLE AS money, coalesce(v, 0) AS portfolio_value,
        100000.0::DOUBLE + coalesce(v, 0) AS total FROM nation LEFT JOIN h ON s_nationkey = n_nationkey)""",
        select=f"SELECT {rounded(VAL)} FROM x",
    ),
)


# -- models -----------------------------------------------------------------------------------

MIN_ROWS = 200


def stored_models(s, p):
    """Training dates from the bars: the last day a symbol closed a quarter."""
    ends = d.bars(s, p).filter(indicators.quarter_end(c("date")) == 1)
    return ends.groupBy("symbol").agg(F.max("date").cast("timestamp").alias("trained_at"))


add(
    "retrain_policy",
    lambda s, p: models.retrain_status(d.company(s, p), stored_models(s, p), dt.date(2001, 10, 5)).select("symbol", "status"),
    with_(
        BARS, COMPANY,
        "m AS (SELECT symbol, max(date) AS t FROM bars WHERE date = last_day(date) AND month(date) % 3 = 0 GROUP BY 1)",
        select="""SELECT code AS symbol, CASE WHEN t IS NULL OR DATE '2001-10-05' - t >= 7 THEN 'train' ELSE 'not_needed' END AS status
        FROM company LEFT JOIN m ON symbol = code""",
    ),
)
add(
    "run_statistics",
    lambda s, p: explore.status_counts(
        models.training_status(
            models.retrain_status(d.company(s, p), stored_models(s, p), dt.date(2001, 10, 5)),
            d.bars(s, p), stored_models(s, p), 520,
        )
    ),
    with_(
        BARS, COMPANY,
        "m AS (SELECT symbol, max(date) AS t FROM bars WHERE date = last_day(date) AND month(date) % 3 = 0 GROUP BY 1)",
        "n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)",
        """st AS (SELECT CASE WHEN NOT (t IS NULL OR DATE '2001-10-05' - t >= 7) THEN 'not_needed'
        WHEN coalesce(n, 0) < 520 THEN 'skipped' WHEN t IS NOT NULL THEN 'trained' ELSE 'failed' END AS status
        FROM company LEFT JOIN m ON m.symbol = code LEFT JOIN n ON n.symbol = code)""",
        select='SELECT status, count(*) AS "count" FROM st GROUP BY 1',
    ),
)


def model_features(s, p):
    """All feature groups of complete rows."""
    return features.build_features(d.bars(s, p), d.fx(s, p), d.us(s, p), d.daily(s, p), min_rows=MIN_ROWS)


def trained(s, p):
    return models.train_models(model_features(s, p), features.feature_columns(), F.lit(DAY))


add("trained_models", lambda s, p: trained(s, p).select("symbol", "val_auc", "epochs_trained", "rows"))


def given_models(s, p):
    """Models whose weights follow from the suppliers: other columns and orders by symbol, one column that bars lack."""
    sup = d.table(s, p, "supplier")
    even = c("s_suppkey") % 2 == 0
    return sup.select(
        c("s_suppkey").cast("string").alias("symbol"),
        F.when(even, F.array(F.lit("close"), F.lit("no such"), F.lit("volume")))
        .otherwise(F.array(F.lit("volume"), F.lit("open"))).alias("feature_cols"),
        F.when(even, F.array(F.lit(1000.0), F.lit(1.0), F.lit(25.0))).otherwise(F.array(F.lit(25.0), F.lit(1000.0))).alias("center"),
        F.when(even, F.array(F.lit(500.0), F.lit(2.0), F.lit(10.0))).otherwise(F.array(F.lit(10.0), F.lit(500.0))).alias("scale"),
        F.when(even, F.array(F.lit(0.5), F.lit(0.75), c("s_acctbal") / 10000))
        .otherwise(F.array(c("s_acctbal") / 10000, F.lit(-0.5))).alias("weights"),
        F.lit(0.125).alias("bias"),
        (c("s_nationkey") / 25).alias("val_auc"),
    )


add(
    "scored_latest_rows",
    lambda s, p: models.score_latest(d.bars(s, p), given_models(s, p), DAY),
    with_(
        BARS,
        "last AS (SELECT symbol, arg_max(open, date) AS o, arg_max(close, date) AS c, arg_max(volume, date) AS v FROM bars GROUP BY 1)",
        """z AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 2 = 0
        THEN (c - 1000) / 500 * 0.5::DOUBLE + (0 - 1) / 2.0::DOUBLE * 0.75::DOUBLE + (v - 25) / 10 * (s_acctbal / 10000)
        ELSE (v - 25) / 10 * (s_acctbal / 10000) + (o - 1000) / 500 * -0.5::DOUBLE END + 0.125::DOUBLE AS z
        FROM supplier JOIN last ON symbol = CAST(s_suppkey AS VARCHAR))""",
        f"""pr AS (SELECT s_suppkey, s_nationkey / 25 AS model_auc, 1 / (1 + exp(-z)) AS probability FROM z),
        sg AS (SELECT *, {SIGNAL} FROM pr)""",
        select=f"""SELECT CAST(s_suppkey AS VARCHAR) AS code, {DAY_SQL} AS prediction_date, signal, round(probability, 4) AS probability,
        model_auc FROM sg""",
    ),
)
add("compared_models", lambda s, p: models.compare_models(model_features(s, p), indicators.TECHNICAL))
add(
    "feature_group_ablation",
    lambda s, p: models.run_ablation(
        model_features(s, p), features.FEATURE_GROUPS, features.COMBINATIONS | features.COMBINATIONS_EXTENDED, folder(s, "ablation")
    ),
)


# -- the same fits on bars, where SQL can count what they are made of ------------------------------

BAR_GROUPS = {"price": ["open", "close"], "range": ["high", "low"], "size": ["volume"], "absent": ["no such"]}
BAR_COMBINATIONS = {"all": ["price", "range", "size"], "price": ["price"], "size+absent": ["size", "absent"], "none": ["absent"]}
add(
    "ablation_sizes",
    lambda s, p: models.run_ablation(
        indicators.add_target(d.bars(s, p)), BAR_GROUPS, BAR_COMBINATIONS, folder(s, "ablation")
    ).select("combination", "n_features", "train_rows", "val_rows"),
    with_(
        BARS, LAB,
        "n AS (SELECT count(*) AS n FROM lab GROUP BY symbol, target)",
        "t AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(round(n * 0.1::DOUBLE)) AS BIGINT) AS v FROM n)",
        """c(combination, n_features) AS (VALUES ('all', 5), ('price', 2), ('size+absent', 1))""",
        select="SELECT combination, n_features, n - v AS train_rows, v AS val_rows FROM c, t",
    ),
)
add(
    "trained_sizes",
    lambda s, p: models.train_models(indicators.add_target(d.bars(s, p)), BAR_GROUPS["price"] + BAR_GROUPS["range"] + BAR_GROUPS["size"], F.lit(DAY))
    .select("symbol", "rows", F.size("weights").alias("columns"), F.col("val_auc").between(0, 1).alias("sound")),
    with_(BARS, select='SELECT symbol, count(*) AS "rows", 5 AS "columns", true AS sound FROM bars GROUP BY symbol'),
)
add(
    "model_gate",
    lambda s, p: s.range(1).select(F.lit(models.require_models(given_models(s, p), 5)).cast("bigint").alias("models")),
    "SELECT count(*) AS models FROM supplier",
)


def created_tables(s, p):
    """The stored tables, made twice; the companies are written into theirs and read back."""
    name = f"news_{uuid.uuid4().hex}"
    s.sql(f"CREATE DATABASE {name} LOCATION '{folder(s, 'tables')}'")
    for _ in range(2):
        tables.create_tables(s, name)
    rows = d.company(s, p).select("company_id", "code", "name", F.lit(None).cast("string"), c("s_nationkey").cast("int"))
    rows.write.insertInto(f"{name}.company")
    return s.table(f"{name}.company").select("company_id", "code", "name", "sector", "sector_id")


add(
    "created_tables",
    created_tables,
    with_(COMPANY, select="SELECT company_id, code, name, CAST(NULL AS VARCHAR) AS sector, CAST(s_nationkey AS INTEGER) AS sector_id FROM company"),
)


def training_run(s, p):
    """Status of every symbol after a training whose histories are partly too short."""
    day = dt.date(2001, 6, 29)
    table = d.bars(s, p).withColumn("target", (c("close") > c("open")).cast("int"))
    for k in range(models.MIN_FEATURES):
        table = table.withColumn(f"x{k}", c("close") * (k + 1))
    company = d.company(s, p).select("company_id", "code", "name")
    none = s.createDataFrame([], "symbol string, trained_at timestamp")
    _, status = trading.weekly_training(table, company, none, day, min_rows=510, columns=[f"x{k}" for k in range(models.MIN_FEATURES)])
    return status


add(
    "training_run",
    training_run,
    with_(BARS, COMPANY, "n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1)",
          select="""SELECT code AS symbol, CASE WHEN coalesce(n, 0) < 510 THEN 'skipped' ELSE 'trained' END AS status
          FROM company LEFT JOIN n ON symbol = code"""),
)
add(
    "trading_day",
    lambda s, p: trading.daily_intents(d.predictions(s, p), d.company(s, p), d.bars(s, p), DAY).select("date", "seq", "symbol", "action", "price"),
    with_(
        BARS, PRED,
        f"""pc AS (SELECT symbol || '.IS' AS symbol, arg_max(close, date) AS price FROM bars
        WHERE date >= {DAY_SQL} - 5 AND date <= {DAY_SQL} GROUP BY 1)""",
        select=f"""SELECT prediction_date AS date, CAST(row_number() OVER (ORDER BY signal > 0,
        CASE WHEN signal > 0 THEN -signal ELSE signal END, probability DESC, CAST(company_id AS VARCHAR)) AS INTEGER) AS seq, pc.symbol,
        CASE WHEN signal > 0 THEN 'buy' ELSE 'sell' END AS action, price FROM pred LEFT JOIN pc ON pc.symbol = company_id || '.IS'
        WHERE prediction_date = {DAY_SQL} AND signal <> 0""",
    ),
)


def polarity(s, p):
    """Labelled texts: quality and toxicity of the documents as three classes."""
    docs = d.table(s, p, "documents").join(d.table(s, p, "labels"), "doc_id")
    return docs.select(
        c("text").alias("sentence"), F.when(c("toxic") == 1, 0).when(c("quality") == 1, 2).otherwise(1).alias("label")
    )


add(
    "sentence_classifier",
    lambda s, p: sentiment.model_scorer(sentiment.train_scorer(polarity(s, p)))(
        sentiment.article_sentences(d.news(s, p))
    )
    .groupBy("label")
    .agg(F.count("*").alias("sentences"), F.avg("score").alias("confidence")),
)


ART = {"code": None, "company_id": None, "articles": None, "score": 6}


def article_run(s, p):
    """Match, score and store all articles as one batch."""
    empty = news.Store(*[s.createDataFrame([], schema) for schema in (news.COMPANY, news.NEWS, news.LINKS)])
    batch = d.news(s, p).select(
        c("news_id").alias("seq"), "url", "news_date", "provider", F.upper("content").alias("content")
    )
    out = news.process_news(
        batch, d.listed(s, p), d.hash_scorer, empty, dt.date(1995, 1, 1), F.lit("2002-01-01").cast("timestamp"),
        folder(s, "articles"),
    )
    return rounds(
        out.news.join(out.bridge, "news_id")
        .join(out.company, "company_id")
        .groupBy("code", "company_id")
        .agg(F.count("*").alias("articles"), F.avg("news_ratio").alias("score")),
        ART,
    )


add(
    "article_pipeline",
    article_run,
    with_(
        LISTED,
        f"raw AS (SELECT doc_id AS news_id, CAST(doc_id % 2500 AS INTEGER) AS day, source AS provider, {upper('text')} AS content FROM documents)",
        """articles AS (SELECT * FROM raw a WHERE NOT EXISTS (SELECT 1 FROM raw b WHERE b.day = a.day AND b.provider = a.provider
        AND b.news_id < a.news_id AND suffix(b.content, a.content)))""",
        EXACT, FUZZY,
        "m AS (SELECT news_id, code FROM exact UNION ALL SELECT news_id, code FROM fuzzy)",
        "news AS (SELECT * FROM articles WHERE news_id IN (SELECT news_id FROM m))",
        SENTENCES, LABELLED, ARTICLE,
        "ids AS (SELECT code, row_number() OVER (ORDER BY min(news_id), code) AS company_id FROM m GROUP BY code)",
        """x AS (SELECT code, company_id, count(*) AS articles, avg(news_ratio) AS score
        FROM m JOIN ids USING (code) JOIN scored USING (news_id) GROUP BY 1, 2)""",
        select=f"SELECT {rounded(ART)} FROM x",
    ),
)

# -- streams ---------------------------------------------------------------------------------------

def arrivals(s, rows, name, parts):
    """``rows`` as files of a folder, one for each number of ``_file``, written in that order."""
    path = folder(s, name)
    for k in range(parts):
        rows.filter(c("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return path


FILES = 10
# Every file brings three days; every 17th event comes five files later, but with the last one at the latest.
FILE_OF = "least(floor(d / 3) + CASE WHEN event_id % 17 = 0 THEN 5 ELSE 0 END, 9)"
EVENTS = f"""e AS (SELECT *, event_type AS symbol, CAST(ts AS DATE) - DATE '2024-01-01' AS d FROM events),
f AS (SELECT *, {FILE_OF} AS file FROM e)"""


def event_files(s, p):
    """Articles made of the events, late ones among them, and a stream of one file a batch."""
    days = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = d.table(s, p, "events").withColumn("d", days).select(
        F.concat(F.lit("http://x/"), (c("d") % 27).cast("string")).alias("url"),
        c("ts").cast("timestamp").alias("published"),
        c("event_type").alias("symbol"),
        F.lit("p").alias("provider"),
        F.lit("x").alias("content"),
        c("value").alias("score"),
        F.expr(FILE_OF).alias("_file"),
    )
    return stream.article_stream(s, arrivals(s, rows, "events", FILES), files_per_batch=1)


def drained(s, df, name, keys=None):
    """Runs a stream to its end and returns the latest row per key."""
    out = folder(s, name)

    def save(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/b={number}")

    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/state")
    writer.outputMode("update" if keys else "append").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{out}/data").drop("b")
    return explore.keep_last(rows, keys, "_batch").drop("_batch") if keys else rows.drop("_batch")


def event_stream(s, p):
    source = s.readStream.schema(s.read.parquet(f"{p}/events.parquet").schema).parquet(f"{p}/events.parq*")
    return source.select(
        F.floor(c("event_id") / 3).cast("string").alias("url"),
        c("ts").cast("timestamp").alias("published"),
        c("event_type").alias("symbol"),
        c("value").alias("score"),
    )


SD = {"symbol": None, "date": None, "avg_sentiment": 6, "news_count": None}
add(
    "stream_daily_sentiment",
    lambda s, p: rounds(drained(s, stream.running_sentiment(event_stream(s, p)), "daily", ["symbol", "date"]), SD),
    f"""SELECT {rounded(SD)} FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, avg(value) AS avg_sentiment,
    count(*) AS news_count FROM events GROUP BY 1, 2)""",
)
# The watermark of a batch is the latest event of the batches before less ten days; events are late by that of the batch
# before. A day is closed, and its late events are dropped, when that reaches its end.
add(
    "stream_late_drop",
    lambda s, p: rounds(drained(s, stream.running_sentiment(event_files(s, p)), "late", ["symbol", "date"]), SD),
    with_(
        EVENTS,
        "b AS (SELECT file, max(ts) AS latest FROM f GROUP BY file)",
        "w AS (SELECT a.file, max(b.latest) - INTERVAL 10 DAY AS mark FROM b a LEFT JOIN b ON b.file < a.file - 1 GROUP BY a.file)",
        f"""x AS (SELECT symbol, CAST(ts AS DATE) AS date, avg(value) AS avg_sentiment, count(*) AS news_count
        FROM f JOIN w USING (file) WHERE mark IS NULL OR CAST(ts AS DATE) + INTERVAL 1 DAY > mark GROUP BY 1, 2)""",
        select=f"SELECT {rounded(SD)} FROM x",
    ),
)


def distinct_events(s, p):
    """By days, so that an article's time does not depend on which of its events comes first."""
    days = event_files(s, p).withColumn("published", F.date_trunc("day", "published"))
    return drained(s, stream.deduplicated(days), "dedup").select("url", F.to_date("published").alias("date"))


# An url is known until the watermark of an earlier batch has passed its first day by ten days more; those of the last
# three days come again after that.
add(
    "stream_distinct_articles",
    distinct_events,
    with_(
        EVENTS,
        "r AS (SELECT DISTINCT 'http://x/' || d % 27 AS url, d, file FROM f)",
        "b AS (SELECT file, max(d) AS latest FROM r GROUP BY file)",
        "w AS (SELECT a.file, coalesce(max(b.latest) - 10, -1000) AS mark FROM b a LEFT JOIN b ON b.file < a.file GROUP BY a.file)",
        "k AS (SELECT r.* FROM r LEFT JOIN w ON w.file = r.file - 1 WHERE d > coalesce(mark, -1000))",
        "o AS (SELECT k.*, first_value(d) OVER (PARTITION BY url ORDER BY file) AS known, row_number() OVER (PARTITION BY url ORDER BY file) AS n FROM k)",
        "y AS (SELECT o.*, w.mark AS before FROM o LEFT JOIN w ON w.file = o.file - 1)",
        select="SELECT url, DATE '2024-01-01' + CAST(d AS INTEGER) AS date FROM y WHERE n = 1 OR known + 10 < before",
    ),
)


INGEST_FILES = 4


def ingested(s, p):
    """The article pipeline on the documents as they arrive, a quarter a batch."""
    rows = d.news(s, p).select(
        c("news_id").alias("seq"), "url", "news_date", "provider", F.upper("content").alias("content")
    )
    size = rows.agg(F.max("seq") + 1).scalar()
    files = arrivals(s, rows.withColumn("_file", F.floor(c("seq") * INGEST_FILES / size)), "articles-in", INGEST_FILES)
    out = folder(s, "ingest")
    write = news.ingest(out, d.listed(s, p), d.hash_scorer, dt.date(1995, 1, 1), F.lit("2002-01-01").cast("timestamp"))
    source = stream.article_stream(s, files, rows.schema, 1)
    stream.start_ingest(source, write, f"{out}/state", every=None).awaitTermination()
    stored, links, company = (s.read.parquet(f"{out}/{name}") for name in ("news", "links", "company"))
    company = company.filter(c("batch") == INGEST_FILES - 1)
    return rounds(
        stored.drop("batch").join(links.drop("batch"), "news_id")
        .join(company, "company_id")
        .groupBy("code", "company_id")
        .agg(F.count("*").alias("articles"), F.avg("news_ratio").alias("score")),
        ART,
    )


add("stream_ingest", ingested, ORACLES["article_pipeline"])
