"""Fixed schemas (DDL) of the stored tables and of the JSON inputs."""

BARS = "symbol string, date date, open double, high double, low double, close double, volume double"
COMPANY = "company_id bigint, code string, name string, sector string, sector_id int"
NEWS = (
    "news_id bigint, url string, news_date date, website string, provider string, "
    "content string, news_type int, news_ratio double, created_at timestamp"
)
NEWS_COMPANY = "news_id bigint, company_id bigint"
PREDICTION = (
    "company_id bigint, prediction_date date, signal int, probability double, "
    "model_version string, model_auc double, created_at timestamp"
)
MACRO = "series string, date date, value double"
HEADLINES = (
    "items array<struct<id: string, title: string, provider: string, source: string, "
    "published: bigint, storyPath: string, link: string>>"
)
MODEL = (
    "symbol string, feature_cols array<string>, center array<double>, scale array<double>, "
    "weights array<double>, bias double, train_auc double, val_auc double, "
    "epochs_trained int, rows bigint, trained_at timestamp"
)
LEDGER = (
    "wallet string, date date, seq int, symbol string, action string, units bigint, "
    "price double, amount double, cash double"
)

TABLES = {
    "company": COMPANY,
    "news": NEWS,
    "news_company": NEWS_COMPANY,
    "prediction": PREDICTION,
}
