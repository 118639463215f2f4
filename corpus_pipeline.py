"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but the last
return the columns of ``docs``. Rows with a null id and repeated ids pass each stage as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import mixing, ngram_join, packing, private, queries
from tickerloom.llm.storage import shared_folder, stored


#: Rows of an Arrow batch: whole texts are sent to the Python workers, so fewer than Spark's default at a time.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of rows in an Arrow batch, which bounds what executors and workers hold at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from ``labels``, stays below a half. Rows without an id are judged too."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id")
    scored = queries.toxicity_scores(packed, labels, ["_row"], "_row.text")
    return scored.where("predicted = 0").select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles with a Jaccard similarity of 0.75 link: that with the smallest id.

    Each row is judged by its own text, also if ids repeat; rows are told apart by their place in ``docs``, which a scan
    gives alike each time (a row that is read with another text than before is an error). Of equal ids the first row
    stays, rows without an id come last. Rows without words are linked with nothing and stay. Texts go to the numbers of
    the rows that stay by one join, without Python.
    """
    bounded_batches(spark)
    folder = shared_folder(spark)
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.monotonically_increasing_id().alias("_number"), F.xxhash64("text").alias("_mark"), *names)
    places = stored(rows.select("_number", "_mark", F.col("doc_id").alias("id")), folder, "places")
    groups = stored(ngram_join.ngram_components(rows.select("_number", "text"), "_number"), folder, "groups").where("n_shingles > 0")
    ranked = places.join(groups, "_number").select("component_id", F.struct(F.col("id").isNull().alias("none"), "id", "_number", "_mark").alias("place"))
    best = ranked.groupBy("component_id").agg(F.min("place").alias("place")).select("place._number", "place._mark")
    wordless = places.join(groups, "_number", "left_anti").select("_number", "_mark")
    kept = best.union(wordless).withColumnRenamed("_mark", "_seen")
    moved = F.raise_error(F.lit("the rows came in another order than before: write the table first")).cast("boolean")
    return rows.join(kept, "_number").where(F.when(F.col("_mark") == F.col("_seen"), True).otherwise(moved)).select(*names)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind in brackets."""
    return private.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, the last one of a source in part."""
    bounded_batches(spark)
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens; a document that is repeated is packed as often."""
    bounded_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", hide_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack),
]

#: Language-model scores, tokenizers and the cutting-stock program have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each one's result written to the shared folder and read again."""
    folder, docs = shared_folder(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
