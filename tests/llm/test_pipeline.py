import collections
import random
import time

import corpus_pipeline
from test_ngram_join import brute
from test_private import base

from tickerloom.llm.mixing import mixed
from tickerloom.llm.storage import stored


def tables(spark, folder):
    rng = random.Random(9)
    syllables = "an the re on ed er tion in ha st le or is ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(420):
        text = [word() for _ in range(rng.randrange(20, 90))]
        if i % 6 == 0:
            text[3] = text[9] = "scum"
        if i % 10 == 1:
            text.insert(5, f"mail{i}@x.com")
        if i % 7 == 0 and i > 100:
            text = docs[i - 7][1].split(" ") + ["again"]
        docs.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int("scum" in text)))
    docs += [(1000, "", "en", "s0", 0), (1001, None, None, None, None), (1002, "word " * 20_000, "en", "s1", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:330], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return dict((d[0], d[1]) for d in docs)


def test_stages_one_by_one(spark, tmp_path):
    folder = str(tmp_path)
    texts = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
        assert docs.columns == columns, name
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic = {i for i, t in texts.items() if t and "scum" in t}
    assert len(toxic & kept[0].keys()) <= 0.1 * len(toxic)
    assert len(texts.keys() - toxic - kept[0].keys()) <= 0.03 * len(texts)
    ids = sorted(kept[0])
    groups = {ids[i]: ids[c] for i, (_, c) in brute([texts[i] for i in ids]).items()}
    assert kept[1].keys() == {i for i, c in groups.items() if i == c}
    assert kept[2].keys() == kept[1].keys()
    for i, r in kept[2].items():
        assert not base(r["text"]) and (r["text"] == texts[i]) == (not base(texts[i]))
    words = collections.Counter()
    for r in docs.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    before = spark.createDataFrame(list(kept[2].values()), docs.schema)
    assert all(words[r["doc_id"]] == r["taken"] for r in mixed(before).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_run_on_given_documents_and_on_none(spark, tmp_path):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 100 and "sequence_id" in rows.columns
    empty = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_one_of_each_group_with_equal_and_null_ids(spark, tmp_path):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, one), (5, one), (5, two), (7, three), (7, three), (None, three), (None, "x y z u v w"), (None, "x y z u v w"), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()
    want = [(1, one), (5, two), (7, three), (None, "x y z u v w"), (None, None), (8, ""), (8, "")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept) == collections.Counter(want)


def test_rows_that_stay_are_joined_without_python(spark, tmp_path):
    """Texts went through three Python workers a task, which took the most memory of the stage."""
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    assert "ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan


def test_a_stored_table_leaves_no_shuffle_files(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    rows = spark.range(200_000).selectExpr("id % 70001 as k", "xxhash64(id) as v")
    held = disk.getAllFiles().size()
    table = stored(rows.groupBy("k").count(), str(tmp_path))
    for _ in range(50):  # the files go in the background
        if disk.getAllFiles().size() <= held:
            break
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= held and table.count() == 70_001
