import numpy as np

from tickerloom.llm.language import _grams, with_language


def test_ngrams_stay_inside_a_text():
    codes = np.array([0, 97, 98, 0, 0, 99, 0], np.uint32)  # "ab", "", "c"
    one, two, three = (x.tolist() for x in _grams(codes, 1 << 20, 3))
    none = 1 << 20
    assert [x == none for x in one] == [True, False, False, True, True, False, True]
    assert [x == none for x in two] == [False, False, False, True, False, False, True]
    assert [x == none for x in three] == [False, False, True, True, False, True, True]


def test_naive_bayes_by_hand(make_docs):
    """With single characters, the scores are those of the formula."""
    train = make_docs([("aab", "x", "s"), ("abbb", "y", "s"), (None, "y", "s"), ("zz", None, "s")])
    rows = with_language(make_docs(["aa", "b"]), train, ["doc_id"], buckets=1 << 10, longest=1).collect()
    from tickerloom.llm.language import SMOOTHING as k

    p = {"x": {"a": (2 + k) / (3 + k * 1024), "b": (1 + k) / (3 + k * 1024)}, "y": {"a": (1 + k) / (4 + k * 1024), "b": (3 + k) / (4 + k * 1024)}}
    for r, text in zip(sorted(rows), ["aa", "b"]):
        like = {lang: np.prod([p[lang][c] for c in text]) for lang in p}
        best = max(sorted(like), key=like.get)
        assert r["lang_pred"] == best and abs(r["score"] - like[best] / sum(like.values())) < 1e-4


def test_edge_cases(make_docs, spark):
    train = make_docs([("hello there", "en", "s"), ("bonjour à tous", "fr", "s")])
    texts = ["", None, "123 !?", "hello", "BONJOUR", "x" * 200_000, "hello"]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in with_language(make_docs(texts), train, ["doc_id"]).collect()}
    assert [out[i][0] for i in range(5)] == ["und", "und", "und", "en", "fr"]
    assert out[0][1] == out[2][1] == 0 and out[3] == out[6] and all(0 <= s <= 1 for _, s in out.values())
    nothing = with_language(make_docs(texts), train.limit(0), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert with_language(make_docs(texts).limit(0), train, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    from tickerloom.llm.queries import op1_language_id

    path = "/root/testdata/sf0.001"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = [r for r in op1_language_id(spark, path).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows) > 20
