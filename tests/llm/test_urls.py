import itertools
import math

from tickerloom.llm import urls


def test_segmentation_equals_all_cuts():
    words = {"cheap": 50, "pills": 40, "pill": 30, "s": 5, "he": 60, "the": 90, "there": 30, "re": 10, "her": 20}
    total = sum(words.values())
    known, one = {w: math.log(n / total) for w, n in words.items()}, -math.log(total)

    def value(parts):
        return sum(known.get(p, one - 2.5 * len(p)) for p in parts)

    for label in ("cheappills", "thereher", "pillsqq", "z", "thethethe"):
        cuts = []
        for gaps in itertools.product((0, 1), repeat=len(label) - 1):
            parts, at = [], 0
            for i, g in enumerate(gaps, 1):
                if g:
                    parts.append(label[at:i])
                    at = i
            cuts.append([*parts, label[at:]])
        got = urls.best_cut(label, known, one)
        assert "".join(got) == label and abs(value(got) - max(map(value, cuts))) < 1e-9
    assert urls.best_cut("cheappills", known, one) == ["cheap", "pills"] and urls.best_cut("", known, one) == []


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/x?q=/en/", "https://a.example.org/en/12#a/b", "http://b.com/fr/1", "http://b.com/de/2",
    "http://xcom/de/2", "http://com/de/", "http://b.org", "http://b.org?x=/", "http://example.org/en/2", "http://Éx.com/DE/3", "x://y://z.org/", "http://cheap-pills.net/de/4",
    "http://cheap-pills.net/fr/4", "http://b.net/" + "a" * 50_000, "http://" + "a" * 300 + ".net/", "http://b.com/de/2", "://org/x", "http://a.org.com/fr/",
]


def test_parts_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    rows = {r["page_id"]: r for r in urls.judged_urls(pages).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, name), u
        assert rows[i]["verdict"] == verdict if verdict else rows[i]["verdict"] in urls.VERDICTS
    assert rows[15]["verdict"] == "block" and rows[16]["verdict"] == "allow"
    assert urls.judged_urls(pages.limit(0)).count() == 0
    alone = urls.judged_urls(pages.where("page_id in (0, 2)")).collect()
    assert {r["verdict"] for r in alone} == {"allow"}


def test_given_pages(sample):
    for r in urls.judged_urls(sample("pages")).join(sample("pages").select("page_id", "url"), "page_id").collect():
        host, path = parts(r["url"])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name) and r["verdict"] == (verdict or r["verdict"])
        assert r["host_words"].replace(" ", "") == "".join(c for c in host if c.isalnum())


def test_words_are_counted_exactly(spark):
    """A frequent other word does not make a host a word."""
    text = "<p>cheap pills here " + "cheappill " * 500 + "</p>"
    pages = spark.createDataFrame([(1, "http://cheappills.net/x", text), (2, "http://pillscheapzz.net/x", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["host_words"] for r in urls.judged_urls(pages).collect()}
    assert got == {1: "cheappill s net", 2: "pills cheap zz net"}


def test_a_host_of_a_megabyte_and_pages_without_an_end(spark):
    """Neither is repeated with each of its pieces or searched anew from each of its tags."""
    host = "pills" * 200_000 + ".net"
    open_ = "<script" * 60_000 + "<" * 100_000 + "<p>cheap pills</p>"
    pages = spark.createDataFrame([(1, f"http://{host}", "cheap pills"), (2, "http://a.net/", open_), (3, "http://b.net/", "<STYLE>pills x</style >cheap <b")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judged_urls(pages).collect()}
    assert got[1]["host"] == host and got[1]["host_words"].split() == ["pills"] * 200_000 + ["net"]
    assert urls._plain("<STYLE>pills x</style >cheap <b").split() == ["cheap", "<b"]


def test_scores_equal_naive_bayes_by_hand(spark):
    paths = [("b.com", "/de/a/a"), ("b.com", "/de/a/b"), ("b.com", "/fr/b/c"), ("b.net", "/a/c/new"), ("b.net", "/"), ("b.com", "/de/a/b")]
    pages = spark.createDataFrame([(i, f"http://{h}{p}", None) for i, (h, p) in enumerate(paths)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in urls.judged_urls(pages).collect()}
    tokens = [[f"h:{w}" for w in rows[i]["host_words"].split()] + [f"p:{w}" for w in p.split("/") if w] for i, (_, p) in enumerate(paths)]
    counts = {v: [t for i, ts in enumerate(tokens) if rows[i]["rule"] and rows[i]["verdict"] == v for t in ts] for v in urls.VERDICTS}
    known = set(counts["allow"] + counts["block"])
    share = lambda t, v: (counts[v].count(t) + 0.5) / (len(counts[v]) + 0.5 * len(known))
    for i, ts in enumerate(tokens):
        value = math.log(4 / 2) + sum(math.log(share(t, "block") / share(t, "allow")) for t in ts if t in known)
        assert abs(rows[i]["block_score"] - 1 / (1 + math.exp(-value))) < 1e-9


def test_long_words_are_found(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    pages = spark.createDataFrame([(1, f"http://neue{long}.de/", f"<p>neue {long} {long}</p>"), (2, "http://" + "q" * 30 + ".de/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["host_words"] for r in urls.judged_urls(pages).collect()}
    assert got[1] == f"neue {long} de" and got[2] == "q" * 30 + " de"
