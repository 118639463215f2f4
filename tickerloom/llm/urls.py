"""URL filter: rules by host and path; for the rest, words of the host found by a Viterbi search, and naive Bayes.

Word frequencies come from the pages' urls and texts. A host label is cut into the words that are likeliest together.
The classes are learned from the urls that a rule decides, by multinomial naive Bayes over the words of host and path.
Both are counted by the exact word in written tables, which grow with the input, and joined to what the urls need.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

#: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
VERDICTS = ("allow", "block")
#: Pieces of hosts that are sent at once.
SENT = 1 << 16
#: Different words that a task counts before it gives its counts out.
HELD_WORDS = 1 << 18
SMOOTHING = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    rest = F.substring_index(url, "://", 1)
    inside = F.when(F.instr(url, "://") > 0, F.substr(url, F.length(rest) + 4)).otherwise("")
    host = F.regexp_extract(F.coalesce(inside, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(inside, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path on end) and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


_WORD = re.compile(r"[^\W_]+")
_TAG, _ENTITY = re.compile(r"<[^>]*>|&#?\w+;"), re.compile(r"&#?\w+;")
_OPEN = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def _plain(html: str) -> str:
    """The text of a page: without scripts and styles that end, tags that end, and entities. Time grows with the length,
    also if nothing ends."""
    kept, at, endless = [], 0, set()
    for m in _OPEN.finditer(html):
        name = m[1].lower()
        if m.start() < at or name in endless:
            continue
        end = _CLOSE[name].search(html, m.end())
        if end:
            kept.append(html[at : m.start()])
            at = end.end()
        else:
            endless.add(name)
    html = " ".join([*kept, html[at:]])
    last = html.rfind(">") + 1
    return _TAG.sub(" ", html[:last]) + " " + _ENTITY.sub(" ", html[last:])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words in one task's urls and texts; host labels count whole only where they stand alone."""
    counts: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for path, html in zip(batch.column("path").to_pylist(), batch.column("html").to_pylist()):
            for word in _WORD.findall(f"{path} {_plain(html or '')}".lower()):
                if not word.isdigit():
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) >= HELD_WORDS:
                yield rows()
                counts.clear()
    yield rows()


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of the words in paths and texts, each word once."""
    return pages.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def best_cut(label: str, known: dict[str, float], one: float) -> list[str]:
    """The likeliest cut of ``label`` into words by their log probabilities; a word that is not ``known`` counts as one
    occurrence, whose log probability is ``one``, less for each letter."""
    lengths = sorted({len(w) for w in known})
    best, cut, start = [0.0], [0], 0  # ``start`` is where the best unknown word would begin
    for end in range(1, len(label) + 1):
        value, at = best[start] + one - 2.5 * (end - start), start
        for n in lengths:
            if n > end:
                break
            p = known.get(label[end - n : end])
            if p is not None and best[end - n] + p > value:
                value, at = best[end - n] + p, end - n
        best.append(value)
        cut.append(at)
        if value + 2.5 * end > best[start] + 2.5 * start:
            start = end
    words, end = [], len(label)
    while end:
        words.append(label[cut[end] : end])
        end = cut[end]
    return words[::-1]


def _pieces(lengths: list[int]):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different pieces of the parts of each host, of the lengths that words have, under the host's name."""
        firsts, seconds, found = [], [], []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(found, pa.string())], names=["a", "b", "word"])
            firsts.clear(), seconds.clear(), found.clear()
            return out

        for batch in batches:
            for a, b, host in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "host"))):
                parts = set(_WORD.findall(host))
                longest = max(map(len, parts), default=0)
                for n in lengths:
                    if n > longest:
                        break
                    new = {part[k : k + n] for part in parts for k in range(len(part) - n + 1)}
                    found.extend(new)
                    firsts.extend([a] * len(new)), seconds.extend([b] * len(new))
                    if len(found) >= SENT:
                        yield rows()
        yield rows()

    return pieces


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) of different hosts, from the (word, n) of ``word_counts``. A host's pieces go by a 128-bit name of
    it, so that a very long host is not repeated with each."""
    total = max(words.agg(F.sum("n")).first()[0] or 0, 1)
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(hosts: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for host, pairs in zip(hosts.to_pylist(), known.to_pylist()):
            costs = {p["word"]: math.log(p["n"] / total) for p in pairs or ()}
            out.append([w for part in _WORD.findall(host) for w in best_cut(part, costs, -math.log(total))])
        return pa.array(out, pa.list_(pa.string()))

    hosts = hosts.select("host", F.xxhash64("host").alias("a"), F.xxhash64(F.lit(7), "host").alias("b"))
    found = hosts.mapInArrow(_pieces(lengths), "a long, b long, word string").join(words, "word")
    found = found.groupBy("a", "b").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return hosts.join(found, ["a", "b"], "left").select("host", cut("host", "known").alias("words"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def path_words(paths: pa.Array) -> pa.Array:
    return pa.array([_WORD.findall(p.lower()) for p in paths.to_pylist()], pa.list_(pa.string()))


def judged_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict, host_words, block_score) of every url.

    A rule decides where one fits. Elsewhere the url is blocked if its words are likelier among blocked urls; without
    any url that a rule decides, and for urls without words in even cases, it is allowed. Null urls have empty parts.
    Repeated rows stay, an empty table gives no rows, other columns are ignored.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = stored(rows.withColumns({"rule": rule, "ruled": verdict}))
    words = stored(word_counts(pages.select(path.alias("path"), F.col(html_col).cast("string").alias("html"))))
    cuts = stored(host_words(rows.select("host").distinct(), words))
    allowed, blocked = (F.sum(F.when(F.col("ruled") == v, 1).otherwise(0)).alias(v) for v in VERDICTS)
    urls = rows.groupBy("host", "path").agg(allowed, blocked).join(cuts, "host")
    tokens = F.concat(F.transform("words", lambda w: F.concat(F.lit("h:"), w)), F.transform("_path", lambda w: F.concat(F.lit("p:"), w)))
    urls = stored(urls.withColumn("_path", path_words("path")).withColumn("tokens", tokens).drop("_path"))
    said = urls.where("allow + block > 0").select(F.explode("tokens").alias("token"), *VERDICTS)
    said = stored(said.groupBy("token").agg(*(F.sum(v).alias(v) for v in VERDICTS)))  # others say nothing
    ruled = urls.agg(*(F.sum(v) for v in VERDICTS)).first()
    *sums, known = said.agg(*(F.sum(v) for v in VERDICTS), F.count("*")).first()
    allowed, blocked = (F.log((F.col(v) + SMOOTHING) / ((n or 0) + SMOOTHING * max(1, known))) for v, n in zip(VERDICTS, sums))
    prior = math.log(((ruled[1] or 0) + 1) / ((ruled[0] or 0) + 1))
    odds = urls.select("host", "path", F.explode("tokens").alias("token")).join(said.select("token", (blocked - allowed).alias("odds")), "token")
    odds = odds.groupBy("host", "path").agg(F.sort_array(F.collect_list("odds")).alias("odds"))  # summed in one order
    value = F.lit(prior) + F.coalesce(F.aggregate("odds", F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    judged = urls.join(odds, ["host", "path"], "left").select("host", "path", F.concat_ws(" ", "words").alias("host_words"), value.alias("_value"))
    verdict = F.coalesce("ruled", F.when(F.col("_value") > 0, VERDICTS[1]).otherwise(VERDICTS[0]))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("_value")))))
    out = rows.join(judged, ["host", "path"])
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "host_words", score.alias("block_score"))
