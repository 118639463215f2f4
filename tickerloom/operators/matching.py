"""Articles to companies: exact codes and fuzzy names."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.jaro import PREFIX, SCALE, char_codes, similarity
from tickerloom.functions.text import WORD, clean_company_name, strip, words

c = F.col

def exact_matches(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """J-7: articles(news_id, content) that hold a company code as a whole word.

    The first word of a code is always a word of the article, so this is an
    equi-join on words; only codes of several words are checked further. The
    comparison is case-sensitive: the upper-cased code against the raw text.
    """
    code = F.upper(strip(c("code")))
    keys = companies.select("code", "name", code.alias("_code")).withColumns(
        {
            "_word": F.regexp_extract("_code", f"({WORD}+)", 1),
            "_single": F.col("_code").rlike(rf"\A{WORD}+\z"),
        }
    )
    tokens = articles.select(
        "news_id",
        F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(f"({WORD}+)"), 1))).alias("_word"),
    )
    hits = tokens.join(keys.filter(c("_word") != ""), "_word")
    single = hits.filter(c("_single")).select("news_id", "code", "name")
    inside = F.expr(r"rlike(content, concat('(?U)\\b\\Q', _code, '\\E\\b'))")
    several = hits.filter(~c("_single")).join(articles, "news_id").filter(inside).select("news_id", "code", "name")
    found = single.unionByName(several)
    return found.select(
        "news_id",
        "code",
        "name",
        F.lit(None).cast("string").alias("cleaned_name"),
        F.lit("exact_kod").alias("match_type"),
        F.lit(None).cast("double").alias("score"),
    )


def names_to_match(companies: DataFrame) -> DataFrame:
    """Cleaned names; single words under 5 characters never match."""
    cleaned = companies.withColumn("cleaned_name", clean_company_name(c("name")))
    n = F.size(words(c("cleaned_name")))
    return cleaned.withColumn("_n", n).filter((c("_n") > 1) | ((c("_n") == 1) & (F.length("cleaned_name") >= 5)))


def letters(x: Column) -> Column:
    """64-bit set of the characters of a text (characters may share a bit)."""
    return F.aggregate(
        F.split(x, ""), F.lit(0).cast("bigint"), lambda mask, ch: mask.bitwiseOR(_bit(ch))
    )


def _bit(ch: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.ascii(ch), F.lit(64)))


def possible(threshold: float) -> Column:
    """Condition that every pair (cleaned_name, shingle) reaching the threshold meets.

    With a common prefix of p characters, a score of t needs a Jaro score of at
    least (t - 0.1p) / (1 - 0.1p), hence m/|a| + m/|b| >= 3J - 1 for m matched
    characters; characters found on one side only cannot be matched.
    """
    least_sum = partial(_least_sum, threshold)

    def differs(p: int) -> Column:
        return F.left("cleaned_name", F.lit(p)) != F.left("shingle", F.lit(p))

    # Tried in order, and most pairs differ in the first character already.
    needed = F.when(differs(1), least_sum(0))
    for p in range(2, PREFIX + 1):
        needed = needed.when(differs(p), least_sum(p - 1))
    needed = needed.otherwise(least_sum(PREFIX))
    lost_a = F.bit_count(c("_mask").bitwiseAND(F.bitwise_not(c("_smask"))))
    lost_b = F.bit_count(c("_smask").bitwiseAND(F.bitwise_not(c("_mask"))))
    common = F.least(c("_len") - lost_a, c("_slen") - lost_b)
    total = common / c("_len") + common / c("_slen") + 1e-9
    return (total >= least_sum(PREFIX)) & (total >= needed)


def _least_sum(threshold: float, prefix: int) -> float:
    """What m/|a| + m/|b| must reach for m matched characters, with a common prefix of at most ``prefix``."""
    return 3 * max(0.0, (threshold - SCALE * prefix) / (1 - SCALE * prefix)) - 1


#: Articles whose word runs are compared with the names in one task at a time, about.
GROUP = 128
#: Different runs that are compared with all names at once.
RUNS = 1 << 16


#: Characters that a text may hold so often are told apart by how often; those beyond count as matched.
PLANES = 4


def _planes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text and k <= PLANES the 64-bit set of the characters it holds k times and more (characters may share a
    bit), how many characters come beyond that, and its length."""
    codes, lengths = char_codes(texts)
    inside = np.arange(codes.shape[1]) < lengths[:, None]
    places = np.sort(np.where(inside, codes % np.uint32(64), np.uint32(64)), axis=1)
    out, beyond, times = np.zeros((PLANES, len(places)), np.uint64), np.zeros(len(places), np.int16), np.zeros(len(places), np.int64)
    for i in range(places.shape[1]):
        here = places[:, i]
        times = times * (here == places[:, i - 1]) + 1 if i else times + 1
        used = here < 64
        bit = np.where(used, np.uint64(1) << (here % np.uint32(64)).astype(np.uint64), np.uint64(0))
        for k in range(PLANES):
            out[k] |= np.where(times == k + 1, bit, np.uint64(0))
        beyond += used & (times > PLANES)
    return out, beyond, lengths


def _joined(a: np.ndarray, b: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The planes of texts put together, from the planes of both parts; ``beyond`` grows by what no plane holds."""
    out = np.empty_like(a)
    for k in range(PLANES):
        out[k] = a[k] | b[k]
        for i in range(k):
            out[k] |= a[i] & b[k - 1 - i]
    return out, beyond + _count(a) + _count(b) - _count(out)


def _count(planes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(planes).sum(axis=0, dtype=np.int16)


def _starts(texts: list[str]) -> np.ndarray:
    """The first characters of each text, 0 behind its end."""
    codes, _ = char_codes([x[:PREFIX] for x in texts])
    return np.pad(codes, ((0, 0), (0, PREFIX - codes.shape[1])))


class _Runs:
    """Different runs of n words, each word by its place in ``known``: what bounds their matches, without their texts."""

    def __init__(self, words: np.ndarray, known: list[str], planes: tuple, starts: np.ndarray):
        sets, beyond, lengths = planes
        space, blank = _planes([" "])[0], np.broadcast_to(_starts([" "]), (len(words[0]), PREFIX))
        self.words, self.known = words, known
        self.planes, self.beyond, self.length = sets[:, words[0]], beyond[words[0]], lengths[words[0]]
        self.start = starts[words[0]]
        for k in words[1:]:
            for part, more, size, begins in ((np.broadcast_to(space, self.planes.shape), 0, 1, blank), (sets[:, k], beyond[k], lengths[k], starts[k])):
                self.planes, self.beyond = _joined(self.planes, part, self.beyond + more)
                for p in range(PREFIX):
                    short = np.flatnonzero(self.length <= p)
                    self.start[short, p] = begins[short, p - self.length[short]]
                self.length = self.length + size
        order = np.argsort(self.length, kind="stable")
        self.order, self.planes, self.beyond, self.length, self.start = (
            order, np.ascontiguousarray(self.planes[:, order]), self.beyond[order], self.length[order], self.start[order]
        )
        self.first = self.start[:, 0]
        by_first = np.argsort(self.first, kind="stable")
        chars, starts = np.unique(self.first[by_first], return_index=True)
        self.beginning = dict(zip(chars.tolist(), np.split(by_first, starts[1:])))

    def texts(self, at: np.ndarray) -> list[str]:
        return [" ".join(w) for w in zip(*[[self.known[i] for i in k[self.order[at]].tolist()] for k in self.words])]


def _needed(threshold: float, prefix: int, x, y) -> np.ndarray:
    """Characters that texts of these lengths must match to reach the threshold."""
    return np.ceil(_least_sum(threshold, prefix) / (1 / x + 1 / y) - 1e-9).astype(np.int16)


def _close_pairs(names: list[str], runs: _Runs, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the name, place of the run, score) of all pairs that reach the threshold.

    With a common prefix of p characters ``_least_sum`` bounds the matched characters of such a pair from below, and the
    characters that both texts have bound them from above; the few pairs left are scored.
    """
    sets, beyond, lengths = _planes(names)
    starts, none = _starts(names), np.zeros(0, np.int64)
    least = np.array([_least_sum(threshold, p) for p in range(PREFIX + 1)])
    any_beyond, kinds = bool(runs.beyond.any()), {}
    alike, others = [], []

    def common(k: int, at) -> np.ndarray:
        out = np.bitwise_count(runs.planes[0, at] & sets[0, k]).astype(np.int16)
        for plane in range(1, PLANES):
            if sets[plane, k]:
                out += np.bitwise_count(runs.planes[plane, at] & sets[plane, k])
        return out + np.minimum(runs.beyond[at], beyond[k]) if any_beyond and beyond[k] else out

    for k, length in enumerate(lengths.tolist()):
        if length not in kinds:
            far, near = (_needed(threshold, p, length, runs.length) for p in (0, PREFIX))
            # No more characters match than the shorter text has, so other lengths never reach it.
            fits = np.flatnonzero(far <= np.minimum(length, runs.length))
            kinds[length] = far, near, slice(fits[0], fits[-1] + 1) if len(fits) else slice(0, 0)
        far, near, fits = kinds[length]
        begins = runs.beginning.get(int(starts[k, 0]), none)
        shared = common(k, begins)
        hit = shared >= near[begins]
        alike.append((np.full(np.count_nonzero(hit), k), begins[hit], shared[hit]))
        other = fits.start + np.flatnonzero(common(k, fits) >= far[fits])
        other = other[runs.first[other] != starts[k, 0]]
        others.append((np.full(len(other), k), other))
    left, right, shared = (np.concatenate(x) for x in zip(*alike))
    same = (starts[left] == runs.start[right]) & (starts[left] > 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    hit = shared >= np.ceil(least[prefix] / (1 / lengths[left] + 1 / runs.length[right]) - 1e-9)
    left, right = (np.concatenate([x[hit], *y]) for x, y in zip((left, right), zip(*others)))
    score = np.zeros(len(left))
    for at in range(0, len(left), RUNS):
        part = slice(at, at + RUNS)
        score[part] = similarity([names[k] for k in left[part].tolist()], runs.texts(right[part]))
    hit = score >= threshold
    return left[hit], runs.order[right[hit]], score[hit]


def _best_of_articles(threshold: float):
    """The best score of each name in each article of a group, at least the threshold."""

    def best(key: tuple, articles: pa.Table, names: pa.Table) -> pa.Table:
        articles = articles.filter(pc.greater(pc.binary_length(articles.column("text")), 0))
        split = pc.split_pattern(articles.column("text").combine_chunks(), " ")
        word = pc.list_flatten(split).dictionary_encode()
        ids, known = word.indices.to_numpy(zero_copy_only=False).astype(np.int64), word.dictionary.to_pylist()
        text = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths, planes, heads = names.column("_n").to_numpy(), _planes(known), _starts(known)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for n in np.unique(lengths).tolist():
            starts = np.flatnonzero(text[: max(0, len(text) - n + 1)] == text[n - 1 :])
            if not len(starts):
                continue
            run, most = ids[starts], len(known)
            for k in range(1, n):
                if most * len(known) >= 1 << 62:
                    run = np.unique(run, return_inverse=True)[1]
                    most = int(run.max()) + 1
                run, most = run * len(known) + ids[starts + k], most * len(known)
            # Equal runs lie together; each different one stands for all its places.
            order = np.argsort(run, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(run[order]) != 0]))
            count, first = np.diff(np.append(edge, len(order))), starts[order[edge]]
            mine = np.flatnonzero(lengths == n)
            cleaned = names.column("cleaned_name").take(pa.array(mine)).to_pylist()
            for at in range(0, len(first), RUNS):
                place = first[at : at + RUNS]
                name, which, score = _close_pairs(cleaned, _Runs(np.array([ids[place + k] for k in range(n)]), known, planes, heads), threshold)
                times = count[at + which]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                owner = text[starts[order[np.repeat(edge[at + which], times) + step]]]
                found.append((owner, np.repeat(mine[name], times), np.repeat(score, times)))
        owner, name, score = (np.concatenate(x) for x in zip(*found))
        pair, at = np.unique(owner * max(1, len(names)) + name, return_inverse=True)
        most = np.zeros(len(pair))
        np.maximum.at(most, at, score)
        owner, name = pair // max(1, len(names)), pair % max(1, len(names))
        columns = [articles.column("news_id").take(pa.array(owner)), names.column("cleaned_name").take(pa.array(name)), pa.array(most)]
        return pa.table(columns, names=["news_id", "cleaned_name", "score"])

    return best


def fuzzy_matches(
    articles: DataFrame,
    companies: DataFrame,
    threshold: float = 0.88,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """J-8: best Jaro-Winkler score of a company name over the word runs of an article.

    Articles are dealt into groups of some hundred, and each group gets all different names. A group's different runs of
    as many words as a name has are compared with it once: a bound by common characters, which no match can violate,
    leaves few pairs for the exact score. No run is shuffled, and no more than a group is held at once.
    """
    names = names_to_match(companies).select("code", "name", "cleaned_name", "_n")
    groups = articles.agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.lit(1))).scalar()
    index = names.select("cleaned_name", "_n").distinct().withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)))
    # The words, one space between them.
    texts = articles.select(
        F.pmod(F.xxhash64("news_id"), groups).alias("_group"), "news_id", F.array_join(words(F.upper("content")), " ").alias("text")
    )
    id_type = articles.schema["news_id"].dataType.simpleString()
    found = texts.groupBy("_group").cogroup(index.groupBy("_group")).applyInArrow(
        _best_of_articles(threshold), f"news_id {id_type}, cleaned_name string, score double"
    ).join(names.drop("_n"), "cleaned_name")
    if exclude is not None:
        found = found.join(exclude.select("news_id", "code").hint("merge"), ["news_id", "code"], "left_anti")
    best = found.groupBy("news_id", "code", "name", "cleaned_name")
    return best.agg(F.round(F.max("score"), 4).alias("score")).select(
        "news_id", "code", "name", "cleaned_name", F.lit("fuzzy_name").alias("match_type"), "score"
    )


def match_articles(articles: DataFrame, companies: DataFrame, threshold: float = 0.88) -> DataFrame:
    """Exact matches, and fuzzy matches of the companies not matched exactly."""
    exact = exact_matches(articles, companies)
    return exact.unionByName(fuzzy_matches(articles, companies, threshold, exclude=exact))


def ordered_matches(matches: DataFrame) -> DataFrame:
    """T-1: exact first, then fuzzy by score; ties by code.

    One article has at most one row per company.
    """
    w = Window.partitionBy("news_id").orderBy(
        F.when(c("match_type") == "exact_kod", 0).otherwise(1), c("score").desc_nulls_last(), "code"
    )
    return matches.withColumn("rank", F.row_number().over(w))


def code_to_name(matches: DataFrame) -> DataFrame:
    """Matches of an article as one map from code to name."""
    return matches.groupBy("news_id").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("code", "name")))).alias("code_to_name")
    )


def with_company_name(df: DataFrame, matches: DataFrame) -> DataFrame:
    """J-9: name of each (news_id, code), the code itself where unknown."""
    names = matches.select("news_id", "code", c("name").alias("_name"))
    return df.join(names, ["news_id", "code"], "left").withColumn(
        "name", F.coalesce("_name", "code")
    ).drop("_name")
