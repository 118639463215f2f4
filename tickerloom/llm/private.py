"""Personal data: labelers vote on spans, expectation-maximisation finds how far to trust them, a classifier decides.

Fixed patterns give the base spans, which always stay. Matches that fail a pattern's test and looser patterns give
candidates. A pattern labeler, a gazetteer, a context labeler and an edge labeler vote on all spans (yes, no, abstain).
The votes of the whole corpus, counted by combination, are the input of the expectation-maximisation; its posteriors are
the labels of a naive Bayes classifier over features of the span, whose answer adds candidates to the base spans. All of
it is column expressions and aggregates; the driver sees counts of combinations only, whose number is fixed.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no text makes them slow: a run of characters is entered at its start only (or where
# the last match ended) and never given back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns: written-out mail addresses, version 6 addresses, national phone numbers.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}",
    "phone": r"(?:(?<![0-9+(.-])|\G)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a pattern to be tried.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Gazetteer: ends of domains, first digits of cards, country and area codes.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "be")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = r"^(?:1|33|34|39|41|43|44|49|32|31|351|45|46|47|48|61|81|86|91)"
#: Words before a span that speak for a kind, and words that speak against all kinds.
CUES = {
    "email": r"mail|contact|write|kontakt|contacto|schreib|escrib",
    "ip": r"\bip\b|server|host|address|login|adresse",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta|pago",
    "phone": r"phone|call|tel|fax|mobile|appel|anruf|llam",
}
AGAINST = r"token|key|order|invoice|version|isbn|sku|build|serial|article|\bref\b|\bid\b|[$€£]"
#: Characters before a span that the context labeler reads.
CONTEXT = 40

LABELERS = ("pattern", "gazetteer", "context", "edges")
VOTES = ("yes", "no", "none")
ROUNDS = 30
SMOOTHING = 0.5

_SPAN = "struct<kind:int,s:int,e:int,m:string,ok:boolean>"


def _matches(text: Column, pattern: str, hint: str | None) -> Column:
    """(s, e, m) of the leftmost non-overlapping matches, in code points: what splits a text lies between the matches."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out")))

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    tried = text.rlike("[0-9]") if hint is None else F.contains(text, F.lit(hint))
    return F.when(tried, found).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test: from the right, every second one counts double, by its digit sum."""

    def step(acc, i):
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        # At most 255, however many zeros lead.
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _as_spans(matches: Column, kind: str, ok) -> Column:
    return F.transform(matches, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), ok(x["m"]).alias("ok")).cast(_SPAN))


def _raw(text: Column) -> Column:
    """All matches of the base patterns, and whether they pass, as ``_SPAN``."""
    return F.concat(*[_as_spans(_matches(text, BASE[k], HINT[k]), k, partial(_passes, k)) for k in KINDS])


def _loose(text: Column) -> Column:
    """All matches of the looser patterns."""
    hint = {"email": "at", "ip": ":", "phone": None}
    return F.concat(*[_as_spans(_matches(text, p, hint[k]), k, lambda m: F.lit(False)) for k, p in LOOSE.items()])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "yes").when(no, "no").otherwise("none")


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for i, k in enumerate(KINDS):
        out = F.when(kind == i, values[k]).otherwise(out)
    return out


def _judged(text: Column, x: Column) -> Column:
    """A span with the labelers' votes and the classifier's features."""
    kind, m, digits = x["kind"], x["m"], _digits(x["m"])
    before = F.lower(F.substr(text, F.greatest(x["s"] - CONTEXT + 1, F.lit(1)), F.least(x["s"], F.lit(CONTEXT))))
    last = F.when(x["s"] > 0, F.substr(text, x["s"], F.lit(1))).otherwise("")
    following = F.substr(text, x["e"] + 1, F.lit(1))
    length = F.length(digits)
    pattern = _by_kind(
        kind,
        {
            "email": _vote(x["ok"], F.lit(False)),
            "ip": _vote(x["ok"], ~x["ok"] & F.contains(m, F.lit("."))),
            "card": _vote(x["ok"], ~x["ok"]),
            "phone": _vote(x["ok"], ~x["ok"] & F.startswith(m, F.lit("+"))),
        },
    )
    domain = F.regexp_extract(F.lower(m), r"([a-z0-9-]+)$", 1)
    known = _by_kind(kind, {"email": domain.isin(*DOMAINS), "ip": m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:"), "card": digits.rlike(ISSUERS), "phone": digits.rlike(COUNTRIES) | (length == 10)})
    cue = _by_kind(kind, {k: before.rlike(CUES[k]) for k in KINDS})
    word = r"^[\p{L}\p{N}_]$"
    votes = {
        "pattern": pattern,
        "gazetteer": _vote(known, ~known),
        "context": _vote(cue, before.rlike(AGAINST)),
        "edges": _vote(~last.rlike(word) & ~following.rlike(word), last.rlike(word) | following.rlike(word)),
    }
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[A-Za-z]+", "a"), "[0-9]+", "9"), r"(.{4}).*", "$1")
    features = [F.concat(F.lit(f"{n}="), v) for n, v in votes.items()]
    features += [
        F.concat(F.lit("digits="), F.least(length, F.lit(20)).cast("string")),
        F.concat(F.lit("length="), F.least(F.floor(F.length(m) / 8), F.lit(6)).cast("string")),
        F.concat(F.lit("shape="), F.pmod(F.hash(shape), F.lit(16)).cast("string")),
    ]
    features = [F.concat(kind.cast("string"), F.lit(":"), f) for f in features]
    return F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["ok"].alias("ok"), F.concat_ws(" ", kind.cast("string"), *votes.values()).alias("votes"), F.array(*features).alias("features"))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and ``_spans``: the base spans and the candidates of its text with votes and features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_raw", _raw(text)).withColumn("_loose", _loose(text))
    clear = lambda c: ~F.exists(F.col("_raw"), lambda b: b["ok"] & (b["s"] < c["e"]) & (c["s"] < b["e"]))
    digits = lambda c: F.length(_digits(c["m"]))
    failed = F.filter("_raw", lambda c: ~c["ok"] & ((c["kind"] != 2) | digits(c).between(12, 19)) & ((c["kind"] != 3) | digits(c).between(7, 15)) & clear(c))
    rows = rows.withColumn("_all", F.concat(F.filter("_raw", lambda c: c["ok"]), failed, F.filter("_loose", clear)))
    return rows.withColumn("_spans", F.transform("_all", lambda x: _judged(text, x))).drop("_raw", "_loose", "_all")


def reliabilities(counts: dict[str, int]) -> tuple[dict[str, float], dict]:
    """Expectation-maximisation over the counts of vote combinations ("kind vote vote ..."): the posterior of each
    combination, and each labeler's share of each vote among true and false spans."""
    rows = [(c.split(" "), n) for c, n in sorted(counts.items())]
    post = [min(0.95, max(0.05, 0.5 + 0.2 * (r[1:].count("yes") - r[1:].count("no")))) for r, _ in rows]
    share: dict = {}
    for _ in range(ROUNDS):
        prior = {}
        for k in {r[0] for r, _ in rows}:
            mine = [(p, n) for p, (r, n) in zip(post, rows) if r[0] == k]
            prior[k] = (sum(p * n for p, n in mine) + SMOOTHING) / (sum(n for _, n in mine) + 2 * SMOOTHING)
        for j, labeler in enumerate(LABELERS, 1):
            for true in (True, False):
                weights = {v: SMOOTHING for v in VOTES}
                for p, (r, n) in zip(post, rows):
                    weights[r[j]] += n * (p if true else 1 - p)
                total = sum(weights.values())
                share[labeler, true] = {v: w / total for v, w in weights.items()}
        post = []
        for r, _ in rows:
            odds = math.log(prior[r[0]] / (1 - prior[r[0]]))
            odds += sum(math.log(share[x, True][r[j]] / share[x, False][r[j]]) for j, x in enumerate(LABELERS, 1))
            post.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    return {" ".join(r): p for p, (r, _) in zip(post, rows)}, share


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def span_classifier(spans: DataFrame) -> dict[str, float]:
    """Log odds of each feature, and of each kind, from the ``_spans`` of all rows."""
    each = spans.select(F.explode("_spans").alias("x")).select("x.votes", "x.features")
    counts = {r[0]: r[1] for r in each.groupBy("votes").count().collect()}  # 4 * 3 ** 4 combinations at most
    if not counts:
        return {}
    post, _ = reliabilities(counts)
    each = each.withColumn("p", _lookup(post, F.col("votes")))
    # Every feature has a fixed number of values.
    rows = each.select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    totals = {}
    for r in rows:
        kind, name = r["f"].split("=")[0].split(":")
        t = totals.setdefault((kind, name), [0.0, 0.0, 0])
        t[0], t[1], t[2] = t[0] + r["yes"], t[1] + r["no"], t[2] + 1
    out = {}
    for r in rows:
        yes, no, values = totals[tuple(r["f"].split("=")[0].split(":"))]
        out[r["f"]] = math.log((r["yes"] + SMOOTHING) / (yes + SMOOTHING * values)) - math.log((r["no"] + SMOOTHING) / (no + SMOOTHING * values))
        out[f"{r['f'].split(':')[0]}:"] = math.log((yes + SMOOTHING) / (no + SMOOTHING))
    return out


def _kept(model: dict[str, float]) -> Column:
    """Base spans and the candidates that the classifier takes, by start, then kind."""
    odds = lambda x: F.aggregate(x["features"], _lookup(model, F.concat(x["kind"].cast("string"), F.lit(":"))), lambda a, f: a + _lookup(model, f))
    kept = F.filter("_spans", lambda x: x["ok"] | (odds(x) > 0) if model else x["ok"])
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["ok"].alias("ok"))))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _equal(i: int, x: Column) -> Column:
    return x == i


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts and digest are of the base spans, ``spans`` lists all spans as kind:start:end (code points, end exclusive).
    Null texts are empty. Rows that repeat stay, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = stored(with_spans(rows, "_text").drop("_text"))
    out = found.withColumn("_kept", _kept(span_classifier(found))).withColumn("_base", F.filter("_kept", lambda x: x["ok"]))
    kinds = F.transform("_base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, partial(_equal, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(F.col("_id").alias(id_col), *counts, F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("_kept")).alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets (overlapping ones by the first's).

    Texts without a span and null texts stay as they are; ``n_chars`` follows the text if there is such a column.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")).withColumn("_text", F.col(f"_row.`{text_col}`").cast("string"))
    rows = with_spans(packed, "_text")
    model = span_classifier(stored(with_spans(packed.select("_text"), "_text").select("_spans").where(F.size("_spans") > 0)))
    rows = rows.withColumn("_kept", _kept(model))
    text, labels = F.col("_text"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, x):
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(labels, x["kind"] + 1))
        new = F.struct(x["e"].alias("at"), piece.alias("out"))
        longer = F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["s"] >= acc["at"], new).otherwise(longer)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("_kept", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn("_new", F.when(text.isNotNull() & (F.size("_kept") > 0), done))
    new = F.col("_new")
    change = {text_col: F.coalesce(new, F.col(f"_row.`{text_col}`")), "n_chars": F.coalesce(F.length(new).cast("long"), F.col("_row.`n_chars`")) if "n_chars" in names else None}
    return rows.select(*[(change[c] if change.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in names])
