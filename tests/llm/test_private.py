import hashlib
import random
import re

from tickerloom.llm import private

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return [s for *_, s in sorted(found)]


def check(docs):
    """Base spans equal the patterns'; returns the spans that the method added, by id."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = private.personal_data(docs).collect()
    assert len(rows) == docs.count()
    added = {}
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
        spans = [s for s in r["spans"].split(",") if s]
        assert set(want) <= set(spans) and len(set(spans)) == len(spans)
        order = [(int(s.split(":")[1]), list(PATTERNS).index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
        added[r["doc_id"]] = [s for s in spans if s not in want]
    return added


EDGE = [
    "", None, " ", "a@b.c_d@e.f", "x@y.", "a@b..c", "@a.b", "é.x@a-b.de!", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "12.34.56", "1.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111111111", "+1 (403) 555-9312+44 20 7946 0958 +1 2 +123456789012345678", "+49 30 ((--)) 1234567.",
    "\U0001f600 mail a@b.co\n\U0001f600 10.0.0.1", "9" * 5_000, "a" * 5_000, "a@" + "b." * 3_000 + "c", "1." * 3_000, "+1" + "(" * 3_000, "1 " * 3_000, "a@b.c " * 300, "a@b.c", "a@b.c",
]


def test_base_spans_on_edges(make_docs):
    check(make_docs(EDGE))


def test_base_spans_on_random_texts(make_docs):
    rng = random.Random(6)
    pieces = ["a", "Z9", "@", ".", "..", "-", "_", "+", "1", "255", "256", "4111111111111111", " ", "  ", "\n", "(", ")", "é", "\U0001f600", "com", "+49", "0171"]
    check(make_docs(["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)]))


def test_given_documents(sample):
    check(sample("documents"))


def test_method_adds_spans_with_support(make_docs):
    """Written-out numbers after a cue are taken, numbers after a counter cue are not."""
    rng = random.Random(1)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts = [f"please call +1 ({n(3)}) 555-{n(4)} now" for _ in range(60)]
    texts += [f"order number {n(16)} is here" for _ in range(60)] + [f"phone: (212) 555-{n(4)} today" for _ in range(30)]
    added = check(make_docs(texts))
    assert sum(any(s.startswith("phone") for s in added[i]) for i in range(120, 150)) >= 27
    assert not any(added[i] for i in range(60, 120))


def test_reliabilities_by_planted_labelers():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.3
        votes = []
        for right in (0.95, 0.8, 0.7, 0.55):
            votes.append("yes" if (rng.random() < right) == true else "no")
        key = " ".join(["0", *votes])
        counts[key] = counts.get(key, 0) + 1
    post, share = private.reliabilities(counts)
    assert post["0 yes yes yes yes"] > 0.9 and post["0 no no no no"] < 0.1
    assert abs(share["pattern", True]["yes"] - 0.95) < 0.08 and abs(share["gazetteer", False]["no"] - 0.8) < 0.08


def test_redaction(make_docs):
    docs = make_docs(["mail a@b.co or 10.0.0.1!", "nothing here", "", None, "\U0001f600 4111 1111 1111 1111", "+1 (403) 555-9312"])
    got = {r["doc_id"]: r for r in private.redacted(docs).collect()}
    assert [got[i]["text"] for i in range(6)] == ["mail [EMAIL] or [IP]!", "nothing here", "", None, "\U0001f600 [CARD]", "[PHONE]"]
    assert got[0]["n_chars"] == len(got[0]["text"]) and got[3]["n_chars"] is None
    assert private.redacted(docs).columns == docs.columns and private.redacted(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(make_docs):
    plan = private.redacted(make_docs(["a@b.co"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
