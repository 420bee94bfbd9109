"""Base spans against the given patterns by brute force; added spans by precision and recall on planted ones."""

import hashlib
import random
import re

from fieldstrata.llm import piispans

KINDS = ("email", "ip", "card", "phone")
GIVEN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_ok(digits):
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in GIVEN.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn_ok(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), KINDS.index(kind), m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_by_brute_force(spark):
    r = random.Random(5)
    bits = ["a@b.co", "x.y@", "@c-d.org.", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+44", "12", " ", "-", ".", "+", "@", "ñ", "\n", "7" * 19, "5500000000000004", "(0)", "%"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(600)] + [(1000, None), (1001, ""), (7, "a@b.co"), (7, "a@b.co"), (None, "a@b.co"), (1002, "x " * 200_000 + "a@b.co")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = sorted((str(x["doc_id"]), x["base_sha256"], sum(x[f"n_{k}"] for k in KINDS)) for x in piispans.find(docs).collect())
    want = sorted((str(i), hashlib.sha256(brute(t or "").encode()).hexdigest(), len([s for s in brute(t or "").split(",") if s])) for i, t in rows)
    assert got == want
    assert piispans.find(docs.limit(0)).count() == 0


def test_added_spans(spark):
    r = random.Random(6)
    words = "the of and to in is that for it was on are as with".split()
    rows, planted = [], {}
    for i in range(400):
        parts = [r.choice(words) for _ in range(r.randint(20, 60))]
        if i % 4 == 0:
            secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
            at = r.randint(3, 15)
            parts[at] = f'token = "{secret}"'
            planted[i] = " ".join(parts).index(secret), secret
        rows.append((i, " ".join(parts)))
    got = {x["doc_id"]: x["spans"].split(",") for x in piispans.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["spans"]}
    want = {i: f"secret:{a}:{a + len(s)}" for i, (a, s) in planted.items()}
    found = sum(w in got.get(i, []) for i, w in want.items())
    added = sum(s.startswith("secret") for x in got.values() for s in x)
    assert found / len(want) > 0.95 and found / max(added, 1) > 0.95
