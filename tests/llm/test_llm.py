"""The operators of fieldstrata.llm against brute force, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

llm = pytest.importorskip("fieldstrata.llm")

from fieldstrata.llm import bytededup, decontaminate, linededup, packing, piispans, qualitymil, qualityrules, simhash, toxicity, worddedup  # noqa: E402

WORDS = "alpha beta gamma delta river stone cloud maple ember frost lantern quiet harbor meadow copper violet".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, repeats, empty, null and long texts; extra columns with clashing names."""
    rng = random.Random(3)
    shared, line = prose(rng, 70), prose(rng, 25)
    rows = []
    for i in range(60):
        text = "\n".join(prose(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
        if i % 4 == 0:
            text += " " + shared + " " + prose(rng, 5)
        if i % 5 == 0:
            text += "\n" + line
        rows.append((i, text))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1].replace("river", "rivers", 1)), (103, ""), (104, None), (105, "x"), (106, "é" * 400), (107, "ab " * 400), (108, prose(rng, 5000)), (109, " \n\n ")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 7 else None, "en", 1, 2, 3, 4) for i, t in corpus], "doc_id long, text string, source string, lang string, node int, a int, n int, count int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def odd(spark):
    """Null and repeated ids, repeated rows."""
    t = "one two three four five six seven eight nine ten " * 6
    return spark.createDataFrame([(None, t, None), (1, t, "a"), (1, t, "a"), (2, None, "b"), (2, "other words here", "b")], "doc_id long, text string, source string")


def test_packing_round_trip(spark, docs, corpus):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    rows = packing.pack(spark, docs, length=128, block=4).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, windows = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["source"]))
    for i, t in corpus:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for w in sorted(windows):
        at = 0
        for offset, n, _ in sorted(windows[w]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == 128 for s in sizes[:-1]) and sorted(windows) == list(range(len(sizes)))
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    every = sum(total.values())
    for w in sorted(windows)[:-1]:
        took = Counter()
        for _, n, s in windows[w]:
            took[s] += n
        assert all(abs(took[s] - 128 * total[s] / every) <= 3 for s in total)


def test_packing_schedule_is_the_same_from_any_task():
    plan = packing.Schedule([1000, 17, 1, 5000], None, 64, 4)
    assert all((plan.given(k + 1) >= plan.given(k)).all() for k in range(plan.n_blocks))
    other = packing.Schedule([1000, 17, 1, 5000], None, 64, 4)
    pieces = [p for q, n in enumerate([1000, 17, 1, 5000]) for p in other.cut(q, 0, n)]
    halves = [p for q, n in enumerate([1000, 17, 1, 5000]) for a, b in ((0, n // 2), (n // 2, n - n // 2)) if b for p in plan.cut(q, a, b)]
    assert sum(p[1] for p in pieces) == sum(p[1] for p in halves) == 6018
    weighted = packing.Schedule([1000, 1000], [3.0, 1.0], 100, 2)
    first = [p for p in weighted.cut(0, 0, 1000)]
    assert first[0][1] == 75 and sum(p[1] for p in first) == 1000


def test_packing_odd(spark, empty):
    assert packing.pack(spark, empty).count() == 0
    assert packing.pack(spark, odd(spark)).count() >= 5


def test_packing_keeps_shares_beyond_4096_sources(spark):
    """Given weights and large sources hold in every window, whatever the number of small sources."""
    rows = [(i, "x", f"tail{i}") for i in range(5000)] + [(10000 + i, "alpha beta gamma delta " * 20, s) for i in range(60) for s in ("big", "heavy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(spark, docs, {"big": 12_000.0, "tail7": 10.0}, 2048, 4).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in rows}
    total, first = Counter(), Counter()
    for r in pieces:
        total[r["source"]] += r["length"]
        first[r["source"]] += r["length"] * (r["sequence_id"] == 0)
    weights = {**total, "big": 12_000.0, "tail7": 10.0}
    for s in ("big", "heavy"):
        want = 2048 * weights[s] / sum(weights.values())
        assert abs(first[s] - want) <= 0.1 * want, s
    queues = {r["source"]: r["queue"] for r in packing.with_queues(docs, ["big", "tail7"]).select("source", "queue").distinct().collect()}
    assert {queues[s] for s in ("big", "heavy", "tail7")} == {"=big", "=heavy", "=tail7"} and len(set(queues.values())) <= 4098


def test_simhash_against_brute_force(docs, corpus):
    import xxhash

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    f = {i: fp(t) for i, t in corpus}
    comp = {i: i for i in f}
    for _ in range(9):
        for i in f:
            comp[i] = min(comp[j] for j in f if (f[i] ^ f[j]).bit_count() <= 2)
    assert all(int(got[i]["fingerprint"], 16) == f[i] and got[i]["component_id"] == comp[i] for i in f)


@pytest.mark.parametrize("most", [2, 32])
def test_simhash_links_connect_the_same(spark, most):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:15]:
        for _ in range(12):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([((x - (1 << 64)) if x >> 63 else x,) for x in fps], "fp long")
    edges = [((r["a"] & (1 << 64) - 1), (r["b"] & (1 << 64) - 1)) for r in simhash.links(df, most).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)

    def roots(pairs):
        p = {x: x for x in fps}

        def find(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        return [find(x) for x in fps]

    assert roots(edges) == roots([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])


def test_line_dedup_against_brute_force(docs, corpus):
    got = {(r["doc_id"], r["line_no"]): r for r in linededup.line_classes(docs).collect()}
    lines = {(i, k): x.strip(" ").lower() for i, t in corpus if t is not None for k, x in enumerate(t.split("\n"))}
    assert set(got) == set(lines)
    first = {}
    for at in sorted(lines):
        if len(lines[at]) >= 9:
            first.setdefault(lines[at], at)
    sets = {x: {x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in first}
    for at, x in lines.items():
        r = got[at]
        if len(x) < 9:
            assert r["kept"]
        else:
            c = (r["class_doc_id"], r["class_line_no"])
            assert r["kept"] == (c == at) and c <= at
            assert (got[first[x]]["class_doc_id"], got[first[x]]["class_line_no"]) == c
    alike = [(a, b) for i, a in enumerate(sets) for b in list(sets)[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    same = [got[first[a]]["class_doc_id"] == got[first[b]]["class_doc_id"] and got[first[a]]["class_line_no"] == got[first[b]]["class_line_no"] for a, b in alike]
    assert alike and np.mean(same) >= 0.9
    apart = [(a, b) for a in list(sets)[:30] for b in list(sets)[30:60] if (a, b) not in alike and (b, a) not in alike]
    assert sum(got[first[a]]["class_doc_id"] == got[first[b]]["class_doc_id"] and got[first[a]]["class_line_no"] == got[first[b]]["class_line_no"] for a, b in apart) <= len(apart) * 0.01


def test_line_dedup_links_crowded_groups(spark):
    """Two originals with hundreds of small edits each: many variants resemble their original only."""
    rng = random.Random(21)
    rows = []
    for _ in range(2):
        hub = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(24))
        rows.append(hub)
        for _ in range(300):
            x = list(hub)
            for _ in range(rng.randint(1, 3)):
                x[rng.randrange(len(x))] = rng.choice("qrstuvwxyz")
            rows.append("".join(x))
    rng.shuffle(rows)
    got = linededup.line_classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                r, s = find(i), find(j)
                comp[max(r, s)] = min(r, s)
    want = {i: find(i) for i in range(len(rows))}
    right = sum(want[r["doc_id"]] == r["class_doc_id"] for r in got)
    assert len(got) == len(rows) and right >= 0.98 * len(rows), right


def test_line_dedup_bands_meet(spark):
    """Share of pairs at a verified similarity of 0.8 to 0.9 that have a band in common, for short and longer lines."""
    rng = random.Random(22)
    pairs = []
    while len(pairs) < 600:
        a = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range((8, 10, 15, 20)[len(pairs) % 4]))
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] = rng.choice("qrstuvwxyz")
        b = "".join(b)
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            pairs.append((a, b))
    assert bands_met(spark, pairs) >= 0.98 * len(pairs)


def bands_met(spark, pairs):
    """How many of the pairs have a band in common."""
    rows = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "doc_id long, text string")
    bands = {}
    for r in linededup.signed(linededup.lines_of(rows, 1)).collect():
        bands.setdefault(int(r["first"]) >> 32, set()).update((r["kind"], i, r[f"b{i}"]) for i in range(linededup.PARTS) if r[f"b{i}"] is not None)
    return sum(bool(bands[2 * i] & bands[2 * i + 1]) for i in range(len(pairs)))


@pytest.mark.parametrize("words, swap", [(24, False), (32, False), (60, False), (120, False), (32, True), (60, True), (120, True)])
def test_line_dedup_bands_meet_in_long_lines(spark, words, swap):
    """Lines on both sides of the border between the two kinds of signature, and longer ones; edits of characters and of words."""
    rng = random.Random(words)
    pairs = []
    while len(pairs) < 300:
        word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
        a = [word() for _ in range(words)]
        b = list(a) if swap else list(" ".join(a))
        for _ in range(rng.randint(1, max(2, words // 5))):
            b[rng.randrange(len(b))] = word() if swap else rng.choice("qrstuvwxyz")
        a, b = " ".join(a), (" " if swap else "").join(b)
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            pairs.append((a, b))
    met = bands_met(spark, pairs)
    print("bands", words, swap, met / len(pairs))
    assert met >= 0.95 * len(pairs)


def test_line_dedup_short_lines(spark):
    """Exact copies of short lines go, whatever their script; blank lines stay."""
    rows = [(1, "Home\n\nles.\n \t"), (2, "home\n\nles.\n首页"), (3, "首页\nx\n \t"), (None, "x")]
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["kept"]) for r in linededup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    again = {(2, 0): (1, 0, False), (2, 2): (1, 2, False), (3, 0): (2, 3, False), (3, 1): (None, 0, False)}
    assert got == {(d, i): again.get((d, i), (d, i, True)) for d, t in rows for i in range(len(t.split("\n")))}


def test_line_dedup_is_native(docs):
    plan = linededup.line_classes(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_documents(spark, docs, empty, corpus):
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert 3 in out and 100 not in out and 101 not in out and 104 in out and out[103] == ""
    assert linededup.dedup_lines(docs).columns == docs.columns
    assert linededup.line_classes(empty).count() == 0
    assert linededup.line_classes(odd(spark)).count() == 4


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(20, 60)))) for i in range(12)]
    rows = []
    for n in range(60):
        x = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 9)):
            j = rng.randrange(len(x))
            x[j : j + 1] = rng.choice([[], [rng.choice("abcd ")], [x[j], rng.choice("abcd")]]) or ["a"]
        rows.append((n, "".join(rng.choice("abcd ") for _ in range(40)) + "".join(x) + "".join(rng.choice("abcd ") for _ in range(40))))
    rows += [(90, None), (91, "")]
    items = [(i, decontaminate.normal(t)) for i, t in items]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.15, 5).collect()}
    want = {}
    for n, t in rows:
        t = decontaminate.normal(t)
        for i, item in items:
            prev = [0] * (len(t) + 1)
            for a, ch in enumerate(item, 1):
                cur = [a]
                for c in range(1, len(t) + 1):
                    cur.append(min(prev[c] + 1, cur[-1] + 1, prev[c - 1] + (ch != t[c - 1])))
                prev = cur
            if min(prev) <= int(0.15 * len(item)) and len(item) >= 5:
                want[n, i] = min(prev)
    assert got == want and want


def test_decontaminated_rows(spark, docs, empty, corpus):
    items = spark.createDataFrame([(1, " ".join(corpus[8][1].split()[:30])), (2, None), (3, "short")], "item_id long, text string")
    left = {r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()}
    assert 8 not in left and {1, 2, 103, 104} <= left
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def brute_bytes(texts, size):
    seen = Counter(b[a : a + size] for b in texts for a in range(len(b) - size + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b), bool)
        for a in range(len(b) - size + 1):
            if seen[b[a : a + size]] > 1:
                m[a : a + size] = True
        out.append((len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1, 2000])
def test_byte_dedup_against_brute_force(docs, corpus, most, monkeypatch):
    if most == 1:
        monkeypatch.setattr(bytededup.repeated_places, "__defaults__", (200, 64, 1, 500_000))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in bytededup.dedup_bytes(docs).collect()}
    want = brute_bytes([(t or "").encode() for _, t in corpus], 200)
    assert got == {i: w for (i, _), w in zip(corpus, want, strict=True)}
    assert sum(w[1] for w in want) > 0


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for size in (3, 4, 5, 8, 13, 20):
        x = np.concatenate([rng.integers(0, 3, 90), [97], rng.integers(0, 2, 60), np.arange(30) % 3, [98], np.arange(40) % 3, [99]])
        got = bytededup.repeated_starts(x, size)
        c = Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1))
        assert got[: len(x) - size + 1].tolist() == [c[tuple(x[i : i + size])] > 1 for i in range(len(x) - size + 1)]


def test_word_dedup_against_brute_force(docs, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in worddedup.dedup_words(docs).collect()}
    first, words = {}, {i: (t or "").encode().split() for i, t in corpus}
    for i in sorted(words):
        for a in range(len(words[i]) - 19):
            first.setdefault(tuple(words[i][a : a + 20]), (i, a))
    removed = 0
    for i, w in words.items():
        m = [False] * len(w)
        for a in range(len(w) - 19):
            if first[tuple(w[a : a + 20])] != (i, a):
                m[a : a + 20] = [True] * 20
        removed += sum(m)
        assert got[i] == (len(w), sum(m), hashlib.sha256(b" ".join(x for x, y in zip(w, m, strict=True) if not y)).hexdigest())
    assert removed > 0


def test_dedup_odd(spark, empty):
    assert worddedup.dedup_words(empty).count() == 0 and bytededup.dedup_bytes(empty).count() == 0
    rows = worddedup.dedup_words(odd(spark)).collect()
    assert len(rows) == 5 and {r["n_removed"] for r in rows if r["doc_id"] == 1} == {60}
    assert sum(r["n_removed"] > 0 for r in bytededup.dedup_bytes(odd(spark)).collect()) == 3


def test_dedup_many_texts_of_one_id(spark):
    """Texts of different lengths that share the null id are told apart."""
    rng = random.Random(31)
    shared = [prose(rng, 60) for _ in range(20)]
    texts = [prose(rng, rng.randint(1, 30)) + " " + str(i) + " " + rng.choice(shared) + " " + prose(rng, rng.randint(0, 30)) for i in range(600)]
    rows = bytededup.dedup_bytes(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == sorted(brute_bytes([t.encode() for t in texts], 200))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_emails_equal_the_pattern():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("a@.b-1 2+%") for _ in range(rng.randint(1, 30)))
        assert list(piispans.emails(t)) == [m.span() for m in EMAIL.finditer(t)]


def test_pii(spark, empty):
    t = "Mail jo.d@example.com or call +1 (555) 123-4567. Card 4111 1111 1111 1111, card 4111 1111 1111 1112; ip 10.0.0.1 and 300.1.1.1. Call 555-123-4567."
    rows = piispans.find(spark.createDataFrame([(1, t), (2, None), (3, ""), (None, t)], "doc_id long, text string")).collect()
    r = next(r for r in rows if r["doc_id"] == 1)
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    base = [f"email:{t.index('jo.d')}:{t.index(' or')}", f"phone:{t.index('+1')}:{t.index('. Card')}", f"card:{t.index('4111')}:{t.index(', card')}", f"ip:{t.index('10.0')}:{t.index(' and 300')}"]
    assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert set(base) <= set(r["spans"].split(","))
    assert len(rows) == 4 and next(r for r in rows if r["doc_id"] == 2)["spans"] == ""
    assert piispans.find(empty).count() == 0


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(4)
    truth = rng.random(20000) < 0.3
    hit, alarm = np.array([0.9, 0.8, 0.7, 0.85, 0.6]), np.array([0.1, 0.2, 0.3, 0.05, 0.4])
    votes = (rng.random((20000, 5)) < np.where(truth[:, None], hit, alarm)).astype(int)
    votes[rng.random((20000, 5)) < 0.2] = -1
    share, h, a = piispans.reliabilities(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.3) < 0.05 and np.abs(h - hit).max() < 0.06 and np.abs(a - alarm).max() < 0.06


def test_quality_rules(spark, docs, empty, corpus):
    got = {r["doc_id"]: r for r in qualityrules.judge(docs).collect()}
    for i, t in corpus:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
        m = set()
        for a in range(len(w) - 4):
            if c[tuple(w[a : a + 5])] > 1:
                m |= set(range(a, a + 5))
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(m))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(m) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert qualityrules.judge(empty).count() == 0
    assert {r["kept"] for r in qualityrules.judge(odd(spark)).collect()} == {False}


def labelled(spark, rng, bad, kind):
    rows, labels = [], []
    for i in range(400):
        y = i % 4 == 0
        rows.append((i, bad(rng) if y else prose(rng, rng.randint(20, 150))))
        labels.append((i, int(y) if kind == "toxic" else int(not y)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {kind} int"), dict(labels)


def test_toxicity_held_out(spark, empty):
    rng = random.Random(9)
    docs, labels, y = labelled(spark, rng, lambda r: prose(r, 40) + f" you {r.choice(['nasty', 'n4sty', 'n a s t y', 'naaasty', 'vilest', 'v1l3st'])} " + prose(r, 40) + r.choice([" nasty", " vilest"]) * (r.random() < 0.7), "toxic")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1).collect()}
    held = [i for i in y if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == y[i] for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(empty, labels).count() == 0
    assert len(toxicity.score(odd(spark), labels).collect()) == 5
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert len(kept & {i for i in y if not y[i]}) >= 295 and len(kept & {i for i in y if y[i]}) <= 5


def test_restores_disguised_words():
    counts = Counter()
    for w in ["idiot", "stupid", "trash", "loser", *WORDS]:
        s = toxicity.EDGE * 2 + w + toxicity.EDGE
        counts.update(s[i : i + 3] for i in range(len(s) - 2))
    m = toxicity.CharModel(counts)
    for written, word in (("1d10t", "idiot"), ("stuuuupid", "stupid"), ("tr@sh", "trash"), ("l0s3r", "loser"), ("s.t.u.p.i.d", "stupid"), ("river", "river")):
        assert toxicity.restored_token(written, m) == word
    assert [toxicity.restore(x.group(), m) for x in toxicity._APART.finditer("an i d i o t here")] == ["idiot"]


def test_restores_spaced_words_and_long_runs():
    counts = Counter()
    for w in ["idiot", "stupid", "shit", "ass", "you", "are", *WORDS, *"youstpid"]:
        s = toxicity.EDGE * 2 + w + toxicity.EDGE
        counts.update(s[i : i + 3] for i in range(len(s) - 2))
    of = toxicity.Scorer(toxicity.CharModel(counts), 18)
    for written, word in (("a s s", "ass"), ("$ h i t", "shit"), ("1 d i o t", "idiot"), ("s h | t", "shit"), ("y o u s t u p i d", "stupid"), ("y o u a r e s t u p i d " * 3, "stupid"), ("idi" + "o" * 80 + "t", "idiot")):
        assert set(of.token(word)) <= set(of.features(f"the river {written.strip()} 12").tolist()), written
    assert toxicity.restored_token("river", of.model) == "river"


def test_quality_classifier_held_out(spark, empty):
    rng = random.Random(11)
    docs, labels, y = labelled(spark, rng, lambda r: " ".join(r.choice(WORDS).upper() + "!!" for _ in range(60)) if r.random() < 0.5 else (r.choice(WORDS) + " ") * 80, "quality")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["score"] for r in qualitymil.score(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0).collect()}
    held = [i for i in y if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == y[i] for i in held]) > 0.97
    assert qualitymil.score(empty, labels).count() == 0
    assert len(qualitymil.score(odd(spark), labels).collect()) == 5


def test_attention_gradients():
    rng = np.random.default_rng(2)
    net = qualitymil.Network()
    x, starts, y = rng.normal(size=(12, qualitymil.FEATURES)), np.array([0, 3, 4, 9]), np.array([1.0, 0, 1, 0])
    loss = lambda: -np.mean(y * np.log(net.forward(x, starts)[0]) + (1 - y) * np.log(1 - net.forward(x, starts)[0]))
    p, kept = net.forward(x, starts)
    g = net.gradients(p, y, kept, starts)
    for k in ("W", "V", "U", "w", "s"):
        at = (0,) * net.p[k].ndim
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        down = loss()
        net.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_pipeline_against_its_stages(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{src}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, src)
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        assert 0 < kept.count() <= docs.count()
        docs = kept
    tokens = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, src).collect()} == tokens
    benchmark = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    assert not any(b in decontaminate.normal(r["text"]) for r in docs.collect() for b in benchmark)
