"""Line dedup and SimHash near-dedup where doc_ids are null or repeated over different texts: nothing is lost that no row
repeats, and nothing repeated stays. Against brute force."""

import random

import pytest

pytest.importorskip("fieldstrata.llm")

from fieldstrata.llm import linededup, simhash, stages  # noqa: E402

KINDS = "doc_id long, text string, source string, row_ long, fp long, row long, component int"
WORDS = "alpha beta gamma delta river stone cloud maple ember frost lantern quiet harbor meadow copper violet walnut signal orbit canvas".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, 4) for i, t, s in rows], KINDS).repartition(3)


def grams(line):
    line = line.strip().lower()
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def union(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.fixture(scope="module")
def rows():
    """A third of the ids null, one id over several texts, equal lines at equal numbers, near copies, repeated rows."""
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = [prose(12) for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [prose(rng.randint(8, 14)) for _ in range(3)]
        lines[rng.randrange(3)] = rng.choice(shared) + rng.choice(["", "", "!"])
        rows.append((None if i % 3 == 0 else 7 if i % 10 == 1 else i, "\n".join(lines), f"s{i}"))
    rows += [(7, shared[0] + "\nzulu precious unique line that nobody else has", "x"), (7, shared[0] + "\nother words of another row with the same id", "y")]
    return rows + [rows[0], rows[1], (None, None, "n"), (None, "", "e"), (7, " \n ", "b")]


def test_lines(spark, rows):
    """Every non-blank line is left exactly once per class, in some row; others stay as they were."""
    out = linededup.dedup_lines(frame(spark, rows)).collect()
    before = [ln for _, t, _ in rows if t and t.strip() for ln in t.split("\n")]
    roots = union(len(before), lambda a, b: len(grams(before[a]) & grams(before[b])) >= 0.8 * len(grams(before[a]) | grams(before[b])))
    place = {}
    for ln, r in zip(before, roots, strict=True):
        place.setdefault(ln, r)
    left = [ln for r in out if r.text and r.text.strip() for ln in r.text.split("\n")]
    assert sorted(place[ln] for ln in left) == sorted(set(roots))
    assert any("zulu precious" in ln for ln in left) and any("another row with the same id" in ln for ln in left)
    assert sum(r.text is None for r in out) == 1 and sum(r.text is not None and not r.text.strip() for r in out) == 2
    assert set(out[0].asDict()) == {x.split()[0] for x in KINDS.split(", ")}
    # each row's own lines, in order
    texts = {(i, s): t.split("\n") for i, t, s in rows if t}
    for r in out:
        if r.text:
            whole = iter(texts[r.doc_id, r.source])
            assert all(ln in whole for ln in r.text.split("\n"))


def test_first_line_stays(spark, rows):
    """Null ids come first, then doc_id, then line number."""
    named = [(i, t, s) for i, t, s in rows[:60] if i not in (None, 7)]
    got = {(r.doc_id, r.line_no): r for r in linededup.line_classes(frame(spark, named)).collect()}
    lines = sorted((i, k, ln) for i, t, _ in named for k, ln in enumerate(t.split("\n")))
    roots = union(len(lines), lambda a, b: len(grams(lines[a][2]) & grams(lines[b][2])) >= 0.8 * len(grams(lines[a][2]) | grams(lines[b][2])))
    for (i, k, _), root in zip(lines, roots, strict=True):
        r = got[i, k]
        assert (r.class_doc_id, r.class_line_no, r.kept) == (*lines[root][:2], lines[root][:2] == (i, k))


def test_documents(spark, rows):
    """One row of each group, with the smallest named doc_id; all groups stay."""
    near = rows + [(i, t + " tail", "near") for i, t, _ in rows[5:8]] + [(None, rows[10][1], "null copy"), (7, rows[10][1], "seven"), (3, rows[11][1], "three")]
    fps = [simhash.fingerprint(t or "") for _, t, _ in near]
    roots = union(len(near), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    want = sorted(repr(min(((i is None, i or 0) for (i, _, _), r in zip(near, roots, strict=True) if r == root))) for root in set(roots))
    out = simhash.one_of_each(frame(spark, near)).collect()
    assert sorted(repr((r.doc_id is None, r.doc_id or 0)) for r in out) == want
    of = {}
    for (i, t, s), r in zip(near, roots, strict=True):
        of[i, t, s] = r
    assert sorted(of[r.doc_id, r.text, r.source] for r in out) == sorted(set(roots))


def test_verdict_case(spark):
    """Rows (1, a), (null, a), (null, b), (3, c), (7, c), (7, d): a, b, c and d all stay once."""
    a, b, c, d = (" ".join(WORDS[k:] + WORDS[:k]) for k in (0, 3, 7, 11))
    rows = [(1, a, ""), (None, a, ""), (None, b, ""), (3, c, ""), (7, c, ""), (7, d, "")]
    out = [(r.doc_id, r.text) for r in stages.one_of_each_group(spark, frame(spark, rows), "").collect()]
    assert sorted(out, key=repr) == sorted([(1, a), (None, b), (3, c), (7, d)], key=repr)


def test_empty_tables(spark):
    for stage in (stages.without_repeated_lines, stages.one_of_each_group):
        out = stage(spark, frame(spark, []), "")
        assert out.count() == 0 and out.columns == [x.split()[0] for x in KINDS.split(", ")]
