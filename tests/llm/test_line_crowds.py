"""Buckets of many near copies that are not linked: what the last step of line dedup lists, and how groups grow."""

import random

import pytest

pytest.importorskip("fieldstrata.llm")

from fieldstrata.llm import components, linededup  # noqa: E402


def test_crowded_bucket_lists_only_pairs_that_may_link(spark):
    rng = random.Random(31)
    hub = [rng.choice("abcdefghijklmnop") for _ in range(200)]

    def edited(edits):
        x = list(hub)
        for i in rng.sample(range(len(x)), edits):
            x[i] = rng.choice("qrstuvwxyz")
        return "".join(x)

    texts = [edited(2) for _ in range(60)] + [edited(rng.randint(4, 16)) for _ in range(30)]
    lines = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    crowd = spark.createDataFrame([(b, i, 0 if i < 60 else i, 0, 30) for b in (1, 2, 3) for i in range(90)], "band long, node long, component long, largest long, outside long")
    temp = []
    got = {(r.a, r.b) for r in linededup._across(linededup._bitmaps(lines, crowd, temp), crowd, 0.8, 8).collect()}
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    apart = [(a, b) for b in range(60, 90) for a in range(b)]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in apart}
    true, near = {p for p, j in alike.items() if j >= 0.8}, {p for p, j in alike.items() if j >= 0.72}
    assert true and len(near) < len(apart) / 2
    assert true <= got <= near, (len(true), len(got), len(near), len(apart))


def test_groups_after_more_links(spark):
    rng = random.Random(32)
    first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(25)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rows = lambda named: sorted((r.node, r.component) for r in named.collect())
    assert rows(linededup.regrouped(components.components(frame(first)), frame(more))) == rows(components.components(frame(first + more)))


def test_bitmaps_are_made_inside_rows(spark, monkeypatch):
    plans, staged = [], linededup.staged

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, *rest)

    monkeypatch.setattr(linededup, "staged", noted)
    rng = random.Random(33)
    texts = ["ab", "", "x" * 40] + ["".join(rng.choices("abcdefgh \u00e9\u4e2d", k=rng.randint(5, 400))) for _ in range(60)]
    lines = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    crowd = spark.createDataFrame([(b, i) for b in (1, 2) for i in range(len(texts))], "band long, node long")
    got = {r.node: r for r in linededup._bitmaps(lines, crowd, []).collect()}
    assert plans and not any("Generate" in p for p in plans)  # no row for each shingle
    hashes = {r.node: set(r.s) for r in lines.select("node", linededup.shingles("line").alias("s")).collect()}
    for node, own in hashes.items():
        bits = [0] * linededup.WORDS
        for h in own:
            bits[h & (linededup.WORDS - 1)] |= 1 << ((h >> 5) & 63)
        assert got[node].size == len(own)
        assert sorted(b & ((1 << 64) - 1) for b in got[node].bits) == sorted(bits)  # the words' order does not matter


def test_a_pair_of_several_buckets_is_put_out_once(spark):
    rng = random.Random(34)
    hub = "".join(rng.choices("abcdefghijklmnop", k=200))
    lines = spark.createDataFrame([(i, hub[: 198 + i % 3]) for i in range(24)], "node long, line string")
    # two nodes out of three in each bucket; groups of two, node 0's is everywhere the largest
    crowd = [(b, i, i // 2, 0) for b in range(3) for i in range(24) if i < 2 or i % 3 != b]
    crowd = spark.createDataFrame([(*row, 14) for row in crowd], "band long, node long, component long, largest long, outside long")
    got = [(r.a, r.b) for r in linededup._across(linededup._bitmaps(lines, crowd, []), crowd, 0.8, 4).collect()]
    assert sorted(got) == [(a, b) for a in range(24) for b in range(a + 1, 24) if a // 2 != b // 2]


def test_small_edge_tables_need_few_steps_and_tasks(spark, monkeypatch):
    names, staged = [], components.staged

    def noted(df, name, *rest):
        out = staged(df, name, *rest)
        names.append((name, df.rdd.getNumPartitions() if name != "edges" or names else 0))
        return out

    monkeypatch.setattr(components, "staged", noted)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    named = components.components(frame([(0, i) for i in range(1, 200)] + [(500, 501), (600, 600)])).collect()
    assert {(r.node, r.component) for r in named} == {(i, 0) for i in range(200)} | {(500, 500), (501, 500), (600, 600)}
    assert [name for name, _ in names] == ["edges", "low"]  # stars already: nothing to do but to see it
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        names.clear()
        chain = components.components(frame([(i, i + 1) for i in range(40)])).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.node, r.component) for r in chain} == {(i, 0) for i in range(41)}
    assert max(n for _, n in names) <= spark.sparkContext.defaultParallelism
