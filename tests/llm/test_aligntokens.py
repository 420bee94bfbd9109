"""Cross-tokenizer alignment against a plain loop over bytes."""

import hashlib
import random
from collections import Counter

import pytest

pytest.importorskip("fieldstrata.llm")

from fieldstrata.llm import aligntokens  # noqa: E402

DOCS = "doc_id long, text string, block string, pairs int, n int"
TEXTS = [
    "hello world", "", None, "a<|endoftext|>b  \n\n <s> </s> <0x41> é", "spaces   and\ttabs \n", "日本語のテキスト 🙂🙂", "has ▁ in it", " lead", "x", "\x00ctl", "ﬁne   nbsp", "hello world",
    "antidisestablishmentarianism's 12345 67", "é combining", "\r\n\r\n",
]


def brute(rows):
    """Per row (n_a, n_b, groups text, links as id pairs), by the tokenizers' own libraries and byte by byte."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    out = []
    for text in rows:
        raw = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(spelt[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append((0, 0, [], []))
            continue
        at_a, at_b = [i for i, x in enumerate(bytes_a) for _ in x], [j for j, x in enumerate(bytes_b) for _ in x]
        pairs = sorted({*zip(at_a, at_b, strict=True)})
        groups, ga, gb = [], [at_a[0]], [at_b[0]]
        for k in range(1, len(raw)):
            if at_a[k] != at_a[k - 1] and at_b[k] != at_b[k - 1]:
                groups.append((ga, gb))
                ga, gb = [], []
            ga, gb = ga + [at_a[k]] * (at_a[k] != at_a[k - 1]), gb + [at_b[k]] * (at_b[k] != at_b[k - 1])
        groups.append((ga, gb))
        out.append((len(ids_a), len(ids_b), [",".join(str(ids_a[i]) for i in x) + "|" + ",".join(str(ids_b[j]) for j in y) for x, y in groups], [(ids_a[i], ids_b[j]) for i, j in pairs]))
    return out


def expected(rows):
    found = brute(t for _, t in rows)
    count = Counter(x for *_, links in found for x in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        (repr(i), n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (i, _), (n_a, n_b, groups, links) in zip(rows, found, strict=True)
    )


def got(df):
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


@pytest.mark.parametrize("chars", [40, 1_000_000])
def test_alignment(spark, chars):
    """Null, empty and odd texts, null and repeated ids, repeated rows, clashing columns; small blocks and one block."""
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id here"), (None, TEXTS[3]), (3, "other text"), (0, "hello world")]
    rows += [(100 + k, "".join(rng.choice("ab cé\n.9日 thequick") for _ in range(rng.randint(0, 80)))) for k in range(60)]
    assert got(aligntokens.alignment(frame(spark, rows).repartition(3), chars)) == expected(rows)


def test_long_and_empty(spark):
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice(["alpha", "bétà", "x1", "日本"]) for _ in range(30_000))), (2, "z" * 5000), (3, "short")]
    assert got(aligntokens.alignment(frame(spark, rows), 20_000)) == expected(rows)
    assert aligntokens.alignment(frame(spark, [])).count() == 0
    assert got(aligntokens.alignment(frame(spark, [(1, None), (2, "")]))) == expected([(1, None), (2, "")])


def test_links(spark):
    """Links as rows: the same pairs, bytes that both tokens cover, groups counted from zero."""
    rows = list(enumerate(TEXTS))
    found = brute(TEXTS)
    by_doc = {}
    for r in aligntokens.links(frame(spark, rows), 30).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, (_, _, groups, links) in enumerate(found):
        mine = sorted(by_doc.get(i, []), key=lambda r: (r.a, r.b))
        assert [(r.a_id, r.b_id) for r in mine] == links
        if mine:
            assert mine[0].start == 0 and max(r.end for r in mine) == len((" " + TEXTS[i]).encode()) and {r.a_group for r in mine} == set(range(len(groups)))
            assert [r.start for r in mine] == [0, *[r.end for r in mine][:-1]]


def test_query(spark):
    """The registered query over a whole table."""
    from fieldstrata.llm.queries import op13_token_alignment

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_token_alignment(spark, sf)) == expected(rows)
