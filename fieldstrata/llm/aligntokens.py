"""Alignment of two tokenizers: which tokens of one overlap which tokens of the other, and where both end together.

Texts travel in blocks of bounded size. In a block every token has a place on one line of bytes (the documents' bytes
behind one another), and two ``merge_asof`` passes, keyed by document, find for each token start the other side's token
that covers it. Two tokens overlap exactly if one of them covers the other's start, so the union of both directions is
the set of overlaps; where the starts are equal both find the same pair, which is kept once, and a new group begins
(all tokens before it end together).

How often an id pair is linked in the whole corpus is found by Spark. A block is staged as one row: its distinct
id pairs with their numbers of links, and each document's links as places in that list. The pairs of all blocks are
summed, the sums return to each block as one list of counts, and the documents' sums are read off it. Only distinct
pairs of blocks are shuffled, besides the blocks themselves: no link ever becomes a row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, staged, texts

#: One id pair as a number: that times A's id, plus B's.
BASE = 1 << 20
#: Per document: doc_id, counts, digest, and how many of the block's ``codes`` and ``times`` are its own.
BLOCK = "doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, own array<bigint>, codes binary, times binary, pairs array<bigint>, totals array<bigint>"
DOCS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class Tokenizers:
    """A byte-level vocabulary of ranks (A) and a piece model with byte fallback (B), with each token's bytes."""

    def __init__(self, ranks_file: str, pattern: str, piece_model: str):
        import sentencepiece
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_size[list(ranks.values())] = [len(k) for k in ranks]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, batch: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space+text by A and of text by B. Texts that are empty or not given back byte by byte have none.

        A's tokens are the text's own bytes in order, so their total length decides; B may rewrite characters.
        """
        a, b = [], []
        for text, ids_b in zip(batch, self.b.encode(batch, num_threads=1), strict=True):
            spaced = " " + text
            raw = spaced.encode()
            if text and b"".join(map(self.b_bytes.__getitem__, ids_b)) == raw:
                ids_a = self.a.encode_to_numpy(spaced, allowed_special=set(), disallowed_special=())
                if self.a_size[ids_a].sum() == len(raw):
                    a.append(ids_a.astype(np.int64))
                    b.append(np.array(ids_b, np.int64))
                    continue
            a.append(np.empty(0, np.int64))
            b.append(np.empty(0, np.int64))
        return a, b


@cache
def tokenizers(ranks_file: str | None = None, pattern: str | None = None, piece_model: str | None = None) -> Tokenizers:
    import public_tokenizers as P

    return Tokenizers(ranks_file or P.path("byte_bpe_50k.tiktoken"), pattern or P.PATTERN, piece_model or P.path("piece_bpe_32k.model"))


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of all overlapping tokens, and for each side whether a token begins where one of the other side does.

    Both sides cover the same bytes of each document; starts grow along a block, documents included.
    """
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "i": np.arange(len(doc_a)), "from": start_a})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "j": np.arange(len(doc_b)), "from": start_b})
    by_a = pd.merge_asof(a[["doc", "at"]], b, on="at", by="doc")
    by_b = pd.merge_asof(b[["doc", "at"]], a, on="at", by="doc")
    open_a, open_b = by_a["from"].to_numpy() == start_a, by_b["from"].to_numpy() == start_b
    inside = np.flatnonzero(~open_b)
    return np.concatenate([np.arange(len(a)), by_b["i"].to_numpy()[inside]]), np.concatenate([by_a["j"].to_numpy(), inside]), open_a, open_b


@cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0, 1, ..., n - 1, zero-padded on the right, with a free last place; their numbers."""
    words = np.array([str(i) for i in range(n)], f"S{len(str(n - 1)) + 1}")
    return words.view(np.uint8).reshape(n, -1), np.char.str_len(words)


def group_digests(ids_a: np.ndarray, open_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, open_b: np.ndarray, n_b: np.ndarray) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` for each document (token numbers n_a, n_b); '' for one without tokens."""
    if not len(ids_a):
        return [""] * len(n_a)
    first_a, first_b = np.flatnonzero(open_a), np.flatnonzero(open_b)
    end_a = np.append(first_a[1:], len(ids_a))
    at_a = np.arange(len(ids_a)) + first_b[np.cumsum(open_a) - 1]
    at_b = np.arange(len(ids_b)) + end_a[np.cumsum(open_b) - 1]
    order, follow = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    order[at_a], order[at_b] = ids_a, ids_b
    follow[at_a[end_a - 1]] = ord("|")
    follow[at_b[np.append(first_b[1:], len(ids_b)) - 1]] = ord(";")
    digits, width = _digits(BASE if len(order) and order.max() >= 65536 else 65536)
    cells, w = digits[order], width[order]
    cells[np.arange(len(order)), w] = follow
    written = cells[cells != 0]
    ends = np.append(0, np.cumsum(w + 1))[np.append(0, np.cumsum(n_a + n_b))]
    return [hashlib.sha256(written[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Aligned:
    """The alignment of a list of texts: ids, links (i, j) over all its tokens, group beginnings, counts per text."""

    def __init__(self, both: Tokenizers, batch: list[str]):
        a, b = both.encode(batch)
        self.n_a, self.n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        self.ids_a, self.ids_b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        self.doc_a, self.doc_b = np.repeat(np.arange(len(a)), self.n_a), np.repeat(np.arange(len(b)), self.n_b)
        self.start_a, self.start_b = starts(both.a_size[self.ids_a]), starts(both.b_size[self.ids_b])
        self.i, self.j, self.open_a, self.open_b = overlaps(self.doc_a, self.start_a, self.doc_b, self.start_b)
        self.doc = self.doc_a[self.i]

    def digests(self) -> list[str]:
        return group_digests(self.ids_a, self.open_a, self.n_a, self.ids_b, self.open_b, self.n_b)


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts of about that many characters (one text may have more)."""
    ids, block, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts(batch), strict=True):
            if block and size + len(text) > chars:
                yield ids, block
                ids, block, size = [], [], 0
            ids.append(doc_id)
            block.append(text)
            size += len(text)
    if block:
        yield ids, block


def _block_row(doc_ids: list, al: Aligned) -> pa.RecordBatch:
    """A block as one row. Distinct pairs of the block are numbered; each document has its pairs' numbers and counts."""
    docs = len(doc_ids)
    code, pairs = pd.factorize(al.ids_a[al.i] * BASE + al.ids_b[al.j])
    entries, times = np.unique(al.doc * max(len(pairs), 1) + code, return_counts=True)
    doc, code = np.divmod(entries, max(len(pairs), 1))
    totals = np.bincount(code, times, len(pairs)).astype(np.int64)
    links, groups = np.bincount(al.doc, minlength=docs), np.bincount(al.doc_a[al.open_a], minlength=docs)
    row = {"doc_id": doc_ids, "n_a": al.n_a, "n_b": al.n_b, "n_groups": groups, "n_links": links, "groups_sha256": al.digests(), "own": np.bincount(doc, minlength=docs)}
    row |= {"codes": code.astype(np.uint32).tobytes(), "times": times.astype(np.uint32).tobytes(), "pairs": pairs, "totals": totals}
    kinds = {"doc_id": pa.list_(pa.int64()), "groups_sha256": pa.list_(pa.string()), "codes": pa.binary(), "times": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()], names=list(row))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from blocks whose pairs have got their corpus-wide counts (doubled, plus one for a B id's highest)."""
    for batch in batches:
        for k in range(batch.num_rows):
            flat = {n: column(batch, n)[k].values for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "own")}
            codes, times = (np.frombuffer(column(batch, n)[k].as_py(), np.uint32) for n in ("codes", "times"))
            counts = column(batch, "counts")[k].values
            counts = np.zeros(0, np.int64) if counts is None else counts.to_numpy()
            own, times = flat.pop("own").to_numpy(), times.astype(np.int64)
            ends = np.append(0, np.cumsum(own))
            for name, each in (("count_sum", counts[codes] >> 1), ("n_best", counts[codes] & 1)):
                sums = np.append(0, np.cumsum(each * times))
                flat[name] = pa.array(sums[ends[1:]] - sums[ends[:-1]])
            names = [x.split()[0] for x in DOCS.split(", ")]
            yield pa.RecordBatch.from_arrays([flat[n] for n in names], names=names)


def links(docs: DataFrame, chars: int = 1_000_000, **vocabularies: str) -> DataFrame:
    """One row per overlap of two tokens: doc_id, a and b (places in the document), a_id, b_id, start and end (bytes of
    space+text that both cover), a_group (its group's place). Conventions as in ``alignment``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(**vocabularies)
        for doc_ids, block in _blocks(batches, chars):
            al = Aligned(both, block)
            size_a, size_b, first_a, first_b = both.a_size[al.ids_a], both.b_size[al.ids_b], starts(al.n_a), starts(al.n_b)
            begin, group = (al.start_a[first_a[al.n_a > 0]], np.cumsum(al.open_a) - 1)
            offset, first_group = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            offset[al.n_a > 0], first_group[al.n_a > 0] = begin, group[first_a[al.n_a > 0]]
            lo = np.maximum(al.start_a[al.i], al.start_b[al.j]) - offset[al.doc]
            hi = np.minimum((al.start_a + size_a)[al.i], (al.start_b + size_b)[al.j]) - offset[al.doc]
            ids = pa.array(doc_ids, pa.int64()).take(pa.array(al.doc))
            out = [ids, al.i - first_a[al.doc], al.j - first_b[al.doc], al.ids_a[al.i], al.ids_b[al.j], lo, hi, group[al.i] - first_group[al.doc]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["doc_id", "a", "b", "a_id", "b_id", "start", "end", "a_group"])

    kinds = "doc_id bigint, a bigint, b bigint, a_id bigint, b_id bigint, start bigint, end bigint, a_group bigint"
    return doc_columns(docs, "doc_id", "text").mapInArrow(run, kinds)


def alignment(docs: DataFrame, chars: int = 1_000_000, **vocabularies: str) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level vocabulary on space+text, B the piece model on text; both without special tokens, whose strings
    in a text are plain text. Texts that are null or empty, or that B's pieces do not spell byte by byte, have no tokens:
    zeros and ''. n_best counts links whose id pair has, corpus-wide, the most links of all pairs with that B id (ties
    included), count_sum adds the pairs' corpus-wide links. Null and repeated doc_ids are rows like any others, as are
    repeated rows, whose links all count. A very long text is a block of its own. An empty table gives no rows; other
    columns are ignored. ``chars`` only bounds a block; ``vocabularies`` names other files (see ``tokenizers``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(**vocabularies)
        for doc_ids, block in _blocks(batches, chars):
            yield _block_row(doc_ids, Aligned(both, block))

    blocks = staged(doc_columns(docs, "doc_id", "text").mapInArrow(run, BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("at", "x")).select("block", "at", "x.pairs", "x.totals")
    counts = staged(pairs.groupBy("pairs").agg(F.sum("totals").alias("n")), "counts")
    highest = counts.groupBy((F.col("pairs") % BASE).alias("b")).agg(F.max("n").alias("highest"))
    value = counts.join(highest, F.col("pairs") % BASE == F.col("b")).select("pairs", (F.col("n") * 2 + (F.col("n") == F.col("highest")).cast("int")).alias("value"))
    back = pairs.select("block", "at", "pairs").join(value, "pairs").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"))
    back = back.select("block", F.transform("v", lambda x: x["value"]).alias("counts"))
    whole = blocks.drop("pairs", "totals").join(back, "block", "left").drop("block")
    return whole.mapInArrow(_sums, DOCS)
