"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

1. Every line of every document is lower-cased and trimmed; equal lines are one node, told apart by 96 bits of hash.
2. Signature: hashes of the line's 5-character shingles (of a long line, the characters that begin its words), sorted. A
   band's value is made of the four hashes that follow one of eight (twelve) fixed points on the circle of hashes, which
   are the four smallest under a rotation of the hash order: two lines agree on it with probability J^4.
3. Lines that share a band's value are candidates. At first each meets its bucket's centre. Buckets whose members are
   then still in different groups: where all but a few belong to the largest group, each of the few meets every member;
   elsewhere two further centres, those with most links, are tried. Even then every member outside the largest group
   meets every other one, in a join by bucket that compares bitmaps of their shingles and puts out only the pairs that
   may reach the threshold: differing bits bound the number of differing shingles from below. So no pair of a bucket is
   given up, and no bucket's pairs are all listed.
4. Candidates are verified by the exact Jaccard similarity of all their 5-character shingles.
5. Distributed union-find (``components``) groups verified lines; the first line of each group by (doc_id, line number) stays.

A line's place is its row's number in a staged copy of the table and its line number, so rows that share a doc_id or have
none are told apart, and no step gathers the rows of one doc_id.

The text of candidates crosses the network on its way to verification; all else moves hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialise import tasks
from .common import doc_columns, narrow, numbered, staged, unstage
from .components import components

BAND_ROWS, PARTS, VERIFY, SHORT = 4, 12, 5, 200
#: 64-bit words of a line's bitmap. Bits of long lines coincide more often, which leaves more pairs to be verified.
WORDS = 32
#: Kind 0 has parts -4 to 3, kind 1 parts -8 to 3.
BAND_NAMES = [f"a{i}" for i in range(4, PARTS)] + [f"b{i}" for i in range(PARTS)]
#: Each match steps over a word (16 characters of a long one, or one character of a script that is written without
#: spaces) and captures the seven characters that start there.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\uffff"
ANCHOR = rf"(?=(.{{1,7}}))(?:[{_ALONE}]|[^ {_ALONE}]{{1,16}}) *"
#: Shingles that begin with a space, thus with a word.
STARTS = rf"(?=( [^ ].{{{VERIFY - 2}}})) "


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, line_no, line, h, g): the hashes are null for blank lines and those of under ``least`` characters.
    Without a column ``row`` in docs, doc_id alone tells rows apart."""
    docs = docs if "row" in docs.columns else docs.withColumn("row", F.lit(0).cast("bigint"))
    cut = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    line = cut.select("row", "doc_id", "line_no", F.lower(F.trim("raw")).alias("line"))
    written = F.ascii("line").between(33, 126) | F.col("line").rlike(r"(?U)\S")  # most lines need no pattern
    long = (F.char_length("line") >= least) & written
    return line.select("row", "doc_id", "line_no", "line", F.when(long, F.xxhash64("line")).alias("h"), F.when(long, F.hash("line")).alias("g"))


#: (doc_id, line_no) as one number in the same order, null doc_ids first; and back.
NO_ID = str(-(1 << 63) - 1)


def packed(doc_id: str, line_no: str) -> F.Column:
    return (F.coalesce(F.col(doc_id).cast("decimal(20,0)"), F.lit(NO_ID).cast("decimal(20,0)")) * F.lit(1 << 32).cast("decimal(11,0)") + F.col(line_no)).cast("decimal(32,0)")


def unpacked(first: str) -> tuple[F.Column, F.Column]:
    no = F.pmod(F.col(first), F.lit(1 << 32).cast("decimal(11,0)")).cast("long")
    doc = ((F.col(first) - no) / F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(20,0)")
    return F.when(doc != F.lit(NO_ID).cast("decimal(20,0)"), doc.cast("long")), no.cast("int")


def _ring(rows: DataFrame) -> DataFrame:
    """rows (h, g, first, row, kind, s) with band values b0, b1, ... in place of the hashes s.

    Sorted, the hashes lie on a circle, cut into eight parts for kind 0 and sixteen for kind 1, of which twelve count. A
    band is the first four hashes from a part's beginning on; an empty part gives none (it would repeat the next one's).
    """
    keys = ("h", "g", "first", "row", "kind")
    rows = rows.select(*keys, F.sort_array("s").alias("s"))
    rows = rows.select(*keys, F.expr("transform(s, x -> shiftright(x, 61 - kind))").alias("part"), F.concat("s", F.slice("s", 1, BAND_ROWS)).alias("around"))
    rows = rows.select(*keys, "around", *[F.array_position("part", F.lit(i - 8).cast("long")).cast("int").alias(f"at{i}") for i in range(PARTS)])
    return rows.select(*keys, *[F.when(F.col(f"at{i}") > 0, F.xxhash64("kind", F.lit(i), F.slice("around", F.col(f"at{i}"), F.lit(BAND_ROWS)))).alias(f"b{i}") for i in range(PARTS)])


def starts(line: str) -> F.Column:
    """The shingles that begin with a space: about one in six, and the same ones in any line that has them."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(STARTS), F.lit(1)))


def signed(lines: DataFrame) -> DataFrame:
    """(h, g, first, row, kind, b0, b1, ...): band values of every line.

    Lines of under ``SHORT`` characters draw them from all their shingles (kind 0), others from the seven characters at the
    beginnings of words (kind 1), which fewer unrelated lines share; within a fifth below ``SHORT``, as much as two lines
    of one class can differ, from both. A line of few such beginnings for its length (saying the same again and again)
    draws them from all its shingles, too.
    """
    rows = lines.select("h", "g", packed("doc_id", "line_no").alias("first"), "row", "line", F.char_length("line").alias("n"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(ANCHOR), F.lit(1)), lambda x: F.xxhash64(x)))
    rows = rows.withColumn("words", F.when(F.col("n") >= SHORT * 0.8, words))
    every = F.when((F.col("n") < SHORT) | (F.size("words") < 30), shingles("line"))
    return _ring(rows.select("h", "g", "first", "row", F.posexplode_outer(F.array(every, F.col("words"))).alias("kind", "s")).filter("s is not null"))


def shingles(line: str) -> F.Column:
    """The distinct hashes of all character shingles of a line (the whole line if it is shorter than one).

    The line in four bytes a character is bound once, by the outer lambda, and cut by place.
    """
    last = F.greatest(F.char_length(line) - VERIFY, F.lit(0))
    cut = F.transform(F.array(F.encode(line, "UTF-32")), lambda wide: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(wide, i * 4 + 1, F.lit(4 * VERIFY)))))
    return F.array_distinct(F.get(cut, F.lit(0)))


def jaccard(a: str, b: str) -> F.Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def possible(threshold: float) -> F.Column:
    """Whether two lines may have that Jaccard similarity, by their numbers of shingles m and n and starting shingles x and y.

    Every starting shingle of only one line is a shingle of only that line: with p of them in the first and q in the
    second, the lines share at most m - p and n - q shingles and have at least m + q and n + p together. Hashes that
    collide only make p and q smaller, which leaves the bound true.
    """
    p, q = F.size(F.array_except("x", "y")), F.size(F.array_except("y", "x"))
    sizes = F.least("m", "n") >= F.greatest("m", "n") * threshold - 1e-9
    return sizes & (F.least(F.col("m") - p, F.col("n") - q) >= F.greatest(F.col("m") + q, F.col("n") + p) * threshold - 1e-9)


def _bucketed(nodes: DataFrame, temp: list[DataFrame]) -> DataFrame:
    """(band, node, n, center) of the buckets of two or more; the centre is the member with the smallest
    number, as arbitrary as a hash (numbers go by it), which most links then lead to as components need them.

    The buckets' sizes are staged, so that a bucket's rows meet them in a plain join that can split a large one.
    """
    rows = nodes.select("node", F.explode(F.array(*BAND_NAMES)).alias("band")).filter("band is not null")
    sizes = staged(rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("center")).filter("n > 1"), "sizes")
    temp.append(sizes)
    return rows.join(sizes, "band").select("band", "node", "n", "center")


def _ordered(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _apart(rows: DataFrame, named: DataFrame, temp: list[DataFrame]) -> DataFrame:
    """(band, node, tried, component, largest, outside) of the buckets whose members are in more than one group: each
    member's group, the bucket's largest one and how many members are outside it."""
    of = staged(rows.select("band", "node", "tried").join(named.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node")), "apart")
    count = of.count()
    sizes = of.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), (F.sum("k") - F.max("k")).alias("outside"))
    mixed = staged(narrow(sizes.filter("outside > 0"), count), "mixed")
    temp += [of, mixed]
    return narrow(of.join(mixed, "band"), count)


def _few_outside(apart: DataFrame, few: int) -> DataFrame:
    """(a, b): in buckets with at most ``few`` members outside the largest group, these with all members of other groups."""
    rows = apart.filter(F.col("outside") <= few)
    lone = rows.filter("component <> largest").select("band", F.col("node").alias("other"), F.col("component").alias("of_other"))
    return rows.join(lone, "band").filter("component <> of_other").select(*_ordered("node", "other"))


def _hubs(crowd: DataFrame, links: DataFrame, temp: list[DataFrame]) -> DataFrame:
    """Rows (band, node, tried, component) with the bucket's next centre: of members not tried yet the one with most links."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    rank = F.struct(F.coalesce("degree", F.lit(0)), F.xxhash64("node"))
    centre = staged(narrow(crowd.filter("not tried").join(degree, "node", "left").groupBy("band").agg(F.max_by(F.struct("node", "component"), rank).alias("center")), crowd.count()), "centres")
    temp.append(centre)
    return crowd.join(centre, "band").select("band", "node", "tried", "component", F.col("center.node").alias("center"), F.col("center.component").alias("of_center"))


def _bitmaps(lines: DataFrame, crowd: DataFrame, temp: list[DataFrame]) -> DataFrame:
    """(node, size, bits), staged: the number of each node's shingles and a bitmap that has one bit set for each of them.

    A node's bitmap is made inside its row: its hashes are dealt to quarters, and each quarter gives every fourth word.
    """
    row = lambda s: F.struct(F.size(s).alias("size"), _bits(s).alias("bits"))
    made = F.get(F.transform(F.array(shingles("line")), row), F.lit(0)).alias("made")  # the set is bound once
    out = staged(crowd.select("node").distinct().join(lines, "node").select("node", made).select("node", "made.size", "made.bits"), "bitmaps")
    temp.append(out)
    return out


def _bits(s: F.Column) -> F.Column:
    """``WORDS`` words of 64 bits, of which an array of hashes sets one a hash: its last bits tell the word, the next six the bit."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 5).bitwiseAND(63).cast("int"))
    word = lambda part, i: F.aggregate(part, F.lit(0).cast("long"), lambda have, x: F.when(F.shiftright(x, 2).bitwiseAND(WORDS // 4 - 1) == i, have.bitwiseOR(bit(x))).otherwise(have))
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.filter(s, lambda x: x.bitwiseAND(3) == j))
    return F.flatten(F.transform(quarters, lambda part: F.transform(F.sequence(F.lit(0), F.lit(WORDS // 4 - 1)), lambda i: word(part, i))))


def _across(bitmaps: DataFrame, crowd: DataFrame, threshold: float, most: int = 256) -> DataFrame:
    """(a, b): of each bucket every member outside the largest group with every member of another group, where their bitmaps
    leave the threshold possible. A bit that only one of two lines has set stands for a shingle of only that line, and no
    two bits for the same one: lines of m and n shingles that differ in d have the similarity (m + n - d) / (m + n + d).

    Those outside meet the bucket in parts of about ``most``, so a large bucket is work for many tasks. Of the buckets that
    two nodes share, the smallest puts their pair out, and of two nodes outside only the larger one meets the other.
    """
    n, last = tasks(crowd), F.floor((F.col("outside") - 1) / most)
    words = [f"w{i}" for i in range(WORDS)]  # columns that are never null: comparing them is compiled to little code
    wide = bitmaps.select("node", "size", *[F.coalesce(F.get("bits", F.lit(i)), F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)])
    wide = wide.join(crowd.groupBy("node").agg(F.collect_set("band").alias("bands")), "node")  # twenty at most
    rows = crowd.select("band", "node", "component", "largest", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), last.alias("last")).join(wide, "node")
    lone = rows.filter((F.col("component") != F.col("largest")) & (F.col("part") == F.pmod(F.xxhash64("node"), F.col("last") + 1)))
    lone = lone.select("band", "part", F.col("node").alias("other"), F.col("component").alias("of_other"), F.col("size").alias("other_size"), F.col("bands").alias("other_bands"), *[F.col(w).alias(f"other_{w}") for w in words])
    bits = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in words), F.lit(0))
    both = F.col("size") + F.col("other_size")
    meet = (F.col("component") != F.col("of_other")) & ((F.col("component") == F.col("largest")) | (F.col("node") < F.col("other")))
    once = F.col("band") == F.array_min(F.array_intersect("bands", "other_bands"))
    alike = lambda differ: both - differ >= (both + differ) * threshold - 1e-9
    met = rows.drop("last").repartition(n, "band", "part").join(lone.repartition(n, "band", "part"), ["band", "part"])
    return met.filter(meet & alike(F.abs(F.col("size") - F.col("other_size"))) & alike(bits) & once).select(*_ordered("node", "other"))


def candidate_lines(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, line, size, begins) of every node in a pair, from its first place: size is its number of shingles, begins
    holds hashes of its ``starts``. Both are found once a line, however many pairs it is in."""
    _, no = unpacked("first")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first", "row"), "node")
    by_row = wanted.select("node", "row", no.alias("line_no")).groupBy("row").agg(F.collect_list(F.struct("line_no", "node")).alias("at"))
    found = docs.select("row", "text").join(by_row.hint("shuffle_hash"), "row").select(F.split("text", "\n", -1).alias("all"), F.explode("at").alias("at"))
    line = found.select("at.node", F.lower(F.trim(F.get("all", F.col("at.line_no")))).alias("line"))
    return line.select("node", "line", F.size(shingles("line")).alias("size"), F.transform(starts("line"), lambda x: F.hash(x)).alias("begins"))


def verified(lines: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose lines have at least that Jaccard similarity; only those that ``possible`` leaves
    meet their texts."""
    left = lines.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("begins").alias("x"))
    right = lines.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("begins").alias("y"))
    near = pairs.join(left, "a").join(right, "b").filter(possible(threshold)).select("a", "b")
    both = near.join(lines.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    sets = both.select("a", "b", shingles("x").alias("x"), shingles("y").alias("y"))
    return sets.filter(jaccard("x", "y") >= threshold).select("a", "b")


def regrouped(named: DataFrame, more: DataFrame) -> DataFrame:
    """named (node, component) after further links (a, b): only groups that a link joins are gone over anew."""
    of = lambda end: named.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(ends.filter("a <> b"))
    alone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(named, "node", "left_anti").withColumn("component", F.col("node"))
    whole = named.select("node", "component").union(alone)
    return staged(whole.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "named")


def line_classes(docs: DataFrame, threshold: float = 0.8, least: int = 1, few: int = 16, rounds: int = 3) -> DataFrame:
    """One row per line: doc_id, line_no, class_doc_id, class_line_no (the class's first line), kept.

    Blank lines (and those of under ``least`` characters) are kept, each in a class of its own.
    Null text has no lines; an empty text has one blank line. Every row is a document of its own, whatever its doc_id:
    null comes first, and of equal lines at the same line number of rows that share a doc_id one is first, so repeated
    rows keep their lines once. Columns other than doc_id and text are ignored. An empty table gives no rows.
    """
    docs, row = numbered(doc_columns(docs, "doc_id", "text"))
    return _classes(docs.withColumnRenamed(row, "row"), threshold, least, few, rounds).drop("row")


def _classes(docs: DataFrame, threshold: float = 0.8, least: int = 1, few: int = 16, rounds: int = 3) -> DataFrame:
    """``line_classes`` of documents with row numbers (row, doc_id, text), which its rows carry as well."""
    bands = [F.min(F.when(F.col("kind") == "ab".index(name[0]), F.col(f"b{name[1:]}"))).alias(name) for name in BAND_NAMES]
    nodes = signed(lines_of(docs, least).filter("h is not null")).groupBy("h", "g").agg(F.min("first").alias("first"), F.min_by("row", "first").alias("row"), ((F.min("first") < F.max("first")) | (F.min("row") < F.max("row"))).alias("again"), *bands)
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    temp: list[DataFrame] = []  # staged tables that nothing reads once the next one is written
    buckets = staged(_bucketed(nodes, temp), "buckets")
    pairs = staged(buckets.filter("node <> center").select(*_ordered("node", "center")).distinct(), "pairs")
    lines = staged(candidate_lines(docs, nodes, pairs), "lines")  # later rounds only pair the same lines anew
    links = staged(verified(lines, pairs, threshold), "links")
    unstage(*temp, pairs)
    temp.clear()
    named = components(links)
    crowd, before = buckets.filter("n > 2").select("band", "node", (F.col("node") == F.col("center")).alias("tried")), [buckets]
    for turn in range(rounds):
        apart = staged(_apart(crowd, named, temp), "apart")
        unstage(*temp, *before)
        temp.clear()
        before = [apart]
        if apart.isEmpty():
            break
        pairs, crowd = _few_outside(apart, few), apart.filter(F.col("outside") > few)
        if turn + 1 < rounds:
            stars = staged(_hubs(crowd, links, temp), "stars")
            before.append(stars)
            crowd = stars.select("band", "node", (F.col("tried") | (F.col("node") == F.col("center"))).alias("tried"))
            pairs = pairs.union(stars.filter("component <> of_center").select(*_ordered("node", "center")))
        elif not crowd.isEmpty():  # decided exactly
            pairs = pairs.union(_across(_bitmaps(lines, crowd, temp), crowd, threshold))
        more = staged(verified(lines, pairs.distinct(), threshold), "links")
        unstage(*temp)
        temp.clear()
        if not more.isEmpty():
            links = links.union(more)
            named = regrouped(named, more)
    unstage(*before, lines)
    firsts = staged(named.join(nodes.select("node", "first", "row"), "node").groupBy("component").agg(F.min("first").alias("class_first"), F.min_by("row", "first").alias("class_row")), "firsts")
    merged = named.join(firsts, "component").select("node", "class_first", "class_row")
    # a line that is alone in its node and class is its own first
    firsts = nodes.select("node", "h", "g", "first", "row", "again").join(merged, "node", "left").filter("again or class_first is not null").select("h", "g", F.coalesce("class_first", "first").alias("first"), F.coalesce("class_row", "row").alias("first_row"))
    place = packed("doc_id", "line_no")
    out = lines_of(docs, least).drop("line").join(firsts, ["h", "g"], "left").withColumn("own", F.col("first").isNull() | ((F.col("first") == place) & (F.col("first_row") == F.col("row")))).withColumn("first", F.coalesce("first", place))
    doc, no = unpacked("first")
    return out.select("row", "doc_id", "line_no", doc.alias("class_doc_id"), no.alias("class_line_no"), F.col("own").alias("kept"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents (all their columns) without the lines that ``line_classes`` does not keep.

    A document all of whose judged lines go, and which has no other words, goes too; documents that were null or blank
    stay as they are. Lines go from the row they are in, so null and repeated doc_ids lose nothing that is not repeated.
    """
    columns = docs.columns
    docs, row = numbered(docs)
    classes = _classes(docs.select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), **options)
    drop = classes.filter("not kept").groupBy(F.col("row").alias(row)).agg(F.collect_set("line_no").alias(f"{row}lines"))
    whole, gone = docs.join(drop, row, "left"), F.col(f"{row}lines")
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    return whole.withColumn("text", text).filter(gone.isNull() | (F.trim("text") != "")).select(*columns)
