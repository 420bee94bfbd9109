"""Seekable WARC bundles: round trips, standard readers, lookups by identifier, decisions against brute force."""

import base64
import hashlib
import io
import random

import pytest

pytest.importorskip("fieldstrata.llm")

from fieldstrata.llm import warc  # noqa: E402

PAGES = "page_id long, url string, html string, row long, payload string, record_type int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], PAGES)


def brute(rows, least=0):
    """Sorted (page_id, bytes, digest, type, refers_to)."""
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = n > 0 and len(payload) >= least
            out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Copies, null and repeated ids, repeated rows, null and empty payloads, odd urls, line ends, a long payload."""
    rng = random.Random(6)
    bodies = ["<p>" + "".join(rng.choice("abc é\r\n<>") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    rows = [(i, f"http://x.example/{i}", rng.choice(bodies)) for i in range(150)]
    rows += [(None, "u", bodies[0]), (None, None, bodies[0]), (7, "twice", bodies[1]), (7, "twice", bodies[1]), (200, None, None), (201, "a\r\nWARC-Type: evil", ""), (202, "ünï", ""), (-5, "neg", bodies[2])]
    return rows + [(203, "long", "é\r\n\r\n" * 200_000), (204, "marks", "WARC/1.1\r\n\r\n" * 3), (None, "only", "one of its kind"), (None, "only", "one of its kind")]


@pytest.mark.parametrize("least", [0, 50])
def test_archive(spark, rows, least):
    archive = warc.write(frame(spark, rows).repartition(3), least=least, frame_bytes=2000, bundle_bytes=20_000)
    assert got(warc.resolved(archive)) == brute(rows, least)
    assert archive.index.count() == archive.index.select("record_id").distinct().count() == len(rows)
    held = warc.read(archive, payload=True)
    assert sorted((r.payload.decode() for r in held.collect() if r.record_type == "response")) == sorted(b[2] or "" for b in _responses(rows, least))


def _responses(rows, least):
    seen, out = set(), []
    for r in rows:
        if len((r[2] or "").encode()) < least or (r[2] or "") not in seen:
            out.append(r)
        seen.add(r[2] or "")
    return out


def test_standard_readers(spark, rows):
    """A reader that knows nothing of seek tables gets the records one after another, of each bundle the warcinfo first."""
    import zstandard

    archive = warc.write(frame(spark, rows), frame_bytes=2000, bundle_bytes=20_000)
    files, path = warc.place(archive.folder)
    for (name,) in archive.index.select("bundle").distinct().collect():
        with files.open_input_file(f"{path}/{name}") as f:
            raw = f.read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        at, ids = 0, []
        while at < len(plain):
            head = plain.index(b"\r\n\r\n", at)
            fields = dict(x.split(": ", 1) for x in plain[at:head].decode().split("\r\n")[1:])
            end = head + 4 + int(fields["Content-Length"])
            assert plain[at:].startswith(b"WARC/1.1\r\n") and plain[end : end + 4] == b"\r\n\r\n"
            ids.append(fields["WARC-Record-ID"][1:-1])
            at = end + 4
        mine = archive.index.filter(archive.index.bundle == name).orderBy("frame", "offset").collect()
        assert ids[1:] == [r.record_id for r in mine]


def test_lookup(spark, rows):
    """One record by its identifier, from its frame alone."""
    archive = warc.write(frame(spark, rows), frame_bytes=2000)
    one = archive.index.filter("page_id = 203")
    found = warc.lookup(archive, one).collect()
    assert [(r.page_id, r.payload.decode()) for r in found] == [(203, "é\r\n\r\n" * 200_000)]
    odd = warc.lookup(archive, archive.index.filter("page_id = 201")).first()
    assert odd.url == "a%0D%0AWARC-Type: evil"


def test_damage_is_found(spark):
    raw = warc.record("urn:x", 1, "u", b"payload", "1970-01-01T00:00:00Z")
    assert warc.parsed(raw)[1] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_empty(spark):
    assert warc.resolved(warc.write(frame(spark, []))).count() == 0
    assert got(warc.resolved(warc.write(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")))) == brute([(1, None, None), (2, None, "")])


def test_query(spark):
    """The registered query over a whole table, against its SQL and brute force."""
    import duckdb

    from fieldstrata.llm.queries import op12_warc, oracle_sql

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    df = op12_warc(spark, sf)
    assert got(df) == brute(rows)
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = db.sql(oracle_sql()["op12_warc"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
