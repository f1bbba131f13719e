"""Operator 12: round trips, the same bytes whatever the partitions, and damage that is found."""

import gzip
import hashlib
import os
import random

import pytest

from gavel.llm import warc as W

PAGES = "page_id long, url string, html string"


def _rows(rng, n=300):
    texts = ["", None, "é" * 50, "<p>same</p>", "x" * 9] + [f"<p>{rng.random()}</p>" * 40 for _ in range(20)]
    rows = [(rng.choice([None, i, i, i, 7, -(1 << 62), (1 << 62) + i]), rng.choice([None, "http://a/b c\n", f"http://x/{i}"]), rng.choice(texts)) for i in range(n)]
    return rows + rows[:40]


def _expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row, as a multiset."""
    key = lambda p: (p is not None, p or 0)
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page, url))
    out = []
    for data, found in groups.items():
        best = max((p for p, _ in found), key=key)
        for i, (page, _) in enumerate(sorted(found, key=lambda x: key(x[0]), reverse=True)):
            first = i == 0 or len(data) < least
            out.append((page, len(data), W.base32_sha1(data), "response" if first else "revisit", None if first else best))
    return sorted(map(repr, out))


def _told(df):
    return sorted(repr(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, tmp_path, least):
    rows = _rows(random.Random(3))
    manifest = W.write_archives(spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", digest int"), str(tmp_path / "a"), file_bytes=3000, least_bytes=least)
    files = manifest.collect()
    assert len(files) > 4 and sum(f.records for f in files) == len(rows)
    assert sorted(f.name for f in files) == sorted(x for x in os.listdir(tmp_path / "a") if x.endswith(".gz"))
    assert not os.path.exists(tmp_path / "a" / "_temporary")
    for f in files:
        data = (tmp_path / "a" / f.name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (f.bytes, f.sha256)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    read = W.read_archives(spark, str(tmp_path / "a"), payload=True)
    assert _told(read) == _expected(rows, least)
    for r in read.filter("record_type = 'response'").collect():
        assert W.base32_sha1(bytes(r.payload)) == r.payload_digest and len(r.payload) == r.payload_bytes
    ids = [h["warc-record-id"] for f in files for h, _ in map(W.parse_record, W.members(open(tmp_path / "a" / f.name, "rb")))]  # noqa: SIM115
    assert len(set(ids)) == len(ids)


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    rows = _rows(random.Random(4))
    sums = []
    for n in (1, 7):
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame(rows, PAGES).repartition(n)
        sums.append(sorted((r.name, r.sha256) for r in W.write_archives(df, str(tmp_path / str(n)), file_bytes=2000).collect()))
    assert sums[0] == sums[1]


def test_ranges_cut_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(W, "LEAST_RANGE", 5000)
    monkeypatch.setattr(W, "CELLS", 4)
    rng = random.Random(6)
    rows = [(rng.choice([5, 5, None, rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(0, 300)]), f"u{i}", "x" * 100) for i in range(900)]
    compact = W._compact(spark.createDataFrame(rows, PAGES)).drop("html", "url").cache()
    starts = W.bounds(compact)
    assert starts == sorted(set(starts)) and len(starts) > 40
    from bisect import bisect_right
    from collections import Counter

    held = Counter(max(0, bisect_right(starts, (r.page_id is not None, r.page_id or 0, r.h)) - 1) for r in compact.collect())
    assert max(held.values()) * 300 <= 2.5 * 5000 and len(held) > 35


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "a")
    name = W.write_archives(spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], PAGES), folder).first().name
    data = (tmp_path / "a" / name).read_bytes()
    (tmp_path / "a" / name).write_bytes(data[:-5])
    with pytest.raises(Exception, match="ends inside a record"):
        W.read_archives(spark, folder).collect()
    plain = gzip.decompress(data).replace(b"page 3", b"page 4", 1)
    (tmp_path / "a" / name).write_bytes(b"".join(gzip.compress(b"WARC/1.1\r\n" + x) for x in plain.split(b"WARC/1.1\r\n")[1:]))
    with pytest.raises(Exception, match="damaged record"):
        W.read_archives(spark, folder).collect()


def test_files_that_were_moved_are_not_missed(spark, tmp_path):
    """A task that is run again after its files were renamed."""
    folder = str(tmp_path / "a")
    files = W.write_archives(spark.createDataFrame([(1, "u", "x")], PAGES), folder).withColumn("temporary", W.F.lit("_temporary/gone/x")).select(*[f.split()[0] for f in W.FILES.split(", ")])
    assert files.mapInArrow(W._mover(folder), W.FILES).count() == 1
    with pytest.raises(Exception, match="neither under"):
        files.withColumn("name", W.F.lit("other")).mapInArrow(W._mover(folder), W.FILES).count()


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "a")
    assert W.write_archives(spark.createDataFrame([], PAGES), folder).count() == 0
    assert W.read_archives(spark, folder).count() == 0
