import hashlib

import pytest
from pyspark.sql import functions as F

from orbitweave.llm import warc
from orbitweave.llm.warc import audit_files, bit_rot, fixity_audit, read_warc, records_in, slot_of, with_names, write_warc


def pages(spark, n=100):
    rows = [(i, f"http://x.example/{i}", f"<p>page é {i} " + "x" * (i % 7), 1) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, hash int").repartition(4)


def test_files_hold_each_record_with_its_range(spark, tmp_path):
    write_warc(with_names(pages(spark, 20), 8), f"{tmp_path}/w")
    import glob
    import gzip

    whole = {p.split("file=")[1].split("/")[0]: gzip.open(p).read() for p in glob.glob(f"{tmp_path}/w/file=*/*.gz")}
    assert len(whole) == 3
    found = read_warc(spark, f"{tmp_path}/w", 8).collect()
    assert len(found) == 20
    for r in found:
        data = whole[r.file][r.first : r.last]
        head, _, rest = data.partition(b"\r\n\r\n")
        assert data.startswith(b"WARC/1.1\r\n") and rest[int(head.rpartition(b"Content-Length: ")[2]) :] == b"\r\n\r\n"
        assert r.hash == hashlib.sha256(data).hexdigest() and f"<{r.id}>".encode() in head and r.slot == int(r.id.split(":")[2]) % 8
    for file, data in whole.items():
        ranges = sorted((r.first, r.last) for r in found if r.file == file)
        assert ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_bytes_that_are_no_record_are_one_of_their_own():
    good = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:7:ab12>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    broken = good.replace(b"Content-Length: 3", b"Content-Length: x")
    found = list(records_in(good + broken + good + good[:-5]))
    assert [x[0] for x in found] == ["urn:page:7:ab12", found[1][0], "urn:page:7:ab12", found[3][0]] and found[1][0].startswith("unreadable:")
    n = len(good)
    assert [x[1:3] for x in found] == [(0, n), (n, 2 * n), (2 * n, 3 * n), (3 * n, 4 * n - 5)]
    assert list(records_in(b"")) == [] and slot_of("urn:page:none:ffff", 10) == 5 and slot_of("other", 10) == 0


@pytest.mark.parametrize("spoil", ["changed", "lost", "added", None])
def test_audit_finds_exactly_the_spoilt_records(spark, spoil):
    rot = {
        "changed": lambda df: df.withColumn("html", F.when(F.col("page_id").isin(5, 63), "<q>").otherwise(F.col("html"))),
        "lost": lambda df: df.filter(~F.col("page_id").isin(5, 63)),
        "added": lambda df: df.unionByName(df.filter(F.col("page_id").isin(5, 63)).withColumn("id", F.regexp_replace("id", ".$", "x"))),
        None: None,
    }[spoil]
    got = [(r.finding, int(r.id.split(":")[2])) for r in fixity_audit(pages(spark), rot, 32, 4).collect()]
    assert sorted(got) == ([] if spoil is None else [(spoil, 5), (spoil, 63)])


def test_matches_comparing_all_records(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {(r.finding, int(r.id.split(":")[2])) for r in fixity_audit(df, lambda x: bit_rot(x, 5), 16, 4).collect()}
    rows = {r.page_id: r.html for r in df.collect()}
    want = {("lost", i) for i in rows if i % 40 == 13} | {("changed", i) for i, h in rows.items() if i % 5 == 0 and h[11] != "~" and i % 40 != 13}
    assert got == want and want


def test_records_in_another_file_are_moved(spark, tmp_path):
    named = with_names(pages(spark, 30), 8)
    write_warc(named, f"{tmp_path}/a")
    write_warc(named.withColumn("file", F.when(F.col("page_id") == 9, "f0-0").otherwise(F.col("file"))), f"{tmp_path}/b")
    (r,) = audit_files(spark, f"{tmp_path}/a", f"{tmp_path}/b", 8, 4).collect()
    assert (r.finding, r.file_a, r.file_b) == ("moved", "f1-0", "f0-0") and r.hash_a == r.hash_b


def _joined(df, monkeypatch):
    """The names where crowded files are too many to be sent."""
    with monkeypatch.context() as m:
        m.setattr(warc, "SENT_ROWS", 0)
        return with_names(df, 4).collect()


def test_odd_rows(spark, monkeypatch):
    rows = [(None, None, None), (None, "u", "z"), (1, None, "x"), (1, None, "x"), (2, "u", None), (2, "u", ""), (3, "u", "y" * 100000), (-4, "u", "\r\n\r\nWARC/1.1")]
    rows += [(7, "u", f"many {i}") for i in range(40)] + [(None, "u", f"none {i}") for i in range(40)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, file string, slot string")
    assert sorted(r.file for r in with_names(df, 4).collect()) == sorted(r.file for r in _joined(df, monkeypatch))
    named = with_names(df, 4)
    assert named.count() == len(rows) and max(r["count"] for r in named.groupBy("file").count().collect()) < 32
    assert fixity_audit(df, None, 4).collect() == []
    got = fixity_audit(df, lambda x: x.filter("page_id = 1"), 4).collect()
    assert len(got) == len(rows) - 2 and {r.finding for r in got} == {"lost"}
    assert fixity_audit(df.limit(0)).collect() == []


def test_damaged_packed_bytes_are_found_and_fail_nothing(spark, tmp_path):
    import glob
    import gzip
    import shutil
    from pathlib import Path

    write_warc(with_names(pages(spark, 96), 32), f"{tmp_path}/a")
    shutil.copytree(f"{tmp_path}/a", f"{tmp_path}/b")
    hit, cut = sorted(glob.glob(f"{tmp_path}/b/file=*/*.gz"))[:2]
    whole = {p: gzip.open(p).read() for p in (hit, cut)}
    data = bytearray(Path(hit).read_bytes())
    data[len(data) // 2] ^= 0x55
    Path(hit).write_bytes(data)
    Path(cut).write_bytes(Path(cut).read_bytes()[:-200])
    for crc in glob.glob(f"{tmp_path}/b/file=*/.*.crc"):
        Path(crc).unlink()
    assert whole[cut].startswith(part := warc._unpacked(Path(cut).read_bytes())) and 0 < len(part) < len(whole[cut])
    assert warc._unpacked(gzip.compress(b"one") + gzip.compress(b"two")) == b"onetwo"
    found = audit_files(spark, f"{tmp_path}/a", f"{tmp_path}/b", 32, 4).collect()
    held = {r.id for r in read_warc(spark, f"{tmp_path}/a", 32).collect() if r.file in {p.split("file=")[1].split("/")[0] for p in (hit, cut)}}
    named = {r.id for r in found if r.id in held}
    assert len(named) >= 4 and {r.id for r in found} - held <= {r.id for r in found if r.finding == "added"} and {r.finding for r in found} <= {"changed", "lost", "added", "moved"}
    assert audit_files(spark, f"{tmp_path}/a", f"{tmp_path}/a", 32, 4).count() == 0
