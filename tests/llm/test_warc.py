"""WARC archives and their index."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripweave.llm import warc

LONG = "<html>" + "é" * 700 + "</html>"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(rows):
    found = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        origin = max(same, default=None) if len(data) >= 1000 else None
        other = origin if origin is not None and origin != page else None
        kind = "response" if other is None else "revisit"
        found.append((page, len(data), hashlib.sha1(data).hexdigest(), kind, other))
    return sorted(found, key=str)


def archived(spark, rows):
    pages = pages_of(spark, rows)
    folder, archives, top = warc.archive_pages(pages)
    return pages, folder, archives, top


ROWS = [
    (1, "http://www.example.org/a?b=1#c", LONG),
    (2, "https://example.org:8080/a", LONG),
    (7, "http://sub.example.org/", LONG),
    (3, None, None),
    (4, "not a url", ""),
    (5, "http://example.org/with blank\nand line", "short\r\n\r\nWARC/1.1\r\n"),
    (6, "http://example.org/s", "short"),
    (8, "http://example.org/s", "short"),
    (None, "http://example.org/n", LONG),
]


def test_records_come_back(spark):
    pages, folder, _, top = archived(spark, ROWS)
    got = [tuple(r) for r in warc.look_up(pages, folder, top).collect()]
    assert sorted(got, key=str) == expected(ROWS)


def test_many_blocks_parts_and_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "SPAN", 900)
    rng = random.Random(6)
    rows = [(i, f"http://h{i % 17}.example.net/{i % 40}", LONG[: rng.randint(0, 400)] + str(i)) for i in range(400)]
    rows += rows[:30]  # repeated rows
    pages, folder, archives, top = archived(spark, rows)
    assert archives.count() > 10 and archives.agg(F.sum("records")).first()[0] == len(rows)
    assert sorted((tuple(r) for r in warc.look_up(pages, folder, top).collect()), key=str) == expected(rows)
    # Every archive is read by a task of its own, with adaptive execution on.
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert warc.read_captures(archives, folder).rdd.getNumPartitions() == archives.count()
    some = pages.where("page_id % 50 = 3")
    assert {r.page_id for r in warc.look_up(some, folder, top).collect()} == {i for i in range(400) if i % 50 == 3}
    absent = pages.limit(1).select((F.col("page_id") + 10_000).alias("page_id"), "url")
    assert warc.look_up(absent, folder, top).count() == 0


def test_archives_are_gzip_members_of_warc_records(spark):
    _, folder, archives, _ = archived(spark, ROWS)
    system, _ = warc.filesystem(folder)
    text = b""
    for row in archives.collect():
        with system.open_input_stream(row.path, compression=None) as stream:
            text += gzip.decompress(stream.read())
    assert text.count(b"WARC-Type: response") == 6 and text.count(b"WARC-Type: revisit") == 3
    assert b"WARC-Refers-To: <urn:page:7>" in text


def test_same_id_and_url_with_other_content(spark):
    rows = [(1, "http://e.org/", "one"), (1, "http://e.org/", "two"), (2, "http://e.org/", "two")]
    pages, folder, _, top = archived(spark, rows)
    assert sorted((tuple(r) for r in warc.look_up(pages, folder, top).collect()), key=str) == expected(rows)


def test_empty_table(spark):
    pages, folder, archives, top = archived(spark, [(1, "x", "y")])
    none = pages.limit(0)
    folder, archives, top = warc.archive_pages(none)
    assert (archives.count(), top) == (0, [])
    assert warc.look_up(none, folder, top).count() == 0


def test_url_keys(spark):
    frame = pages_of(spark, [(1, "HTTP://www.Example.org:80/A?b#c", None), (2, "http://u@a.b.c/", None)])
    assert {r.k for r in frame.select(warc.url_key(F.col("url")).alias("k")).collect()} == {"org,example)/A?b", "c,b,a)/"}


def test_broken_archives_are_refused():
    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            part, self.data = self.data[:n], self.data[n:]
            return part

    whole = warc.member(b"abc") + warc.member(b"de")
    assert [data for *_, data in warc.members(Stream(whole))] == [b"abc", b"de"]
    with pytest.raises(ValueError):
        list(warc.members(Stream(whole[:-3])))
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_urls_with_unicode_blanks_at_their_ends(spark):
    blanks = ["\u00a0", "\u0085", "\u2003", "\u2028", "\u3000"]
    rows = [(i, f"{b}http://e.org/{i}", f"a{i}") for i, b in enumerate(blanks)]
    rows += [(10 + i, f"http://e.org/{i}{b}", f"b{i}") for i, b in enumerate(blanks)]
    pages, folder, _, top = archived(spark, rows)
    found = warc.look_up(pages, folder, top, complete=True).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows)


def test_a_wanted_page_without_capture_is_an_error_if_asked(spark):
    pages, folder, _, top = archived(spark, ROWS)
    absent = pages.limit(1).select((F.col("page_id") + 10_000).alias("page_id"), "url")
    with pytest.raises(Exception, match="no capture of page"):
        warc.look_up(absent, folder, top, complete=True).collect()
