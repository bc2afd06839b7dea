"""Record heads of any length."""

import pytest

from loadloom.llm import warc
from loadloom.session import scratch_path


def test_url_longer_than_any_block_is_read_back(spark):
    rows = [(1, "data:text/html," + "x" * 100_000, "<p>one</p>"), (2, "http://a.example/", "y" * 300),
            (3, "http://a.example/?q=" + "z" * 65_536, "y" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, scratch_path(spark, "warc"))).collect()}
    assert {i: got[i].url for i in got} == {i: u for i, u, _ in rows}
    assert got[1].html == "<p>one</p>" and (got[3].record_type, got[3].refers_to) == ("revisit", 2)


def test_record_without_end_of_head_is_refused():
    with pytest.raises(warc.BadRecord):
        warc.parse(warc.VERSION + b"\r\nWARC-Type: response")
