"""Records whose WARC header is longer than what is decoded at once, as the first of a range."""

import io
import random

import pytest

from palimp.llm import warc


@pytest.mark.parametrize("url", ["u" * 200_000, "\n" * 40_000, "".join(random.Random(1).choices("abcdefghij0123456789/", k=150_000))])
@pytest.mark.parametrize("split", [997, 50_000, 1 << 30])
def test_long_url(url, split):
    data = b"".join(warc.build_record(i, url if i % 2 == 0 else "u", b"payload", "d", None, False, "d") for i in range(5))
    ids = [f["warc-record-id"] for a in range(0, len(data), split) for _, f, _ in warc.records_of_range(io.BytesIO(data), len(data), a, min(a + split, len(data)))]
    assert ids == [warc.record_id(i) for i in range(5)]


def test_no_record():
    import gzip

    data = gzip.compress(b"WARC/1.1\r\nno end " * 9000) + gzip.compress(b"WA") + gzip.compress(bytes(1 << 20)) + warc.build_record(1, "u", b"x", "d", None, False, "d")
    assert [f["warc-record-id"] for _, f, _ in warc.records_of_range(io.BytesIO(data), len(data), 0, len(data))] == [warc.record_id(1)]
