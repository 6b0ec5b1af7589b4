"""WARC files with damaged records in the middle."""

from tidemark.llm import warc


def test_records_after_a_damaged_one_are_read():
    one = {"kind": "response", "url": "http://x.org/", "at": 1000, "status": 200, "headers": {"ETag": "1"}, "payload": b"hello"}
    parts = [warc.write([{**one, "record_id": f"r{i}"}]) for i in range(4)]
    ids = lambda data: [r["fields"]["warc-record-id"] for r in warc._parse(data)]
    size = parts[1].split(b"Content-Length: ")[1].split(b"\r\n")[0]
    long, odd = (parts[1].replace(b"Content-Length: " + size, b"Content-Length: " + n) for n in (b"999999", b"x7"))
    short = parts[1].replace(b"Content-Length: " + size, b"Content-Length: 3")
    for bad in (parts[1].replace(b"WARC/1.1", b"WXRC/1.1", 1), long, odd, short, b"noise\r\n\r\nnoise\r\n", parts[1][:-12]):
        assert ids(parts[0] + bad + parts[2] + parts[3]) == ["r0", "r2", "r3"], bad
    assert ids(b"".join(parts)) == ["r0", "r1", "r2", "r3"] and ids(parts[0] + parts[1][:-9]) == ["r0"]
