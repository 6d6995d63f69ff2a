import pytest

from loomspark.sources import fetch


def test_retries():
    waits, calls = [], []

    def get():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert fetch.with_retries(get, sleep=waits.append) == "up" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        fetch.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), tries=2, sleep=waits.append)


def test_cache(tmp_path):
    calls, waits = [], []
    get = lambda: calls.append(1) or {"a": 1}
    assert [fetch.cached(tmp_path, "k/1", get, 2.0, waits.append) for _ in range(2)] == [{"a": 1}] * 2
    assert len(calls) == 1 and waits == [2.0]


def test_short_pages_are_asked_for_again():
    answers = {1: [[1, 2]], 2: [[3], [3, 4]], 3: [[5], [5]], 4: [[6, 7]]}
    got = list(fetch.pages(lambda n: answers[n].pop(0), 2, sleep=lambda s: None))
    assert got == [[1, 2], [3, 4], [5]]
    assert list(fetch.pages(lambda n: [], 2, sleep=lambda s: None)) == []


def test_counts():
    assert fetch.expected_count("<b>Found 1,234 performances</b>") == 1234 and fetch.expected_count("No performances were found") is None
    with pytest.raises(ValueError, match="no count"):
        fetch.expected_count("<html>")


@pytest.fixture
def server(tmp_path):
    """A server that refuses every first request with 503, and what is not there with 404."""
    import json
    import threading
    import zipfile
    from http.server import BaseHTTPRequestHandler, HTTPServer

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/rows.csv", "a,b\n1,2\n")
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = {"/a.zip": (tmp_path / "a.zip").read_bytes(), "/x.json": json.dumps({"n": 3}).encode()}.get(self.path)
            self.send_response(404 if body is None else 503 if asked.count(self.path) == 1 and self.path == "/a.zip" else 200)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *args):
            pass

    web = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}", asked
    web.shutdown()


def test_download(server, tmp_path):
    address, asked = server
    waits = []
    path = fetch.download(f"{address}/a.zip", tmp_path / "down" / "a.zip", sleep=waits.append)
    assert waits == [1.0] and asked == ["/a.zip"] * 2 and not list((tmp_path / "down").glob("*.part"))
    assert [p.read_text() for p in fetch.unpacked(path, tmp_path / "out")] == ["a,b\n1,2\n"]
    with pytest.raises(ValueError, match="404"):
        fetch.download(f"{address}/gone", tmp_path / "gone", sleep=waits.append)
    assert asked.count("/gone") == 1 and fetch.get_json(f"{address}/x.json") == {"n": 3}
