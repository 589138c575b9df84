"""The data source of answers: pages, faults, saved answers, and streams that resume. The service is a server of this machine."""

import http.server
import threading

import pytest

from lectern.sources import answers, feeds, shared


class Service(http.server.BaseHTTPRequestHandler):
    asked: list[str] = []

    def do_GET(self):  # noqa: N802
        self.asked.append(self.path)
        _, term, page = self.path.split("/")
        busy = term == "busy" and self.asked.count(self.path) < 3
        code = 503 if busy or term == "down" else 403 if term == "shut" else 404 if int(page) > 1 else 200
        body = f'{{"data":[{{"title":"{term} {page}","abstract":"about","url":"u{page}"}}]}}'.encode() if term != "odd" else b"\xff\xfe"
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body if code == 200 else b"")

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/{{term}}/{{page}}"
    server.shutdown()


def test_pages_and_faults(spark, service):
    """A busy service is asked again, a page that isn't there gives no row, and what fails is a row with the reason."""
    answers.register(spark)
    df = spark.read.format("search_answers").options(**answers.options(service, ["a b", "busy", "down", "shut", "odd", "a b"], pages=3, wait=0.01)).load()
    assert df.rdd.getNumPartitions() == 15
    got = df.collect()
    bad = {(r.term, r.page): r.error for r in got if r.error}
    assert bad == {(t, n): e for t, e in (("down", "HTTP 503"), ("shut", "HTTP 403")) for n in range(3)} | {("odd", n): "not UTF-8" for n in range(2)}
    assert Service.asked.count("/a%20b/0") == Service.asked.count("/shut/0") and Service.asked.count("/down/0") == 3 * Service.asked.count("/shut/0")
    found = feeds.page(spark.createDataFrame(got, df.schema), "answer", "json", "term", "page").collect()
    assert sorted((r.term, r.page, r.title, r.url) for r in found) == [(t, n, f"{t.replace(chr(32), "%20")} {n}", f"u{n}") for t in ("a b", "busy") for n in range(2)]


def test_no_service(spark):
    answers.register(spark)
    df = spark.read.format("search_answers").options(**answers.options("http://127.0.0.1:9/{term}", ["x"], tries=2, wait=0.01, timeout=2)).load()
    assert [(r.answer, "refused" in r.error.lower()) for r in df.collect()] == [(None, True)]
    with pytest.raises(ValueError, match="list of terms"):
        answers.Options.of({"url": "x", "terms": "[1]"})


def test_saved_answers(spark):
    path = shared.new_folder(spark, "test-answers")
    rows = [("a", 0, "line one\nline two"), ("a", 1, "more"), ("b", 0, "é")]
    spark.createDataFrame(rows, "term string, page int, value string").repartition(1).write.partitionBy("term", "page").text(path)
    answers.register(spark)
    df = spark.read.format("search_answers").options(**answers.options(f"{path}/term={{term}}/page={{page}}/", ["a", "b", "none"], pages=2)).load()
    assert sorted((r.term, r.page, r.answer.rstrip("\n"), r.error) for r in df.collect()) == [(*r, None) for r in rows]


def test_stream_resumes_after_its_last_page(spark, service):
    answers.register(spark)
    folder = shared.new_folder(spark, "test-answer-stream")

    def run(pages):
        stream = spark.readStream.format("search_answers").options(**answers.options(service, ["x", "y"], pages=pages)).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
        return sorted((r.term, r.page) for r in spark.read.parquet(f"{folder}/out").collect())

    assert run(1) == [("x", 0), ("y", 0)]
    first = len(Service.asked)
    assert run(1) == [("x", 0), ("y", 0)] and len(Service.asked) == first
    assert run(2) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]
    assert all(p.endswith("/1") for p in Service.asked[first:])
