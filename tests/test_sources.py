import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.error import HTTPError, URLError

import pytest


from claimweave.operators.chunks import flatten_documents, segment
from claimweave.sources import config, filings, files
from claimweave.sources.html import BLOCK_SCHEMA, blocks_of, page_blocks

PAGE = """<html><head><title>t</title></head><body><ix:header><div>hidden</div></ix:header><p>Front  matter</p>
<h2>Item 1. Business</h2><div><p>We sell <b>chips</b>.</p>loose<p style="display: none">no</p></div>
<table><tr><td>Revenue</td><td>100</td></tr><tr><td> </td><th>Cost</th></tr></table>
<p><b>Item 1A. Risk&nbsp;Factors</b><br><p>Risk one<ul><li>a<li>b</ul><script>var x</script></body></html>"""


def test_blocks_of_a_page():
    assert [(k, t) for _, k, _, t in blocks_of(PAGE)] == [
        ("block", "Front matter"), ("block", "Item 1. Business"), ("block", "We sell chips ."), ("table", "Revenue | 100\nCost"),
        ("block", "Item 1A. Risk Factors"), ("block", "Risk one"), ("block", "a"), ("block", "b"),
    ]
    assert blocks_of(None) == [] and blocks_of("<span>x</span>") == []


def test_segments(spark):
    pages = spark.createDataFrame([("d", PAGE), ("e", ""), ("n", None)], "document_id string, html string")
    rows = segment(page_blocks(pages)).orderBy("ordinal", "paragraph_index").collect()
    assert [r.chunk_id for r in rows] == ["d#s000#p0", "d#s001#p0", "d#s001#p1", "d#s001#p2", "d#s002#p0", "d#s002#p1", "d#s002#p2", "d#s002#p3"]
    assert [r.heading for r in rows if r.paragraph_index == 0] == ["", "Item 1. Business", "Item 1A. Risk Factors"]
    first = segment(spark.createDataFrame([("d", 0, "block", "h1", "Top"), ("d", 1, "block", "p", "x")], BLOCK_SCHEMA)).collect()
    assert {r.section_id for r in first} == {"s000"}


def test_stored_documents(spark, tmp_path):
    chunk = {"chunk_id": "d#s000#p0", "document_id": "d", "section_id": "s000", "paragraph_index": 0, "text": "t", "chunk_type": "paragraph", "is_heading": False, "char_len": 1}
    (tmp_path / "d.json").write_text(json.dumps({"document_id": "d", "company": {"ticker": "X", "name": "N"}, "sections": [{"section_id": "s000", "ordinal": 0, "heading": "", "chunks": [chunk]}]}))
    (tmp_path / "index.json").write_text(json.dumps({"d": {"document_id": "d"}}))
    docs = files.stored_documents(spark, str(tmp_path))
    assert [r.chunk_id for r in flatten_documents(docs).collect()] == ["d#s000#p0"]
    assert files.document_rows(docs).first().cik is None


def test_universe_and_recent(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"0": {"ticker": "aa", "title": "A", "cik_str": 1}, "1": {"ticker": "bb", "title": "B", "cik_str": 2}}))
    (tmp_path / "b.json").write_text(json.dumps([{"ticker": "cc", "name": "C", "cik": 3}]))
    got = lambda f: [(r.ticker, r.name, r.cik) for r in files.company_universe(spark, str(tmp_path / f)).orderBy("pos").collect()]
    assert got("a.json") == [("AA", "A", 1), ("BB", "B", 2)] and got("b.json") == [("CC", "C", 3)]
    (tmp_path / "r.json").write_text(json.dumps({"ts": 1.0, "items": [{"ticker": "x", "name": "X", "cik": 9, "form": "10-K", "date": "2024-01-01"}]}))
    assert files.recent_cache(spark, str(tmp_path / "r.json")).first().ticker == "x"


def test_transcripts_and_claims(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("document_id: T\ncompany: {ticker: X, name: N}\nturns:\n- {speaker: A, role: CEO, text: hi}\n- {speaker: B, role: CFO, text: yo, planted: p}\n")
    rows = files.transcripts(spark, str(tmp_path / "t.yaml")).orderBy("turn").collect()
    assert [(r.speaker, r.text, r.planted) for r in rows] == [("A", "hi", None), ("B", "yo", "p")]
    (tmp_path / "c.json").write_text(json.dumps({"k": {"claim_id": "k", "topic": "t", "bbox": [1.0, 2.0]}}))
    assert files.claims(spark, str(tmp_path / "c.json")).first().bbox == [1.0, 2.0]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("a: ${A:-x}\nb: [1, '${B}-${C:-}']\n")
    assert config.load_yaml(str(tmp_path / "c.yaml"), {"B": "q"}) == {"a": "x", "b": [1, "q-"]}
    env = {"K": "old"}
    (tmp_path / ".env").write_text("# no\nK=new\nL='v'\n")
    config.load_env(str(tmp_path / ".env"), env)
    assert env == {"K": "old", "L": "v"}


class _Site(BaseHTTPRequestHandler):
    """A list of filings, their bodies, and addresses that fail in stated ways; counts what was asked."""

    asked: Counter = Counter()
    wrong: list = []

    def do_GET(self):
        _Site.asked[self.path] += 1
        if self.path.startswith("/fail/"):
            _, _, code, times = self.path.split("/")
            if _Site.asked[self.path] <= int(times):
                self.send_response(int(code))
                self.send_header("Retry-After", "3")
                self.end_headers()
                return
        body = b"body of " + self.path.encode()
        if self.path.startswith("/list/"):
            recent = {"form": ["10-K", "10-Q", "10-K", "8-K", "10-Q", "10-Q"], "filingDate": ["2024-02-01", "2024-05-01", "2023-02-01", "2024-03-01", "2023-08-01", "2023-05-01"], "accessionNumber": [f"0-{i}" for i in range(6)], "primaryDocument": [f"d{i}.htm" for i in range(6)]}
            body = json.dumps({"name": "N", "tickers": ["T"], "filings": {"recent": recent}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch_waits_as_asked_and_gives_up(site):
    waits = []
    assert filings.fetch(f"{site}/fail/429/2", "u", wait=waits.append).startswith(b"body") and waits == [3.0, 3.0]
    with pytest.raises(HTTPError):
        filings.fetch(f"{site}/fail/503/9", "u", tries=2, wait=waits.append)
    for code in (400, 401, 403, 404):
        with pytest.raises(HTTPError):
            filings.fetch(f"{site}/fail/{code}/1", "u", wait=lambda _: pytest.fail("waited"))
        assert _Site.asked[f"/fail/{code}/1"] == 1


@pytest.mark.parametrize("error, again", [(TimeoutError(), True), (BrokenPipeError(32, "x"), True), (ConnectionResetError(104, "x"), True), (URLError(TimeoutError()), True), (ConnectionRefusedError(111, "x"), False), (ValueError("cannot generate item 500: connection"), False), (PermissionError(13, "x"), False)])
def test_what_is_worth_another_try(error, again):
    assert (filings.pause_after(error) is not None) == again


def test_newest_filings_of_each_form_with_bodies(spark, site):
    options = {"user_agent": "u", "ciks": "1, 2", "forms": "10-K:1,10-Q:2", "base_url": site + "/list/{cik}", "document_url": site + "/doc/{plain}/{name}"}
    reader = filings.FilingsReader(options)
    assert [p.cik for p in reader.partitions()] == ["1", "2"]
    rows = list(reader.read(reader.partitions()[0]))
    assert [(r[3], r[4]) for r in rows] == [("10-Q", "2024-05-01"), ("10-K", "2024-02-01"), ("10-Q", "2023-08-01")]
    assert rows[0][7] == "body of /doc/01/d1.htm"
    spark.dataSource.register(filings.FilingsSource)
    got = spark.read.format("filings").options(**options).load()
    assert got.count() == 6 and "html" in got.columns
    with pytest.raises(ValueError):
        filings.FilingsReader({})


def test_each_document_is_fetched_once_ever(spark, site, tmp_path):
    listed = spark.createDataFrame([(1, "a-1", "x.htm"), (1, "a-2", "y.htm"), (1, "a-2", "y.htm")], "cik long, accession string, primary_document string")
    cache = f"file://{tmp_path}/raw"
    for more in ([], [(2, "b-1", "z.htm")]):
        asked = listed.unionByName(spark.createDataFrame(more, listed.schema)) if more else listed
        got = {r.accession: r.html for r in filings.fetch_missing(asked, cache, "u", site + "/once/{accession}/{name}").collect()}
        assert got["a-1"] == "body of /once/a-1/x.htm" and len(got) == 2 + len(more)
    assert [_Site.asked[f"/once/{x}"] for x in ("a-1/x.htm", "a-2/y.htm", "b-1/z.htm")] == [1, 1, 1]
