"""Documents, responses, connectors, text functions, reports and the stream."""

import base64
import contextlib
import email
import http.server
import json
import sys
import threading
import types
from html import escape
from pathlib import Path
from unittest.mock import Mock, patch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablescore.functions import text
from tablescore.operators.report import leaderboard, with_missing
from tablescore.sources import connectors as c
from tablescore.sources import services as s
from tablescore.sources.documents import documents, manifest, pretty, responses, todo, with_responses, write_outcomes
from tablescore.streaming.ingest import score_stream

SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def test_text_functions(spark):
    cells = ["a-b c\n", "".join(SPACES) + "x" + "".join(SPACES), "−–​", "", None, "<a b='c\"'>&"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, s string")
    rows = df.select("i", text.normalize_cell(F.col("s")).alias("n"), text.strip(F.col("s")).alias("t"), text.html_escape(F.col("s")).alias("e"), text.data_url(F.encode("s", "utf-8")).alias("u")).orderBy("i").collect()
    for r, x in zip(rows, cells, strict=True):
        want = [None] * 4 if x is None else ["".join(x.replace("-", "").split()), x.strip(), escape(x), "data:application/pdf;base64," + base64.b64encode(x.encode()).decode()]
        assert [r.n, r.t, r.e, r.u] == want
    long = spark.createDataFrame([("x" * 500,)], "s string").select(text.data_url(F.encode("s", "utf-8")).alias("u")).first().u
    assert "\n" not in long
    one = spark.createDataFrame([("/pdfs/a.pdfs/x.pdf", "a<caption>1\n2</caption>b<caption>3</caption>")], "p string, h string")
    assert tuple(one.select(text.output_path(F.col("p"), "azure"), text.strip_captions(F.col("h"))).first()) == ("/azure/a.azure/x.json", "ab")


def test_documents_and_resume(spark, tmp_path):
    for name in ("pdfs/a.pdf", "pdfs/deep/b.pdf", "pdfs/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = documents(spark, str(tmp_path / "pdfs"))
    assert sorted(bytes(r.content).decode() for r in found.collect()) == ["pdfs/a.pdf", "pdfs/deep/b.pdf"]
    plan = manifest(found, "out")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a.json").write_text('{"html_table":\n null}')
    done = responses(spark, str(tmp_path / "out"))
    left = todo(plan, done.select(F.col("path").alias("output")))
    assert [Path(r.output).name for r in left.collect()] == ["b.json"]
    assert {Path(r.path).name: r.raw for r in with_responses(plan, done).collect()} == {"a.pdf": '{"html_table":\n null}', "b.pdf": None}


def test_run_connector(spark, tmp_path):
    docs = spark.createDataFrame([(f"{i}.pdf", b"x") for i in range(6)], "path string, content binary")
    stored = {f"{i}.pdf": {"html_table": str(i)} for i in range(4)} | {"4.pdf": {"error": "refused"}}
    service = c.Service("field", 3, "out", c.RetryPolicy(1))
    rows = {r.path: r for r in c.run_connector(docs, lambda: c.replay(stored), service).collect()}
    assert [rows[f"{i}.pdf"].ok for i in range(6)] == [True] * 4 + [False] * 2
    assert rows["4.pdf"].error == "refused" and json.loads(rows["4.pdf"].payload) == {"error": "refused"}
    assert rows["5.pdf"].error == "ProviderRequestError: no response for 5.pdf" and rows["5.pdf"].payload is None
    write_outcomes(c.run_connector(docs, lambda: c.replay(stored), service), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 6
    texts = spark.createDataFrame([('{"a":1}',), ("{",), (None,)], "payload string")
    assert [r[0] for r in texts.select(pretty(F.col("payload"))).collect()] == ['{\n  "a": 1\n}', None, None]


class Limited(RuntimeError):
    status_code, headers = 429, {"retry-after-ms": "5000"}


class Refused(RuntimeError):
    status_code = 400


def test_retries():
    slept = []
    policy = c.RetryPolicy(3, c.has_status(429))
    calls = Mock(side_effect=[Limited(), Limited(), "ok"])
    assert policy.call(calls, slept.append) == "ok" and slept == [5.0, 5.0]
    with pytest.raises(Limited):
        policy.call(Mock(side_effect=Limited()), slept.append)
    with pytest.raises(Refused):
        policy.call(Mock(side_effect=Refused()), slept.append)
    error = RuntimeError("Quota exceeded")
    assert c.says("quota")(error) and not c.says("limit")(error)
    for headers, attempt, want in [({}, 2, 4.0), ({}, 9, 30.0), ({"retry-after": "7"}, 0, 7.0), ({"retry-after-ms": "x", "retry-after": "-1"}, 1, 2.0), ({"retry-after-ms": "500", "retry-after": "9"}, 0, 0.5)]:
        error.headers = headers
        assert policy.delay(error, attempt) == want


def test_polling():
    service = c.SERVICES["chunkr"]
    states = iter([(200, {"status": "Starting"}), (200, {"status": "Succeeded", "output": []})])
    assert c.poll(service, lambda: next(states), lambda s: None)["output"] == []
    assert "error" in c.poll(service, lambda: (200, {"status": "Canceled"}))
    assert "500" in c.poll(service, lambda: (500, "down"))["error"]
    assert c.poll(service, Mock(side_effect=OSError("cut")))["error"] == "cut"
    now = iter(range(0, 10_000, 200))
    assert "600" in c.poll(service, lambda: (200, {"status": "Starting"}), lambda s: None, lambda: next(now))["error"]


def modules(*path, **members):
    made = {}
    for i in range(len(path)):
        made[".".join(path[: i + 1])] = types.ModuleType(".".join(path[: i + 1]))
    for k, v in members.items():
        setattr(made[".".join(path)], k, v)
    return made


#: Names of settings, as the services' request code wants them.
ENVIRONMENT = {name: name.lower() for service in c.SERVICES.values() for name in service.settings}


@pytest.fixture
def pdf(tmp_path):
    (tmp_path / "case.pdf").write_bytes(b"pdf bytes")
    return tmp_path / "case.pdf"


def with_sdk(*mods, environment=ENVIRONMENT):
    merged = {}
    for m in mods:  # packages that two SDKs share are one module
        for name, module in m.items():
            merged[name] = merged.get(name, module)
            for k, v in vars(module).items():
                if not k.startswith("__"):
                    setattr(merged[name], k, v)
    both = contextlib.ExitStack()
    both.enter_context(patch.dict("os.environ", environment, clear=True))
    both.enter_context(patch.dict(sys.modules, merged))
    return both


def test_ocr_request_and_errors(pdf):
    client, slept = Mock(), []
    made = Mock(return_value=client)
    sdk = lambda **more: with_sdk(modules("mistralai", "azure", "client", MistralAzure=made), **more)
    client.ocr.process.side_effect = [Limited(), Mock(model_dump=Mock(return_value={"pages": []}))]
    with sdk():
        assert s.analyze(pdf, "mistral_ocr", model="m", sleep=slept.append) == {"pages": []}
    made.assert_called_with(api_key="mistral_api_key", server_url="mistral_api_endpoint")
    sent = client.ocr.process.call_args.kwargs
    assert slept == [5.0] and (sent["model"], sent["table_format"], sent["timeout_ms"]) == ("m", "html", 180000)
    assert sent["document"]["type"] == "document_url" and base64.b64decode(sent["document"]["document_url"].split(",", 1)[1]) == b"pdf bytes"
    client.ocr.process.side_effect = [Mock(model_dump=Mock(return_value=[]))]
    with sdk(), pytest.raises(TypeError, match="not an object"):
        s.analyze(pdf, "mistral_ocr", model="m")
    client.ocr.process.side_effect = Refused("no")
    with sdk(), pytest.raises(c.ProviderRequestError, match="mistral_ocr did not answer: no"):
        s.analyze(pdf, "mistral_ocr", model="m")
    client.ocr.process.reset_mock()
    with sdk(), pytest.raises(FileNotFoundError):
        s.analyze("missing.pdf", "mistral_ocr", model="m")
    client.ocr.process.assert_not_called()
    with sdk(environment={}), pytest.raises(RuntimeError, match="MISTRAL_API_ENDPOINT and MISTRAL_API_KEY"):
        s.analyze(pdf, "mistral_ocr", model="m")
    client.ocr.process.side_effect = [Mock(model_dump=Mock(return_value={}))]
    with sdk(environment=ENVIRONMENT | {"MISTRAL_TIMEOUT_MS": "7"}):
        s.analyze(pdf, "mistral_ocr", model="m")
    assert client.ocr.process.call_args.kwargs["timeout_ms"] == 7


def test_content_understanding(pdf):
    client = Mock()
    answer = client.begin_analyze_binary.return_value.result.return_value.as_dict
    sdk = lambda **more: with_sdk(modules("azure", "ai", "contentunderstanding", ContentUnderstandingClient=Mock(return_value=client)), modules("azure", "core", "credentials", AzureKeyCredential=Mock()), **more)
    ask = lambda: s.analyze(pdf, "azure_content_understanding", analyzer_id="a")
    answer.return_value = {"contents": []}
    with sdk():
        assert ask() == {"contents": []}
        client.begin_analyze_binary.assert_called_once_with(analyzer_id="a", binary_input=b"pdf bytes", content_type="application/pdf")
        answer.return_value = []
        with pytest.raises(TypeError):
            ask()
        client.begin_analyze_binary.side_effect = RuntimeError("down")
        with pytest.raises(c.ProviderRequestError):
            ask()
    with sdk(environment={}), pytest.raises(RuntimeError, match="ENDPOINT and .*KEY are required"):
        ask()


def test_document_intelligence_waits_for_its_rate(pdf):
    client, request = Mock(), Mock()
    client.begin_analyze_document.side_effect = [Limited(), Mock(result=Mock(return_value=Mock(as_dict=Mock(return_value={"tables": []}))))]
    sdk = with_sdk(modules("azure", "ai", "documentintelligence", DocumentIntelligenceClient=Mock(return_value=client)), modules("azure", "ai", "documentintelligence", "models", AnalyzeDocumentRequest=request), modules("azure", "core", "credentials", AzureKeyCredential=Mock()))
    with sdk:
        assert s.analyze(pdf, "azure_document_intelligence", sleep=lambda x: None) == {"tables": []}
    request.assert_called_with(bytes_source=b"pdf bytes")
    assert client.begin_analyze_document.call_args.args[0] == "prebuilt-layout"


def test_document_ai_takes_the_first_table(pdf):
    table = lambda html: Mock(to_dataframe=Mock(return_value=Mock(to_html=Mock(return_value=html))))
    pages = [Mock(tables=[]), Mock(tables=[table("<a>"), table("<longer table>")]), Mock(tables=[table("<c>")])]
    sdk_pages = Mock()
    cloud = modules("google", "cloud", documentai=Mock()) | modules("google", "cloud", "documentai_toolbox", document=Mock(Document=Mock(from_documentai_document=Mock(return_value=sdk_pages))))
    cloud["google.cloud"].documentai = Mock()
    with with_sdk(modules("google", "api_core", "client_options", ClientOptions=Mock()), cloud):
        for found, html in ((pages, "<a>"), ([], None)):
            sdk_pages.pages = found
            assert s.analyze(pdf, "google_document_ai") == {"html_table": html}


def test_pictures_of_first_pages(pdf):
    class Picture:
        def save(self, to, format):
            to.write(b"picture " + format.encode())

    client = Mock()
    client.chat.completions.create.return_value.choices = [Mock(message=Mock(content="<table></table>"))]
    openai = modules("openai", OpenAI=Mock(return_value=client))
    paper = modules("pdf2image", convert_from_bytes=lambda content, first_page, last_page: [Picture()] * (content == b"pdf bytes" and (first_page, last_page) == (1, 1)))
    with with_sdk(openai, paper):
        assert s.analyze(pdf, "gpt4o") == {"html_table": "<table></table>"}
        sent = client.chat.completions.create.call_args.kwargs
        text, picture = sent["messages"][0]["content"]
        assert (sent["model"], sent["max_tokens"], text["text"]) == ("gpt-4o", 4096, c.TABLE_PROMPT)
        assert base64.b64decode(picture["image_url"]["url"].removeprefix("data:image/png;base64,")) == b"picture PNG"
    reader = Mock()
    amazon = modules("textractor", Textractor=Mock(return_value=reader)) | modules("textractor", "data", "constants", TextractFeatures=Mock(TABLES="t"))
    amazon["textractor"].Textractor = Mock(return_value=reader)
    with with_sdk(amazon):
        for tables, html in (([Mock(to_html=lambda: "<table><caption>a\nb</caption>x</table>"), None], "<table>x</table>"), ([], None)):
            reader.analyze_document.return_value.tables = tables
            assert s.analyze(pdf, "textract", rasterise=lambda content: content[:3]) == {"html_table": html}
        reader.analyze_document.assert_called_with(file_source=b"pdf", features=["t"])


def test_unstructured(pdf):
    client, shared, operations = Mock(), Mock(), Mock()
    client.general.partition.side_effect = [OSError("cut"), Mock(elements=[{"type": "Table"}])]
    made = modules("unstructured_client", UnstructuredClient=None) | modules("unstructured_client", "models", shared=shared, operations=operations)
    made["unstructured_client"].UnstructuredClient = Mock(return_value=client)
    with with_sdk(made):
        assert s.analyze(pdf, "unstructured", sleep=lambda x: None) == {"elements": [{"type": "Table"}]}
    shared.Files.assert_called_with(content=b"pdf bytes", file_name="case.pdf")


def test_jobs_over_http(pdf):
    asked = []

    def server(answers):
        def send(method, url, headers, **more):
            asked.append((method, url, headers["Authorization"], more))
            return answers.pop(0)

        return send

    wait = lambda x: None
    done = {"status": "Succeeded", "output": []}
    with with_sdk():
        ask = lambda name, *answers, **more: s.analyze(pdf, name, send=server(list(answers)), sleep=wait, **more)
        assert ask("chunkr", (200, {"task_id": "t"}), (200, {"status": "Starting"}), (200, done)) == done
        assert [x[:3] for x in asked] == [("POST", "https://api.chunkr.ai/api/v1/task", "chunkr_api_key"), *[("GET", "https://api.chunkr.ai/api/v1/task/t", "chunkr_api_key")] * 2]
        assert asked[0][3] == {"fields": {"model": "HighQuality", "target_chunk_length": "512", "ocr_strategy": "Auto"}, "file": ("case.pdf", b"pdf bytes")}
        assert "402" in ask("chunkr", (402, "pay"))["error"]
        assert "Canceled" in ask("chunkr", (200, {"task_id": "t"}), (200, {"status": "Canceled"}))["error"]
        asked.clear()
        result = {"chunks": []}
        jobs = lambda *answers: ask("chunk_jobs", *answers, url="https://jobs.test/")
        assert jobs((200, {"file_id": "f"}), (200, {"job_id": "j"}), (200, {"status": "Pending"}), (200, {"status": "Completed", "result": result})) == result
        assert [x[1].removeprefix("https://jobs.test") for x in asked] == ["/upload", "/parse_async", "/job/j", "/job/j"] and asked[0][2] == "Bearer chunk_jobs_api_key"
        assert asked[1][3] == {"body": {"document_url": "f", "advanced_options": {"ocr_system": "combined"}}}
        assert "upload: status 500" in jobs((500, "down"))["error"]
        assert "submission: status 400" in jobs((200, {"file_id": "f"}), (400, "no"))["error"]
        assert "Failed" in jobs((200, {"file_id": "f"}), (200, {"job_id": "j"}), (200, {"status": "Failed"}))["error"]
        assert "404" in jobs((200, {"file_id": "f"}), (200, {"job_id": "j"}), (404, "gone"))["error"]


def test_http_requests():
    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def answer(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            seen.append((self.command, self.path, self.headers["Authorization"], self.headers["Content-Type"], body))
            code, text = (404, b"gone") if "lost" in self.path else (200, b'{"ok": 1}')
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text)

        do_GET = do_POST = answer
        log_message = lambda *a: None

    with http.server.HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}"
        assert s.http("POST", f"{url}/a", {"Authorization": "k"}, fields={"x": "y"}, file=("f.pdf", b"%PDF\x00")) == (200, {"ok": 1})
        assert s.http("POST", f"{url}/b", {}, body={"z": 1}) == (200, {"ok": 1})
        assert s.http("GET", f"{url}/lost", {}) == (404, "gone")
        server.shutdown()
    form = email.message_from_bytes(b"Content-Type: " + seen[0][3].encode() + b"\r\n\r\n" + seen[0][4])
    assert [(p.get_param("name", header="Content-Disposition"), p.get_filename(), p.get_payload(decode=True)) for p in form.get_payload()] == [("x", None, b"y"), ("file", "f.pdf", b"%PDF\x00")]
    assert seen[1][3:] == ("application/json", b'{"z": 1}') and seen[2][0] == "GET"


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_data_url(content):
    assert base64.b64decode(s.data_url(content).split(",")[1]) == content


def test_leaderboard(spark):
    truth = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, provider string")
    scores = with_missing(truth, spark.createDataFrame([(1, 0.5), (3, 1.0)], "k int, score double"), "k")
    rows = {r.provider: tuple(r)[1:] for r in leaderboard(scores, "provider").collect()}
    assert rows == {"p": (2, 1, 0.5, 0.5, 0.5, 0.5), "q": (1, 0, 1.0, 1.0, 1.0, 1.0)}


def test_stream(spark, tmp_path):
    truth = spark.createDataFrame([("d1", [["a"]]), ("d2", [["a"]]), ("d3", [["a"]])], "doc_id string, truth array<array<string>>")
    (tmp_path / "in").mkdir()
    put = lambda name, html: (tmp_path / f"in/{name}.json").write_text(json.dumps({"html_table": html}))
    put("d1", "<tr><td>a</td></tr>")
    put("d2", "<tr><td>b</td></tr>")
    run = lambda: score_stream(spark, str(tmp_path / "in"), truth, "field", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    put("d3", None)
    run()
    rows = {r.doc_id: (r.score and round(r.score, 4), r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"d1": (1.0, None), "d2": (0.8333, None), "d3": (None, "no prediction")}
