"""The calls of the nine services, as connectors.

`connect(name)` makes a service's connector. SDKs are imported here, when a connector is made, so on the
executors; none is needed to import this module. Two services have plain HTTP jobs: a document is sent
(uploaded first, for one of them), and the job polled until it ends. Two take a picture of the first page:
`rasterise` turns a document's bytes into one, by pdf2image unless another function is given.
"""

from __future__ import annotations

import base64
import io
import json
import os
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from .connectors import SERVICES, TABLE_PROMPT, Connector, ProviderRequestError, Service, poll, settings

PDF = "application/pdf"
Http = Callable[..., tuple[int, Any]]


def data_url(content: bytes, kind: str = PDF) -> str:
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"


def first_page(content: bytes) -> Any:
    """The picture of a PDF's first page."""
    from pdf2image import convert_from_bytes

    return convert_from_bytes(content, first_page=1, last_page=1)[0]


def png(picture: Any) -> bytes:
    held = io.BytesIO()
    picture.save(held, format="PNG")
    return held.getvalue()


def http(method: str, url: str, headers: dict[str, str], *, fields: dict[str, str] | None = None, file: tuple[str, bytes] | None = None, body: Any = None) -> tuple[int, Any]:
    """(status, JSON value or text) of a request: a form with fields and a file, a JSON body, or neither."""
    data, headers = None, dict(headers)
    if file is not None:
        edge = uuid.uuid4().hex
        headers["Content-Type"] = f"multipart/form-data; boundary={edge}"
        parts = [(f'name="{k}"', "", v.encode()) for k, v in (fields or {}).items()]
        parts.append((f'name="file"; filename="{file[0]}"', f"Content-Type: {PDF}\r\n", file[1]))
        data = b"".join(f"--{edge}\r\nContent-Disposition: form-data; {name}\r\n{kind}\r\n".encode() + value + b"\r\n" for name, kind, value in parts) + f"--{edge}--\r\n".encode()
    elif body is not None:
        headers["Content-Type"], data = "application/json", json.dumps(body).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method)) as got:
            code, text = got.status, got.read().decode()
    except urllib.error.HTTPError as refused:
        code, text = refused.code, refused.read().decode(errors="replace")
    try:
        return code, json.loads(text)
    except ValueError:
        return code, text


# --- SDKs ---------------------------------------------------------------------------------------


def content_understanding(service: Service, *, analyzer_id: str) -> Connector:
    endpoint, key = settings("azure_content_understanding")
    from azure.ai.contentunderstanding import ContentUnderstandingClient
    from azure.core.credentials import AzureKeyCredential

    client = ContentUnderstandingClient(endpoint, AzureKeyCredential(key))
    return lambda path, content: client.begin_analyze_binary(analyzer_id=analyzer_id, binary_input=content, **service.request).result().as_dict()


def document_intelligence(service: Service) -> Connector:
    endpoint, key = settings("azure_document_intelligence")
    from azure.ai.documentintelligence import DocumentIntelligenceClient
    from azure.ai.documentintelligence.models import AnalyzeDocumentRequest
    from azure.core.credentials import AzureKeyCredential

    client = DocumentIntelligenceClient(endpoint=endpoint, credential=AzureKeyCredential(key))
    return lambda path, content: client.begin_analyze_document(service.request["model"], AnalyzeDocumentRequest(bytes_source=content)).result().as_dict()


def document_ai(service: Service) -> Connector:
    """The first table of the first page that has one, not the largest."""
    project, processor = settings("google_document_ai")
    from google.api_core.client_options import ClientOptions
    from google.cloud import documentai
    from google.cloud.documentai_toolbox import document

    place = service.request["location"]
    client = documentai.DocumentProcessorServiceClient(client_options=ClientOptions(api_endpoint=f"{place}-documentai.googleapis.com"))
    name = client.processor_path(project, place, processor)

    def call(path: str, content: bytes) -> dict[str, Any]:
        raw = documentai.RawDocument(content=content, mime_type=service.request["mime_type"])
        found = document.Document.from_documentai_document(client.process_document(request=documentai.ProcessRequest(name=name, raw_document=raw)).document)
        tables = (table for page in found.pages for table in page.tables)
        return {"html_table": next((table.to_dataframe().to_html() for table in tables), None)}

    return call


def vision_model(service: Service, *, rasterise: Callable[[bytes], Any] = first_page) -> Connector:
    """A model that sees the first page and answers in HTML."""
    (key,) = settings("gpt4o")
    import openai

    client = openai.OpenAI(api_key=key)

    def call(path: str, content: bytes) -> dict[str, Any]:
        picture = {"type": "image_url", "image_url": {"url": data_url(png(rasterise(content)), "image/png")}}
        answer = client.chat.completions.create(messages=[{"role": "user", "content": [{"type": "text", "text": TABLE_PROMPT}, picture]}], **service.request)
        return {"html_table": answer.choices[0].message.content}

    return call


def mistral_ocr(service: Service, *, model: str) -> Connector:
    """Tables come as HTML. MISTRAL_TIMEOUT_MS overrides the time limit."""
    endpoint, key = settings("mistral_ocr")
    from mistralai.azure.client import MistralAzure

    client = MistralAzure(api_key=key, server_url=endpoint)
    limit = {"timeout_ms": int(os.environ.get("MISTRAL_TIMEOUT_MS", service.request["timeout_ms"]))}

    def call(path: str, content: bytes) -> Any:
        sent = {"type": "document_url", "document_url": data_url(content)}
        return client.ocr.process(model=model, document=sent, **dict(service.request) | limit).model_dump(mode="json")

    return call


def textract(service: Service, *, rasterise: Callable[[bytes], Any] = first_page) -> Connector:
    """The first table of the first page, without captions."""
    from textractor import Textractor
    from textractor.data.constants import TextractFeatures

    client = Textractor(region_name=service.request["region_name"])
    wanted = [getattr(TextractFeatures, name) for name in service.request["features"]]

    def call(path: str, content: bytes) -> dict[str, Any]:
        tables = client.analyze_document(file_source=rasterise(content), features=wanted).tables
        return {"html_table": re.sub("(?s)<caption>.*?</caption>", "", tables[0].to_html()) if len(tables) else None}

    return call


def unstructured(service: Service) -> Connector:
    (key,) = settings("unstructured")
    from unstructured_client import UnstructuredClient
    from unstructured_client.models import operations, shared

    client = UnstructuredClient(api_key_auth=key, server_url=service.request["server_url"])

    def call(path: str, content: bytes) -> dict[str, Any]:
        files = shared.Files(content=content, file_name=os.path.basename(path))
        wanted = shared.PartitionParameters(files=files, strategy=getattr(shared.Strategy, service.request["strategy"]))
        return {"elements": client.general.partition(request=operations.PartitionRequest(partition_parameters=wanted)).elements}

    return call


# --- HTTP jobs ----------------------------------------------------------------------------------


def _answered(what: str, answer: tuple[int, Any]) -> Any:
    code, value = answer
    if code != 200:
        raise ProviderRequestError(f"{what}: status {code}: {value}")
    return value


def _job(run: Callable[[str, bytes], dict[str, Any]]) -> Connector:
    """Whatever goes wrong on the way is an {"error": ...} response."""

    def call(path: str, content: bytes) -> dict[str, Any]:
        try:
            return run(path, content)
        except Exception as error:
            return {"error": str(error)}

    return call


def chunkr(service: Service, *, send: Http = http, sleep: Callable[[float], None] = time.sleep) -> Connector:
    """One form with the file and the task's options; the whole task is the response."""
    (key,) = settings("chunkr")
    headers = {"Authorization": key}

    def run(path: str, content: bytes) -> dict[str, Any]:
        task = _answered("submission", send("POST", service.url, headers, fields=dict(service.request), file=(os.path.basename(path), content)))
        return poll(service, lambda: send("GET", f"{service.url}/{task['task_id']}", headers), sleep)

    return _job(run)


def chunk_jobs(service: Service, *, url: str | None = None, send: Http = http, sleep: Callable[[float], None] = time.sleep) -> Connector:
    """The file is uploaded, a job started on it, and the finished job's result is the response."""
    (key,) = settings("chunk_jobs")
    base, headers = (url or service.url).rstrip("/"), {"Authorization": f"Bearer {key}"}

    def run(path: str, content: bytes) -> dict[str, Any]:
        upload = _answered("upload", send("POST", f"{base}/upload", headers, file=(os.path.basename(path), content)))
        job = _answered("submission", send("POST", f"{base}/parse_async", headers, body={"document_url": upload["file_id"], **service.request}))
        ended = poll(service, lambda: send("GET", f"{base}/job/{job['job_id']}", headers), sleep)
        return ended if "error" in ended else ended["result"]

    return _job(run)


_CALLS: dict[str, Callable[..., Connector]] = {
    "azure_content_understanding": content_understanding,
    "azure_document_intelligence": document_intelligence,
    "chunkr": chunkr,
    "google_document_ai": document_ai,
    "gpt4o": vision_model,
    "mistral_ocr": mistral_ocr,
    "chunk_jobs": chunk_jobs,
    "textract": textract,
    "unstructured": unstructured,
}


def connect(name: str, **options: Any) -> Connector:
    """The connector of a service of connectors.SERVICES, for run_connector's factory."""
    return _CALLS[name](SERVICES[name], **options)


def analyze(path: Path | str, name: str, *, sleep: Callable[[float], None] = time.sleep, **options: Any) -> dict[str, Any]:
    """One document through a service, tried again by its policy: the raw response. A file that can't be read is
    its own error; what the service or its SDK raises is a ProviderRequestError."""
    call = connect(name, **options)
    content = Path(path).read_bytes()
    try:
        response = SERVICES[name].policy.call(lambda: call(str(path), content), sleep)
    except Exception as error:
        raise ProviderRequestError(f"{name} did not answer: {error}") from error
    if not isinstance(response, dict):
        raise TypeError(f"{name} answered with {type(response).__name__}, not an object")
    return response
