import json
import threading
from functools import partial
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from loomq.operators import translate
from loomq.sources import providers as p


@pytest.fixture()
def server():
    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            size = int(self.headers.get("Content-Length") or 0)
            body = json.loads(self.rfile.read(size)) if size else None
            seen.append((dict(self.headers), body))
            status, headers, answer = answers.pop(0)(body) if answers else (200, {}, {"translations": [{"text": t.upper()} for t in body["text"]]})
            data = json.dumps(answer).encode()
            self.send_response(status)
            for k, v in {**headers, "Content-Length": str(len(data))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST

        def log_message(self, *args):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/", seen, answers
    own.shutdown()


def test_batches_and_markup(server):
    url, seen, _ = server
    provider = p.HttpProvider(p.DEEPL, "k", url)
    assert provider.translate(["a", "<b>c</b>", "d"], "de", "en") == ["A", "<B>C</B>", "D"]
    plain, markup = (body for _, body in seen)
    assert plain == {"text": ["a", "d"], "target_lang": "DE", "source_lang": "EN", "formality": "less"} and markup["tag_handling"] == "html"
    assert seen[0][0]["Authorization"] == "DeepL-Auth-Key k"
    provider.translate(["x"] * 120, "fi", None)
    assert [len(body["text"]) for _, body in seen[2:]] == [50, 50, 20] and "formality" not in seen[2][1] and "source_lang" not in seen[2][1]


def test_waits_and_errors(server):
    url, seen, answers = server
    waits = []
    provider = p.HttpProvider(p.DEEPL, "k", url, waits.append)
    answers[:] = [lambda b: (429, {"Retry-After": "7"}, {}), lambda b: (429, {"Retry-After": "soon"}, {})]
    assert provider.translate(["a"], "de", None) == ["A"] and waits == [7.0, 60.0]
    answers[:] = [lambda b: (429, {}, {"message": "slow down"})] * 3
    assert [str(e) for e in provider.translate(["a", "b"], "de", None)] == ["429 slow down"] * 2
    answers[:] = [lambda b: (403, {}, {"error": {"message": "no key"}})]
    assert str(provider.translate(["a"], "de", None)[0]) == "403 no key"
    answers[:] = [lambda b: (200, {}, {"translations": []})]
    assert "1 texts sent, 0 came back" in str(provider.translate(["a"], "de", None)[0])
    answers[:] = [lambda b: (200, {}, {"odd": 1})]
    assert "unexpected answer" in str(provider.translate(["a"], "de", None)[0])
    assert isinstance(p.HttpProvider(p.DEEPL, "k", "http://127.0.0.1:9/").translate(["a"], "de", None)[0], p.ServiceError)


def test_other_services(server):
    url, seen, answers = server
    answers[:] = [lambda b: (200, {}, {"data": {"translations": [{"translatedText": "eins"}]}}), lambda b: (200, {}, {"choices": [{"message": {"content": "```html\n<i>zwei</i>\n```"}}]})]
    assert p.HttpProvider(p.GOOGLE, "g", url).translate(["one"], "DE", "EN") == ["eins"]
    assert seen[-1][1] == {"q": ["one"], "target": "de", "format": "text", "source": "en"} and {k.lower(): v for k, v in seen[-1][0].items()}["x-goog-api-key"] == "g"
    assert p.HttpProvider(p.chat(url, "m"), "o").translate(["<i>two</i>"], "DE", None) == ["<i>zwei</i>"]
    request = seen[-1][1]
    assert request["temperature"] == 0.1 and request["messages"][1]["content"] == "<i>two</i>" and "HTML" in request["messages"][0]["content"]
    assert "temperature" not in p.chat(url, "o1-mini").body(["x"], "DE", None, False)


def test_usage(server):
    url, _, answers = server
    service = p.replace(p.DEEPL, usage_url=url)
    answers[:] = [lambda b: (200, {}, {"character_count": 5, "character_limit": 9}), lambda b: (500, {}, {})]
    provider = p.HttpProvider(service, "k", url)
    assert provider.usage() == (True, 5, 9) and provider.usage() == (False, None, None)
    assert p.HttpProvider(p.GOOGLE, "k", url).usage() == (False, None, None)
    assert p.availability({"deepl": "x", "grok": " "}, ["ocr"]) == {"deepl": True, "google": False, "openai": False, "grok": False, "ocr": True}


def test_in_a_translation(spark, server):
    url, _, _ = server
    translate.register("deepl-here", partial(p.HttpProvider, p.DEEPL, "k", url))
    units = spark.createDataFrame([(1, 0, "hello WISDOM", True), (1, 1, "x", False)], "doc_id int, unit_index int, text string, translatable boolean")
    done = translate.translate_units(units, "deepl-here", "DE", terms=["wisdom"]).orderBy("unit_index").collect()
    assert [(r["status"], r["translated"]) for r in done] == [("translated", "HELLO WISDOM"), ("skipped", None)]
