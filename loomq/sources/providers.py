"""Translation services over HTTP, by their published interfaces, and what is available.

A service says how a request is made of texts and how its answer is read; sending, waiting and errors are the same for
all. Register one with translate.register(name, functools.partial(HttpProvider, service, key)); a worker makes its own.
"""

from __future__ import annotations

import html
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

#: Attempts where a service asks to wait, and the wait where it doesn't say how long.
ATTEMPTS, WAIT = 3, 60.0
# Fixed value: target languages for which the first service takes a form of address.
WITH_FORMALITY = ("DE", "FR", "IT", "ES", "NL", "PL", "PT-BR", "PT-PT", "JA", "RU")
# Fixed value: model families that take the default temperature only.
FIXED_TEMPERATURE = ("o1", "o3", "gpt-5")
_MARKUP = re.compile(r"<[a-zA-Z/][^>]*>")


class ServiceError(Exception):
    pass


@dataclass(frozen=True)
class Service:
    """url, headers(key), body(texts, target, source, markup), read(answer), texts in a request, timeout in seconds."""

    url: str
    headers: Callable[[str], dict[str, str]]
    body: Callable[[list[str], str, str | None, bool], dict]
    read: Callable[[dict], list[str]]
    batch: int = 1
    timeout: float = 60.0
    usage_url: str | None = None


def _deepl_body(texts: list[str], target: str, source: str | None, markup: bool) -> dict:
    body: dict = {"text": texts, "target_lang": target.upper()}
    if source:
        body["source_lang"] = source.upper()
    if markup:
        body["tag_handling"] = "html"
    if target.upper() in WITH_FORMALITY:
        body["formality"] = "less"
    return body


def _google_body(texts: list[str], target: str, source: str | None, markup: bool) -> dict:
    return {"q": texts, "target": target.lower(), "format": "html" if markup else "text"} | ({"source": source.lower()} if source else {})


def chat(url: str, model: str) -> Service:
    """A service of the chat kind: instructions and one text in, one text out."""

    def body(texts: list[str], target: str, source: str | None, markup: bool) -> dict:
        rules = [f"Translate the user's text{f' from {source}' if source else ''} to {target}.", "Use the informal form of address.", "Answer with the translation only."]
        if markup:
            rules.insert(1, "Keep every HTML tag and attribute exactly as it is and translate only what stands between tags.")
        request = {"model": model, "messages": [{"role": "system", "content": " ".join(rules)}, {"role": "user", "content": texts[0]}]}
        return request if model.startswith(FIXED_TEMPERATURE) else request | {"temperature": 0.1}

    def read(answer: dict) -> list[str]:
        text = answer["choices"][0]["message"]["content"]
        fenced = re.fullmatch(r"\s*```[a-zA-Z]*\n(.*?)\n?```\s*", text, re.S)
        return [fenced[1] if fenced else text]

    return Service(url, lambda key: {"Authorization": f"Bearer {key}"}, body, read)


DEEPL = Service(
    "https://api-free.deepl.com/v2/translate", lambda key: {"Authorization": f"DeepL-Auth-Key {key}"}, _deepl_body,
    lambda answer: [t["text"] for t in answer["translations"]], 50, 30.0, "https://api-free.deepl.com/v2/usage",
)
GOOGLE = Service(
    "https://translation.googleapis.com/language/translate/v2", lambda key: {"X-Goog-Api-Key": key}, _google_body,
    lambda answer: [t["translatedText"] for t in answer["data"]["translations"]], 100, 30.0,
)
SERVICES = {
    "deepl": DEEPL, "google": GOOGLE, "openai": chat("https://api.openai.com/v1/chat/completions", "gpt-4o-mini"), "grok": chat("https://api.x.ai/v1/chat/completions", "grok-3-mini"),
}


class HttpProvider:
    """A provider as translate.translate_units() takes it; a request that fails is an error of each of its texts."""

    def __init__(self, service: Service, key: str, url: str | None = None, sleep: Callable[[float], None] = time.sleep):
        self.service, self.key, self.sleep = replace(service, url=url) if url else service, key, sleep

    def translate(self, texts: list[str], target: str, source: str | None) -> list[str | Exception]:
        out: list[str | Exception] = [ServiceError("not sent")] * len(texts)
        for markup in (False, True):  # texts with and without markup are asked for apart
            own = [i for i, t in enumerate(texts) if bool(_MARKUP.search(t)) == markup]
            for at in range(0, len(own), self.service.batch):
                part = own[at : at + self.service.batch]
                try:
                    answer = self.service.read(self._send(self.service.url, self.service.body([texts[i] for i in part], target, source, markup)))
                    if len(answer) != len(part):
                        raise ServiceError(f"{len(part)} texts sent, {len(answer)} came back")
                except (ServiceError, KeyError, IndexError, TypeError) as error:
                    answer = [error if isinstance(error, ServiceError) else ServiceError(f"unexpected answer: {error!r}")] * len(part)
                for i, text in zip(part, answer):
                    out[i] = text
        return out

    def usage(self) -> tuple[bool, int | None, int | None]:
        """(whether the service tells its usage, characters used, limit), as translate.analysis() takes it as live."""
        if not self.service.usage_url:
            return False, None, None
        try:
            found = self._send(self.service.usage_url, None)
        except ServiceError:
            return False, None, None
        return True, found.get("character_count"), found.get("character_limit")

    def _send(self, url: str, body: dict | None) -> dict:
        data = None if body is None else json.dumps(body).encode("utf-8")
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", **self.service.headers(self.key)})
        for attempt in range(1, ATTEMPTS + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.service.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as error:
                if error.code == 429 and attempt < ATTEMPTS:
                    self.sleep(_wait(error.headers.get("Retry-After")))
                    continue
                raise ServiceError(f"{error.code} {_told(error.read())}".strip()) from None
            except (urllib.error.URLError, TimeoutError, ValueError) as error:
                raise ServiceError(str(getattr(error, "reason", error))) from None
        raise ServiceError("too many requests")


def _wait(told: str | None) -> float:
    try:
        return max(float(told), 1.0) if told else WAIT
    except ValueError:
        return WAIT


def _told(data: bytes) -> str:
    """What an error's body says, without the request's key or text."""
    try:
        found = json.loads(data)
        said = found.get("message") or found.get("error", {}).get("message", "")
    except (ValueError, AttributeError):
        said = ""
    return html.unescape(str(said))[:200]


def availability(keys: dict[str, str | None], engines: Iterable[str] = ()) -> dict[str, bool]:
    """Which providers have a key and which engines are there, by name."""
    return {name: bool((keys.get(name) or "").strip()) for name in SERVICES} | dict.fromkeys(engines, True)
