"""Embedders, extractors and judges behind HTTP, and the checks of their settings.

A setting names a provider, a model and, if need be, a base URL and a key. All but one of the providers speak the same
published chat and embedding format; the other has a format of its own. Nothing is called before it is used.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from urllib.parse import urlparse

from graphloom.functions import text as tx
from graphloom.operators.providers import Embedder, Extractor, parse_extraction, validate

#: Names of providers, published addresses, limits of a call.
LOCAL, KEYED = "ollama", ("openai", "azure", "groq")
BASE_URLS = {
    "ollama": "http://localhost:11434",
    "openai": "https://api.openai.com/v1",
    "azure": "https://api.openai.com/v1",
    "groq": "https://api.openai.com/v1",
    "genai": "https://generativelanguage.googleapis.com/v1beta/openai",
    "gemini": "https://generativelanguage.googleapis.com/v1beta/openai",
}
PROVIDERS = (*BASE_URLS, "vertex")
SECONDS, ERROR_BYTES, ANSWER_BYTES = 120, 4096, 32 << 20


def check_url(url: str) -> str:
    parts = urlparse(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"not a http or https address: {url!r}")
    return url.rstrip("/")


@dataclass(frozen=True)
class Setting:
    """What a knowledge base says of a provider."""

    provider: str
    model: str
    base_url: str = ""
    dim: int = 0
    key: str = ""

    @staticmethod
    def of(config: Mapping, key: str = "") -> Setting:
        return Setting(config.get("provider") or "", config.get("model") or "", config.get("base_url") or "", int(config.get("dim") or 0), config.get("api_key") or key)

    def checked(self, embeds: bool) -> Setting:
        """The setting with its address; an error if it cannot work. Embeddings of the keyed providers need a key."""
        if not self.model:
            raise ValueError("a provider needs the name of a model")
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider!r}: one of {', '.join(PROVIDERS)}")
        if embeds and self.provider in KEYED and not self.key:
            raise ValueError(f"{self.provider} needs a key")
        url = self.base_url or BASE_URLS.get(self.provider, "")
        if self.provider == "vertex" and not url:
            project, place = os.environ.get("GOOGLE_CLOUD_PROJECT", ""), os.environ.get("GOOGLE_CLOUD_LOCATION", "us-central1")
            if not project:
                raise ValueError("vertex needs a base URL or GOOGLE_CLOUD_PROJECT")
            url = f"https://{place}-aiplatform.googleapis.com/v1beta1/projects/{project}/locations/{place}/endpoints/openapi"
        return Setting(self.provider, self.model, check_url(url), self.dim, self.key)


def post(url: str, payload: dict, key: str = "", seconds: float = SECONDS) -> dict:
    """Posts JSON and reads JSON; any status but 200 is an error with the head of the answer."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            if answer.status != 200:
                raise OSError(f"status {answer.status}")
            body = answer.read(ANSWER_BYTES + 1)
    except urllib.error.HTTPError as e:
        raise OSError(f"status {e.code}: {e.read(ERROR_BYTES).decode(errors='replace')}") from None
    if len(body) > ANSWER_BYTES:
        raise OSError(f"an answer of more than {ANSWER_BYTES} bytes")
    return json.loads(body)


class HttpEmbedder:
    def __init__(self, setting: Setting):
        self.setting = setting.checked(embeds=True)
        self.dim = setting.dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        s = self.setting
        if not texts:
            return []
        if s.provider == LOCAL:
            vectors = post(f"{s.base_url}/api/embed", {"model": s.model, "input": texts}, s.key)["embeddings"]
        else:
            vectors = [r["embedding"] for r in sorted(post(f"{s.base_url}/embeddings", {"model": s.model, "input": texts}, s.key)["data"], key=lambda r: r.get("index", 0))]
        validate(vectors, len(texts), self.dim or None)
        return vectors


def chat(setting: Setting, as_json: bool = False) -> Callable[[str], str]:
    """A function that puts a prompt to a model."""
    s = setting.checked(embeds=False)

    def ask(prompt: str) -> str:
        messages = [{"role": "user", "content": prompt}]
        if s.provider == LOCAL:
            return post(f"{s.base_url}/api/chat", {"model": s.model, "messages": messages, "stream": False} | ({"format": "json"} if as_json else {}), s.key)["message"]["content"]
        found = post(f"{s.base_url}/chat/completions", {"model": s.model, "messages": messages} | ({"response_format": {"type": "json_object"}} if as_json else {}), s.key)
        if not found.get("choices"):
            raise OSError("an answer without choices")
        return found["choices"][0]["message"]["content"]

    return ask


class ChatExtractor:
    """Extraction, and the question whether two entities are one, by a model that answers prompts."""

    def __init__(self, ask_json: Callable[[str], str], ask: Callable[[str], str] | None = None):
        self.ask_json, self.ask = ask_json, ask or ask_json

    def extract(self, text: str) -> dict:
        return parse_extraction(self.ask_json(tx.extraction_prompt(text)))

    def same(self, a: dict, b: dict) -> bool:
        return self.ask(tx.resolution_prompt(a, b)).strip().strip('."').lower() == "true"

    def summarize(self, text: str) -> str:
        return self.ask(tx.summary_prompt(text)).strip()


def embedder(config: Mapping, key: str = "") -> Embedder:
    return HttpEmbedder(Setting.of(config, key))


def extractor(config: Mapping, key: str = "") -> Extractor:
    setting = Setting.of(config, key)
    return ChatExtractor(chat(setting, as_json=True), chat(setting))


def check_knowledge_base(kb: Mapping, key: str = "") -> None:
    """An error if a knowledge base's settings name providers that cannot work. Settings that are missing mean the built-in embedder and rules."""
    for name, embeds in (("embed_config", True), ("llm_config", False)):
        config = kb.get(name)
        if config and any(config.get(k) for k in ("provider", "model", "base_url")):
            try:
                Setting.of(config, key).checked(embeds)
            except ValueError as e:
                raise ValueError(f"{name} of {kb.get('id') or kb.get('name')}: {e}") from None
