"""Providers over HTTP, with retries; only the standard library is needed."""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from lucidframe.model.base import Failure, Request

IN_FLIGHT = 8
RETRIES = 4
RETRY_STATUS = {408, 425, 429, 500, 502, 503, 504, 529}
FIRST_WAIT, LONGEST_WAIT = 0.25, 30.0


class ProviderError(RuntimeError):
    pass


def post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 120.0, sleep=time.sleep) -> dict:
    """JSON in, JSON out; waits double from a quarter second, with jitter, unless the server says how long."""
    data = json.dumps(body).encode()
    for attempt in range(RETRIES + 1):
        wait = min(LONGEST_WAIT, FIRST_WAIT * 2**attempt)
        wait = wait / 2 + random.random() * wait / 2
        try:
            request = urllib.request.Request(url, data, {"content-type": "application/json"} | (headers or {}))
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == RETRIES:
                raise ProviderError(f"{url}: status {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from None
            after = e.headers.get("retry-after", "")
            wait = float(after) if after.isdigit() else wait
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if attempt == RETRIES:
                raise ProviderError(f"{url}: {e}") from None
        sleep(wait)
    raise AssertionError


def key_from(name: str) -> str:
    if not os.environ.get(name):
        raise ProviderError(f"set {name} to the provider's key")
    return os.environ[name]


class _Concurrent:
    def complete(self, requests: list[Request]) -> list[str | Failure]:
        def one(r: Request) -> str | Failure:
            try:
                return self.ask(r)
            except (ProviderError, KeyError, IndexError, TypeError) as e:
                return Failure(str(e)[:300])

        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            return list(pool.map(one, requests))


@dataclass
class Ollama(_Concurrent):
    model_id: str = "qwen3:4b"
    embed_id: str = "nomic-embed-text"
    url: str = "http://localhost:11434"
    embed_batch: int = 64

    def ask(self, r: Request) -> str:
        body = {"model": self.model_id, "stream": False, "think": False, "messages": [{"role": "system", "content": r.instruction}, {"role": "user", "content": r.text}], "options": {"temperature": 0, "num_predict": r.max_tokens}}
        if r.schema:
            body["format"] = r.schema
        return post(f"{self.url}/api/chat", body)["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return post(f"{self.url}/api/embed", {"model": self.embed_id, "input": texts})["embeddings"]


@dataclass
class Anthropic(_Concurrent):
    model_id: str = "claude-haiku-4-5"
    url: str = "https://api.anthropic.com"
    key_name: str = "ANTHROPIC_API_KEY"
    embed_id: str = ""
    embed_batch: int = 64

    def ask(self, r: Request) -> str:
        body = {"model": self.model_id, "max_tokens": r.max_tokens, "system": r.instruction, "messages": [{"role": "user", "content": r.text}]}
        if r.schema:
            body["output_config"] = {"format": {"type": "json_schema", "schema": r.schema}}
        out = post(f"{self.url}/v1/messages", body, {"x-api-key": key_from(self.key_name), "anthropic-version": "2023-06-01"})
        if out.get("stop_reason") == "refusal":
            raise ProviderError("the model refused")
        return "".join(b["text"] for b in out["content"] if b["type"] == "text")

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise ProviderError("this provider has no embeddings; name another embedder")


@dataclass
class Voyage:
    embed_id: str = "voyage-3.5"
    url: str = "https://api.voyageai.com"
    key_name: str = "VOYAGE_API_KEY"
    model_id: str = ""
    embed_batch: int = 128

    def complete(self, requests: list[Request]) -> list[str | Failure]:
        return [Failure("this provider has no completions") for _ in requests]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), 1000):
            body = {"model": self.embed_id, "input": texts[i : i + 1000]}
            data = post(f"{self.url}/v1/embeddings", body, {"authorization": f"Bearer {key_from(self.key_name)}"})["data"]
            out += [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        return out


@dataclass
class Paired:
    """Completions of one provider, embeddings of another."""

    completer: object
    embedder: object

    @property
    def model_id(self) -> str:
        return self.completer.model_id

    @property
    def embed_id(self) -> str:
        return self.embedder.embed_id

    @property
    def embed_batch(self) -> int:
        return self.embedder.embed_batch

    def complete(self, requests):
        return self.completer.complete(requests)

    def embed(self, texts):
        return self.embedder.embed(texts)
