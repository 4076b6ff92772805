"""What a provider is: a picklable object with complete(), embed() and two names."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

EDGE = re.compile(r"^[\s!-/:-@\[-`{-~]+|[\s!-/:-@\[-`{-~]+$")


@dataclass(frozen=True)
class Request:
    instruction: str
    text: str
    max_tokens: int
    schema: dict | None = None


@dataclass(frozen=True)
class Failure:
    """A request that got no usable answer; the row fails, not the query."""

    reason: str


class Provider(Protocol):
    model_id: str
    embed_id: str
    embed_batch: int

    def complete(self, requests: list[Request]) -> list[str | Failure]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def yes_or_no(answer: str) -> bool | None:
    word = EDGE.sub("", answer).lower()
    return {"yes": True, "no": False}.get(word)


def json_object(answer: str) -> dict | None:
    """An object, with or without a fence around it."""
    text = answer.strip()
    if text.startswith("```"):
        text = text[3:].removesuffix("```").strip()
        text = text[4:].strip() if text[:4].lower() == "json" else text
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def score_of(answer: str) -> float | None:
    value = (json_object(answer) or {}).get("score")
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return None
    return min(1.0, max(0.0, float(value)))


@dataclass
class Mock:
    """A deterministic model. "yes" to an input that holds a needle of the condition; JSON by a responder.

    needles: condition -> substrings; a condition not named is its own needle. responder(request) answers
    requests with a schema. themes: embeddings count one dimension a theme that the text holds (15 at most), else the
    bytes' positions modulo 16.
    """

    needles: dict[str, list[str]] = field(default_factory=dict)
    responder: Callable[[Request], Any] | None = None
    themes: list[str] | None = None
    model_id: str = "mock"
    embed_id: str = "mock-embed"
    embed_batch: int = 64

    def holds(self, condition: str, text: str) -> bool:
        return any(n in text for n in self.needles.get(condition, [condition]))

    def complete(self, requests: list[Request]) -> list[str | Failure]:
        return [self.answer(r) for r in requests]

    def answer(self, r: Request) -> str | Failure:
        if r.schema is None:
            return "yes" if self.holds(r.instruction.partition("Condition: ")[2].partition("\n")[0], r.text) else "no"
        if self.responder:
            out = self.responder(r)
            return out if isinstance(out, (str, Failure)) else json.dumps(out)
        keys = r.schema["properties"]
        if set(keys) == {"score"}:
            query = r.instruction.partition("Query: ")[2].partition("\n")[0].lower().split()
            return json.dumps({"score": sum(w in r.text.lower() for w in query) / max(1, len(query))})
        if set(keys) == {"label"}:
            words = re.findall(r"\w+", r.text.lower())
            return json.dumps({"label": next((t for t in self.themes or [] if t in r.text), max(sorted(set(words)), key=words.count, default="empty"))})
        return json.dumps({k: self.holds(v.get("description", k), r.text) if v.get("type") == "boolean" else None for k, v in keys.items()})

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * 16
            if self.themes is not None:
                for i, theme in enumerate(self.themes[:15]):
                    v[i] = 1.0 if theme in t else 0.0
                if not any(v):
                    v[15] = 1.0
            else:
                for i, b in enumerate(t.encode()):
                    v[i % 16] += b / 255.0
            out.append(v)
        return out
