"""Models behind small interfaces: an HTTP client and offline stand-ins."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass


@dataclass(frozen=True)
class HttpModel:
    """A service with ``/embeddings`` and ``/chat/completions`` routes."""

    url: str
    key: str = ""
    embedding_model: str = "embedding"
    chat_model: str = "chat"
    timeout: float = 60.0

    def _post(self, route: str, body: dict) -> dict:
        request = urllib.request.Request(
            f"{self.url.rstrip('/')}/{route}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        )
        with urllib.request.urlopen(request, timeout=self.timeout) as response:  # raises on an error status
            return json.loads(response.read())

    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector per text, empty where the service returns none."""
        data = self._post("embeddings", {"model": self.embedding_model, "input": texts}).get("data") or []
        vectors = [d.get("embedding") or [] for d in data]
        return vectors + [[]] * (len(texts) - len(vectors))

    def chat(self, system: str, user: str, as_json: bool = False) -> str:
        """The first choice, or an empty text (``{}`` for JSON)."""
        body: dict = {"model": self.chat_model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if as_json:
            body["response_format"] = {"type": "json_object"}
        choices = self._post("chat/completions", body).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ("{}" if as_json else "")


class Extractive:
    """Answers with the first lines of the best passages; needs no model."""

    def chat(self, system: str, user: str, as_json: bool = False) -> str:
        heads = [line for line in user.splitlines() if line.startswith("[DOC #")]
        return "{}" if as_json else ("Most relevant: " + "; ".join(heads[:3]) if heads else "No passage was found.")
