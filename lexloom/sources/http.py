"""HTTP connectors to model services: what is sent, and how replies are read. How a request is made is a parameter."""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable

from lexloom.functions import SYSTEM_PROMPT
from lexloom.sources.models import Embed
from lexloom.sources.settings import Settings

#: post(url, headers, body) gives the status and the text of the reply; it raises OSError where there is none.
Post = Callable[[str, dict, dict], tuple[int, str]]

# The instruction of rerankers that take one, and the part of a model's name that tells them.
RERANK_INSTRUCTION = "Given a legal question, retrieve passages that answer the question from Indonesian labor-law regulations"
PAIRWISE = "qwen3-reranker"


class ServiceError(RuntimeError):
    """A model service could not be reached, refused or gave a reply that cannot be used."""


def urllib_post(timeout: float) -> Post:
    """Requests by the standard library."""

    def post(url: str, headers: dict, body: dict) -> tuple[int, str]:
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.status, reply.read().decode()
        except urllib.error.HTTPError as refused:
            return refused.code, refused.read().decode("utf-8", "replace")

    return post


def detail_of(text: str) -> str:
    """A short error of a refused request: its detail, its error or the body, 500 characters at most."""
    try:
        body = json.loads(text)
    except ValueError:
        body = text
    return str((body.get("detail") or body.get("error") or body) if isinstance(body, dict) else body)[:500]


def _ask(settings: Settings, post: Post, path: str, body: dict, what: str):
    headers = {"Authorization": f"Bearer {settings.api_key}", "Content-Type": "application/json"}
    try:
        status, text = post(f"{settings.base_url}/{path}", headers, body)
    except OSError as error:
        raise ServiceError(f"{what} cannot be reached") from error
    if status >= 400:
        raise ServiceError(f"{what} failed (HTTP {status}): {detail_of(text)}")
    try:
        return json.loads(text)
    except ValueError as error:
        raise ServiceError(f"{what} did not reply in JSON") from error


def _numbers(row, what: str) -> list[float]:
    try:
        out = [float(x) for x in row]
    except (TypeError, ValueError) as error:
        raise ServiceError(f"{what} holds what is no number") from error
    if not all(map(math.isfinite, out)):
        raise ServiceError(f"{what} holds a value that is not finite")
    return out


def embedder(settings: Settings, post: Post | None = None) -> Callable[[], Embed]:
    """For embed_texts: dense and sparse vectors in one request. A sparse row is an object of index to value or a whole list."""

    def connect() -> Embed:
        settings.check_indexing()
        send = post or urllib_post(settings.http_timeout_seconds)

        def embed(texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
            if not texts:
                return []
            body = _ask(settings, send, f"inference/{settings.embedding_model}", {"inputs": texts, "dense": True, "sparse": True, "colbert": False, "normalize": True}, "the embedding service")
            dense, sparse = (body.get(k) if isinstance(body, dict) else None for k in ("embeddings", "sparse"))
            if not isinstance(dense, list) or not isinstance(sparse, list) or len(dense) != len(texts) or len(sparse) != len(texts):
                raise ServiceError(f"the embedding service did not give {len(texts)} dense and sparse vectors")
            out = []
            for row, weights in zip(dense, sparse, strict=True):
                if not isinstance(row, list) or not row or not isinstance(weights, dict | list):
                    raise ServiceError("an empty or broken vector")
                pairs = list(weights.items()) if isinstance(weights, dict) else list(enumerate(weights))
                places = [int(x) for x in _numbers([k for k, _ in pairs], "a sparse vector")]
                if any(p < 0 for p in places):
                    raise ServiceError("a sparse vector with a negative index")
                own = zip(places, _numbers([v for _, v in pairs], "a sparse vector"), strict=True)
                out.append((_numbers(row, "a dense vector"), {k: v for k, v in own if v}))
            return out

        return embed

    return connect


def reranker(settings: Settings, post: Post | None = None) -> Callable[[], Callable[[str, list[str]], list[float]]]:
    """For model_rerank: a score for each text. Some models take a query for each text and an instruction, the others one query."""

    def connect() -> Callable[[str, list[str]], list[float]]:
        settings.check_query()
        send = post or urllib_post(settings.http_timeout_seconds)

        def score(question: str, texts: list[str]) -> list[float]:
            if PAIRWISE in settings.rerank_model.lower():
                body = {"queries": [question] * len(texts), "documents": texts, "instruction": RERANK_INSTRUCTION}
            else:
                body = {"query": question, "documents": texts}
            reply = _ask(settings, send, f"inference/{settings.rerank_model}", body, "the reranker") if texts else []
            scores = reply.get("scores") if isinstance(reply, dict) else reply
            if not isinstance(scores, list) or len(scores) != len(texts):
                raise ServiceError(f"the reranker did not give {len(texts)} scores")
            return _numbers(scores, "the reranker's reply")

        return score

    return connect


def _chat(settings: Settings, send: Post, system: str, user: str, temperature: float, tokens: int) -> str:
    body = {"model": settings.generative_model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": temperature, "max_tokens": tokens, "stream": False}
    reply = _ask(settings, send, "openai/chat/completions", body, "the chat model")
    try:
        content = reply["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError) as error:
        raise ServiceError("the chat model gave no message") from error
    if not isinstance(content, str):
        raise ServiceError("the chat model gave no text")
    return content


def scope_model(settings: Settings, post: Post | None = None) -> Callable[[], Callable[[str, str], str]]:
    """For classify_scope: replies to (system prompt, user prompt)."""

    def connect() -> Callable[[str, str], str]:
        settings.check_scope()
        send = post or urllib_post(settings.http_timeout_seconds)
        return lambda system, user: _chat(settings, send, system, user, 0.0, 16)

    return connect


def answer_model(settings: Settings, post: Post | None = None) -> Callable[[], Callable[[str, str], str]]:
    """For generate_answers: replies to (question, context)."""

    def connect() -> Callable[[str, str], str]:
        settings.check_query()
        send = post or urllib_post(settings.http_timeout_seconds)
        # the same text as generation_prompt's
        user = lambda question, context: f"Pertanyaan pengguna:\n{question}\n\nKonteks dokumen:\n{context}\n\nBerikan jawaban yang langsung, ringkas, dan ter-grounding pada konteks.\n/no_think"
        return lambda question, context: _chat(settings, send, SYSTEM_PROMPT, user(question, context), 0.7, settings.generation_max_tokens)

    return connect
