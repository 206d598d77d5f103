"""Hosted embedding and language models: error classes, retries, and thin clients.

``post`` is any callable(url, json, headers, timeout) -> (status, body text); nothing here opens a
connection by itself, so tests and offline runs inject their own.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomdex.config import GenerationConfig


class TransientError(RuntimeError):
    """Worth another attempt."""


class PermanentError(RuntimeError):
    """Will fail again."""


Post = Callable[..., tuple[int, str]]


#: Which answers are worth another attempt, by status and by words of an error in the body.
RETRY_STATUS = (429, *range(500, 600))
RETRY_WORDS = re.compile(r"429|busy|overloaded", re.IGNORECASE)


def fault_in(status: int, body: str) -> tuple[type[RuntimeError], str] | dict:
    """What an answer stands for: an error's class and its subject, or the decoded body."""
    if status >= 400:
        return (TransientError if status in RETRY_STATUS else PermanentError), f"status {status}"
    try:
        got = json.loads(body)
    except ValueError:
        return PermanentError, "no JSON"
    told = got.get("error") if isinstance(got, dict) else None
    if told is None:
        return got
    text = str(told.get("message", told)) if isinstance(told, dict) else str(told)
    again = RETRY_WORDS.search(text) or (isinstance(told, dict) and told.get("code") in RETRY_STATUS[:1])
    return (TransientError if again else PermanentError), f"error in the body: {text}"


def payload_of(status: int, body: str) -> dict:
    """The decoded body; raises the error that an answer stands for, with the start of the body."""
    got = fault_in(status, body)
    if isinstance(got, tuple):
        kind, subject = got
        raise kind(f"{subject[:400]} | {body[:400]}")
    return got


def with_retries(call: Callable[[], object], attempts: int, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """``call`` again after transient errors, with doubling pauses."""
    pause = first
    for n in range(1, attempts + 1):
        try:
            return call()
        except TransientError:
            if n == attempts:
                raise
            sleep(pause)
            pause = min(most, pause * 2)


def _send(post: Post, url: str, body: dict, key: str, timeout: float) -> dict:
    if not key:
        raise PermanentError("no API key")
    try:
        status, text = post(url, json=body, headers={"Authorization": f"Bearer {key}"}, timeout=timeout)
    except (TimeoutError, ConnectionError) as e:
        raise TransientError(f"connection: {e}") from e
    return payload_of(status, text)


@dataclass
class EmbeddingClient:
    post: Post
    url: str
    key: str
    model: str
    dimension: int = 1024
    attempts: int = 6
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, texts: list[str]) -> list[list[float]]:
        def once() -> list[list[float]]:
            got = _send(self.post, self.url, {"model": self.model, "input": texts, "dimensions": self.dimension}, self.key, 60)
            if "data" not in got:
                raise PermanentError("no data in the response")
            return [x["embedding"] for x in got["data"]]

        return with_retries(once, self.attempts, sleep=self.sleep)


@dataclass
class ChatClient:
    post: Post
    url: str
    key: str
    config: GenerationConfig = GenerationConfig()
    attempts: int = 4
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, system: str, user: str, model: str | None = None, temperature: float | None = None, top_p: float | None = None) -> str:
        c = self.config
        body = {
            "model": model or c.model, "temperature": c.temperature if temperature is None else temperature, "top_p": c.top_p if top_p is None else top_p,
            "max_tokens": c.max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
        }

        def once() -> str:
            got = _send(self.post, self.url, body, self.key, 90)
            try:
                return got["choices"][0]["message"]["content"]
            except (KeyError, IndexError, TypeError) as e:
                raise PermanentError("no message in the response") from e

        return with_retries(once, self.attempts, sleep=self.sleep)


def embed_column(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 8) -> DataFrame:
    """(chunk_id, embedding) by ``embed`` on ``batch`` texts a call. Task retries call again, so ``embed`` must be repeatable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            vecs = [[float(x) for x in v] for a in range(0, len(texts), batch) for v in embed(texts[a : a + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    return rows.select("chunk_id", text).mapInArrow(run, "chunk_id string, embedding array<float>")
