"""Interfaces of models, and deterministic stand-ins for where no model is installed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    """Turns texts into vectors of ``dimension`` numbers, one each, in order."""

    dimension: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class RerankingProvider(Protocol):
    """Scores documents for a question, one finite number each, in order."""

    def score(self, question: str, documents: Sequence[str]) -> list[float]: ...


class AnswerProvider(Protocol):
    """Answers an ordered batch of (role, content) messages."""

    def chat(self, messages: Sequence[tuple[str, str]]) -> str: ...


class ProviderError(RuntimeError):
    """A provider gave something it must not give, or nothing."""


class ProviderUnavailable(ProviderError):
    """A provider cannot be reached, or its model is not there."""


class ProviderTimeout(ProviderError):
    """A provider did not answer in time."""


class ProviderResponseError(ProviderError):
    """A provider answered what is no answer."""


class DigestEmbedding:
    """Vectors from the SHA-256 of a text: the same on every machine, without meaning."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        """(byte + 1) / 256 of the digest's bytes, repeated to the dimension."""
        import hashlib

        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return [[(d[i % 32] + 1) / 256 for i in range(self.dimension)] for d in digests]


class FixedAnswer:
    """Always the same answer; remembers what it was asked."""

    def __init__(self, answer: str):
        self.answer, self.calls = answer, []

    def chat(self, messages: Sequence[tuple[str, str]]) -> str:
        """The fixed answer."""
        if not messages:
            raise ProviderError("no messages")
        self.calls.append(list(messages))
        return self.answer


class LocalChat:
    """A chat model served on this machine: ``POST /api/chat`` without streaming, redirects or proxies."""

    def __init__(self, model: str, address: str = "http://127.0.0.1:11434", timeout: float = 120.0):
        import ipaddress
        from urllib.parse import urlsplit

        parts = urlsplit(address)
        host = parts.hostname or ""
        try:
            local = ipaddress.ip_address(host).is_loopback
        except ValueError:
            local = host == "localhost"
        if parts.scheme != "http" or not local or parts.username or parts.query or parts.fragment or parts.path not in ("", "/"):
            raise ValueError("only a plain address of this machine is allowed")
        if not model.strip() or timeout <= 0:
            raise ValueError("a model and a positive timeout are needed")
        self.model, self.address, self.timeout = model, f"http://{parts.netloc}", timeout

    def chat(self, messages: Sequence[tuple[str, str]]) -> str:
        """The content of the model's reply."""
        import json
        import urllib.error
        import urllib.request

        class Stay(urllib.request.HTTPRedirectHandler):
            def redirect_request(self, *args):
                return None

        if not messages:
            raise ProviderError("no messages")
        body = {"model": self.model, "stream": False, "messages": [{"role": r, "content": c} for r, c in messages]}
        sent = urllib.request.Request(f"{self.address}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), Stay())
        try:
            with opener.open(sent, timeout=self.timeout) as reply:
                data = json.loads(reply.read())
        except TimeoutError as e:
            raise ProviderTimeout("the model did not answer in time") from e
        except urllib.error.HTTPError as e:
            raise (ProviderUnavailable if e.code in (404, 502, 503) else ProviderResponseError)(f"status {e.code}") from e
        except urllib.error.URLError as e:
            raise (ProviderTimeout if isinstance(e.reason, TimeoutError) else ProviderUnavailable)("the model cannot be reached") from e
        except OSError as e:
            raise ProviderUnavailable("the model cannot be reached") from e
        except ValueError as e:
            raise ProviderResponseError("the reply is not JSON") from e
        said = data.get("message") if isinstance(data, dict) else None
        if not isinstance(said, dict) or said.get("role") != "assistant" or not isinstance(said.get("content"), str) or not said["content"].strip():
            raise ProviderResponseError("the reply has no content")
        return said["content"]


def embedded(df: DataFrame, text: str, make: Callable[[], EmbeddingProvider], dimension: int, batch: int = 64) -> DataFrame:
    """``df`` with a column ``embedding``. The model is made once per Python worker and called in batches.

    A null text has a null vector; a vector of another width, or one that is not finite, fails the query.
    """

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import math

        provider = make()
        for texts in parts:
            known = [i for i, t in enumerate(texts) if t is not None]
            out: list[list[float] | None] = [None] * len(texts)
            for start in range(0, len(known), batch):
                some = known[start : start + batch]
                vectors = provider.embed([texts.iloc[i] for i in some])
                if len(vectors) != len(some):
                    raise ProviderResponseError("one vector per text is needed")
                for i, v in zip(some, vectors):
                    if len(v) != dimension or not all(map(math.isfinite, v)):
                        raise ProviderResponseError("a vector is not usable")
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn("embedding", embed(F.col(text)))


def scorer(make: Callable[[], RerankingProvider]) -> Callable[[Column, Column], Column]:
    """A score for :func:`strataloom.operators.search.reranked` from a provider, made once per Python worker."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        provider = make()
        for question, document in parts:
            out = pd.Series(0.0, index=question.index)
            for q, rows in document.groupby(question):
                scores = provider.score(q, list(rows))
                if len(scores) != len(rows):
                    raise ProviderResponseError("one score per document is needed")
                out.loc[rows.index] = [float(s) for s in scores]
            yield out

    return score
