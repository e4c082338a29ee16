"""Remote and local models behind the provider classes. Their libraries are imported on the executors, when first used.

Keys are read by the libraries from their usual environment variables. Nothing here is used unless asked
for: ``LODESIFT_MODELS`` chooses between ``mock`` (the default) and ``real``.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from lodesift.functions.providers import LLM, CallableEmbedder, CallableLLM, CallableReranker, Embedder, MockEmbedder, MockLLM, MockReranker, Reranker


def _timed(call: Callable):
    began = time.perf_counter()
    return call(), (time.perf_counter() - began) * 1000


def openai_chat(model: str, most: int = 1024, temperature: float = 0.0, client: Callable | None = None) -> CallableLLM:
    """Chat completions; asked again without a temperature where the model rejects it."""

    def make():
        if client is None:
            from openai import OpenAI

            api = OpenAI()
        else:
            api = client()

        def call(prompt: str) -> tuple:
            asked = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_completion_tokens": most}

            def send():
                try:
                    return api.chat.completions.create(**asked, temperature=temperature)
                except Exception as e:  # noqa: BLE001 - told apart by its message
                    if "temperature" not in str(e) or "unsupported" not in str(e).lower():
                        raise
                    return api.chat.completions.create(**asked)

            reply, ms = _timed(send)
            used = reply.usage
            cached = getattr(getattr(used, "prompt_tokens_details", None), "cached_tokens", None) or 0
            return reply.choices[0].message.content or "", used.prompt_tokens, used.completion_tokens, cached, 0, ms

        return call

    return CallableLLM(make)


def anthropic_chat(model: str, most: int = 1024, client: Callable | None = None) -> CallableLLM:
    """Messages whose shared prefix is a system block that the model caches; input counts all three tiers."""

    def make():
        if client is None:
            from anthropic import Anthropic

            api = Anthropic()
        else:
            api = client()

        def call(prompt: str, prefix: str) -> tuple:
            asked = {"model": model, "max_tokens": most, "messages": [{"role": "user", "content": prompt}]}
            if prefix:
                asked["system"] = [{"type": "text", "text": prefix, "cache_control": {"type": "ephemeral"}}]
            reply, ms = _timed(lambda: api.messages.create(**asked))
            used = reply.usage
            read, written = used.cache_read_input_tokens or 0, used.cache_creation_input_tokens or 0
            text = "".join(b.text for b in reply.content if b.type == "text")
            return text, used.input_tokens + read + written, used.output_tokens, read, written, ms

        return call

    return CallableLLM(make, parts=True)


def openai_embedder(model: str = "text-embedding-3-small", client: Callable | None = None) -> CallableEmbedder:
    def make():
        if client is None:
            from openai import OpenAI

            api = OpenAI()
        else:
            api = client()

        def embed(texts: list[str]) -> list[list[float]]:
            got = api.embeddings.create(model=model, input=texts).data
            return [d.embedding for d in sorted(got, key=lambda d: d.index)]

        return embed

    return CallableEmbedder(make)


def voyage_embedder(model: str = "voyage-4", post: Callable[[dict], dict] | None = None) -> CallableEmbedder:
    """Embeddings over HTTP; what comes back is put into the order of the texts by its index."""

    def make():
        def send(body: dict) -> dict:
            import json
            import urllib.request

            request = urllib.request.Request(
                "https://api.voyageai.com/v1/embeddings",
                json.dumps(body).encode(),
                {"Authorization": f"Bearer {os.environ['VOYAGE_API_KEY']}", "Content-Type": "application/json"},
            )
            with urllib.request.urlopen(request, timeout=60) as reply:
                return json.load(reply)

        def embed(texts: list[str]) -> list[list[float]]:
            out: list[list[float]] = [[]] * len(texts)
            for d in (post or send)({"model": model, "input": texts})["data"]:
                out[d["index"]] = d["embedding"]
            return out

        return embed

    return CallableEmbedder(make, budget=100_000)


def local_embedder(model: str = "BAAI/bge-large-en-v1.5", load: Callable | None = None) -> CallableEmbedder:
    def make():
        if load is None:
            from sentence_transformers import SentenceTransformer

            encoder = SentenceTransformer(model)
        else:
            encoder = load()
        return lambda texts: [[float(x) for x in v] for v in encoder.encode(texts, normalize_embeddings=True)]

    return CallableEmbedder(make)


def cross_encoder(model: str = "BAAI/bge-reranker-v2-m3", load: Callable | None = None) -> CallableReranker:
    """Joint scores of query and text; the model is loaded once a task and fed with whole batches."""

    def make():
        if load is None:
            from sentence_transformers import CrossEncoder

            scorer = CrossEncoder(model)
        else:
            scorer = load()
        return lambda queries, texts: [float(x) for x in scorer.predict(list(zip(queries, texts)))]

    return CallableReranker(make)


def _real() -> bool:
    kind = os.environ.get("LODESIFT_MODELS", "mock")
    if kind not in ("mock", "real"):
        raise ValueError(f"LODESIFT_MODELS is mock or real, not {kind}")
    return kind == "real"


def default_llm(model: str = "gpt-4.1-mini-2025-04-14") -> LLM:
    if not _real():
        return MockLLM()
    return anthropic_chat(model) if model.startswith("claude") else openai_chat(model)


def default_embedder(model: str = "text-embedding-3-small") -> Embedder:
    if not _real():
        return MockEmbedder()
    return voyage_embedder(model) if model.startswith("voyage") else local_embedder(model) if "/" in model else openai_embedder(model)


def default_reranker() -> Reranker:
    return cross_encoder() if _real() else MockReranker()
