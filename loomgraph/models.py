"""Embedding and chat models behind narrow interfaces, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subjects import HIDDEN


class Embedder(Protocol):
    """Texts to vectors of one length; loaded once in a worker."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ChatModel(Protocol):
    """A prompt to the pieces of an answer."""

    def reply(self, prompt: str) -> Iterator[str]: ...


class _Hashes(dict):
    """Words to their hashes, each looked up once; a new word's is made."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


class HashEmbedder:
    """Unit vectors of signed word counts under a fixed hash; of the texts given together a word is hashed once, and all are counted at once."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [(text or "").lower().split() for text in texts]
        known = _Hashes()
        hashes = np.array([known[w] for own in words for w in own], np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        sign = 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(np.float64)
        cell = row * self.dim + (hashes % np.uint64(self.dim)).astype(np.int64)
        out = np.bincount(cell, sign, len(texts) * self.dim).reshape(len(texts), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class EchoChat:
    """Says the last user content again, word by word."""

    def reply(self, prompt: str) -> Iterator[str]:
        said = prompt.rpartition("<|im_start|>user\n")[2].partition("<|im_end|>")[0] or prompt
        for i, word in enumerate(said.split(" ")):
            yield word if i == 0 else " " + word


class ScriptedChat:
    """Gives prepared answers one after the other, then the last again."""

    def __init__(self, answers: list[str]):
        self.answers, self.at = answers, 0

    def reply(self, prompt: str) -> Iterator[str]:
        answer = self.answers[min(self.at, len(self.answers) - 1)]
        self.at += 1
        yield answer


class ServiceEmbedder:
    """An embedding service: ``post(url, body) -> dict`` is the caller's client."""

    def __init__(self, post: Callable[[str, dict], dict], url: str, model: str, dim: int, input_type: str = "passage"):
        self.post, self.url, self.model, self.dim, self.input_type = post, url, model, dim, input_type

    def embed(self, texts: list[str]) -> np.ndarray:
        said = self.post(f"{self.url}/embeddings", {"input": texts, "model": f"{self.model}-{self.input_type}", "dimensions": self.dim, "encoding_format": "float"})
        return np.array([x["embedding"] for x in sorted(said["data"], key=lambda x: x["index"])])


class ServiceChat:
    """A chat service: ``post(url, body) -> dict`` is the caller's client. Tool calls come back as their JSON list."""

    def __init__(self, post: Callable[[str, dict], dict], url: str, model: str, tools: list[dict] | None = None, **options):
        self.post, self.url, self.model, self.tools, self.options = post, url, model, tools, options

    def reply(self, prompt: str) -> Iterator[str]:
        return self.chat([{"role": "user", "content": prompt}])

    def chat(self, messages: list[dict]) -> Iterator[str]:
        """The answer to a whole conversation: messages (role, content), as ``chat_request`` makes them."""
        body = {"model": self.model, "messages": messages, **self.options} | ({"tools": self.tools} if self.tools else {})
        choice = self.post(f"{self.url}/chat/completions", body)["choices"][0]
        yield json.dumps(choice["message"]["tool_calls"]) if choice.get("finish_reason") == "tool_calls" else choice["message"]["content"]


def sample_token(logits: np.ndarray, rng: np.random.Generator, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> int:
    """A token for the scores of a vocabulary: the best at temperature 0, else one by its probability, among the ``top_k`` best, the fewest that hold ``top_p``, or of those first the one and then the other."""
    if temperature <= 0:
        return int(np.argmax(logits))
    z = np.asarray(logits, float) / temperature
    p = np.exp(z - z.max())
    order = np.argsort(-p, kind="stable")
    if top_k is not None:
        order = order[:top_k]
    if top_p is not None:
        share = np.cumsum(p[order]) / p[order].sum()
        order = order[: int(np.searchsorted(share, top_p)) + 1]
    return int(rng.choice(order, p=p[order] / p[order].sum()))


class TableChat:
    """A local model over a table of scores: after a word, the scores of the next; it ends at ``end`` or after ``most`` words. Same seed, same answer."""

    def __init__(self, scores: dict[str, dict[str, float]], end: str = "", most: int = 64, seed: int = 0, **sampling):
        self.scores, self.end, self.most, self.seed, self.sampling = scores, end, most, seed, sampling

    def reply(self, prompt: str) -> Iterator[str]:
        rng = np.random.default_rng(self.seed)
        words = prompt.rpartition("<|im_start|>user\n")[2].partition("<|im_end|>")[0].split()
        word = words[-1] if words else ""
        for i in range(self.most):
            following = self.scores.get(word)
            if not following:
                return
            names = sorted(following)
            word = names[sample_token(np.array([following[x] for x in names]), rng, **self.sampling)]
            if word == self.end:
                return
            yield word if i == 0 else " " + word


def embed_texts(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embeddings", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the vector of ``text`` in its place; string columns stay (or those in ``keep``). Batches go to the model as Arrow sends them."""
    kept = keep if keep is not None else [c for c, kind in df.dtypes if kind == "string" and c != text]
    kept = [*kept, *[c for c in HIDDEN if c in df.columns and c not in kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder.embed([x or "" for x in batch.column(len(kept)).to_pylist()])
            flat = np.ascontiguousarray(vectors, np.float32)
            ends = pa.array(np.arange(len(flat) + 1) * (flat.shape[1] if flat.ndim == 2 else 0), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], [*kept, out])

    rows = df.select(*kept, text)
    schema = ", ".join([*[f"`{c}` {dict(df.dtypes)[c]}" for c in kept], f"`{out}` array<float>"])
    return rows.mapInArrow(run, schema)


def answer(prompts: DataFrame, model: ChatModel, stamp: str = "") -> DataFrame:
    """(keys ..., role, content, timestamp, _batch_id, _row_id): the model's pieces for every row's ``prompt``."""
    keys = [c for c in prompts.columns if c != "prompt" and c not in HIDDEN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*[batch.column(k)[i].as_py() for k in range(len(keys))], "assistant", piece, stamp, 0, n] for i in range(batch.num_rows) for n, piece in enumerate(model.reply(batch.column(len(keys))[i].as_py() or ""))]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([*keys, "role", "content", "timestamp", *HIDDEN], r, strict=True)) for r in rows])

    schema = ", ".join([*[f"`{c}` {dict(prompts.dtypes)[c]}" for c in keys], "role string, content string, timestamp string, _batch_id long, _row_id long"])
    return prompts.select(*keys, F.col("prompt")).mapInArrow(run, schema)
