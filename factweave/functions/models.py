"""Pluggable models, each with a deterministic default that needs no network.

An embedder, reranker or resolver is any function over pandas Series; Spark calls
it on Arrow batches.  Model names, ONNX files and remote services plug in here.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import text as X
from factweave.functions.vector import cosine

Embed = Callable[[pd.Series], list]


def hashed_trigrams(size: int = 64) -> Embed:
    """The default embedder: counts of hashed word trigrams, of unit length."""

    def embed(texts: pd.Series) -> list:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                padded = f"  {word.strip('.,;:!?()[]')} "
                for i in range(len(padded) - 2):
                    row[zlib.crc32(padded[i : i + 3].encode()) % size] += 1
            norm = np.linalg.norm(row)
            if norm:
                row /= norm
        return list(out)

    return embed


class Embedder:
    """A function, or an object with encode(list), as an expression and for single texts."""

    def __init__(self, model=None, size: int = 64, query_prefix: str = "", document_prefix: str = ""):
        if isinstance(model, str):
            raise ValueError(f"no model named {model} here; give a function or an object with encode")
        encode = getattr(model, "encode", None)
        self.embed: Embed = hashed_trigrams(size) if model is None else (lambda texts: [np.asarray(v, np.float32) for v in encode(list(texts))]) if encode else model
        self.query_prefix, self.document_prefix = query_prefix, document_prefix

    def column(self, text: Column) -> Column:
        embed = self.embed

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([np.asarray(v, np.float32) for v in embed(texts)])

        return run(F.concat(F.lit(self.document_prefix), text))

    def one(self, text: str, query: bool = False) -> list[float]:
        prefix = self.query_prefix if query else self.document_prefix
        return [float(x) for x in self.embed(pd.Series([prefix + text]))[0]]

    def score(self, query: str, texts: list[str]) -> list[float]:
        """Cosine of the query, as a document, with each text."""
        if not texts:
            return []
        a = np.asarray(self.one(query), float)
        b = np.stack([np.asarray(v, float) for v in self.embed(pd.Series([self.document_prefix + t for t in texts]))])
        norm = np.linalg.norm(a) * np.linalg.norm(b, axis=1)
        return (b @ a / np.where(norm == 0, 1, norm)).tolist()


class Reranker:
    """Scores pairs of query and text: predict(list of pairs), a function of two Series, or by default cosine and shared words."""

    def __init__(self, model=None, embedder: Embedder | None = None):
        predict = getattr(model, "predict", None)
        self.model = (lambda q, t: predict(list(zip(q, t, strict=True)))) if predict else model
        self.embedder = embedder or Embedder()

    def column(self, query: str, text: Column, embedding: Column) -> Column:
        if self.model is not None:
            model = self.model

            @F.pandas_udf("double")
            def run(texts: pd.Series) -> pd.Series:
                return pd.Series(model(pd.Series([query] * len(texts)), texts), dtype=float)

            return run(text)
        vector = F.array(*(F.lit(x) for x in self.embedder.one(query, True)))
        return cosine(embedding, vector) + 0.1 * F.coalesce(X.jaccard(X.words(text), X.words(F.lit(query))), F.lit(0.0))

    def relevance(self, query: str, texts: list[str]) -> list[float]:
        """Raw scores of single texts."""
        if self.model is not None:
            return [float(x) for x in self.model(pd.Series([query] * len(texts)), pd.Series(texts))]
        return self.embedder.score(query, texts)


def canonicaliser(given) -> Callable[[Column], Column]:
    """None, a mapping of aliases, or a function of columns."""
    if given is None:
        return lambda name: F.trim(F.regexp_replace(name, "\\s+", " "))
    if isinstance(given, Mapping):
        return lambda name: X.canonical(name, dict(given))
    if callable(given):
        return given
    raise TypeError("a canonicaliser is None, a mapping or a function")


class RuleResolver:
    """The default conflict resolver: two texts about the same subject whose numbers or negation differ.

    A resolver is a function (new, old Series) -> boolean Series.
    """

    def __call__(self, new: pd.Series, old: pd.Series) -> pd.Series:
        def tokens(text):
            return [w.strip(".,;:!?").lower() for w in (text or "").split()]

        def conflict(a, b):
            x, y = tokens(a), tokens(b)
            digits = lambda ws: {w for w in ws if any(c.isdigit() for c in w)}
            negated = lambda ws: bool({"not", "no", "never", "nicht", "kein", "ne", "pas"} & set(ws))
            plain = lambda ws: set(ws) - digits(ws) - {"not", "no", "never", "nicht", "kein", "ne", "pas"}
            shared = len(plain(x) & plain(y)) / max(len(plain(x) | plain(y)), 1)
            return a != b and shared >= 0.6 and (digits(x) != digits(y) or negated(x) != negated(y))

        return pd.Series([conflict(a, b) for a, b in zip(new, old, strict=True)], dtype=bool)


def entailment_resolver(predict: Callable[[list], np.ndarray], least: float = 0.5) -> Callable:
    """From a model that gives three logits for (old, new), contradiction first."""

    def run(new: pd.Series, old: pd.Series) -> pd.Series:
        logits = np.asarray(predict(list(zip(old, new, strict=True))), float)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return pd.Series(e[:, 0] / e.sum(1) >= least)

    return run


def chat_resolver(ask: Callable[[str], str], most: int = 10) -> Callable:
    """From a chat model: JSON {"conflict": bool} or a reply that begins with yes; an error is no conflict."""

    def run(new: pd.Series, old: pd.Series) -> pd.Series:
        out = []
        for i, (a, b) in enumerate(zip(new, old, strict=True)):
            try:
                reply = ask(f"Old: {b}\nNew: {a}\nDoes the new statement contradict the old one?") if i < most else ""
                out.append(bool(json.loads(reply)["conflict"]) if reply.strip().startswith("{") else reply.strip().lower().startswith("yes"))
            except Exception:  # noqa: BLE001 - a resolver must not stop the ingest
                out.append(False)
        return pd.Series(out, dtype=bool)

    return run


def template_answer(query: str, facts: list[dict]) -> str:
    """The default synthesizer: the facts, each once, and what connects them."""
    texts = list(dict.fromkeys(f["content"] for f in facts))
    if not texts:
        return "No facts were found."
    bridges = list(dict.fromkeys(s["entity"] for f in facts for s in f.get("path", []) if s.get("entity")))
    said = " ".join(t if t.endswith((".", "!", "?")) else f"{t}." for t in texts)
    return said + (f" They are connected through {', '.join(bridges)}." if bridges else "")


def prompt(query: str, facts: list[dict]) -> str:
    """What a language model is asked, from another session's facts too."""
    lines = [f"- {f['content']}" + (f" (from {', '.join(f['scopes'])})" if f.get("cross_session") and f.get("scopes") else "") for f in facts]
    return "Facts:\n" + "\n".join(lines) + f"\n\nQuestion: {query}\nAnswer from the facts alone."


def prompt_synthesizer(ask: Callable[[str], str]) -> Callable[[str, list[dict]], str]:
    return lambda query, facts: ask(prompt(query, facts)).strip()


def summary_words(tokens: int) -> int:
    """How many words a summary of so many tokens may have."""
    return max(20, math.floor(0.75 * tokens))
