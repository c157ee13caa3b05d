"""Seams for extraction models: what a model returns for texts, as column expressions that ingest takes.

Each takes a plain function over a list of texts and returns a function of a
Column, so a pipeline object, an ONNX session or a remote model plugs in alike.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = T.ArrayType(T.StringType())
PAIRS = T.ArrayType(T.StructType([T.StructField("cause", T.StringType()), T.StructField("effect", T.StringType())]))
# Kinds of entity that conversations are asked for.
CHAT_KINDS = ("person", "organization", "location", "event", "preference", "plan", "topic")


def _mapped(run: Callable[[list[str]], list], kind: T.DataType) -> Callable[[Column], Column]:
    def column(text: Column) -> Column:
        def batch(texts: pd.Series) -> pd.Series:
            return pd.Series(run([x or "" for x in texts]), dtype=object)

        return F.pandas_udf(batch, kind)(text)

    return column


def names(words: list[str]) -> list[str]:
    """Words of a tagger as names: no word pieces, nothing of one character, each once."""
    return list(dict.fromkeys(w for w in (w.strip() for w in words) if len(w) > 1 and not w.startswith("##")))


def token_classifier(tag: Callable[[list[str]], list[list[dict]]]) -> Callable[[Column], Column]:
    """Entities from a tagger that gives {"word": ...} for each entity of each text."""
    return _mapped(lambda texts: [names([e["word"] for e in found]) for found in tag(texts)], NAMES)


def labelled(find: Callable[[list[str], list[str], float], list[list[dict]]], kinds: tuple[str, ...] = CHAT_KINDS, least: float = 0.3) -> Callable[[Column], Column]:
    """Entities from a model that is told the kinds to look for and gives {"text", "label", "score"}."""
    return _mapped(lambda texts: [names([e["text"] for e in found if e.get("score", 1.0) >= least and e.get("label") in kinds]) for found in find(texts, list(kinds), least)], NAMES)


def offsets(tag: Callable[[list[str]], list[list[tuple[str, int, int]]]], kinds: tuple[str, ...] | None = None) -> Callable[[Column], Column]:
    """Entities from B-/I- tags with offsets, as token classifiers exported to ONNX give them."""

    def run(texts: list[str]) -> list[list[str]]:
        out = []
        for text, tags in zip(texts, tag(texts), strict=True):
            spans, last = [], None
            for label, low, high in tags:
                if high <= low:
                    continue
                head, _, kind = label.partition("-")
                if head == "I" and last == kind and spans:
                    spans[-1][2] = high
                elif head in ("B", "I"):
                    spans.append([kind, low, high])
                last = kind if head in ("B", "I") else None
            out.append(list(dict.fromkeys(text[a:b] for kind, a, b in spans if not kinds or kind in kinds)))
        return out

    return _mapped(run, NAMES)


def best_pairs(found: list[dict]) -> list[dict]:
    """Relations (head, tail, score), the best of each pair in any case, none of a thing to itself."""
    best: dict[tuple[str, str], dict] = {}
    for r in found:
        head, tail = str(r["head"]).strip(), str(r["tail"]).strip()
        key, score = (head.lower(), tail.lower()), float(r.get("score", 0.0))
        if head and tail and key[0] != key[1] and (key not in best or score > best[key]["score"]):
            best[key] = {"cause": head, "effect": tail, "score": score}
    return [{"cause": r["cause"], "effect": r["effect"]} for r in best.values()]


def relation_model(find: Callable[[list[str]], list[list[dict]]]) -> Callable[[Column], Column]:
    """Relations from a model that gives {"head", "tail", "score"} for each text."""
    return _mapped(lambda texts: [best_pairs(found) for found in find(texts)], PAIRS)


def span_pointer(point: Callable[[list[str]], list[tuple[tuple[int, int], tuple[int, int], float] | None]], gate: Callable[[list[str]], list[float]] | None = None, least: float = 0.5) -> Callable[[Column], Column]:
    """Relations from a model that points at a cause and an effect; a gate, or else its own score, says whether there is one."""

    def run(texts: list[str]) -> list[list[dict]]:
        open_ = gate(texts) if gate else None
        out = []
        for i, (text, found) in enumerate(zip(texts, point(texts), strict=True)):
            good = found is not None and (open_[i] if open_ is not None else found[2]) >= least
            pair = {"cause": text[slice(*found[0])].strip(), "effect": text[slice(*found[1])].strip()} if good else None
            out.append([pair] if pair and pair["cause"] and pair["effect"] else [])
        return out

    return _mapped(run, PAIRS)


def splitter(split: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """Sentences from a model that splits one text."""
    return _mapped(lambda texts: [[s for s in split(t) if s.strip()] for t in texts], NAMES)
