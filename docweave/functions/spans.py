"""Spans of cited claims, and vectors pooled over spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKER = re.compile(r"\[(\d+(?:;\d+)*)\]")


def claims(answer: str | None) -> list[dict]:
    """(claim, markers) of every sentence that cites: the sentence without its markers, and their numbers."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+(?!\[)", answer or ""):
        numbers = sorted({int(n) for m in _MARKER.finditer(sentence) for n in m[1].split(";")})
        if numbers:
            out.append({"claim": " ".join(_MARKER.sub("", sentence).split()), "markers": numbers})
    return out


def token_bounds(offsets: list[tuple[int, int]], chunk: tuple[int, int]) -> tuple[int, int]:
    """The first and one past the last token that a chunk of characters touches; equal where it touches none."""
    first = next((i for i, (_, b) in enumerate(offsets) if b > chunk[0]), len(offsets))
    last = max((i + 1 for i, (a, _) in enumerate(offsets) if a < chunk[1]), default=first)
    return first, max(first, last)


def pooled(tokens: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The mean of the token vectors within each bounds, brought to length 1; zeros where there are none."""
    out = np.zeros((len(bounds), tokens.shape[1]))
    for i, (a, b) in enumerate(bounds):
        if b > a:
            m = tokens[a:b].mean(axis=0)
            n = np.linalg.norm(m)
            out[i] = m / n if n > 0 else m
    return out
