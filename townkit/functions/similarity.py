"""Ratcliff-Obershelp similarity, which no built-in function gives, as an Arrow UDF over candidate pairs only."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longer texts are compared one by one: from 200 characters on, SequenceMatcher leaves out frequent ones, and tables of matches grow with the square.
LONG = 64
#: Bytes of the tables of matches that are filled at once.
TABLE_BYTES = 512 << 10


def matched(codes: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Characters that SequenceMatcher matches in texts a and b (rows of codes, where 0 is no character): the longest run that
    both have, the first in a and then in b of equal ones, and so on to its left and right. The tables of many pairs are filled together."""
    total = np.zeros(len(a), np.int64)
    pair, a_from, b_from = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    a_size, b_size = lengths[a], lengths[b]
    while True:
        open_ = (a_size > 0) & (b_size > 0)
        pair, a_from, b_from, a_size, b_size = (v[open_] for v in (pair, a_from, b_from, a_size, b_size))
        if not len(pair):
            return total
        order = np.argsort(a_size * b_size, kind="stable")  # tables of like size are filled together
        pair, a_from, b_from, a_size, b_size = (v[order] for v in (pair, a_from, b_from, a_size, b_size))
        size, a_at, b_at = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        at = 0
        while at < len(pair):
            # as many as the first one's table allows, and of these as many as the greatest one's does
            to = at + max(1, TABLE_BYTES // int(a_size[at] * b_size[at]))
            to = at + max(1, TABLE_BYTES // int(a_size[at:to].max() * b_size[at:to].max()))
            part = slice(at, min(to, len(pair)))
            width, height = int(b_size[part].max()), int(a_size[part].max())
            i, j = np.arange(height)[:, None], np.arange(width)[:, None]
            x = np.where(i < a_size[part], codes[a[pair[part]], np.minimum(a_from[part] + i, codes.shape[1] - 1)], 0)
            y = np.where(j < b_size[part], codes[b[pair[part]], np.minimum(b_from[part] + j, codes.shape[1] - 1)], 0)
            table = np.zeros((height, width + 1, x.shape[1]), np.uint8)  # the run that ends at i and j - 1
            for n in range(height):
                equal = (y == x[n]) & (x[n] != 0)
                np.multiply(table[n - 1, :-1] + 1 if n else np.uint8(1), equal, out=table[n, 1:])
            flat = table.reshape(height * (width + 1), -1)
            best = flat.argmax(0)
            size[part] = flat[best, np.arange(flat.shape[1])]
            a_at[part], b_at[part] = best // (width + 1) + 1 - size[part], best % (width + 1) - size[part]
            at = part.stop
        np.add.at(total, pair, size)
        found = size > 0
        pair, a_from, b_from, a_size, b_size, size, a_at, b_at = (v[found] for v in (pair, a_from, b_from, a_size, b_size, size, a_at, b_at))
        a_end, b_end = a_at + size, b_at + size
        pair = np.concatenate([pair, pair])
        a_from, b_from = np.concatenate([a_from, a_from + a_end]), np.concatenate([b_from, b_from + b_end])
        a_size, b_size = np.concatenate([a_at, a_size - a_end]), np.concatenate([b_at, b_size - b_end])


def ratios(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Twice the matched characters over all characters of each pair, NaN if a side is null; equal pairs are measured once."""
    out = np.full(len(a), np.nan)
    texts = pd.concat([a, b], ignore_index=True)
    numbers, texts = pd.factorize(texts)
    x, y = numbers[: len(a)], numbers[len(a) :]
    there = (x >= 0) & (y >= 0)
    if not there.any():
        return out
    pairs, place = np.unique(x[there] * len(texts) + y[there], return_inverse=True)
    x, y = pairs // len(texts), pairs % len(texts)
    lengths = np.array([len(t) for t in texts])
    found = np.ones(len(pairs))
    short = (x != y) & (lengths[x] <= LONG) & (lengths[y] <= LONG)
    if short.any():
        kept = lengths <= LONG
        plain = np.array([t if k else "" for t, k in zip(texts, kept, strict=True)], dtype=f"U{max(1, int(lengths[kept].max()))}")
        signs = plain.view(np.uint32).reshape(len(plain), -1)
        codes = (np.unique(signs, return_inverse=True)[1] + 1).reshape(signs.shape)
        codes = np.where(np.arange(signs.shape[1]) < lengths[:, None], codes, 0)
        codes = codes.astype(np.uint8 if codes.max() < 256 else np.uint32)
        found[short] = 2.0 * matched(codes, lengths, x[short], y[short]) / (lengths[x[short]] + lengths[y[short]])
    for n in np.flatnonzero((x != y) & ~short):
        found[n] = SequenceMatcher(None, texts[x[n]], texts[y[n]]).ratio()
    out[there] = found[place]
    return out


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters; not symmetric. Null if a side is null."""
    found = ratios(a, b)
    return pd.Series(found).astype(object).where(~np.isnan(found), None) if np.isnan(found).any() else pd.Series(found)
