"""Splitting one text into spans: separators as arrays of places, runs packed by binary search."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

#: From coarse to fine; the last resort is single characters.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Markdown headings, lines in capitals, numbered sections whose number ends in a separator. Capitals and
#: white space may run over several lines, which then are one heading.
HEADING = re.compile(r"^(#{1,4}\s.+|[A-Z][A-Z\s]{3,}|(?:Section|Article|Part|Chapter)\s+\d+\s*[–—:.-]\s+\S.{0,100})$", re.MULTILINE)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[A-Za-z0-9_]+")


def places(text: str) -> list[np.ndarray]:
    """Where each separator stands, from left to right, none over another of its kind."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line, space, dot = (codes == ord(c) for c in "\n .")
    breaks = np.flatnonzero(line)
    first = np.ones(len(breaks), bool)
    first[1:] = np.diff(breaks) > 1
    in_run = np.arange(len(breaks)) - np.maximum.accumulate(np.where(first, np.arange(len(breaks)), 0))
    followed = np.zeros(len(breaks), bool)
    followed[:-1] = ~first[1:]
    return [breaks[(in_run % 2 == 0) & followed], breaks, np.flatnonzero(dot[:-1] & space[1:]), np.flatnonzero(space)]


def recursive_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of up to `size` characters: cut before the coarsest separator there is, and finer where a piece is longer."""
    found, out = places(text), []

    def split(start: int, end: int, level: int) -> None:
        cuts = None
        for k in range(level, len(SEPARATORS)):
            a, b = np.searchsorted(found[k], (start, end - len(SEPARATORS[k]) + 1))
            if b > a:
                own = found[k][a:b]
                cuts, level = own if own[0] == start else np.concatenate(([start], own)), k + 1
                break
        if cuts is None:
            cuts, level = np.arange(start, end), len(SEPARATORS) + 1
        bounds = np.append(cuts, end)
        large = np.flatnonzero(np.diff(bounds) >= size)
        at = 0
        for piece in large.tolist():
            _pack(bounds, at, piece, size, overlap, out)
            if level <= len(SEPARATORS):
                split(int(bounds[piece]), int(bounds[piece + 1]), level)
            else:
                out.append((int(bounds[piece]), int(bounds[piece + 1])))
            at = piece + 1
        _pack(bounds, at, len(bounds) - 1, size, overlap, out)

    if text:
        split(0, len(text), 0)
    return out


def _pack(bounds: np.ndarray, i: int, last: int, size: int, overlap: int, out: list) -> None:
    """Runs of the pieces i .. last-1: as many as fit, the next run starts with up to `overlap` characters of the one before."""
    while i < last:
        j = min(int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1, last)
        out.append((int(bounds[i]), int(bounds[j])))
        if j == last:
            return
        i = min(max(int(np.searchsorted(bounds, bounds[j] - overlap)), int(np.searchsorted(bounds, bounds[j + 1] - size)), i), j)


def recursive_chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk), trimmed; starts come from searching on from a cursor that never moves back."""
    out, cursor = [], 0
    for a, b in recursive_spans(text, size, overlap):
        chunk = text[a:b].strip()
        if chunk:
            cursor = max(cursor, text.find(chunk, cursor))
            out.append((cursor, chunk))
    return out


def sections(text: str) -> list[tuple[int, str | None, int, str]]:
    """(section, title, start, text): from heading to heading; what comes before the first is section 0, without title."""
    heads = list(HEADING.finditer(text))
    out, lead = [], text[: heads[0].start()] if heads else text
    if lead.strip():
        kept = lead.strip() if heads else lead
        out.append((0, None, text.find(kept) if heads else 0, kept))
    for k, head in enumerate(heads):
        end = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        out.append((k + 1, head.group(0).strip(), head.start(), text[head.start() : end].strip()))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text.strip())) if s]


def hashed_counts(texts: list[str], dim: int) -> np.ndarray:
    """The vectors of scorers.embed, a row each, counted for all texts at once."""
    words = [_WORD.findall(t.lower()) for t in texts]
    number = {w: _signed(w) % dim for own in words for w in set(own)}
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    place = np.fromiter((number[w] for own in words for w in own), np.int64, len(row))
    return np.bincount(row * dim + place, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)


def _signed(word: str) -> int:
    n = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def semantic_chunks(texts: list[str], threshold: float, vectors: Callable[[list[str]], np.ndarray]) -> list[list[tuple[int, int, str, int]]]:
    """(start, end, chunk, sentences) of each text: neighbours below the threshold are parted; up to three sentences stay whole."""
    own = [sentences(t) for t in texts]
    every = [s for x in own if len(x) > 3 for s in x]
    v = vectors(every) if every else np.zeros((0, 1))
    square = (v * v).sum(1)
    both = np.sqrt(square[1:] * square[:-1])  # one root of the product: exact for counts, whose cosine can be the threshold
    like = np.divide((v[1:] * v[:-1]).sum(1), both, out=np.zeros(len(both)), where=both > 0)
    out, at = [], 0
    for text, parts in zip(texts, own, strict=True):
        if len(parts) <= 3:
            out.append([(0, len(text), text, len(parts))] if text else [])
            continue
        cuts = (np.flatnonzero(like[at : at + len(parts) - 1] < threshold) + 1).tolist()
        at, rows, cursor = at + len(parts), [], 0
        for a, b in zip([0, *cuts], [*cuts, len(parts)], strict=True):
            found = text.find(parts[a], cursor)
            start = cursor if found < 0 else found
            chunk = " ".join(parts[a:b])
            last = text.find(parts[b - 1], start)
            rows.append((start, last + len(parts[b - 1]) if last >= 0 else start + len(chunk), chunk, b - a))
            cursor = max(cursor, start)
        out.append(rows)
    return out
