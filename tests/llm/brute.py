"""Plain, quadratic or single-process versions of the operators' results, for comparison."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def byte_repeats(rows, window=50):
    """{position: (n_bytes, n_removed, n_spans, sha)} for rows of (doc_id, text)."""
    first = {}
    key = lambda d: (d is None, d)
    raw = [(t or "").encode() for _, t in rows]
    for (d, _), r in zip(rows, raw, strict=True):
        for i in range(len(r) - window + 1):
            s = r[i : i + window]
            if s not in first or key(d) < first[s]:
                first[s] = key(d)
    out = []
    for (d, _), r in zip(rows, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if first[r[i : i + window]] < key(d):
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(rows, window=20):
    first = {}
    key = lambda d, i: (d is None, d, i)
    split = [words(t) for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            if s not in first or key(d, i) < first[s]:
                first[s] = key(d, i)
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
