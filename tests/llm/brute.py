"""Plain single-process versions to compare with."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text: str | None) -> frozenset:
    words = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_components(rows: list[tuple[int, str | None]], per_cent: int = 85) -> list[tuple]:
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    met = Counter((i, j) for places in where.values() if len(places) > 1 for n, i in enumerate(places) for j in places[n + 1 :])
    for (i, j), common in met.items():
        if 100 * common >= per_cent * (len(sets[i]) + len(sets[j]) - common):
            parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(sets[i]), least[root(i)] if sets[i] else key, (least[root(i)] if sets[i] else key) == key) for i, (key, _) in enumerate(rows)]


def repeated_spans(rows: list[tuple[int, str | None]], size: int = 200) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(hashlib.md5(d[i : i + size]).digest() for d in data for i in range(len(d) - size + 1))
    out = []
    for (key, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - size + 1):
            if seen[hashlib.md5(d[i : i + size]).digest()] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((key, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def periodic_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period), looking at every period."""
    number: dict = {}
    data, found, n = np.array([number.setdefault(w, len(number)) for w in words]), [], len(words)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], (data[q:] == data[:-q]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same))
        for start, stop in zip(edges[::2], edges[1::2]):
            length = int(stop - start) + q
            part = data[start : start + length]
            if length >= max(6, 4 * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                found.append((int(start), length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def damaged_words(doc_id: int | None, text: str | None) -> list[bytes]:
    words = WORDS.findall((text or "").encode())
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def run_digest(doc_id: int | None, text: str | None) -> tuple:
    words = damaged_words(doc_id, text)
    runs = periodic_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def damaged_turns(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest_edits(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """(cost, audit, lines) of (role, text, fault), from the last row to the first."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best: dict = {}
    for i in range(len(rows), -1, -1):
        for inserts in range(4, -1, -1):
            for state in ("", "s", "u", "a"):
                ways = [(0, "", [])] if i == len(rows) and state in ("", "a") else []
                if i < len(rows):
                    role, text, fault = rows[i]
                    c, audit, lines = best[i + 1, 0, state]
                    ways.append((c + 2, "D" + audit, lines))
                    extra = 5 if fault == "truncated" else 0
                    if fault not in ("blank", "duplicate"):
                        to = follows.get((state, role[:1]))
                        if to:
                            c, audit, lines = best[i + 1, 0, to]
                            ways.append((c + extra, "K" + audit, [f"{role}:{text}", *lines]))
                        for to in "ua":
                            if follows.get((state, to)):
                                c, audit, lines = best[i + 1, 0, to]
                                ways.append((c + 1 + extra, "R" + audit, [f"{names[to]}:{text}", *lines]))
                for to in "ua":
                    if inserts < 4 and follows.get((state, to)):
                        c, audit, lines = best[i, inserts + 1, to]
                        ways.append((c + 5, "I" + audit, [f"{names[to]}:", *lines]))
                best[i, inserts, state] = min(ways, key=lambda w: w[:2]) if ways else (10**9, "", [])
    return best[0, 0, ""]


def repaired_conversations(rows: list[tuple], every: list) -> list[tuple]:
    by_conv: dict = {conv: [] for conv in every}
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role, text))
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        known, marked, numbers = set(), [], [t[0] for t in turns if t[0] is not None]
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in known else "truncated" if solid[-1] not in ".!?" else ""
            known.add((role, text))
            marked.append((role, text, fault))
        faults = Counter(m[2] for m in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, lines = cheapest_edits(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return out
