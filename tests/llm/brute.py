"""Plain single-machine versions of what the queries return, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def base_secrets(text: str | None) -> tuple[int, int, int, str]:
    t = text or ""
    assign = [m.span() for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    access = [m.span() for m in ACCESS.finditer(t) if len(m[0]) >= 18]
    hexes = [m.span() for m in HEX.finditer(t) if len(m[0]) >= 16]
    spans = sorted([(s, k, e) for k, found in enumerate((assign, access, hexes)) for s, e in found])
    return len(assign), len(access), len(hexes), ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_components(rows: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id: size of its set, least doc_id that links reach."""
    sets = {i: shingles(t, k) for i, t in rows}
    holders: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    up = {i: i for i in sets}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def without_repeats(texts: list[str | None], width: int) -> list[tuple[int, int, str]]:
    every = [words(t) for t in texts]
    often = Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = []
    for w in every:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if often[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def crc_mod_4(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4


def with_planted_runs(text: str | None, doc_id: int | None) -> list[str]:
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def runs(w: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) by trying every period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> list[str]:
    return ASCII_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text: str | None, items: list[tuple[int | None, str | None]]) -> tuple[int, int, int, str, bool]:
    w, hit, ids = plain_words(text), set(), set()
    for i, t in items:
        own = plain_words(t)
        n = min(len(own), 10)
        known = {tuple(own[p : p + n]) for p in range(len(own) - n + 1)} if n else set()
        at = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in known] if n else []
        hit.update(q for p in at for q in range(p, p + n))
        if at and i is not None:
            ids.add(str(i))
    return len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def collocations(rows: list[tuple[str | None, str | None]], least: int = 100, longest: int = 5, top: int = 2_000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) from the (lang, text) of all documents."""
    counts: dict[str, Counter] = {}
    n: Counter = Counter()
    for lang, text in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside: dict[tuple, int] = {}
        for p, a in many.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside.get(p[i : i + k], 0))
        found = []
        for p, a in many.items():
            if inside.get(p, 0) < a:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)
