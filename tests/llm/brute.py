"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near_duplicates(rows, size=5, percent=75):
    """rows: (id, text). By an inverted index of shingles."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                shared[j] += 1
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def decontaminate(rows, items, window=10):
    owners = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[i : i + window])].add(str(item))
    sizes = {len(w) for w in owners}
    out = []
    for d, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = np.zeros(len(words), bool), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in owners:
                    hit[i : i + n] = True
                    found |= owners[w]
        out.append((d, len(words), int(hit.sum()), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit.any())))
    return sorted(out)


def tokens(rows, path):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fill_in_middle(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for d, text in rows:
        text = text or ""
        parts = TOKEN.findall(text)
        drawn = hashlib.sha256(f"42:{d}".encode()).hexdigest()
        h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, z = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
        p, m, s = ("".join(x) for x in (parts[:a], parts[a:z], parts[z:]))
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            out.append((d, len(parts), "plain", None, None, sha(text), sha(text)))
        elif h[3] % 100 < 80:
            out.append((d, len(parts), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)))
        else:
            out.append((d, len(parts), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)))
    return out


def one_edit(a, b):
    """By dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1] == 1


def vocabulary(rows):
    seen = defaultdict(int)
    for d, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{word}".encode())
            if h % 97 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            seen[word] += 1
    return {w: n for w, n in seen.items() if n >= 3 and len(w) >= 5}


def variants(n):
    """n: word to count. By every string one deletion or replacement away."""
    near, by = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for alike in by.values():
        for w in alike:
            near[w] |= alike - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n]
