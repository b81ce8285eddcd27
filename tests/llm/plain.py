"""Plain versions of the operators, without Spark and without their methods."""

import hashlib
import re

import numpy as np
import xxhash


def printable(line):
    return re.search(r"[^ \t\r]", line) is not None


def lanes(text):
    """Lanes of a text as one list, from their definition."""
    out = [0] * 137
    for paragraph in filter(printable, (text or "").split("\n")):
        digest = hashlib.sha256(paragraph.encode()).hexdigest()
        for i in range(8):
            out[1 + i] = (out[1 + i] + int(digest[8 * i : 8 * i + 8], 16)) % 2**32
        for phrase in filter(printable, re.split(r"[.,!?;:|]+", paragraph)):
            out[0] += 1
            code = hashlib.md5(phrase.encode()).hexdigest()
            for w in range(2):
                word = int(code[16 * w : 16 * w + 16], 16)
                for b in range(64):
                    out[9 + 64 * w + b] = (out[9 + 64 * w + b] + (1 if word >> b & 1 else -1)) % 2**16
    return out


def lanes_text(values):
    return "".join(f"{v:08x}" for v in values[:9]) + "".join(f"{v:04x}" for v in values[9:])


def likeness(a, b):
    signed = lambda v: [(x + 2**15) % 2**16 - 2**15 for x in v]
    both = sum(x * x for x in signed(a[9:])) + sum(x * x for x in signed(b[9:]))
    apart = sum(x * x for x in signed([x - y for x, y in zip(a[9:], b[9:], strict=True)]))
    return 1.0 if both == 0 else max(0.0, 1.0 - apart / both)


def edits(rows):
    """(doc_id, text, edited, next text) in descending doc_id."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        out.append((i, text, text[: len(text) - half] + following[:half], following))
    return out


def simhash(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """Root place of each fingerprint."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def base_spans(text):
    """(start, kind, end) of the fixed patterns."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def elements(text):
    """Lines, each with the blank lines behind it."""
    out = []
    for line in text.split("\n"):
        if out and not printable(line):
            out[-1] += "\n" + line
        else:
            out.append(line)
    return out


def line_dedup(rows, min_words=10):
    """{(doc_id, text): text without later copies}, comparing every pair of positions line by line."""
    order = sorted({(i is None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), i, t) for i, t in rows if t is not None}, key=lambda r: r[:3])
    places, texts = [], []
    for d, (_, _, _, _, text) in enumerate(order):
        parts = [p.rstrip(" \t\r\n") for p in elements(text)]
        texts.append(parts)
        places += [(d, n) for n, p in enumerate(parts) if p]
    words = lambda line: max(len(re.split("[ \t]+", line.strip(" "))), len(line) // 10)
    gone = set()
    for x, (d, n) in enumerate(places):
        most = 0
        for e, m in places[:x]:
            size = 0
            while n + size < len(texts[d]) and m + size < len(texts[e]) and texts[d][n + size] and texts[d][n + size] == texts[e][m + size]:
                size += 1
            most = max(most, size)
        if sum(words(p) for p in texts[d][n : n + most]) >= min_words:
            gone |= {(d, n + k) for k in range(most)}
    return {(i, t): "\n".join(p for n, p in enumerate(elements(t)) if (d, n) not in gone) for d, (_, _, _, i, t) in enumerate(order)}


def best_products(vectors, is_query, k):
    """[(query, rank, id, score)] of {(id, whole vector)} by comparing all pairs."""
    width = max((len(v) for _, v in vectors), default=0)
    table = np.array([list(v) + [0] * (width - len(v)) for _, v in vectors], dtype=object).reshape(len(vectors), width)
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in vectors if i is not None and is_query(i)}):
        own = np.array(list(v) + [0] * (width - len(v)), dtype=object)
        scores = sorted((-int(row @ own), j is None, j or 0) for row, (j, _) in zip(table, vectors, strict=True) if j != i)
        out += [(i, r + 1, None if missing else j, -s) for r, (s, missing, j) in enumerate(scores[:k])]
    return out
