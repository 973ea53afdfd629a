"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def suffix_dedup(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, sha(kept)))
    return out


def contamination(rows, items):
    windows = {}
    for item, text in items:
        ws = contract_words(text)
        if ws:
            for k in range(max(1, len(ws) - 9)):
                windows.setdefault(tuple(ws[k : k + 10]), set()).add(str(item))
    out = []
    for i, text in rows:
        ws, hit, found = contract_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if tuple(ws[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(ws[k : k + size])]
        out.append((i, len(ws), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def fingerprint(text):
    ws = white_words((text or "").translate(LOWER))
    if not ws:
        return 0
    h = [xxhash.xxh64(" ".join(ws[k : k + 4]).encode(), seed=42).intdigest() for k in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """Index of the first row of each row's component."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def line_dedup(rows, least):
    """rows (id, text, site) -> kept texts."""
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n") if text is not None else ():
            if white_words(line):
                sites.setdefault(line.strip(" "), set()).add(site or "")
    goes = {line for line, s in sites.items() if len(s) >= least}
    return [None if t is None else "\n".join(x for x in t.split("\n") if not (white_words(x) and x.strip(" ") in goes)) for _, t, _ in rows]


def quality(text):
    ws = white_words(text)
    tri = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    n = Counter(tri)
    repeated = {p for k, x in enumerate(tri) if n[x] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if white_words(x)]
    failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    ws = contract_words(text)
    places = sorted((k, label) for p, label in PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
    return len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def article_text(source):
    """Text of a page's article elements, where every block has its own tags; by patterns only."""
    import html

    inner = re.findall(r"(?s)<article[^>]*>(.*?)</article>", re.sub(r"(?s)<!--.*?-->|<(script|style)[^>]*>.*?</\1>", "", source))
    parts = re.split(r"</?(?:p|h\d|div|ul|ol|li|figure|figcaption|blockquote|table|tr|td|pre|section)(?:\s[^>]*)?>", "\0<p>".join(inner))
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x)).replace("\0", "")).split()) for x in parts)
    return "\n\n".join(t for t in texts if t)
