"""Plain versions of the operators, over lists of rows, to hold the results against."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def shingles(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_duplicates(rows, percent=80):
    """{doc_id: (n, component)} for rows (doc_id, text); pairs are found by rare shingles first."""
    sets = {i: shingles(t) for i, t in rows}
    often = Counter(s for found in sets.values() for s in found)
    holders, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, found in sorted(sets.items(), key=lambda x: (len(x[1]), x[0])):
        rare = sorted(found, key=lambda s: (often[s], s))
        rare = rare[: len(found) - -(-percent * len(found) // 100) + 1]
        for j in {j for s in rare for j in holders[s]}:
            if root(i) != root(j):
                both = len(found & sets[j])
                if 100 * both >= percent * (len(found) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        for s in rare:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    found = []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def nearest(rows, queries, k=10):
    """{query: [(id, distance)]} over rows (id, vector)."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in queries:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(far[i])) for i in order]
    return out


def warc(rows):
    """{page_id: (bytes, digest, type, refers_to)} for rows (page_id, html)."""
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        first[data] = min(first.get(data, i), i)
    out = {}
    for i, html in rows:
        data = (html or "").encode()
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first[data] != i
        out[i] = (len(data), name, "revisit" if revisit else "response", first[data] if revisit else None)
    return out


def chat(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} for rows (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def formatted_chars(rows, escaped):
    """{conv_id: code points of all examples written out} for rows (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        parts = [f"<|{escaped(r)}|>{escaped(t)}<|end|>" for _, r, t in turns]
        out[conv] = sum(len("".join(parts[: i + 1])) for i, (_, r, _) in enumerate(turns) if r == "assistant")
    return out


def escaped(text):
    """Backslashes doubled, and one put behind the first character of every control string."""
    text = text.replace("\\", "\\\\")
    return re.sub(r"<(?=\||/?s>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])", lambda m: m[0] + "\\", text)
