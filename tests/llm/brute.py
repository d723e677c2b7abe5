"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard(docs, percent=85, k=4):
    docs = sorted(docs, key=lambda d: d[0])
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = []
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    common = {}
    for ids in where.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    r = roots(len(docs), links)
    return {(d[0], len(s), docs[r[i]][0]) for i, (d, s) in enumerate(zip(docs, sets, strict=True))}


def suffix(docs, length=200):
    seen = {}
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, x in data:
        for p in range(len(x) - length + 1):
            h = x[p : p + length]
            seen[h] = seen.get(h, 0) + 1
    out = set()
    for i, x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(x)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.add((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for p, label in phrases.items():
        p = p.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += found
        if found:
            labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def blocks(text, templates, threshold=0.8, size=128, stride=64):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    out = set()
    for b in range(0, max(len(w) - stride, 1), stride):
        for k, t in templates.items():
            if len(t & set(w[b : b + size])) >= threshold * len(t) - 1e-9:
                out.add((b, k))
    return out


def pii(text):
    text = text or ""
    out = []

    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 if x > 9 else x
        return s % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def languages(docs, bits, number, held):
    """{id: (language, score)} by plain loops; ``bits`` holds a letter's vector by its ``number``."""
    dim = bits.shape[1] * 64
    signs = {}

    def letter(n, place):
        if (n, place) not in signs:
            words = [int(bits[n][(k - place) % bits.shape[1]]) for k in range(bits.shape[1])]
            signs[n, place] = [-1 if w.to_bytes(8, "little")[i // 8] >> (7 - i % 8) & 1 else 1 for w in words for i in range(64)]
        return signs[n, place]

    def profile(text):
        letters = re.sub("0+", "0", "0" + "".join(chr(0x100000 + number(c)) if c.isalpha() else "0" for c in text) + "0")
        if letters == "0":
            return None
        codes = [0 if c == "0" else ord(c) - 0x100000 for c in letters]
        total = [0.0] * dim
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            for i, (x, y, z) in enumerate(zip(letter(a, 2), letter(b, 1), letter(c, 0), strict=True)):
                total[i] += x * y * z
        return total

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    profiles = {i: profile(t or "") for i, t, _ in docs}
    sums = {}
    for i, _, lang in docs:
        if i is not None and not held(i) and lang is not None and profiles[i]:
            v = unit(profiles[i])
            sums[lang] = [x + y for x, y in zip(sums.get(lang, [0.0] * dim), v, strict=True)]
    sums = {k: unit(v) for k, v in sums.items()}
    mean = [sum(x) / len(sums) for x in zip(*sums.values(), strict=True)]
    centred = {k: unit([x - m for x, m in zip(v, mean, strict=True)]) for k, v in sums.items()}
    out = {}
    for i, v in profiles.items():
        if v is None:
            out[i] = ("und", 0.0)
        else:
            v = unit(v)
            score, lang = max((sum(x * y for x, y in zip(v, p, strict=True)), k) for k, p in centred.items())
            out[i] = (lang, (1 + score) / 2)
    return out
