"""Plain versions of the operators, for small inputs."""

import hashlib
import random
import re


def union_find(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, size=3):
    ws = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)])


def jaccard(rows, size=3, num=90, den=100):
    """[(doc_id, text)] -> {doc_id: (n, component)}; ids are different."""
    sets = {i: shingle_set(t, size) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = union_find(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def repeats(rows, length=100):
    """[(doc_id, text)] -> {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}; ids are different."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                for j in range(p, p + length):
                    gone[j] = True
            else:
                seen[s] = (i, p)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(docs, items, window=10):
    """-> {doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""

    def split(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    wins = []
    for i, t in items:
        w = split(t)
        k = min(window, len(w))
        if k:
            wins.append((str(i), {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}, k))
    out = {}
    for i, t in docs:
        w = split(t)
        hit, found = [False] * len(w), set()
        for item, own, k in wins:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in own:
                    found.add(item)
                    for x in range(j, j + k):
                        hit[x] = True
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit))
    return out


def noisy_corpus(seed=1, families=12, copies=9, vocabulary=400, words=(3, 160)):
    """Texts with exact copies, near copies, shared passages and oddities: [(doc_id, text)]."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(rng.randint(*words))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
    for _ in range(families):
        texts.append(" ".join(rng.choice(vocab) for _ in range(40)) + " " + passage + "\n" + " ".join(rng.choice(vocab) for _ in range(5)))
    texts += ["", None, "one", "One", "two words", "TWO  words", "   ", "The " * 300, "The " * 300 + "end", "x" * 99, "x" * 100, "x" * 260, "a\x00b c", "ß" * 120, "ß" * 121]
    rng.shuffle(texts)
    return list(enumerate(texts))
