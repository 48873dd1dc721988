"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def remainder(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def kneser_ney(rows, order, folds=10):
    """(n_tokens, n_known, train_tokens, base_score, score) of each row."""
    texts = [WORD.findall((t or "").translate(LOWER)) + ["</s>"] for _, t in rows]
    train = [w for (i, _), w in zip(rows, texts) if remainder(i, folds)]
    count = collections.Counter(w for t in train for w in t)
    total, v = sum(count.values()), len(count)
    adjusted = {n: collections.Counter() for n in range(1, order + 1)}
    heads = {n: collections.Counter() for n in range(2, order)}
    for t in train:
        s = ["<s>", *t]
        for k in range(1, len(s)):
            if k >= order - 1:
                adjusted[order][tuple(s[k - order + 1:k + 1])] += 1
            elif k + 1 in heads:
                heads[k + 1][tuple(s[:k + 1])] += 1
    for n in range(order - 1, 0, -1):
        adjusted[n].update(g[1:] for g in adjusted[n + 1])
        adjusted[n].update(heads.get(n, {}))
    off, context = {}, {}
    for n, grams in adjusted.items():
        h = collections.Counter(grams.values())
        n1, n2, n3, n4 = (h[k] for k in (1, 2, 3, 4))
        off[n] = (0.5, 1.0, 1.5)
        if min(n1, n2, n3, n4):
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            off[n] = d if all(0 <= x <= k for k, x in enumerate(d, 1)) else off[n]
        context[n] = collections.defaultdict(lambda: [0, 0.0])
        for g, a in grams.items():
            context[n][g[:-1]][0] += a
            context[n][g[:-1]][1] += off[n][min(a, 3) - 1]

    def p(g):
        below = 1 / (v + 1) if len(g) == 1 else p(g[1:])
        if g[:-1] not in context[len(g)]:
            return below
        mass, rest = context[len(g)][g[:-1]]
        a = adjusted[len(g)][g]
        return (a - (off[len(g)][min(a, 3) - 1] if a else 0)) / mass + rest / mass * below

    out = []
    for t in texts:
        s = ["<s>", *t]
        out.append((len(t), sum(w in count for w in t), total, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t),
                    sum(math.log10(p(tuple(s[max(0, k - order + 1):k + 1]))) for k in range(1, len(s)))))
    return out


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [words[k:k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, distance=3):
    """(fingerprint, component) of each row (id, text)."""
    marks = [simhash(t) for _, t in rows]
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= distance:
                name[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return [(f"{m:016x}", least[root(k)]) for k, m in enumerate(marks)]


def _runs(flags):
    return sum(1 for k, f in enumerate(flags) if f and not (k and flags[k - 1]))


def byte_repeats(rows, window=200):
    """(n_bytes, n_removed, n_spans, sha of the rest) of each row."""
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[k:k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k:k + window]] > 1:
                gone[k:k + window] = b"\1" * window
        out.append((len(t), sum(gone), _runs(gone), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def word_repeats(rows, window=13):
    """(n_words, n_removed, kept words) of each row."""
    texts = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), t in zip(rows, texts):
        for k in range(len(t) - window + 1):
            g = tuple(t[k:k + window])
            first[g] = min(i, first.get(g, i))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if first[tuple(t[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((len(t), sum(gone), [w for w, g in zip(t, gone) if not g]))
    return out


def holders(docs, items, gram=5):
    """Pairs of documents and the items of which nine tenths of the words lie in
    runs of ``gram`` words that the document has too."""
    words = re.compile(r"[^\W_]+")
    items = {i: words.findall((t or "").lower()) for i, t in items}
    where = collections.defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - gram + 1):
            where[tuple(w[k:k + gram])].add((i, k))
    covered = collections.defaultdict(set)
    for d, t in docs:
        w = words.findall((t or "").lower())
        for k in range(len(w) - gram + 1):
            for i, at in where.get(tuple(w[k:k + gram]), ()):
                covered[d, i] |= set(range(at, at + gram))
    return {k for k, c in covered.items() if len(c) >= 0.9 * len(items[k[1]])}


def turned(doc_id, text):
    """The words that op12's contract has searched."""
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w and doc_id is not None:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return w


def periodic(w, min_length=6, exponent=4):
    """(start, length, period) of every run of a sequence, by trying every period."""
    found, number = {}, {}
    w = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    for q in range(1, len(w) // exponent + 1):
        edge = np.diff(np.concatenate(([0], (w[q:] == w[:-q]).astype(np.int8), [0])))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j + q - i >= max(min_length, exponent * q):
                found.setdefault((i, j + q - i), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_digest(w):
    runs = periodic(w)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
            len(w) < 50 or 100 * len(again) > 50 * len(w))


def resampled(docs, target, ngrams=(1, 1), buckets=10_000, min_words=20, percent=10, seed=2024):
    """(doc_id, n_features, weight, score, rank) of every document."""
    def scan(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1)]

    texts = [scan(t) for _, t in docs]
    s, t = Counter(b for _, f in texts for b in f), Counter(b for x in target for b in scan(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(docs, texts):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2], r[5]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]
