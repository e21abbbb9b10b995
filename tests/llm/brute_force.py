"""What the operators compute, by trying everything."""

import math
import re
from collections import Counter

import numpy as np
import xxhash


def later_words(texts, k):
    """Words of each text that some window of ``k`` words covers which occurred before, in the order of ids."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].split()
        for s in range(len(w) - k + 1):
            window = tuple(w[s : s + k])
            if window in seen:
                out.setdefault(i, set()).update(range(s, s + k))
            seen.add(window)
    return out


def simhash_of(text):
    """256 bits: the sign of the sum of +1 and -1 for each bit of the words' hashes, weighted by their counts; None without words."""
    sums = [0] * 256
    counts = Counter(re.findall(r"\w+", (text or "").lower()))
    for word, n in counts.items():
        raw = word.encode("utf-8", "surrogatepass")
        bits = int.from_bytes(b"".join(xxhash.xxh3_128_digest(raw, seed=s) for s in (0, 1)), "big")
        weight = math.floor(4 * math.sqrt(n) + 0.5)
        for k in range(256):
            sums[k] += weight if bits >> (255 - k) & 1 else -weight
    return sum(1 << (255 - k) for k, x in enumerate(sums) if x > 0) if counts else None


def near_groups(ids, texts, limit):
    """All pairs within ``limit``, and the least id of the group of each id that isn't the least."""
    fps = [simhash_of(t) for t in texts]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for a in range(len(ids)):
        for b in range(a):
            if fps[a] is not None and fps[b] is not None and (fps[a] ^ fps[b]).bit_count() <= limit:
                pairs.add((ids[b], ids[a]))
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in ids if find(i) != i}


def wrong_bits(a, b, offset):
    """Wrong bits and all bits where frame t of ``a`` is frame t - offset of ``b``."""
    both = [(a[t], b[t - offset]) for t in range(len(a)) if 0 <= t - offset < len(b)]
    return sum(((int(x) ^ int(y)) & 0xFFFFFFFF).bit_count() for x, y in both), 32 * len(both)


def best_alignment(a, b, least_frames):
    """(share of wrong bits, offset) over all offsets with an overlap of ``least_frames``."""
    out = (1.0, 0)
    for offset in range(least_frames - len(b), len(a) - least_frames + 1):
        begin = max(offset, 0)
        n = min(len(a), len(b) + offset) - begin
        wrong = int(np.bitwise_count(a[begin : begin + n] ^ b[begin - offset : begin - offset + n]).sum())
        out = min(out, (wrong / (32 * n), offset))
    return out


def words_of(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")


def trigram_models(labelled):
    """By language: a function from a word to its log-likelihood. Every letter of all samples is told apart; all others are one more."""
    grams: dict = {}
    for lang, text in labelled:
        for w in filter(None, words_of(text)):
            w = ["", "", *w, ""]
            grams.setdefault(lang, Counter()).update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    letters = {c for g in grams.values() for t in g for c in t if c}
    n_symbols = len(letters) + 2

    def model(g):
        one, two, ctx, before = Counter(), Counter(), Counter(), Counter()
        for (a, b, c), n in g.items():
            one[c] += n
            two[b, c] += n
            ctx[a, b] += n
            before[b] += n
        total = sum(one.values()) + 0.5 * n_symbols

        def loglik(w):
            w = ["", "", *(c if c in letters else "?" for c in w), ""]
            out = 0.0
            for a, b, c in (w[i : i + 3] for i in range(len(w) - 2)):
                p1 = (one[c] + 0.5) / total
                p2 = (two[b, c] + 8 * p1) / (before[b] + 8)
                out += math.log((g[a, b, c] + 4 * p2) / (ctx[a, b] + 4))
            return out

        return loglik

    return {lang: model(g) for lang, g in sorted(grams.items())} | {"und": lambda w: (len(w) + 1) * -math.log(n_symbols)}


def mixture(text, models, penalty, tolerance=1e-3, rounds=60):
    """Shares by language, of the set that grows by the language that raises the likelihood most, while that pays."""
    words = [w for w in words_of(text) if w]
    names = list(models)
    if not words:
        return {}
    lik = np.exp(np.array([[m(w) for m in models.values()] for w in words]))
    top = lik.max(1, keepdims=True)
    lik = lik / top

    def em(allowed):
        share = np.array([1.0 if k in allowed else 0.0 for k in range(len(names))]) / len(allowed)
        for _ in range(rounds):
            r = lik * share
            new = (r / r.sum(1, keepdims=True)).mean(0)
            moved = np.abs(new - share).max()
            share = new
            if moved <= tolerance:
                break
        return share, np.log((lik * share).sum(1)).sum()

    price = penalty * math.log(len(words) + 1)
    single = np.log(lik).sum(0)
    chosen, reached = {int(single.argmax())}, single.max()
    share = np.eye(len(names))[single.argmax()]
    full = em(set(range(len(names))))[1]
    while full - reached > price:
        tries = [(em(chosen | {k}), k) for k in range(len(names)) if k not in chosen]
        (s, value), k = max(tries, key=lambda x: (x[0][1], -x[1]))
        if value - reached <= price:
            break
        chosen, reached, share = chosen | {k}, value, s
    return {names[k]: share[k] for k in chosen if share[k] > 0}
