"""Operators by their definitions, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORD.findall((text or "").translate(low))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(texts):
    """The group of each text, as the place of its first member; texts without words are alone."""
    sets = [*map(shingles, texts)]
    group = [*range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return group


def mix(rows, share=1.5, repeats=2, weights=(5, 2, 1)):
    """How often each row (doc_id, source, text) is played: sources fill up by weight, plays are queued by finish time."""
    sizes = [len(WORD.findall(t or "")) for _, _, t in rows]
    total = defaultdict(int)
    for (_, s, _), n in zip(rows, sizes):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, budget, free = {}, Fraction(share) * sum(sizes), [*names]
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > repeats * total[s]]
        for s in full or free:
            target[s] = Fraction(repeats * total[s]) if full else level * weight[s]
        free = [s for s in free if s not in target]
    order = lambda i: hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}:{hashlib.md5((rows[i][2] or '').encode()).hexdigest()}:mix".encode()).hexdigest()
    played, queue = Counter(), []
    for i in sorted(range(len(rows)), key=order):
        s = rows[i][1]
        played[s] += sizes[i]
        if sizes[i]:
            queue += [((played[s] + total[s] * r) / float(target[s]), (s is None, s or ""), i) for r in range(repeats)]
    plays, spent = [0] * len(rows), 0
    for _, _, i in sorted(queue):
        spent += sizes[i]
        if spent > sum(target.values()):
            break
        plays[i] += 1
    return plays


TOKEN = re.compile(r"[^\W_]+")


def segments(scores):
    """Maximal scoring segments by definition: the best one, the shortest and earliest of equals, then left and right of it."""

    def split(a, b):
        best = max(((sum(scores[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i = -best[2]
        j = i - best[1]
        return [*split(a, i), (i, j, best[0]), *split(j, b)]

    return split(0, len(scores))


def toxicity(train, texts, stems=(4, 5, 6), least_ratio=25.0, least_odds=1.5, e_value=0.05):
    """Probability and significant segments of each text, from (text, toxic) training rows."""
    forms = lambda w: [w, *["^" + w[:k] for k in stems if len(w) > k]]
    seen = {0: Counter(), 1: Counter()}
    for text, toxic in train:
        for f in {f for w in TOKEN.findall(text.lower()) for f in forms(w)}:
            seen[int(toxic)][f] += 1
    n = {c: sum(seen[c].values()) for c in seen}
    kept = {}
    for f in {*seen[0], *seen[1]}:
        o, t = seen[0][f], seen[1][f]
        prior = (o + t) * n[1] / (n[0] + n[1])
        odds = lambda x, m: math.log((x + prior) / (m + n[1] - x - prior))
        ratio = 2 * sum(x * math.log(x / ((o + t) * m / (n[0] + n[1]))) for x, m in ((t, n[1]), (o, n[0])) if x)
        if odds(t, n[1]) - odds(o, n[0]) > least_odds and ratio > least_ratio:
            kept[f] = (odds(t, n[1]) - odds(o, n[0]), o, t)
    p_t, p_o = sum(t for _, _, t in kept.values()) / n[1], sum(o for _, o, _ in kept.values()) / n[0]
    drift = math.log((1 - p_t) / (1 - p_o))
    law = [(d, (o + 0.5) / n[0]) for d, o, _ in kept.values()] + [(drift, 1 - p_o)]
    low, high = 1e-3, 20.0
    while high - low > 1e-12:
        mid = (low + high) / 2
        if sum(p * math.exp(min(mid * s, 700)) for s, p in law) < 1:
            low = mid
        else:
            high = mid
    scale = low

    def found(text):
        tokens = TOKEN.findall(text.lower())
        scores = [max([kept[f][0] if f in kept else 0.0 for f in forms(w)]) or drift for w in tokens]
        return segments(scores), max(len(tokens), 1)

    tops = [(max(s for *_, s in seg), m) for (seg, m), toxic in ((found(t), y) for t, y in train) if seg and not toxic]
    log_k = sum(scale * s - math.log(m) for s, m in tops) / len(tops) - 0.5772156649015329 if tops else 0.0

    def evidence(text):
        seg, m = found(text)
        bits = [max(0.0, scale * s - log_k - math.log(m)) for *_, s in seg]
        return max(bits, default=0.0), math.log1p(sum(b for b in bits if b > -math.log(e_value)))

    points = [(1.0, *evidence(t)) for t, _ in train]
    w = [0.0, 0.0, 0.0]
    for _ in range(200):  # Newton's method for the ridge logistic curve
        grad, hess = [-1e-3 * x for x in w], [[1e-3 * (i == j) for j in range(3)] for i in range(3)]
        for x, (_, y) in zip(points, train):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i in range(3):
                grad[i] += x[i] * (y - p)
                for j in range(3):
                    hess[i][j] += x[i] * x[j] * (p * (1 - p) + 1e-9)
        rows = [[*hess[i], grad[i]] for i in range(3)]
        for i in range(3):
            rows[i] = [v / rows[i][i] for v in rows[i]]
            for j in range(3):
                if j != i:
                    rows[j] = [a - rows[j][i] * b for a, b in zip(rows[j], rows[i])]
        step = [r[3] for r in rows]
        w = [a + b for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-8:
            break
    out = []
    for text in texts:
        seg, m = found(text or "")
        best, total = evidence(text or "")
        z = max(-30.0, min(30.0, w[0] + w[1] * best + w[2] * total))
        spots = [(a, b) for a, b, s in seg if scale * s > log_k + math.log(m) - math.log(e_value)]
        out.append((1 / (1 + math.exp(-z)), spots))
    return out
