"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ngram_components(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text), all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    to = list(range(len(rows)))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b]:
                common = len(s & sets[b])
                if 100 * common >= 80 * (len(s) + len(sets[b]) - common):
                    to[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def repeats(rows, length=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept) of rows (doc_id, text); kept is None if it isn't UTF-8."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        try:
            text = kept.decode()
        except UnicodeDecodeError:
            text = None
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), len(kept), text))
    return out


def contamination(rows, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = defaultdict(set)
    for item, text in items:
        w = pattern.findall((text or "").translate(UPPER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in rows:
        w = pattern.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                own = grams.get(tuple(w[i : i + n]))
                if own:
                    found |= own
                    hit |= set(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def nearest(rows, every=20, k=20):
    """query, rank, id, score by comparing all."""
    import math

    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    own = {i: v for i, v in rows if i is not None and fine(v)}
    out = []
    for q, v in own.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in own.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def softmax_of_words(text, weights, base, index_of):
    """Posteriors of a text's lower-cased words, counted by their hashed place and scaled to length 1."""
    import math

    counts = Counter(index_of(w) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w)
    size = math.sqrt(sum(c * c for c in counts.values())) or 1.0
    logits = [b + sum(row[i] * c / size for i, c in counts.items()) for row, b in zip(weights, base, strict=True)]
    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


def least_rates(n, soft, want, scale, nearness, steps=1500, most=float("inf")):
    """Rates >= 0 of the penalised least squares, and its value, by accelerated projected gradients over all rates."""
    import numpy as np

    w, p = np.array(n, float) / sum(n), np.array(soft)
    want, scale = np.array(list(want)), np.array(list(scale))
    misses = lambda r: p.T @ (w * r) - want
    value = lambda r: _value(np.array(r))
    _value = lambda r: float((misses(r) ** 2 / scale).sum() + nearness * (w * (r - 1) ** 2).sum())
    steepest = 2 * ((p * p / scale).sum(axis=1) * w).sum() + 2 * nearness
    r = ahead = np.ones(len(w))
    t = 1.0
    for _ in range(steps):
        new = np.clip(ahead - (2 * p @ (misses(ahead) / scale) + 2 * nearness * (ahead - 1)) / steepest, 0, most)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, r = new + (before - 1) / t * (new - r), new
    return r, value(r), value


def rule_score(model, stats):
    """The score of a rule ensemble for statistics by name."""
    import math

    odds = model["base"]
    for rule, weight in model["rules"].items():
        odds += weight * all((stats[s] > at) if above else (stats[s] <= at) for s, above, at in rule)
    return 1 / (1 + math.exp(-odds))


def language(model, x):
    """The language that a profile is given: the family that wins most pairs, then the language within it; ties by margin."""
    import math

    def best(names, machines):
        wins = dict.fromkeys(names, 0.0)
        for (a, b), w in machines.items():
            if a in wins and b in wins:
                m = sum(u * v for u, v in zip(x, w[:-1], strict=True)) + w[-1]
                wins[a] += (m > 0) + 1e-3 * math.tanh(m)
                wins[b] += (m < 0) + 1e-3 * math.tanh(-m)
        return max(names, key=lambda k: wins[k])

    family = best(sorted(model["languages"]), model["families"])
    return best(model["languages"][family], model["within"])


def near_copies(rows, like=0.9):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, vector), all pairs compared."""
    import math

    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    to = list(range(len(rows)))

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    rows = [(i, [math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] if fine(v) else None) for i, v in rows]
    links = [0] * len(rows)
    size = [math.sqrt(sum(x * x for x in v)) if fine(v) else None for _, v in rows]
    for a, (_, v) in enumerate(rows):
        for b in range(a):
            if size[a] and size[b] and sum(x * y for x, y in zip(v, rows[b][1], strict=False)) / (size[a] * size[b]) >= like:
                links[a] += 1
                links[b] += 1
                to[find(a)] = find(b)
    least = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            least[find(i)] = min(vec, least.get(find(i), vec))
    named = [least.get(find(i)) if size[i] else vec for i, (vec, _) in enumerate(rows)]
    return [(vec, n, c, vec is not None and vec == c) for (vec, _), n, c in zip(rows, links, named, strict=True)]


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    short, long = sorted((a, b), key=len)
    return short[i:] == long[i + 1 :]


def variants(rows, shortest=7, often=2, every=31, times=10):
    """(word, form, root, n, n_near, form_n) of rows (doc_id, text), all pairs of words compared."""
    import zlib

    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    words = {w: n for w, n in seen.items() if len(w) >= shortest and n >= often}
    near, form = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_apart(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def codes(rows, parts=16, entries=64, rounds=2, scale=256, bound=1 << 25):
    """(vec_id, code, error, label_error, codebooks_sha256) of rows (vec_id, vector, label), all entries compared."""
    import math

    kept = [(i, [min(max(math.floor(scale * x), -bound), bound) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    per = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = lambda v: [tuple((v + [0] * (parts * per - len(v)))[p * per : (p + 1) * per]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (away(x, books[p][e]), e))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups[p, nearest(p, x)].append(x)
        for (p, e), own in groups.items():
            books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    told, sums = [], Counter()
    for i, v, label in kept:
        at = [nearest(p, x) for p, x in enumerate(cut(v))]
        error = sum(away(x, books[p][at[p]]) for p, x in enumerate(cut(v)))
        sums[label] += error
        told.append((i, "".join(f"{a:02x}" for a in at), error, label))
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, code, error, sums[label], digest) for i, code, error, label in told]
