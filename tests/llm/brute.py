"""Plain versions of what the corpus operators compute, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WHITE = " \t\n\x0b\x0c\r"


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_groups(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (a, b) for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    named = components(sets, links)
    return {i: (len(sets[i]), named[i]) for i in sets}


def without_repeats(texts, width):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            window = tuple(w[k : k + width])
            if window in seen:
                gone[k : k + width] = [True] * width
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def _align(one, two, i=0, j=0):
    """Matched places of two line sequences by recursion: common ends, then lines unique to both in a longest rising
    order (of equal ones the last, each step from the last line it can follow), then what lies between."""
    if not one or not two:
        return []
    if one[0] == two[0]:
        return [(i, j), *_align(one[1:], two[1:], i + 1, j + 1)]
    if one[-1] == two[-1]:
        return [*_align(one[:-1], two[:-1], i, j), (i + len(one) - 1, j + len(two) - 1)]
    both = [(p, two.index(x)) for p, x in enumerate(one) if x and one.count(x) == 1 and two.count(x) == 1]
    if not both:
        return []
    length, back = [], []
    for n, (_, q) in enumerate(both):
        length.append(1 + max((length[m] for m in range(n) if both[m][1] < q), default=0))
        back.append(max((m for m in range(n) if length[m] == length[n] - 1), default=None))
    n = max(m for m in range(len(both)) if length[m] == max(length))
    chain = []
    while n is not None:
        chain.append(both[n])
        n = back[n] if length[n] > 1 else None
    out, a, c = [], 0, 0
    for p, q in [*chain[::-1], (len(one), len(two))]:
        out += _align(one[a:p], two[c:q], i + a, j + c)
        if p < len(one):
            out.append((i + p, j + q))
        a, c = p + 1, q + 1
    return out


def lines_left(texts, block_words):
    """What is left of each text if it is aligned with every earlier one that shares a line."""
    split = {i: (t or "").split("\n") for i, t in texts.items()}
    code = {}
    hashed = {i: [code.setdefault(x.strip(WHITE), len(code) + 1) if x.strip(WHITE) else 0 for x in own] for i, own in split.items()}
    left = {}
    for b, own in split.items():
        gone = set()
        for a in texts:
            if a < b and set(hashed[a]) & set(hashed[b]) - {0}:
                block = []
                for i, j in [*_align(hashed[a], hashed[b]), (None, None)]:
                    if not block or (i, j) != (block[-1][0] + 1, block[-1][1] + 1) if i is not None else True:
                        if sum(len(words(own[k])) for _, k in block) >= block_words:
                            gone |= {k for _, k in block if hashed[b][k]}
                        block = []
                    block.append((i, j))
        left[b] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return left



def training_counts(texts, held):
    counts = Counter()
    for i, t in texts.items():
        if not held(i):
            counts.update(words(t, lower=True) + [None])
    return counts


def suffix_tree(rows, held, depth=3, least=3, divergence=0.02):
    """Base score and score of each (id, text): every run of a training text is counted, nothing is hashed."""
    texts = [[None, *words(t, lower=True), None] for _, t in rows]
    counts = Counter()
    for (i, _), x in zip(rows, texts, strict=True):
        if not held(i):
            counts.update(tuple(x[j - k : j + 1]) for j in range(1, len(x)) for k in range(min(depth, j) + 1))
    total = sum(c for r, c in counts.items() if len(r) == 1)
    kinds = sum(len(r) == 1 for r in counts)
    repeated = defaultdict(list)
    for run, c in counts.items():
        if len(run) > 1 and counts[run[:-1]] >= least and c > 1:
            repeated[run[:-1]].append(run)
    weight = {}
    for context, runs in repeated.items():
        of, options = counts[context], []
        for rest in (0.1, 0.3, 0.5, 0.7, 0.9):
            gain = (of - sum(counts[r] for r in runs)) * math.log(rest)
            for r in runs:
                shorter = counts[r[1:]] / (counts[r[1:-1]] if len(r) > 2 else total)
                gain += round(4096 * counts[r] * math.log((1 - rest) * (counts[r] - 1) / (of - 1) / shorter + rest)) / 4096
            options.append((gain, rest))
        if max(options)[0] >= divergence * of:
            weight[context] = max(options)[1]
    out = []
    for x in texts:
        base = score = 0.0
        for j in range(1, len(x)):
            p = (counts[(x[j],)] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for k in range(1, min(depth, j) + 1):
                context = tuple(x[j - k : j])
                if context in weight:
                    p = (1 - weight[context]) * counts[(*context, x[j])] / counts[context] + weight[context] * p
            score += math.log10(p)
        out.append((base, score))
    return out


RUN = re.compile("[a-zÀ-ÿ]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def spelling(rows):
    """``{word: (form, root, n, n_near, form_n)}`` from ``(doc_id, text)`` rows, by comparing all words."""
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall((text or "").translate(SMALL)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near, form = defaultdict(list), {}
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and _one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()}


def vector_codes(rows):
    """Codes of ``(vec_id, vector, label)`` rows with ids, every part against every entry."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // 4
    parts = [[v[k * width : (k + 1) * width] for _, v, _ in kept] for k in range(4)]
    books = [p[:256] for p in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(4):
        for k in range(4):
            groups = defaultdict(list)
            for x in parts[k]:
                groups[nearest(x, books[k])[1]].append(x)
            books[k] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[k])]
    found = [[nearest(parts[k][r], books[k]) for k in range(4)] for r in range(len(kept))]
    by_label = Counter()
    for (_, _, c), f in zip(kept, found, strict=True):
        by_label[c] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [
        (i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[c], digest)
        for (i, _, c), f in zip(kept, found, strict=True)
    ]


def licenses(rows, templates, percent=80):
    """(id, license, matches, first word, containment) by laying each template on every shingle of it that a text holds."""

    def plain(text):
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        return "".join(c if not c.isascii() or c.isalnum() else " " for c in low).split(" ")

    out = []
    for doc, text in rows:
        w = [x for x in plain(text) if x]
        best = {}
        for name, texts in templates.items():
            for template in texts:
                own = [x for x in plain(template) if x]
                n, size = len(own), min(5, len(own))
                slack = n // 4 if n > 5 else 0
                grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
                places = defaultdict(list)
                for k in range(n - size + 1):
                    places[tuple(own[k : k + size])].append(k)
                last = None
                for at in sorted({k - p for k, g in enumerate(grams) for p in places.get(g, ())}):
                    held = len(set(grams[max(0, at - slack) : max(0, at + n - size + 1 + slack)]) & set(places))
                    share = 100 * held / len(places)
                    if share < percent:
                        continue
                    at = max(at, 0)
                    entry = best.setdefault(name, [0, at, 0.0])
                    if last is None or last + max(3, n // 2) < at:
                        entry[0], last = entry[0] + 1, at
                    entry[1], entry[2] = min(entry[1], at), max(entry[2], share)
        out += [(doc, name, *entry) for name, entry in best.items()]
    return out
