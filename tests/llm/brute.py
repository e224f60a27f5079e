"""Plain Python versions of what the operators compute."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(k, k + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def licenses(text):
    words, at, labels = LICENSE_WORD.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """source -> target, by sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            break
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: most * sizes[s] if s in capped else level * weight[s] for s in names}


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def katz(rows, k=5):
    """(n_tokens, n_known, train tokens, base score, score) of each (id, text)."""
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    unigrams, bigrams, contexts = Counter(), Counter(), Counter()
    for i, ts in tokens:
        if not held_out(i):
            unigrams.update(ts)
            for h, w in zip(["start", *ts], ts):
                bigrams[h, w] += 1
                contexts[h] += 1
    total, kinds, n = sum(unigrams.values()), len(unigrams), Counter(bigrams.values())
    d = []
    for r in range(1, k + 1):
        x = (r - 0.5) / r
        if n[1] and n[r] and n[r + 1]:
            a, star = (k + 1) * n[k + 1] / n[1], (r + 1) * n[r + 1] / n[r]
            if a < 1 and 0 < (star / r - a) / (1 - a) < 1:
                x = (star / r - a) / (1 - a)
        d.append(x)
    lost = min(0.5, max(sum(c == 1 for c in unigrams.values()), 0.5) / total) if total else 1.0
    lower = lambda w: (1 - lost) * unigrams[w] / total if unigrams[w] else lost
    discount = lambda r: d[r - 1] if r <= k else (r - 0.5) / r
    seen, low = defaultdict(float), defaultdict(float)
    for (h, w), r in bigrams.items():
        seen[h] += discount(r) * r / contexts[h]
        low[h] += lower(w)

    def p(h, w):
        if r := bigrams.get((h, w), 0):
            return discount(r) * r / contexts[h]
        return (1 - seen[h]) / (1 - low[h]) * lower(w) if contexts[h] else lower(w)

    out = []
    for _, ts in tokens:
        score = sum(math.log10(p(h, w)) for h, w in zip(["start", *ts], ts))
        base = sum(math.log10((unigrams[w] + 1) / (total + kinds + 1)) for w in ts)
        out.append((len(ts), sum(unigrams[w] > 0 for w in ts), total, base, score))
    sums = {h: sum(p(h, w) for w in [*unigrams, "unknown"]) for h in [*list(contexts)[:20], "nowhere"]}
    return out, sums


def chat(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def answers(counts, accuracy, good, prior, rounds=200):
    """EM over votes 0, 1 or None by pattern: share of good, and (bad, good, abstain) of each rule on good and on bad."""
    total, rules = sum(counts.values()), range(len(accuracy))
    says = lambda j, v: sum(n for p, n in counts.items() if p[j] == v)
    norm = lambda xs: [x / sum(xs) for x in xs]
    begin = [[norm([says(j, 0) * x + 0.01, says(j, 1) * y + 0.01, says(j, None) / 2 + 0.01]) for j, a in enumerate(accuracy) for x, y in [(1 - a, a) if side else (a, 1 - a)]] for side in (1, 0)]
    share, now = good, begin
    for _ in range(rounds):
        sums, fine = [[[0.0] * 3 for _ in rules] for _ in (0, 1)], 0.0
        for p, n in counts.items():
            of = [2 if v is None else v for v in p]
            weight = [share * math.prod(now[0][j][v] for j, v in enumerate(of)), (1 - share) * math.prod(now[1][j][v] for j, v in enumerate(of))]
            for side in (0, 1):
                for j, v in enumerate(of):
                    sums[side][j][v] += n * weight[side] / sum(weight)
            fine += n * weight[0] / sum(weight)
        share = (fine + prior * good) / (total + prior)
        now = [[norm([x + prior * b + 0.01 for x, b in zip(sums[side][j], begin[side][j])]) for j in rules] for side in (0, 1)]
    return share, *now


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r, text: digest("".join(map(field, (*r[:4], text))))

    def tree(nodes):
        paths, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            upper, held = [], []
            for k in range(0, len(nodes), 16):
                run = nodes[k : k + 16]
                for j in range(len(run)):
                    for i in below[k + j]:
                        paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                upper.append(digest("".join(run)))
                held.append(sum(below[k : k + 16], []))
            nodes, below = upper, held
        return nodes[0], paths

    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in order]
    root, above = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (subroot, paths), up in zip(order, trees, above, strict=True):
        for (_, _, leaf, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), paths, strict=True):
            h, path = leaf, path + up
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                h = leaf_of(r, r[4] and r[4].translate(LOWER))
            for a, b in path:
                h = digest(a + h + b)
            out.append((r[0], leaf, subroot, root, digest("".join(a + b for a, b in path)), h, h == root))
    return out


def collocations(rows, least, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (text, lang)."""
    n, f, within = Counter(), Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, words), a in found.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    within[lang, words[i:j]] = max(within[lang, words[i:j]], a)
    out = defaultdict(list)
    for (lang, words), a in found.items():
        if within[lang, words] < a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, mine in out.items() for k, (s, a, p, left, right) in enumerate(sorted(mine)[:top])}


def near_vectors(rows, cosine):
    """vec_id by row -> (links, component, kept); null, zero and non-finite vectors stay alone."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = lambda v: [x / max(map(abs, v)) for x in v]
    norm = lambda v: math.sqrt(math.fsum(x * x for x in v))
    good = [(i, unit(v)) for i, (_, v) in enumerate(rows) if fine(v)]
    links = [(i, j) for k, (i, v) in enumerate(good) for j, w in good[:k] if len(v) == len(w) and math.fsum(a * b for a, b in zip(v, w, strict=True)) / (norm(v) * norm(w)) >= cosine]
    degree = Counter(x for pair in links for x in pair)
    label = components(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return sorted(((i, degree[k], least.get(label[k]), i is not None and i == least.get(label[k])) for k, (i, _) in enumerate(rows)), key=str)
