"""Plain versions of the operators, straight from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

UPPER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").translate(UPPER)


def op1_base(docs):
    train = [zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in docs]
    tokens = [[*SPACED.findall(lower(t)), None] for _, t in docs]
    counts = Counter(w for ts, own in zip(tokens, train) if own for w in ts)
    n, v = sum(counts.values()), len(counts)
    return [(d, not own, len(ts), sum(counts[w] > 0 for w in ts), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for (d, _), own, ts in zip(docs, train, tokens)]


def op4(text):
    words = SPACED.findall(text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(runs)
    hit = {j for i, r in enumerate(runs) if count[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def op4_kept(rows, weight=25.0, reach=3.0, core=0.75, tail=0.99, beyond=2.0):
    """Verdicts of (text, lang, source), with quantiles of sorted lists."""
    rated = []
    for text, lang, source in rows:
        n, chars, symbols, dup, repeat = op4(text)
        lines = sum(bool(SPACED.search(x)) for x in (text or "").split("\n"))
        failed = n < 20 or 100 * repeat > 30 * n
        rated.append(((lang, source), failed, n, chars / max(n, 1), (symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1))))

    def quantile(group, rows, value, q):
        out = None
        for own in (rows, [r for r in rows if r[0][0] == group[0]], [r for r in rows if r[0] == group]):
            if own:
                x = sorted(map(value, own))[max(math.ceil(q * len(own)) - 1, 0)]
                out = x if out is None else (len(own) * x + weight * out) / (len(own) + weight)
        return out

    base = [r for r in rated if not r[1]]
    length, words = (lambda r: r[3]), (lambda r: r[2])
    groups = {r[0] for r in rated}
    quartiles = {g: [quantile(g, base, length, 0.25), quantile(g, base, length, 0.75), quantile(g, base, words, 0.5)] for g in groups} if base else {}

    def within(r, distances):
        low, high, typical = quartiles[r[0]]
        between = (high - low) * math.sqrt(max(typical / max(r[2], 1), 1))
        return low - distances * between <= r[3] <= high + distances * between

    inner = [r for r in base if within(r, core)]
    limits = {g: [(1 + beyond) * quantile(g, inner, lambda r: r[4][i], tail) - beyond * quantile(g, inner, lambda r: r[4][i], 0.5) if inner else math.inf for i in range(3)] for g in groups}
    return [not r[1] and within(r, reach) and all(x <= limit + 1e-12 for x, limit in zip(r[4], limits[r[0]])) for r in rated]


def op6(docs, k=20):
    first, words = {}, [SPACED.findall(t or "") for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    out = {}
    for i in order:
        gone = set()
        for s in range(len(words[i]) - k + 1):
            if first.setdefault(tuple(words[i][s : s + k]), (i, s)) != (i, s):
                gone.update(range(s, s + k))
        kept = " ".join(w for j, w in enumerate(words[i]) if j not in gone)
        out[i] = (docs[i][0], len(words[i]), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return [out[i] for i in range(len(docs))]


def op8(docs, k=2, percent=80):
    sets = []
    for _, t in docs:
        w = SPACED.findall(lower(t))
        sets.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in held[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            held[x].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [(d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def op9(docs, k=200, keep_first=False):
    raw = [(t or "").encode() for _, t in docs]
    count = Counter(r[i : i + k] for r in raw for i in range(len(r) - k + 1))
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    out, seen = {}, set()
    for i in order:
        r, gone = raw[i], bytearray(len(raw[i]))
        for s in range(len(r) - k + 1):
            x = r[s : s + k]
            if x in seen if keep_first else count[x] > 1:
                gone[s : s + k] = b"\1" * k
            seen.add(x)
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(1 for j in range(len(r)) if gone[j] and (not j or not gone[j - 1]))
        out[i] = (docs[i][0], len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [out[i] for i in range(len(docs))]


def op10(docs, items, k=10):
    held = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for i in range(max(len(w) - k + 1, 1) if w else 0):
            held[tuple(w[i : i + k])].add(item)
    sizes = {len(x) for x in held}
    out = []
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in held:
                    hit.update(range(i, i + n))
                    found |= held[x]
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def path_ratios(blocks):
    """Tag-path ratios of (path, text, characters in links) by their definition."""
    paths = list(dict.fromkeys(p for p, _, _ in blocks))
    own = {p: [b for b in blocks if b[0] == p] for p in paths}
    length = [sum(len(t) for _, t, _ in own[p]) for p in paths]
    links = [sum(n for _, _, n in own[p]) for p in paths]
    rate = [max(a - b, 0) / len(own[p]) for a, b, p in zip(length, links, paths)]
    marks = [sum(len(re.findall("[.,;:!?…。，！？]", t)) for _, t, _ in own[p]) / len(own[p]) for p in paths]
    at = lambda x, i: math.log1p(x[i]) if 0 <= i < len(x) else 0.0
    near = lambda x, i: math.exp((at(x, i - 1) + 4 * at(x, i) + at(x, i + 1)) / 6) - 1
    return {p: math.sqrt(near(rate, i) * (near(marks, i) + 1)) for i, p in enumerate(paths)}


class Blocks(HTMLParser):
    """(path, text, characters in links) of the blocks of a well-formed page; names of marked elements end with !."""

    RAW, MARKED = {"head", "script", "style", "title"}, {"nav", "footer", "aside", "form"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.links, self.found, self.articles = [], [], 0, [], 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((tuple(n for n in self.stack if n not in ("a", "b", "i", "em", "strong", "span", "code")), text, self.links))
        self.parts, self.links = [], 0

    def handle_starttag(self, name, attributes):
        if name == "br":
            self.parts.append(" ")
        if name in ("br", "meta", "img", "link", "hr", "input"):
            return
        if name not in ("a", "b", "i", "em", "strong", "span", "code"):
            self.flush()
            if "p" in self.stack and name in ("p", "div", "ul", "h2"):
                while self.stack.pop() != "p":
                    pass
        self.articles += name == "article"
        marked = name in self.MARKED or any(k == "class" and "ad" in (v or "").split("-") for k, v in attributes)
        self.stack.append(f"article{self.articles}" if name == "article" else name + "!" * marked)

    def handle_endtag(self, name):
        plain = [re.sub(r"[0-9!]+$", "", n) if not re.fullmatch("h[1-6]", n) else n for n in self.stack]
        if name in plain:
            if name not in ("a", "b", "i", "em", "strong", "span", "code"):
                self.flush()
            elif any(n not in ("a", "b", "i", "em", "strong", "span", "code") for n in plain[len(plain) - plain[::-1].index(name) :]):
                return
            del self.stack[len(plain) - 1 - plain[::-1].index(name) :]

    def handle_data(self, text):
        if not self.RAW & set(self.stack):
            self.parts.append(text)
            self.links += len(text) * ("a" in self.stack)


def op2(page):
    """The texts of the paths whose weighted ratio is large enough."""
    found = Blocks(page or "").found
    if not found:
        return ""
    rated = path_ratios(found)
    paths = list(rated)
    marked = {p: any(n.endswith("!") for n in p) for p in paths}
    size = {p: sum(len(t) for q, t, _ in found if q == p) for p in paths}
    links = {p: sum(n for q, _, n in found if q == p) for p in paths}
    held = {p: 0 if marked[p] else max(size[p] - links[p], 0) for p in paths}
    for p in paths:
        for i in range(len(p) - 1, -1, -1):
            if p[i] == "div":
                break
            if p[i].startswith("article"):
                rated[p] *= 1 + sum(n for q, n in held.items() if q[: i + 1] == p[: i + 1]) / max(sum(held.values()), 1)
                break
        rated[p] *= 0.1 if marked[p] else 1
    for p, after in list(zip(paths, paths[1:]))[::-1]:
        if re.fullmatch("h[1-6]", p[-1]) and not marked[p] and not marked[after]:
            rated[p] = max(rated[p], rated[after])
    text = sum(size[p] for p in paths if not marked[p])
    if not text:
        return ""
    least = 0.35 * sum(rated[p] * size[p] for p in paths if not marked[p]) / text
    return "\n\n".join(t for p, t, _ in found if rated[p] >= least and 2 * links[p] < size[p])


def raked(rows, targets, rounds=300):
    """Probability of each (source, lang, topic, tokens)."""
    cells = Counter()
    for *cell, n in rows:
        cells[tuple(cell)] += n
    weight = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(rounds):
        for i, m in enumerate(("source", "lang", "topic")):
            own = Counter()
            for c, w in weight.items():
                own[c[i]] += w
            whole = sum(targets[m].values())
            weight = {c: w * targets[m].get(c[i], 0) / whole / own[c[i]] if own[c[i]] else 0 for c, w in weight.items()}
    most = max(weight[c] / n for c, n in cells.items())
    return [weight[tuple(c)] / cells[tuple(c)] / most if n else 0 for *c, n in rows]


def op1_score(docs, depth):
    """log10 probability of each text by context-tree weighting, node by node."""
    stream = lambda t: bytes(depth) + lower(t).encode() + b"\0"
    seen = defaultdict(lambda: [0, 0])

    def decisions(raw, i):
        node = 1
        for k in range(7, -1, -1):
            bit = raw[i] >> k & 1
            yield node, bit
            node = node << 1 | bit

    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            raw = stream(t)
            for i in range(depth, len(raw)):
                for node, bit in decisions(raw, i):
                    for n in range(depth + 1):
                        seen[raw[i - n : i], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = defaultdict(list)
    for context, node in list(seen):
        if context:
            children[context[1:], node].append((context, node))
    weighted, own = {}, {}
    for key in sorted(seen, key=lambda k: -len(k[0])):
        a = kt(*seen[key])
        if len(key[0]) == depth:
            weighted[key], own[key] = a, 1.0
        else:
            b = sum(weighted[c] for c in children[key])
            most = max(a, b)
            weighted[key] = most + math.log(math.exp(a - most) + math.exp(b - most)) - math.log(2)
            own[key] = math.exp(a - math.log(2) - weighted[key])
    out = []
    for _, t in docs:
        raw, total = stream(t), 0.0
        for i in range(depth, len(raw)):
            for node, bit in decisions(raw, i):
                path = []
                for n in range(depth + 1):
                    if (raw[i - n : i], node) not in seen:
                        break
                    path.append((raw[i - n : i], node))
                p, left = (0.0, 1.0) if path else (0.5, 0.0)
                for j, key in enumerate(path):
                    share = 1.0 if j == len(path) - 1 else own[key]
                    zeros, ones = seen[key]
                    p += left * share * (ones + 0.5) / (zeros + ones + 1)
                    left *= 1 - share
                total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def op13(rows, ids=()):
    """Reports of conversations: every cheapest sequence of edits is kept, and the least taken at the end."""
    convs = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]
        after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

        def inserted(at):
            for _ in range(3):
                for state, (cost, ways) in list(at.items()):
                    for arcs in (after["u"], after["a"]):
                        if state in arcs:
                            add(at, arcs[state], cost + 2, {w + "I" for w in ways})
            return at

        def add(at, state, cost, ways):
            if state not in at or cost < at[state][0]:
                at[state] = (cost, set(ways))
            elif cost == at[state][0]:
                at[state][1].update(ways)

        at = inserted({0: (0, {""})})
        for initial, fault in zip(initials, faults):
            now = {}
            for state, (cost, ways) in at.items():
                add(now, state, cost + 3, {w + "D" for w in ways})
                if fault not in ("b", "d"):
                    more = cost + (fault == "t")
                    if state in after.get(initial, {}):
                        add(now, after[initial][state], more, {w + "K" for w in ways})
                    for arcs in (after["u"], after["a"]):
                        if state in arcs:
                            add(now, arcs[state], more + 2, {w + "R" for w in ways})
            at = inserted(now)
        cost = min(at[s][0] for s in (0, 3) if s in at)
        audit = min(w for s in (0, 3) if s in at and at[s][0] == cost for w in at[s][1])
        lines, left, n = [], iter(own), 0
        first_system = (len(audit) - audit.count("D")) % 2
        for edit in audit:
            role, text = next(left)[1:] if edit != "I" else ("", "")
            if edit == "D":
                continue
            if edit != "K":
                role = ("user", "assistant")[(n - first_system) % 2]
            lines.append(f"{role}:{text}")
            n += 1
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def op13_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def op12(docs, items, k=10):
    held = [(d, Counter(TERMS.findall(lower(t)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 25 + 75 * c.total() * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in TERMS.findall(lower(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return out
