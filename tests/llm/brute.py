"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

BLANKS = " \t\n\x0b\x0c\r"


# ---- personal data ----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            value = m.group()
            digits = re.sub("[^0-9]", "", value)
            if kind == "ip" and any(int(p) > 255 for p in value.split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end(), value))
    return out


TERM = regex.compile(r"(?<=\s)\p{L}[\p{L}\p{M}'’-]*+(?=[\s.,;:!?)])")


def _context_terms(text, start, stop, width):
    padded = f" {text} "
    for at in (max(start + 1 - width, 0),):
        for m in TERM.finditer(padded[at:start + 1]):
            yield m.group().lower(), at - 1 + m.start(), at - 1 + m.end()
    for m in TERM.finditer(padded[stop + 1:stop + 1 + width]):
        yield m.group().lower(), stop + m.start(), stop + m.end()


def private(docs, limits):
    """docs: list of (doc_id, text); per row the base spans and {(start, stop): action}."""
    rows, joint, entities, terms = [], Counter(), Counter(), Counter()
    for _, text in docs:
        text = text or ""
        spans, found = base_spans(text), []
        for kind, a, b, value in spans:
            name = kind + ":" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
            found += [(name, *t) for t in _context_terms(text, a, b, limits.context)]
        for pair in {(e, t) for e, t, _, _ in found}:
            joint[pair] += 1
        for e in {e for e, *_ in found}:
            entities[e] += 1
        for t in {m.group() for m in TERM.finditer(f" {text.lower()} ")}:
            terms[t] += 1
        rows.append((spans, found))
    n, out = len(docs), []
    for spans, found in rows:
        marks = {}
        for e, t, a, b in found:
            if joint[e, t] < limits.min_documents or terms[t] < limits.min_documents or entities[e] >= n:
                continue
            share = math.log(joint[e, t] * n / (entities[e] * terms[t])) / math.log(n / entities[e])
            if share >= limits.generalise_at:
                marks[a, b] = max(marks.get((a, b), ""), "remove" if share >= limits.remove_at else "generalise")
        out.append((spans, marks))
    return out


def sanitised(text, spans, marks):
    put = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    rows = sorted([(a, b, put[k]) for k, a, b, _ in spans] + [(a, b, "" if m == "remove" else "[TERM]") for (a, b), m in marks.items()])
    at, out = 0, ""
    for a, b, word in rows:
        if a >= at:
            out += text[at:a] + word
        at = max(at, b)
    return out + text[at:]


# ---- near duplicates --------------------------------------------------------------------------------------------------

def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_classes(docs, threshold=0.8, common=0.1):
    """Class id per row of (doc_id, text), by the exact similarity of every pair of distinct texts."""
    sets, tokens = {}, {t: regex.findall(r"\w+", (t or "").lower()) for _, t in docs}
    for text, words in tokens.items():
        if words:
            n = min(5, len(words))
            sets[text] = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    seen = Counter(s for found in sets.values() for s in found)
    idf = lambda s: -math.log(min(max(seen[s] / len(sets), common), 0.5))
    weights = {t: {s: (1 + math.log(c)) * idf(s) for s, c in found.items()} for t, found in sets.items()}
    holders = defaultdict(list)
    for t, found in weights.items():
        for s in found:
            holders[s].append(t)
    parent = {t: t for t in sets}
    pairs = {(a, b) for ts in holders.values() for a in ts for b in ts if a < b}
    for a, b in pairs:
        both = sum(min(w, weights[b][s]) for s, w in weights[a].items() if s in weights[b])
        if both >= threshold * (sum(weights[a].values()) + sum(weights[b].values()) - both):
            parent[find(parent, a)] = find(parent, b)
    first = {}
    for i, t in docs:
        if t in parent:
            root = find(parent, t)
            if i is not None and (first.get(root) is None or i < first[root]):
                first[root] = i
            first.setdefault(root, None)
    return [first[find(parent, t)] if t in parent else i for i, t in docs]


# ---- repeated passages ------------------------------------------------------------------------------------------------

def shared_runs(docs, size=50):
    """For each document the code point spans of all runs of `size` words that another document has too."""
    holders, runs = defaultdict(set), {}
    for i, text in docs:
        spans = [(m.start(), m.end(), m.group().lower()) for m in regex.finditer(r"\w+", text or "")]
        runs[i] = [(tuple(w for *_, w in spans[k:k + size]), spans[k][0], spans[k + size - 1][1]) for k in range(len(spans) - size + 1)]
        for run, *_ in runs[i]:
            holders[hash(run)].add(i)
    return {i: [(a, b) for run, a, b in found if len(holders[hash(run)]) > 1] for i, found in runs.items()}


# ---- quality ----------------------------------------------------------------------------------------------------------

def quality(docs, limits):
    """docs: (doc_id, text, host); per row whether it is kept and its text without frequent lines."""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    norm = lambda line: " ".join(split(line.lower()))
    hosts, lines = defaultdict(set), defaultdict(set)
    for _, text, host in docs:
        text = text or ""
        hosts[host].add(text)
        for line in text.split("\n"):
            lines[host, norm(line)].add(text)
    bad = {k for k, v in lines.items() if k[1] and len(v) > limits.line_documents and len(v) * 100 > len(hosts[k[0]]) * limits.line_percent}
    out = []
    for _, text, host in docs:
        words = split(text or "")
        tri = Counter(zip(words, words[1:], words[2:]))
        hit = {k + o for k in range(len(words) - 2) if tri[tuple(words[k:k + 3])] > 1 for o in range(3)}
        failed = len(words) < limits.min_words or 100 * len(hit) > limits.max_repeat_percent * len(words)
        gone = sum(len(split(line)) for line in (text or "").split("\n") if (host, norm(line)) in bad)
        kept = not failed and len(words) - gone >= len(words) * limits.min_kept_share
        out.append((kept, "\n".join(line for line in (text or "").split("\n") if (host, norm(line)) not in bad)))
    return out


# ---- decontamination --------------------------------------------------------------------------------------------------

def item_words(text):
    text = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]


def contaminated(texts, items, size=10):
    windows = set()
    for item in items:
        w = item_words(item)
        windows |= {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    out = []
    for text in texts:
        w = item_words(text)
        out.append(any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1)))
    return out


# ---- mixture ----------------------------------------------------------------------------------------------------------

def mixture(docs, plan, domain_of):
    """docs: (doc_id, text, lang, source); copies per row, by filling a tree and walking each leaf's order."""
    tokens = [len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for _, t, *_ in docs]
    paths = [(domain_of(s), lang or "", s or "") for _, _, lang, s in docs]
    leaves = Counter()
    for p, n in zip(paths, tokens):
        leaves[p] += n

    def fill(prefix, budget, out):
        depth = len(prefix)
        if depth == 3:
            out[prefix] = budget
            return
        level = ("domain", "lang", "source")[depth]
        kids = sorted({p[:depth + 1] for p in leaves if p[:depth] == prefix})
        supply = {k: sum(n for p, n in leaves.items() if p[:depth + 1] == k) * plan.epochs for k in kids}
        weight = {k: plan.weights.get(level, {}).get(k[-1], 1) for k in kids}
        rest, open_kids = budget, [k for k in kids if weight[k]]
        got = dict.fromkeys(kids, 0)
        while open_kids:
            total = sum(weight[k] for k in open_kids)
            full = [k for k in open_kids if supply[k] * total <= weight[k] * rest]
            if not full:
                got.update({k: rest * weight[k] // total for k in open_kids})
                break
            k = min(full, key=lambda x: (supply[x] / weight[x], x))
            got[k], rest = supply[k], rest - supply[k]
            open_kids.remove(k)
        for k in kids:
            fill(k, got[k], out)

    budgets = {}
    fill((), sum(leaves.values()) * plan.budget_percent // 100, budgets)
    out, used = [0] * len(docs), Counter()
    order = sorted(range(len(docs)), key=lambda r: hashlib.md5(f"{plan.seed}:{'null' if docs[r][0] is None else docs[r][0]}".encode()).hexdigest())
    for r in order:
        p = paths[r]
        if leaves[p] and tokens[r]:
            used[p] += tokens[r]
            full, rest = divmod(budgets[p], leaves[p])
            out[r] = full + (1 if rest and used[p] <= rest else 0)
    return out


def content(found, names, threshold=0.15):
    """Blocks (path, role, text, link length) that are content, straight from the definition; names: the elements of each path."""
    import math

    marks = ".,;:!?…。，；：！？、"
    kernel = [math.exp(-0.5 * d * d) for d in (-2, -1, 0, 1, 2)]
    groups = {}
    for path, kind, text, links in found:
        groups.setdefault((path, kind), []).append((text, links))

    def ratio(key, f):
        return sum(f(t, n) for t, n in groups[key]) / len(groups[key]) if key[1] != -1 else 0.0

    def is_menu(key):
        linked = sum(n / max(1, len(t)) for t, n in groups[key]) / len(groups[key])
        return linked > 0.6 and (key[1] != 1 or len(names[key[0]]) > 1 and names[key[0]][-1] == "li")

    length, punctuation = (lambda t, n: max(0, len(t) - n)), (lambda t, n: sum(t.count(c) for c in marks))
    total = {kind: sum(length(t, n) for key, v in groups.items() if key[1] == kind and (kind == 1 or not is_menu(key)) for t, n in v) for kind in (0, 1)}
    outside = (total[0] / (total[0] + total[1])) ** 2 if total[1] else 1.0
    weights, fused = [], []
    for i, (path, kind, _, _) in enumerate(found):
        w = 0.0 if is_menu((path, kind)) else {1: 1.0, 0: outside, -1: 0.0, -2: 0.05 * (1.0 if total[1] else outside)}[kind]
        smooth = [sum(kernel[d + 2] * ratio(found[i + d][:2], f) for d in range(-2, 3) if 0 <= i + d < len(found)) / sum(kernel) for f in (length, punctuation)]
        weights.append(w)
        fused.append(w * smooth[0] * (1 + smooth[1]))
    limit = threshold * sum(w * s for w, s in zip(weights, fused)) / (sum(weights) or 1.0)
    score = {key: [s for b, s in zip(found, fused) if b[:2] == key] for key in groups}
    keep = [sum(score[b[:2]]) / len(score[b[:2]]) > limit for b in found]
    head = [b[1] == 1 and bool(names[b[0]]) and names[b[0]][-1] in ("h1", "h2", "h3", "h4", "h5", "h6") for b in found]
    others = any(k for k, h, b in zip(keep, head, found) if b[1] == 1 and not h)
    rest = any(b[1] == 1 and not h for h, b in zip(head, found))
    return [others if h and rest else k for k, h in zip(keep, head)]
