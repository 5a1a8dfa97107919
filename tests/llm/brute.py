"""Plain Python forms of operators, straight from their definitions."""

import heapq
import math
import re
from collections import defaultdict
from fractions import Fraction

SPACE = "\\x20\\x09-\\x0D"
WORD = re.compile(f"[^{SPACE}]+")
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ORDER = [*KINDS, "key"]


def _holds(kind, m):
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        total = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(map(int, reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    """(start, stop, kind, value) of the base spans, by start, then kind."""
    found = sorted((m.start(), ORDER.index(k), m.end(), m.group()) for k, p in KINDS.items() for m in re.finditer(p, text or "", re.ASCII) if _holds(k, m.group()))
    return [(a, b, ORDER[k], v) for a, k, b, v in found]


def spelled(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in spans)


def _letter(c):
    return c.isalpha()


def personal_data(texts, rounds=3):
    """All spans of each text, base and found by bootstrapping."""
    texts = [t or "" for t in texts]
    marks, places = [], defaultdict(set)
    for row, t in enumerate(texts):
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(t)]
        low = [w.lower() for *_, w in words]

        def around(first, last, low=low):
            place = tuple(low[first : first + 3])
            out = []
            if first >= 2:
                out.append((("L2", low[first - 2], low[first - 1]), place))
            if first == last and first >= 1 and first + 1 < len(low):
                out.append((("LR", low[first - 1], low[first + 1]), place))
            return out

        for i in range(len(low)):
            for pattern, place in around(i, i):
                places[pattern].add(place)
        touched = set()
        for a, b, kind, value in base_spans(t):
            first = sum(1 for x in words if x[1] <= a)
            last = sum(1 for x in words if x[0] < b) - 1
            touched |= set(range(first, last + 1))
            marks.append((row, a, b, kind, value, around(first, last)))
        for i, (a, _, w) in enumerate(words):
            inner = any(w[j] in "@_:=+." and _letter(w[j - 1]) and _letter(w[j + 1]) for j in range(1, len(w) - 1))
            ends = [j for j, c in enumerate(w) if _letter(c) or c in "0123456789"]
            if i in touched or not (inner or re.search("[0-9]", w)) or not ends or ends[-1] - ends[0] + 1 < 5:
                continue
            value = w[ends[0] : ends[-1] + 1]
            key = re.fullmatch("[A-Za-z0-9]{20,}", value) and len(re.findall("[0-9]", value)) >= 4 and re.search("[A-Za-z]", value)
            marks.append((row, a + ends[0], a + ends[-1] + 1, "key" if key else "other", value, around(i, i)))
    edges = {(kind, value, p, place) for *_, kind, value, ps in marks for p, place in ps}
    seeds = {e for e in edges if e[0] != "other"}
    open_ = {e[1:] for e in edges if e[0] in ("other", "key")}
    known, found = set(seeds), {}
    for _ in range(rounds):
        values, held, by_kind = defaultdict(set), defaultdict(set), defaultdict(lambda: defaultdict(set))
        for kind, value, p, place in known:
            values[p].add(value)
            held[p].add(place)
            by_kind[p][kind].add(value)
        sure = {p for p in values if len(values[p]) >= 3 and 2 * len(held[p]) >= len(places[p])}
        weight = {p: math.log2(len(values[p]) + 1) for p in sure}
        kind_of = {p: max((len(v), k) for k, v in by_kind[p].items())[1] for p in sure}
        near = defaultdict(set)
        for value, p, _ in open_:
            if p in sure:
                near[value].add(p)
        found = {v: max((weight[p], kind_of[p]) for p in ps)[1] for v, ps in near.items() if sum(weight[p] for p in ps) / len(ps) >= 2}
        if not found:
            break
        known = seeds | {(found[v], v, p, place) for v, p, place in open_ if v in found}
    out = [base_spans(t) for t in texts]
    for row, a, b, kind, value, _ in marks:
        if kind in ("other", "key") and value in found:
            out[row].append((a, b, found[value], value))
    return [sorted(spans, key=lambda s: (s[0], ORDER.index(s[2]), s[1])) for spans in out]


def redacted(text, spans):
    out, at, runs = [], 0, []
    for a, b, kind, *_ in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, kind])
    for a, b, kind in runs:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def targets(sizes, weights, most):
    """Shares of all sizes by weight, none above `most` times its source's size; sizes and result by source, in order."""
    share, open_ = {}, dict(sizes)
    left = Fraction(sum(sizes.values()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(sizes)}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * sizes[s]]
        if not full:
            share |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            share[s] = Fraction(most * sizes[s])
            left -= share[s]
            del open_[s]
    return share


def sainte_lague(weights, seats):
    """Seats of each party by the highest quotients; ties go to the earlier one."""
    won = dict.fromkeys(weights, 0)
    heap = [(-Fraction(w), i, p) for i, (p, w) in enumerate(weights.items()) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i, p = heapq.heappop(heap)
        won[p] += 1
        heapq.heappush(heap, (-Fraction(weights[p]) / (2 * won[p] + 1), i, p))
    return won
