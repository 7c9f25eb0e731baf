"""What the operators must return, in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def fold(text: str) -> str:
    return text.translate(FOLD)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, k: int) -> frozenset:
    w = words(fold(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def components(rows: list[tuple[int | None, str | None]], k: int) -> list[tuple[int, int | None, bool]]:
    """(n_shingles, component_id, kept) of each row (id, text)."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and (i, j) not in seen:
                seen.add((i, j))
                up[top(j)] = top(i)
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        t = top(i)
        least[t] = d if least.get(t) is None else least[t] if d is None else min(least[t], d)
    return [(len(sets[i]), least[top(i)], rows[i][0] == least[top(i)]) for i in range(len(rows))]


def repeated(texts: list[str | None], width: int) -> list[list[bool]]:
    """Which words of each text a repeated window covers."""
    lists = [words(t) for t in texts]
    count: Counter = Counter()
    for w in lists:
        count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        drop = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                drop[i : i + width] = [True] * width
        out.append(drop)
    return out


def substring_rows(rows: list[tuple], width: int) -> list[tuple]:
    out = []
    for (d, t), drop in zip(rows, repeated([t for _, t in rows], width), strict=True):
        w = words(t)
        kept = " ".join(x for x, gone in zip(w, drop, strict=True) if not gone)
        out.append((d, len(w), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def without_repeats(text: str | None, drop: list[bool]) -> str | None:
    """A text without its dropped words, each with the white space after it."""
    if text is None:
        return None
    found = list(WORD.finditer(text))
    out, at = [], 0
    for i, m in enumerate(found):
        if drop[i]:
            out.append(text[at : m.start()])
            at = found[i + 1].start() if i + 1 < len(found) else len(text)
    return "".join(out) + text[at:]


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    seen: set = set()
    dup = 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered: set[int] = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def license_base(text: str | None) -> tuple:
    """n_words, n_base, first, last, labels."""
    w = ALNUM.findall(fold(text or ""))
    found, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        found += at
        if at:
            labels.add(label)
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def license_scan(texts: list[str | None], templates, phrases: dict, entered: int, least: float) -> list[tuple[str, float]]:
    """labels and score of each text: every template at every offset, word by word."""
    split = lambda t: ALNUM.findall(fold(t or ""))
    files = [split(t) for t in texts]
    known = {w for _, a, b in templates for w in split(a) + split(b)} | {w for p in phrases for w in split(p)}
    df = Counter(w for f in files for w in set(f) & known)
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1e-6 for w in known}
    has = lambda f, p: any(f[i : i + len(p)] == p for i in range(len(f) - len(p) + 1))
    out = []
    for f in files:
        labels, score = set(), 0.0
        for phrase, label in phrases.items():
            if has(f, split(phrase)):
                labels.add(label)
                score = max(score, 0.5)
        for label, text, key in templates:
            t = split(text)
            rare = sorted(set(t), key=lambda w: (-idf[w], w))[:entered]
            entries = [p for p, w in enumerate(t) if w in rare]
            at = lambda o, ps: [p for p in ps if 0 <= o + p < len(f) and f[o + p] == t[p]]  # noqa: B023, E731
            offsets = [o for o in range(-len(t), len(f)) if 2 * len(at(o, entries)) >= len(entries) and at(o, entries)]
            if not offsets or not has(f, split(key)):
                continue
            share = max(sum(idf[t[p]] for p in at(o, range(len(t)))) for o in offsets) / sum(idf[w] for w in t)
            if share >= least:
                labels.add(label)
                score = max(score, min(1.0, share))
        out.append((",".join(sorted(labels)), score))
    return out


def crc(text: str | None) -> int | None:
    return None if text is None else zlib.crc32(text.encode())


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def swap_distance(a: str, b: str) -> int:
    """Edits between two words, where two neighbours that change places are one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            best = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[i - 2][j - 2] + 1)
            rows[i].append(best)
    return rows[-1][-1]


def toxic_score(text: str | None, lexicon, fuzzy: tuple[int, int], window: int, quotes: str) -> float:
    """The score of one text: its words one by one against all entries, its lines one by one for quotations."""
    logit = lambda p: math.log(p / (1 - p))
    base, best = logit(lexicon.without), {}
    stems = [t for t, stem in lexicon.entries if stem]
    for line in (text or "").lower().split("\n"):
        found, marks = [], []  # words with the marks before them, marks with the words before them
        for word, mark in re.findall(rf"([^\W_]+)|([{quotes}])", line):
            if mark:
                marks.append(len(found))
            else:
                found.append((word, len(marks)))
        for i, (w, before) in enumerate(found):
            hit = None
            exact = [e for e, (t, _) in enumerate(lexicon.entries) if t == w]
            held = [e for e, (t, stem) in enumerate(lexicon.entries) if stem and w.startswith(t)]
            if exact or held:
                hit = (exact or held)[0], 0
            else:
                near = []
                for e, (t, stem) in enumerate(lexicon.entries):
                    allowed = 0 if stem or len(t) < fuzzy[0] else 1 if len(t) < fuzzy[1] else 2
                    if allowed and t[0] == w[0] and (n := swap_distance(w, t)) <= allowed:
                        near.append((n, e))
                if near:
                    hit = min(near)[1], 1
            if hit is None:
                continue
            quoted = before % 2 == 1 and before < len(marks) and i - marks[before - 1] <= window and marks[before] - i <= window
            e, miss = hit
            t = lexicon.entries[e][0]
            p = min(lexicon.exact[e], lexicon.misspelt[len(t)]) if miss else lexicon.exact[e]
            worth = max(0.0, logit(min(p, lexicon.context[True] if quoted else 1.0, 0.995)) - base)
            family = next((x for x in stems if t.startswith(x)), t)
            best[family] = max(best.get(family, 0.0), worth)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, base + sum(best.values())))))


def line_dedup(rows: list[tuple], ratio: float, least: int) -> list[str | None]:
    """Texts of rows (host, text) without boilerplate lines."""
    pages: Counter = Counter()
    count: Counter = Counter()
    for host, text in rows:
        if host is not None and text is not None:
            pages[host] += 1
            count.update({(host, x.strip(" ")) for x in text.split("\n") if x.strip(" ")})
    out = []
    for host, text in rows:
        if text is None:
            out.append(None)
            continue
        gone = lambda x: host is not None and x.strip(" ") and count[host, x.strip(" ")] >= least and count[host, x.strip(" ")] > ratio * pages[host]  # noqa: B023, E731
        out.append("\n".join(x for x in text.split("\n") if not gone(x)))
    return out
