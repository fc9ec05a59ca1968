"""Plain Python versions of the operators, and documents with awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, "alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (3, None),
    (4, ""),
    (5, " \t\r\n\x0b\x0c "),
    (6, "short text"),
    (7, "SHORT text"),
    (8, "same words " * 40),
    (8, "same words " * 40),
    (None, "row without an id but with some words of its own in it"),
    (9, "x" * 5000),
    (10, "é ß   ü   ź 😀 " * 30),
]


def frame(spark, rows=AWKWARD, extra: bool = True):
    """Documents; ``extra`` adds columns whose names operators might use themselves."""
    schema = "doc_id long, text string"
    if not extra:
        return spark.createDataFrame(rows, schema)
    more = ", key long, class long, n long, root string, kept boolean, TOKENS string, lang string, n_chars long"
    return spark.createDataFrame([(i, t, 1, 2, 3, "r", False, "t", "en", len(t or "")) for i, t in rows], schema + more)


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text) -> frozenset:
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows, percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id) per row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
        for g in s:
            holders[g].append(k)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    out = []
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids, default=None)) for k in members]
    return out


def without_repeats(rows, width: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept text) per row."""
    texts = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (key, _), w in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((key, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def base_counts(text) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def base_spans(text, luhn) -> list[tuple]:
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": kind != "card" or (13 <= len(digits) <= 19 and luhn(digits)),
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, *m.span()))
    return out
