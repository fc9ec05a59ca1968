"""Personal data: base rules, and spans added by a character-level BiLSTM-CRF.

The model is trained on a bounded sample of labelled windows of the documents (``SAMPLE``, the windows of least hash; the base
rules label them). In half of those that it sees, a number or address of another format is written into the text (``VARIANTS``), labelled
as a span, or as none for dates, prices, versions and the like (``PLAIN``). So it learns what the patterns cannot say: phones without a plus,
cards in dotted groups, addresses with letters outside ASCII. It is sent to the tasks, and its size does not depend on the input.

Every text is read whole, as windows that overlap by ``OVERLAP``; each character takes its tag from the window in which it lies farther from
an edge, and spans are read from the tags of the whole text, so a span may cross any number of windows. An added span
needs a chance of ``MIN_CHANCE`` at each character and touches no base span. So the model only adds, and base spans stay as they are.

Offsets are code points, ends exclusive. A NULL text is empty and has no spans. Rows are independent: repeated
rows, NULL ids and other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm import words as W
from opinion_spark.llm.span_model import KINDS, SpanModel, classes_of, tags_of
from opinion_spark.llm.store import landed

WINDOW, OVERLAP = 512, 64
#: Characters of a window to learn from.
LEARNT = 64
#: Windows to learn from: with a span, and without.
SAMPLE = (1500, 1500)
#: Least chance of every character's tag in an added span.
MIN_CHANCE = 0.9
DECODED_TOGETHER = 1024

Span = tuple[str, int, int]

# Fixed patterns of the base kinds. Each is anchored so that it never starts twice within one run of characters.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Formats of personal data beyond the patterns: 0 stands for a digit, w for a word, u for one with a letter outside ASCII.
VARIANTS = (
    ("phone", "(000) 000-0000"), ("phone", "000-000-0000"), ("phone", "000.000.0000"), ("phone", "0000/0000000"), ("phone", "0000 0000000"),
    ("phone", "00 00 00 00 00"), ("phone", "(0000) 000000"), ("phone", "000/000-0000"), ("phone", "00000 000000"), ("phone", "0-000-000-0000"),
    ("card", "0000.0000.0000.0000"), ("card", "0000/0000/0000/0000"), ("card", "0000_0000_0000_0000"), ("card", "0000 - 0000 - 0000 - 0000"),
    ("card", "0000.000000.00000"), ("email", "w.w@u.w"), ("email", "u@w.w"), ("email", "w00@u.w.w"), ("email", "u.u@u.w"), ("email", "w@w-u.w"),
)
#: Formats that look alike and are no personal data.
PLAIN = (
    "0000-00-00", "00/00/0000", "00.00.0000", "00:00", "00:00:00", "0,000.00", "0.0.0", "0.00", "0000-0000", "00%", "0000", "00,000,000", "#00000", "$000.00",
    "0.0", "000", "0", "00", "w_00", "w0", "@w", "@w00", "w @ w", "000x000", "00-00", "0000/00", "00000", "000000", "w-0.0.0", "0000-00-00 00:00:00", "w 000, 0000",
)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
            at = text.find("@", free)
        else:
            free = at + 1  # no address holds two at signs
            at = text.find("@", at + 1)


def judged_regions(text: str) -> list[tuple[Span, bool]]:
    """Every match of a base pattern, and whether its check passes."""
    out: list[tuple[Span, bool]] = [(("email", a, b), True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        out.append((("ip", *m.span()), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        out.append((("card", *m.span()), 13 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        out.append((("phone", *m.span()), 9 <= sum(c.isdigit() for c in m[0]) <= 15))
    return out


def base_spans(text: str) -> list[Span]:
    return [span for span, passed in judged_regions(text) if passed]


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in in_order(spans))


def window_starts(length: int) -> range:
    """Starts of the windows of a text."""
    return range(0, max(length - OVERLAP, 1), WINDOW - OVERLAP)


def _padded(windows: list[np.ndarray], width: int = LEARNT) -> np.ndarray:
    out = np.zeros((len(windows), width), np.int64)
    for row, window in zip(out, windows, strict=True):
        row[: len(window)] = window
    return out


class _Tagged(NamedTuple):
    """Characters with a tag, in order: which text, where, which tag, how sure."""

    text: np.ndarray
    at: np.ndarray
    tag: np.ndarray
    chance: np.ndarray


def _tagged(coded: list[np.ndarray], model: SpanModel) -> _Tagged:
    places = [(i, start) for i, codes in enumerate(coded) for start in window_starts(len(codes))]
    places.sort(key=lambda p: len(coded[p[0]]) - p[1], reverse=True)  # windows of like lengths together
    parts = []
    for k in range(0, len(places), DECODED_TOGETHER):
        some = places[k : k + DECODED_TOGETHER]
        windows = [coded[i][s : s + WINDOW] for i, s in some]
        x = _padded(windows, max(map(len, windows)))
        column = np.arange(x.shape[1])
        tags, chance = model.decode(x)
        text, start = np.array(some).T
        last = start + WINDOW - OVERLAP >= np.array([max(len(coded[i]) - OVERLAP, 1) for i, _ in some])
        own = (column >= np.where(start > 0, OVERLAP // 2, 0)[:, None]) & (column < np.where(last, WINDOW, WINDOW - OVERLAP // 2)[:, None])
        row, col = np.nonzero(tags)
        kept = own[row, col] & (x[row, col] > 0)
        row, col = row[kept], col[kept]
        parts.append((text[row], start[row] + col, tags[row, col], chance[row, col]))
    if not parts:
        return _Tagged(*(np.zeros(0, np.int64) for _ in range(4)))
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return _Tagged(*(c[order] for c in columns))


def added_spans(texts: list[str], bases: list[list[Span]], model: SpanModel) -> list[list[Span]]:
    """For each text the model's spans that touch none of its base spans."""
    out: list[list[Span]] = [[] for _ in texts]
    some = _tagged([classes_of(t) for t in texts], model)
    if not len(some.at):
        return out
    kind = (some.tag - 1) // 2
    goes_on = (some.text[1:] == some.text[:-1]) & (some.at[1:] == some.at[:-1] + 1) & (kind[1:] == kind[:-1]) & (some.tag[1:] % 2 == 0)
    first = np.flatnonzero(np.r_[True, ~goes_on])
    least = np.minimum.reduceat(some.chance, first)
    ends = some.at[np.r_[first[1:], len(some.at)] - 1] + 1
    for i, k, a, b in zip(*(v[least >= MIN_CHANCE].tolist() for v in (some.text[first], kind[first], some.at[first], ends)), strict=True):
        if all(b <= x or y <= a for _, x, y in bases[i]):
            out[i].append((KINDS[k], a, b))
    return out


def training_windows(docs: DataFrame, text: str = "text", sample: tuple[int, int] = SAMPLE) -> list[tuple[str, list[int]]]:
    """At most ``sum(sample)`` windows of all documents with the tags of the base spans: those of least hash with a span, and
    those without. A task reports no more of each than are wanted in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: tuple[dict, dict] = ({}, {})
        most = [1 << 63, 1 << 63]  # windows of a greater hash are not wanted any more
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if not value:
                    continue
                spans = base_spans(value)
                marked = {p for _, a, b in spans for p in range(a // LEARNT, (b - 1) // LEARNT + 1)}
                for k in range(-(-len(value) // LEARNT)):
                    window = value[k * LEARNT : (k + 1) * LEARNT]
                    order, has = xxhash.xxh3_64_intdigest(window.encode("utf-8", "surrogatepass")) >> 1, k in marked
                    if order > most[has]:
                        continue
                    kept = least[has]
                    kept[order] = (window, k * LEARNT, spans if has else [])
                    if len(kept) > 4 * sample[not has] + 1000:
                        orders = sorted(kept)
                        most[has] = orders[sample[not has]]
                        for order in orders[sample[not has] :]:
                            del kept[order]
        for has, kept in enumerate(least):
            orders = sorted(kept)[: sample[not has]]
            if orders:
                tags = [tags_of(len(w), [(k, a - s, b - s) for k, a, b in spans if a < s + LEARNT and b > s]).tolist() for w, s, spans in map(kept.get, orders)]
                columns = [pa.array(orders, pa.int64()), pa.array([bool(has)] * len(orders)), pa.array([kept[o][0] for o in orders]), pa.array(tags, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["order", "has", "window", "tags"])

    rows = landed(docs.select(F.col(text).cast("string")).mapInArrow(run, "order long, has boolean, window string, tags array<long>"))
    picked = [rows.where(F.col("has") == has).dropDuplicates(["order"]).orderBy("order").limit(n) for has, n in zip((True, False), sample, strict=True)]
    return [(r["window"], r["tags"]) for r in picked[0].unionByName(picked[1]).orderBy("order").collect()]


def _filled(form: str, rng: np.random.Generator) -> str:
    """A format with random digits and words in it."""
    letters, wide = "abcdefghijklmnopqrstuvwxyz", "äöüéèñçøåßжия中"
    word = lambda: "".join(letters[i] for i in rng.integers(0, 26, rng.integers(2, 9)))
    fill = {"0": lambda: str(rng.integers(0, 10)), "w": word, "u": lambda: word() + wide[rng.integers(0, len(wide))] + word()}
    return "".join(fill[c]() if c in fill else c for c in form)


def with_variants(windows: list[tuple[str, list[int]]], seed: int = 5) -> list[tuple[str, list[int]]]:
    """The windows, and again with a number or address of another format written over a part that holds no span."""
    rng = np.random.default_rng(seed)
    out = list(windows)
    for text, tags in windows * 2:
        kind, form = VARIANTS[rng.integers(0, len(VARIANTS))] if rng.random() < 0.6 else (None, PLAIN[rng.integers(0, len(PLAIN))])
        item = _filled(form, rng)
        gaps = [k for k, c in enumerate(text) if c == " " and not any(tags[k : k + len(item) + 2])]
        if not gaps or len(item) + 2 > LEARNT:
            continue
        at = gaps[rng.integers(0, len(gaps))] + 1
        rest = at + len(item)
        tail = ("", ".", ",")[rng.integers(0, 3)] if rng.random() < 0.4 else ""
        # The rest of the text begins at a blank, so that no word is cut in two by the item.
        blank = text.find(" ", rest)
        after, after_tags = (text[blank:], tags[blank:]) if blank >= 0 else ("", [])
        line = text[:at] + item + tail + after
        marks = list(tags[:at]) + tags_of(len(item), [(kind, 0, len(item))] if kind else []).tolist() + [0] * len(tail) + list(after_tags)
        if base_spans(item) and kind is None:
            continue
        out.append((line[:LEARNT], marks[:LEARNT]))
    return out


def trained(windows: list[tuple[str, list[int]]], steps: int = 600) -> SpanModel:
    """A model of labelled windows (text, tags) and their variants."""
    windows = with_variants(windows)
    x = _padded([classes_of(text) for text, _ in windows])
    y = _padded([np.array(tags, np.int64) for _, tags in windows])
    return SpanModel().fit(x, y, steps)


def found(docs: DataFrame, model: SpanModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, base counts per kind, ``base_sha256``, ``spans`` (base and added), ``n_added``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, 1):
                n = part.num_rows
                counts = {kind: np.zeros(n, np.int64) for kind in KINDS}
                digest, spans, n_added = [empty] * n, [""] * n, np.zeros(n, np.int64)
                texts = [t or "" for t in part.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                for row, (base, added) in enumerate(zip(bases, added_spans(texts, bases, shared.value), strict=True)):
                    for kind, _, _ in base:
                        counts[kind][row] += 1
                    digest[row] = hashlib.sha256(written(base).encode()).hexdigest()
                    spans[row], n_added[row] = written(base + added), len(added)
                columns = [part.column(0), *(pa.array(counts[k]) for k in KINDS), pa.array(digest), pa.array(spans), pa.array(n_added)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = [c.lower() for c in docs.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, place):
                values = part.column(place).to_pylist()
                texts = [t or "" for t in values]
                bases = [base_spans(t) for t in texts]
                clean = [v and redact(v, base + added) for v, base, added in zip(values, bases, added_spans(texts, bases, shared.value), strict=True)]
                part = part.set_column(place, part.schema.field(place), pa.array(clean, part.column(place).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
