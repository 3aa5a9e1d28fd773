"""Personal data: exact rules, and a character tagger for the forms they leave out.

Rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers with a plus sign.
A character-level bidirectional LSTM with CRF transitions, trained here from labelled spans, adds
written-out or oddly separated forms: ``name (at) host (dot) org``, phone numbers without a country
sign, card numbers and addresses split by other signs. Its labelled spans are the rules' matches in a
bounded sample of the table and generated forms set between words of that sample.

A span the tagger may add has a digit, an ``@`` or a bracketed ``at`` outside every rule's match, so
only the surroundings of such places are decoded: an ``at`` with all of the local part and host parts
that stand at it, and ``MARGIN`` characters on both sides. Surroundings are cut into windows that
overlap by half and are at least twice as wide as the longest of these forms. The windows' spans are reconciled per text: a span cut by a window's edge gives way to the
neighbouring window, and of spans that still overlap the set with the largest total margin is taken.
Added spans must hold what their kind needs (digits, parts up to 255, Luhn, a host) and never
overlap a rule's match.

Defined results: null and empty texts have no spans; repeated rows are judged each; offsets count
code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, hashed_sample, texts
from .tagger import Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
#: Rows of the table with digits or ``@`` that labelled spans are drawn from, at most.
SAMPLE = 1500
WINDOW, MARGIN, BATCH = 96, 28, 512
#: Widest window. A form of up to half of it is whole in some window; an address has at most 254 characters.
WIDEST = 1024

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"\d|@|[\[({<]\s?(?:at|AT|At)\s?[\])}>]")
_HOST_PARTS = re.compile(r"\s?[\w.-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>])\s?[\w-]+)*", re.I)
_LOCAL_SIGN = re.compile(r"[\w.%+-]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, searched from each ``@`` in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The rules' matches by start, then kind."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# --- labelled spans -------------------------------------------------------------------------------------------------

_FORBIDDEN = np.zeros((9, 9), bool)  # tags: 0 none, 1 + 2k first and 2 + 2k further character of kind k
for _k in range(4):
    _FORBIDDEN[:, 2 + 2 * _k] = True
    _FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def _with_check_digit(body: str) -> str:
    return next(body + c for c in "0123456789" if luhn(body + c))


def generated(r: np.random.Generator, words: list[str]) -> tuple[str, int | None]:
    """A form with its kind, or one that looks alike and has none."""
    pick = lambda *a: a[int(r.integers(len(a)))]
    num = lambda n: "".join(str(int(x)) for x in r.integers(0, 10, n))
    word = lambda: re.sub(r"[^A-Za-z]", "", words[int(r.integers(len(words)))]).lower() or "name"
    kind = int(r.integers(7))
    if kind == 0:
        at = pick("@", " @ ", " (at) ", " [at] ", "(at)", "[at]", " (AT) ", " {at} ")
        dot = pick(".", " . ", " (dot) ", " [dot] ", "(dot)", "[dot]", " (DOT) ", " {dot} ") if at != "@" else pick(".", " . ", "[.]", "(dot)")
        local = word() + pick("", "." + word(), num(2), "".join(pick(".", "_", "-", "+") + pick(word(), word(), num(2)) for _ in range(int(r.integers(2, 6)))))
        host = [word() + pick("", num(1)), *[word() for _ in range(pick(0, 0, 1, 2))], *pick(["com"], ["org"], ["net"], ["edu"], ["example", "com"])]
        return local + at + dot.join(host), 0
    if kind == 1:
        dot = pick(".", "[.]", " . ", "(.)", "[dot]", " [.] ")
        return dot.join(str(int(x)) for x in r.integers(0, 256, 4)), 1
    if kind == 2:
        d, sep = _with_check_digit(pick("4", "5", "34", "6") + num(int(r.integers(12, 15)))), pick(".", "/", "_", " ", "  ", "–", " - ", "")
        return sep.join(d[i:i + 4] for i in range(0, len(d), 4)), 2
    if kind == 3:
        s, area, a, b = pick("-", ".", " ", "/"), num(3), num(3), num(4)
        return pick(f"({area}) {a}-{b}", f"{area}{s}{a}{s}{b}", f"1{s}{area}{s}{a}{s}{b}", f"00{num(2)} {area} {a}{b}", f"0{area}/{a}{b}",
                    f"+ {num(1)} ({area}) {a}-{b}", f"({area}){a}-{b}", f"+{num(2)}/{area}/{a}{b}"), 3
    if kind == 4:
        return "".join(pick(*"0123456789abcdef") for _ in range(int(r.integers(8, 40)))), None
    if kind == 5:
        return pick(num(4), num(2) + "%", f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}:{num(2)}", f"${num(3)}.{num(2)}",
                    num(6), f"v{num(1)}.{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(3)}-{num(2)}", num(11)), None
    return pick(f"{num(2)}.{num(2)}.{num(4)}", f"@{word()}", f"{word()} @ {num(2)}", f"{num(4)}/{num(4)}", f"{word()}_{num(3)}", f"#{num(5)}"), None


def labelled_windows(sample: list[str], n: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """A fifth from the rules' matches in the sample (as far as it has them), the rest with generated forms."""
    r, out = np.random.default_rng(seed), []

    def add(text: str, spans: list[Span]) -> None:
        tags = np.zeros(len(text), np.int64)
        for s, k, e in spans:
            tags[s:e], tags[s] = 2 + 2 * k, 1 + 2 * k
        out.append((char_ids(text), tags))

    for text in sample:
        for s, k, e in base_spans(text):
            if len(out) >= n // 5 or e - s > WINDOW // 2:
                continue
            a = max(0, s - int(r.integers(4, 16)))
            b = min(len(text), e + int(r.integers(4, 16)))
            inside, end = [], -1
            for x, kk, y in base_spans(text[a:b]):
                if x >= end:
                    inside.append((x, kk, y))
                    end = y
            add(text[a:b], inside)
    words = [w for t in sample for w in t[:2000].split()[:200]][:50_000] or ["the", "of", "and", "for", "mail", "call", "write", "is"]
    while len(out) < n:
        before = " ".join(words[int(r.integers(len(words)))] for _ in range(int(r.integers(0, 3))))
        after = " ".join(words[int(r.integers(len(words)))] for _ in range(int(r.integers(0, 3))))
        form, kind = generated(r, words)
        lead = before[-16:] + (" " if before else "")
        text = lead + form + ("", "", "", ".", ",", "!", ":", ";")[int(r.integers(8))] + (" " if after else "") + after[:16]
        add(text, [] if kind is None else [(len(lead), kind, len(lead) + len(form))])
    return out


def train(sample: list[str], windows: int = 6000, epochs: int = 6) -> Tagger:
    tagger = Tagger(9, _FORBIDDEN)
    tagger.train(labelled_windows(sample, windows), epochs, batch=32)
    return tagger


# --- decoding -------------------------------------------------------------------------------------------------------

def valid(kind: int, form: str) -> bool:
    """Whether a decoded form holds what its kind needs."""
    digits = "".join(c for c in form if c.isdecimal())
    letters = any(c.isalpha() for c in form)
    if not digits.isascii():
        digits = "".join(str(int(c)) for c in digits)
    if kind == 0:
        m = re.fullmatch(r"([\w.%+-]+)\s?(?:@|[\[({<]\s?at\s?[\])}>])\s?([\w.-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>])\s?[\w-]+)*)", form, re.I)
        return bool(m and re.search(r"\.|dot", m[2], re.I) and letters)
    if kind == 1:
        parts = re.findall(r"\d+", form)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^\W\d_]", re.sub(r"dot", "", form, flags=re.I))
    if letters:
        return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(form) <= 2 * len(digits) + 8
    return 9 <= len(digits) <= 15 and bool(re.search(r"[^\d]", form)) and not re.fullmatch(r"[\d.]+", form) or (
        kind == 3 and 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", form)))


def address_at(text: str, start: int, end: int) -> tuple[int, int]:
    """Start and end of the local part and the host parts around a sign for ``at``."""
    m = _HOST_PARTS.match(text, end)
    if start and text[start - 1].isspace():
        start -= 1
    while start and _LOCAL_SIGN.match(text[start - 1]):
        start -= 1
    return start, m.end() if m else end


def windows_of(text: str, base: list[Span]) -> list[tuple[int, int, bool, bool]]:
    """(start, end, cut at start, cut at end) of the windows to decode."""
    merged: list[list[int]] = []  # union of the rules' matches
    for s, _, e in base:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts = [m[0] for m in merged]
    areas: list[tuple[int, int, int]] = []  # start, end, length of the longest form around an ``at``
    for m in _ANCHOR.finditer(text):
        k = bisect.bisect_right(starts, m.start()) - 1
        if k >= 0 and m.start() < merged[k][1]:
            continue
        s, e = m.span() if m[0].isdecimal() else address_at(text, *m.span())
        form, s, e = e - s, max(0, s - MARGIN), min(len(text), e + MARGIN)
        while areas and s <= areas[-1][1]:
            before = areas.pop()
            s, e, form = min(s, before[0]), max(e, before[1]), max(form, before[2])
        areas.append((s, e, form))
    out = []
    for s, e, form in areas:
        at, width = s, min(WIDEST, max(WINDOW, 2 * form + 2))
        while True:
            end = min(e, at + width)
            out.append((at, end, at > 0, end < len(text)))
            if end == e:
                break
            at += width // 2
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Non-overlapping (start, kind, end) of the largest total margin; the earliest of equals."""
    found = sorted({(e, s, k): m for s, k, e, m in sorted(found, key=lambda x: x[3])}.items())
    ends = [x[0][0] for x in found]
    best: list[tuple[float, int | None]] = [(0.0, None)]
    for i, ((e, s, _k), m) in enumerate(found):
        j = bisect.bisect_right(ends, s, 0, i)
        take = best[j][0] + m
        best.append((take, j) if take > best[i][0] else (best[i][0], None))
    out, i = [], len(found)
    while i:
        if best[i][1] is None:
            i -= 1
        else:
            e, s, k = found[i - 1][0]
            out.append((s, k, e))
            i = best[i][1]
    return out[::-1]


def added_spans(batch: list[str], bases: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans for each text, reconciled over all its windows."""
    todo = [(i, *w) for i, t in enumerate(batch) for w in windows_of(t, bases[i])]
    todo.sort(key=lambda x: x[2] - x[1])  # alike lengths together, so little is padded
    found: dict[int, list] = {}
    at = 0
    while at < len(todo):
        n = BATCH
        while n > 1 and (w := todo[min(at + n, len(todo)) - 1])[2] - w[1] > BATCH * WINDOW // n:
            n //= 2  # wider windows, fewer of them at a time
        part = todo[at:at + n]
        at += n
        ids = np.zeros((len(part), max(w[2] - w[1] for w in part)), np.int64)
        for r, (i, s, e, _, _) in enumerate(part):
            ids[r, :e - s] = char_ids(batch[i][s:e])
        tags, margin = tagger.decode(ids)
        for r in np.flatnonzero((tags > 0).any(1)):
            i, s, e, cut_start, cut_end = part[r]
            row, width = tags[r], e - s
            for b in np.flatnonzero(row % 2 == 1):
                k, end = int(row[b]) // 2, int(b) + 1
                while end < width and row[end] == 2 + 2 * k:
                    end += 1
                if (b == 0 and cut_start) or (end == width and cut_end):
                    continue
                found.setdefault(i, []).append((s + int(b), k, s + end, float(margin[r, b:end].mean()) * (end - int(b)) + 1e-6))
    out: list[list[Span]] = []
    for i, text in enumerate(batch):
        mine = []
        for s, k, e, m in found.get(i, ()):
            while s < e and text[s].isspace():
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in ",;:"):
                e -= 1
            if m > 0 and s < e and not any(s < y and x < e for x, _, y in bases[i]) and valid(k, text[s:e]) \
                    and not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum()):
                mine.append((s, k, e, m))
        out.append(reconcile(mine))
    return out


def find_all(batch: list[str], tagger: Tagger) -> tuple[list[list[Span]], list[list[Span]]]:
    """Rule matches and added spans of each whole text."""
    bases = [base_spans(t) for t in batch]
    return bases, added_spans(batch, bases, tagger)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Tagger:
    """Trained on at most ``sample`` rows with a digit or ``@``, in order of a hash of key and text."""
    rows = docs.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= 50_000)).select(key, text)
    return train([r[text] for r in hashed_sample(rows, sample, key, text)])


def personal_data(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, matches per kind, base_sha256, spans, and the added spans' number."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, text, key))

    def make():
        def f(batch):
            rows = []
            for part in texts(batch, text):
                for base, more in zip(*find_all(part, model.value), strict=True):
                    n = [sum(k == j for _, k, _ in base) for j in range(4)]
                    rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
        return f

    fields = [*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
              T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return arrow_map(docs.select(key, text), fields, make, [key])


def mask(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; overlapping spans as one, by the first one's kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in sorted(spans):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with all spans of the text replaced; a null text stays null."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs, text, key))

    def make():
        def f(batch):
            out = []
            for part in texts(batch, text):
                for t, base, more in zip(part, *find_all(part, model.value), strict=True):
                    out.append(mask(t, base + more) if base or more else t)
            nulls = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
            return [[None if n else t for t, n in zip(out, nulls, strict=True)]]
        return f

    return arrow_map(docs, [T.StructField(text, T.StringType())], make).select(*docs.columns)
