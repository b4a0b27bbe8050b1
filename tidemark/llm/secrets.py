"""Secret scan: fixed patterns, and password guess costs of values that stand behind a credential word.

A value is judged by the cheapest way to cut it into words, dates, repeats, keyboard walks and brute-force spans: the cost of a
cut is the sum of log10 guesses of its parts and ``JOIN`` for each part after the first. A value that costs ``min_guesses`` or
more is a secret.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import over_arrow

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORD = (r"""(pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret|auth)[_-]?key|auth|bearer|login)"""
        r"""(?![a-z])["']?\x20{0,3}(?P<sep>[:=]>?|\x20is\x20|\x20)\x20{0,3}""")
VALUE = r"""(?:"(?P<double>[^"\r\n]{6,})"|'(?P<single>[^'\r\n]{6,})'|["']?(?P<value>[^\s"'<>]{6,}))"""
# Nothing is consumed, so that a credential word may also stand in what another one takes as its value.
CONTEXT = re.compile(f"(?=(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z]))){WORD}{VALUE})", re.I | re.A)
STEMS = ("pass", "pwd", "secret", "token", "cred", "key", "auth", "bearer", "login")
JOIN = math.log10(2)

# Common password words, most common first: fixed values.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login princess sunshine shadow football baseball iloveyou "
    "trustno michael superman batman hello freedom whatever secret summer winter spring autumn love test user guest root pass "
    "change changeme default access token key private public server client system account manager office company internet computer "
    "example sample demo temp none null true false undefined string value your this that here insert enter required optional"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LEET = str.maketrans("@431!05$7", "aaeliosst")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d")


def _brute(ch: str) -> float:
    if ch.isdigit():
        return 1.0
    if ch.isascii() and ch.isalpha():
        return math.log10(26)
    return math.log10(33) if ch.isascii() else 2.0


def _near(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation; a fixed number of looks back for each character."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    best = [0.0] + [math.inf] * n
    walk = run = step = 0  # starts of the current keyboard walk, repeat and alphabetic sequence
    dates: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := DATE.match(low, i)):
            dates.setdefault(m.end(), []).append((i, 2.1 if len(m[0]) == 4 else 4.6))
    periods: dict[int, list[tuple[int, int]]] = {}
    for size in range(2, 9):  # repeats of longer units: the unit is paid once, each copy adds a factor
        at = 0
        while at + 2 * size <= n:
            end = at + size
            while end < n and low[end] == low[end - size]:
                end += 1
            whole = at + (end - at) // size * size
            if whole - at >= 2 * size:
                periods.setdefault(whole, []).append((at, size))
                at = whole
            else:
                at = max(at + 1, end - size + 1)
    for j in range(1, n + 1):
        ch = low[j - 1]
        if j > 1:
            prev = low[j - 2]
            run = run if ch == prev else j - 1
            walk = walk if _near(prev, ch) else j - 1
            gap = ord(ch) - ord(prev)
            if abs(gap) != 1 or not ch.isalnum():
                step = j - 1
            elif j - 2 > step and gap != ord(prev) - ord(low[j - 3]):
                step = j - 2
        options = [(j - 1, _brute(value[j - 1]), 0.0)]
        if j - run >= 3:
            options.append((run, _brute(ch) + math.log10(j - run), JOIN))
        if j - walk >= 3:
            options.append((walk, math.log10(47 * 4) + 0.35 * (j - walk - 1), JOIN))
        if j - step >= 3:
            options.append((step, math.log10(52 * (j - step)), JOIN))
        for size in range(3, min(LONGEST, j) + 1):
            word = low[j - size:j]
            rank = RANK.get(word) or RANK.get(plain[j - size:j])
            if rank:
                upper = 0.3 if value[j - size:j] != word else 0.0
                options.append((j - size, math.log10(rank + 1) + upper + (0.3 if word not in RANK else 0.0), JOIN))
        options += [(i, cost, JOIN) for i, cost in dates.get(j, ())]
        for i, size in periods.get(j, ()):
            unit = sum(_brute(c) for c in value[i:i + size])
            options.append((i, unit + math.log10((j - i) // size), JOIN))
        best[j] = min(best[i] + cost + (join if i else 0.0) for i, cost, join in options)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


def guess_spans(text: str, min_guesses: float) -> list[tuple[int, int, str]]:
    """Values behind a credential word that cost 10 ** ``min_guesses`` guesses or more.

    Without ``:``, ``=`` or a quote, plain words follow such words in prose: there, a value needs a digit and a letter.
    """
    found, at = [], 0
    for m in CONTEXT.finditer(text):
        kind = m.lastgroup
        value = m[kind] if kind != "value" else m[kind].rstrip(".,;:!?)]}")
        begin = m.start(kind)
        quoted = begin > 0 and text[begin - 1] in "\"'"
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        if m.start() < at or len(value) < 6 or not (m["sep"][0] in ":=" or quoted or mixed):
            continue
        if guess_cost(value) >= min_guesses:
            at = begin + len(value)
            found.append((begin, at, "guess"))
    return found


def find_spans(text: str, min_guesses: float) -> list[tuple[int, int, str]]:
    """All spans in order of start, then kind. A guessed value inside a base span is not told again."""
    base = base_spans(text)
    own = [s for s in guess_spans(text, min_guesses) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
    return sorted(base + own, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_HEXES = np.zeros(256, bool)
_HEXES[48:58] = _HEXES[97:103] = True


def _suspects(column: pa.Array) -> list[bool]:
    """Texts that can hold a span at all: a credential stem, an access key's start or a run of 24 hex digits."""
    out = []
    for text in column.to_pylist():
        if not text:
            out.append(False)
            continue
        low = text.lower()
        hit = "AKIA" in text or any(s in low for s in STEMS) or "ſ" in low
        if not hit:
            b = _HEXES[np.frombuffer(text.encode(), "uint8")]
            gaps = np.flatnonzero(~b)
            hit = len(b) >= 24 and (not len(gaps) or max(int(np.diff(gaps).max(initial=0)) - 1, int(gaps[0]), len(b) - 1 - int(gaps[-1])) >= 24)
        out.append(hit)
    return out


def scan(docs: DataFrame, min_guesses: float = 8.0) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) of every document.

    Null or empty text: no spans. Null ids and repeated rows are scanned like any row; extra columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t, min_guesses)] if hit else []
                 for t, hit in zip(texts.to_pylist(), _suspects(texts))]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(spans, pa.list_(kind))], names=["doc_id", "spans"])

    return over_arrow(docs, ["doc_id", "text"], run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, min_guesses: float = 8.0, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); n_chars follows the text, null text stays null."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(4).to_pylist()
        for i, hit in enumerate(_suspects(batch.column(4))):
            if not hit:
                continue
            parts, at = [], 0
            for a, b, _ in find_spans(texts[i], min_guesses):
                if a >= at:
                    parts += [texts[i][at:a], mark]
                at = max(at, b)
            texts[i] = "".join(parts) + texts[i][at:]
        text = pa.array(texts, pa.string())
        size = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(1), batch.column(2), size], names=["doc_id", "text", "lang", "source", "n_chars"])

    return over_arrow(docs, ["doc_id", "lang", "source", "n_chars", "text"], run, "doc_id bigint, text string, lang string, source string, n_chars bigint")

