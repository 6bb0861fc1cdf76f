"""Personal data by weak supervision.

Candidates are the spans of four fixed formats (which always stay) and of looser
ones. Five labelers vote on each: shape, checksum or range, gazetteer, context
words before the span, and the mix of characters. Votes of the whole corpus are
counted by pattern, a table whose size is bounded by the number of patterns;
expectation-maximisation on it estimates each labeler's reliability for each
kind, and the posteriors train a logistic span classifier, which decides on the
looser candidates in a second pass.

Defined cases: a null or empty text has no spans; offsets count code points;
base spans of one kind never overlap, and looser ones overlap no span at all, of
which the first, then the longest, then the kind that sorts first is taken;
without any candidate nothing is added; repeated rows vote again, as any text
does; texts of any length are scanned whole in about linear time; an empty table
gives an empty table; other columns come back unchanged, but ``with_spans``
replaces those with the names of the new ones (in any case).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, arrow_map, fresh, rows_of

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# Formats of the base kinds and of the looser candidates.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
SPELT_EMAIL = re.compile(r"(?<![\w.])[\w.+-]{1,64} ?(?:\[at\]|\(at\)) ?[\w-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[\w-]{1,63}){1,5}")
SECRET = re.compile(
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bsk-[A-Za-z0-9_-]{20,}"
    r"|\b(?:password|passwd|secret|token|api_?key)[=:][^\s\"']{6,}|\b[0-9a-f]{32,64}\b"
)
# Gazetteers and context words.
TLD = frozenset("com net org edu gov io de fr es uk it nl eu info biz co us ca ch at be pl pt se no fi dk ie au jp cn in br mx".split())
IIN = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421")
CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|write)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|adresse|addr|login)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "secret": re.compile(r"(?i)(?:password|passwd|secret|token|key|aws|credential)"),
}
LAST_LABEL = re.compile(r"\.|\[dot\]|\(dot\)")
NOT_CUE = re.compile(r"(?i)\b(?:version|isbn|doi|figure|page|chapter|order|total|hash|sha|md5|commit|checksum)\b[^\n]{0,12}$")
BEFORE = 40
#: Place of the labeler of context words.
CUE = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run of local characters before it and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        found = DOMAIN.match(text, at + 1) if lo < at else None
        if found:
            yield lo, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base formats, by kind and start."""
    found = [("email", lo, hi) for lo, hi in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    if "[at]" in text or "(at)" in text:
        for m in SPELT_EMAIL.finditer(text):
            yield ("email", *m.span())
    for m in LOCAL_PHONE.finditer(text):
        yield ("phone", *m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19:
            yield ("card", *m.span())
    for m in SECRET.finditer(text):
        yield ("secret", *m.span())


def candidates(text: str) -> tuple[list, list]:
    """Base spans, and looser spans that overlap neither those nor each other."""
    base = base_spans(text)
    taken = sorted((lo, hi) for _, lo, hi in base)
    begin = [lo for lo, _ in taken]
    # The furthest end of the base spans so far: one of them overlaps if it passes a candidate's start.
    reach = list(accumulate((hi for _, hi in taken), max))
    extra: list[tuple[str, int, int]] = []
    for kind, lo, hi in sorted(_loose(text), key=lambda s: (s[1], -s[2], s[0])):
        before = bisect_left(begin, hi)
        if not (before and reach[before - 1] > lo) and not (extra and extra[-1][2] > lo):
            extra.append((kind, lo, hi))
    return base, extra


def votes(text: str, kind: str, lo: int, hi: int, strict: bool) -> tuple[int, ...]:
    """Votes of the five labelers: 1 personal, -1 not, 0 abstains."""
    span = text[lo:hi]
    digits = _digits(span)
    before = text[max(0, lo - BEFORE) : lo]
    shape = 1 if strict else 0
    check, known = 0, 0
    if kind == "email":
        known = 1 if LAST_LABEL.split(span)[-1].strip(")] ").lower() in TLD else -1
        check = 1 if len(span) <= 254 and ".." not in span else -1
    elif kind == "ip":
        parts = span.split(".")
        check = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
        known = -1 if parts[0] in ("0", "10", "127", "255") or span.startswith("192.168.") else 1
    elif kind == "card":
        check = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(IIN) else -1
    elif kind == "phone":
        check = 1 if 9 <= len(digits) <= 15 else -1
        known = (1 if digits.startswith(CODES) else -1) if span[0] == "+" else (1 if digits[0] in "23456789" and digits[3] in "23456789" else -1)
    else:
        name, _, value = span.replace(":", "=").partition("=")
        shape = 1 if value or span.startswith(("AKIA", "ASIA", "gh", "sk-")) else 0
        known = 1 if span.startswith(("AKIA", "ASIA", "gh", "sk-", "password", "passwd", "secret", "token", "api")) else 0
        check = 1 if digits and len(set(value or name)) >= 6 else -1
    cue = 1 if CUES[kind].search(before) else -1 if NOT_CUE.search(before) else 0
    classes = sum(bool(re.search(c, span)) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    mixed = 1 if (2 * sum(map(str.isalpha, span)) > len(span) if kind == "email" else (classes >= 2) == (kind == "secret")) else -1
    return shape, check, known, cue, mixed


def pattern(text: str, kind: str, lo: int, hi: int, strict: bool) -> str:
    """Kind, votes and bucketed length of a candidate: one of a bounded number of strings."""
    v = votes(text, kind, lo, hi, strict)
    size = min(3, (hi - lo) // 10)
    return f"{kind}|{','.join(map(str, v))}|{size}|{int(strict)}"


def pattern_counts(df: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each vote pattern occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in rows_of(batches):
            for t in batch.column(0).to_pylist():
                base, extra = candidates(t or "")
                for strict, spans in ((True, base), (False, extra)):
                    seen.update(pattern(t, *s, strict) for s in spans)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = arrow_map(df.select(text), run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: r.n for r in counted.collect()}


def _parse(p: str) -> tuple[str, list[int], int, int]:
    kind, v, size, strict = p.split("|")
    return kind, [int(x) for x in v.split(",")], int(size), int(strict)


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Posterior of each pattern, and each kind's table of vote probabilities (labeler, class, vote)."""
    posterior: dict[str, float] = {}
    tables = {}
    for kind in KINDS:
        own = sorted(p for p in counts if _parse(p)[0] == kind)
        if not own:
            continue
        v = np.array([_parse(p)[1] for p in own])
        n = np.array([counts[p] for p in own], float)
        on = 1 / (1 + np.exp(-v.sum(axis=1)))
        silent = min(n[v[:, CUE] == 0].sum() / n.sum(), 1 - 1e-9)
        for _ in range(rounds):
            weight = np.stack([n * (1 - on), n * on])
            prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
            # One pseudo-count for each vote, and one for the vote that agrees with the class.
            table = np.array([[[weight[z][v[:, j] == x].sum() + 1 + (x == 2 * z - 1) for x in (-1, 0, 1)] for z in (0, 1)] for j in range(v.shape[1])])
            table /= table.sum(axis=2, keepdims=True)
            # No cue before a span is no evidence: both classes are silent alike there.
            table[CUE] *= (1 - silent) / (1 - table[CUE, :, 1:2])
            table[CUE, :, 1] = max(silent, 1e-9)
            log = np.log(prior) + sum(np.log(table[j][:, v[:, j] + 1]).T for j in range(v.shape[1]))
            on = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        posterior |= dict(zip(own, on.tolist(), strict=True))
        tables[kind] = table
    return posterior, tables


def features(p: str) -> np.ndarray:
    kind, v, size, strict = _parse(p)
    out = np.zeros(1 + len(KINDS) * 2 + len(v) * 3 + 4)
    out[0] = 1
    out[1 + 2 * KINDS.index(kind) + strict] = 1
    for j, x in enumerate(v):
        out[1 + len(KINDS) * 2 + 3 * j + x + 1] = 1
    out[-4 + size] = 1
    return out


def train(counts: dict[str, int], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier fitted to the posteriors by Newton steps."""
    posterior, _ = estimate(counts)
    own = sorted(posterior)
    size = len(features("email|0,0,0,0,0|0|0"))
    w = np.zeros(size)
    if not own:
        return w
    x = np.array([features(p) for p in own])
    y = np.array([posterior[p] for p in own])
    n = np.array([counts[p] for p in own], float)
    n *= 1e4 / max(1e4, n.sum())
    for _ in range(rounds):
        mean = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - mean)) - ridge * w
        bend = (x.T * (n * mean * (1 - mean) + 1e-9)) @ x + ridge * np.eye(size)
        w = w + np.linalg.solve(bend, slope)
    return w


def find_spans(text: str, weights: np.ndarray, decided: dict[str, bool] | None = None) -> tuple[list, list]:
    """Base spans, and the looser candidates that the classifier accepts."""
    base, extra = candidates(text)
    decided = {} if decided is None else decided
    kept = []
    for s in extra:
        p = pattern(text, *s, False)
        if p not in decided:
            decided[p] = bool(features(p) @ weights > 0)
        if decided[p]:
            kept.append(s)
    return base, kept


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def with_spans(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Adds counts of the base kinds, the digest of the base spans, and all spans."""

    def make(texts: list) -> list[list]:
        decided: dict[str, bool] = {}
        rows = []
        for t in texts:
            base, more = find_spans(t or "", weights, decided)
            seen = Counter(k for k, _, _ in base)
            rows.append([*(seen[k] for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)])
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in FIELDS]

    return add_columns(df, text, FIELDS, make)


def redact(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """df with every span in the text replaced by its kind in angle brackets; overlapping spans become one."""

    def one(t: str | None, decided: dict) -> str | None:
        if not t:
            return t
        base, more = find_spans(t, weights, decided)
        out, at = [], 0
        for kind, lo, hi in sorted(base + more, key=lambda s: (s[1], -s[2])):
            if lo >= at:
                out += [t[at:lo], f"<{kind.upper()}>"]
            at = max(at, hi)
        return "".join([*out, t[at:]])

    def make(texts: list) -> list[list]:
        decided: dict[str, bool] = {}
        return [[one(t, decided) for t in texts]]

    hidden = fresh("redacted", df.columns)
    done = add_columns(df, text, [T.StructField(hidden, T.StringType())], make)
    return done.select(*[done[hidden].alias(c) if c.lower() == text.lower() else done[f"`{c}`"] for c in df.columns])


def personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Both passes over df: votes of the whole corpus, then spans."""
    return with_spans(df, train(pattern_counts(df, text)), text)
