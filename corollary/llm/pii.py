"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, a classifier decides.

Candidate spans come from loose patterns: addresses with @, dotted quads, runs of 7 to 19 digits with
separators, social-security-like groups, long random-looking strings (of any length from 20 characters). On each span
  regex labelers (a strict form of its kind),
  a check-sum or range labeler (Luhn, octets, digit counts, share of digits and letters),
  gazetteer labelers (top-level and known mail domains, country prefixes, issuer prefixes, reserved ranges) and
  context labelers (tell-tale or contrary words before the span)
vote yes, no or abstain. Spans are counted by kind and votes over the whole corpus: a table bounded by
the number of vote patterns, not by the data. On it, expectation-maximisation fits for each kind the
share of true spans and each labeler's reliability (votes independent given the truth), and its
posteriors train a logistic regression over votes and shape features. The classifier scores every span.

Defined results: null and empty texts have no span; rows that share a doc_id are scanned one by one,
repeated rows give repeated spans; a null doc_id is reported as null; an empty table gives none; further
columns are ignored. Of overlapping spans the one of the first kind in KINDS stands (a tie can't be: spans of
one kind are apart). A text of any length is scanned as a whole, in time proportional to it and n log n of
its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stage
from .textops import pieces

KINDS = ("email", "secret", "ip", "ssn", "card", "phone")
THRESHOLD = 0.5

_CANDIDATES = {
    "email": re.compile(r"[\w.%+'-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){0,6}"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{20,}+"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?![\w-])"),
}
#: No candidate matches a text without one of these.
_TRIGGER = {"email": "@", "secret": r"[0-9]", "ip": r"[0-9]\.[0-9]", "ssn": r"[0-9]-[0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[\w.%+'-]{0,62}[\w])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}", re.A),
    "secret": re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?:sk|pk|ghp|xox[bp]|AKIA)[A-Za-z0-9_-]{16,}"),
    "ip": re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}"),
    "ssn": re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"),
    "card": re.compile(r"\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5}"),
    "phone": re.compile(r"(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"),
}
_GAZETTEER = {
    "email": (re.compile(r"(?:com|org|net|edu|gov|io|info|co|uk|de|fr|es|it|nl|eu|ch|at|be|us|ca|au|jp|cn|in|br|ru|pl|se|no|dk|fi|pt|mx|biz|dev|app|me)$", re.I), re.compile(r"@(?:localhost|[\d.]+$)|\.(?:png|jpe?g|gif|svg|css|js|py|txt)$", re.I)),
    "secret": (re.compile(r"^(?:sk|pk|ghp|xox[bp]|AKIA|eyJ)"), re.compile(r"^(.)\1*$|lorem|example|https?|www", re.I)),
    "ip": (None, re.compile(r"^(?:0\.|127\.|255\.255|22[4-9]\.|23\d\.)|^(?:\d\.){3}\d$")),
    "ssn": (None, re.compile(r"^(?:078-05-1120|219-09-9999|123-45-6789)$")),
    "card": (re.compile(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"), re.compile(r"^(?:0|(?:19|20)\d{6})")),
    "phone": (re.compile(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)\b"), re.compile(r"^(?:(?:19|20)\d\d[ .-](?:19|20)\d\d|\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.(?:19|20)?\d\d)$")),
}
_CONTEXT = {
    "email": re.compile(r"(?:e-?mail|contact|write|reach|mailto|cc|from|to)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    "secret": re.compile(r"(?:token|secret|key|passw(?:or)?d|api|bearer|auth|credential)\w*\W{0,5}(?:\w+\W+){0,1}$", re.I),
    "ip": re.compile(r"(?:\bip\b|address|host|server|client|from|login)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    "ssn": re.compile(r"(?:ssn|social security|tax id)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|debit|account|payment)\W{0,4}(?:\w+\W+){0,2}$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|mobile|fax|cell|whatsapp)\W{0,4}(?:\w+\W+){0,2}$", re.I),
}
_CONTRARY = {
    "secret": re.compile(r"(?:sha(?:1|256|512)?|md5|commit|checksum|digest|hash|https?:\S*)\W{0,5}$", re.I),
    "ip": re.compile(r"(?:version|v|ver|release|section|chapter|fig)\W{0,2}$", re.I),
    "card": re.compile(r"(?:isbn|order|serial|invoice|id|tracking|no)\W{0,3}$", re.I),
    "phone": re.compile(r"(?:isbn|order|serial|invoice|id|year|page|pages|pp|from|in|between|version)\W{0,3}$", re.I),
}
LABELERS = ("strict", "sum", "listed", "unlisted", "context", "contrary")
FEATURES = len(LABELERS) * 2 + 4


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _sum_vote(kind: str, span: str) -> int:
    digits = "".join(c for c in span if c in "0123456789")
    if kind == "card":
        return 1 if _luhn(digits) and len(set(digits)) > 3 else 0
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 15 else -1 if len(digits) < 7 else 0
    if kind == "ip":
        return 1 if all(int(x) < 256 for x in span.split(".")) else -1
    if kind == "secret":
        letters = sum(c.isalpha() for c in span)
        return 1 if digits and letters and len(set(span)) >= 10 and len(digits) * 8 >= len(span) else -1
    if kind == "email":
        return 1 if "." in span.rpartition("@")[2] else -1
    return 0


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Of LABELERS: 1 for yes, -1 for no, 0 to abstain."""
    span, before = text[start:end], text[max(0, start - 48) : start]
    yes, no = _GAZETTEER[kind]
    contrary = _CONTRARY.get(kind)
    return (
        1 if _STRICT[kind].fullmatch(span) else -1,
        _sum_vote(kind, span),
        1 if yes is not None and yes.search(span) else 0,
        -1 if no is not None and no.search(span) else 0,
        1 if _CONTEXT[kind].search(before) else 0,
        -1 if contrary is not None and contrary.search(before) else 0,
    )


def shape(kind: str, span: str) -> int:
    """Four bits: long for its kind, separators, mixed case, starts with + or a quote's content of hex digits."""
    long = {"email": 24, "secret": 40, "ip": 12, "ssn": 11, "card": 16, "phone": 12}[kind]
    return (len(span) >= long) | (any(c in " -." for c in span) << 1) | ((span != span.lower() and span != span.upper()) << 2) | ((span[0] == "+" or all(c in "0123456789abcdef" for c in span)) << 3)


def candidates(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the loose matches; of overlapping ones the first kind's stands."""
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []  # of the spans of earlier kinds, which are apart from each other
    ends: list[int] = []
    for kind in kinds:
        for m in _CANDIDATES[kind].finditer(text):
            s, e = m.span()
            if kind == "email":
                while e > s and text[e - 1] in ".-_":
                    e -= 1
                while s < e and text[s] in ".'-%+":
                    s += 1
            if kind == "phone" and sum(c.isdigit() for c in text[s:e]) < 7:
                continue
            k = bisect_left(starts, e) - 1
            if k < 0 or ends[k] <= s:
                out.append((kind, s, e))
        both = sorted((a, b) for _, a, b in out)
        starts, ends = [a for a, _ in both], [b for _, b in both]
    return sorted(out, key=lambda x: x[1])


@dataclass
class SpanModel:
    weights: dict[str, np.ndarray]  # by kind: FEATURES weights and a bias
    reliability: dict[str, np.ndarray]  # by kind: labeler x truth x vote
    prior: dict[str, float]

    def score(self, kind: str, vote: tuple[int, ...], bits: int) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(features(np.array([vote]), np.array([bits])) @ w, -40, 40)))[0])


def features(vote: np.ndarray, bits: np.ndarray) -> np.ndarray:
    f = np.concatenate([vote == 1, vote == -1, (bits[:, None] >> np.arange(4)) & 1, np.ones((len(vote), 1))], axis=1)
    return f.astype(float)


def aggregate_votes(vote: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, reliabilities (labeler x truth x vote) and the share of true spans, by EM from the majority."""
    net = vote.sum(axis=1)
    p = np.clip(0.5 + 0.2 * net, 0.05, 0.95)
    before = None
    for _ in range(rounds):
        w = np.stack([count * (1 - p), count * p])
        # Smoothing favours labelers that are right more often than not; without it the truth could swap sides.
        rel = np.empty((vote.shape[1], 2, 3))
        for j in range(vote.shape[1]):
            for truth in (0, 1):
                prior = np.array([2.0, 1.0, 0.2]) if truth == 0 else np.array([0.2, 1.0, 2.0])
                rel[j, truth] = np.array([w[truth][vote[:, j] == v].sum() for v in (-1, 0, 1)]) + prior
        rel /= rel.sum(axis=2, keepdims=True)
        share = (w[1].sum() + 1) / (w.sum() + 2)
        logit = np.log(share / (1 - share)) + sum(np.log(rel[j, 1, vote[:, j] + 1] / rel[j, 0, vote[:, j] + 1]) for j in range(vote.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if before is not None and np.abs(p - before).max() < 1e-9:
            break
        before = p
    return p, rel, float(share)


def fit_span_classifier(x: np.ndarray, p: np.ndarray, count: np.ndarray, steps: int = 50, l2: float = 1.0) -> np.ndarray:
    """Logistic regression of soft labels p, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (q - p)) + l2 * w
        hess = (x * (count * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(patterns: list[tuple]) -> SpanModel:
    """From rows (kind, votes, shape bits, count)."""
    model = SpanModel({}, {}, {})
    for kind in KINDS:
        rows = sorted(r for r in patterns if r[0] == kind)
        if not rows:
            continue
        vote, bits, count = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
        p, model.reliability[kind], model.prior[kind] = aggregate_votes(vote, count)
        model.weights[kind] = fit_span_classifier(features(vote, bits), p, count)
    return model


def _code(vote: tuple[int, ...]) -> int:
    out = 0
    for v in vote:
        out = out * 3 + v + 1
    return out


def _votes(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(reversed(out))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, votes, shape) of the candidates; offsets are code points, end exclusive."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            text = b.column(1)
            has = {k: pc.match_substring_regex(text, p).to_pylist() if p != "@" else pc.match_substring(text, p).to_pylist() for k, p in _TRIGGER.items()}
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i in range(b.num_rows):
                kinds = tuple(k for k in KINDS if has[k][i])
                if not kinds:
                    continue
                t = text[i].as_py()
                for kind, s, e in candidates(t, kinds):
                    for column, v in zip(out, (b.column(0)[i].as_py(), kind, s, e, _code(votes(kind, t, s, e)), shape(kind, t[s:e])), strict=True):
                        column.append(v)
            if out[1]:
                kinds_ = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds_, strict=True)], names=["doc_id", "kind", "start", "end", "votes", "shape"])

    return id_text(docs).where("text is not null and text <> ''").mapInArrow(find, "doc_id long, kind string, start int, end int, votes int, shape int")


def find_private(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, start, end, score) of the spans that the classifier takes for personal data or secrets."""
    found = stage(spans(docs), "spans")
    patterns = [(r[0], _votes(r[1]), r[2], r[3]) for r in found.groupBy("kind", "votes", "shape").count().collect()]
    model = train(patterns)
    scored = [(kind, _code(v), bits, model.score(kind, v, bits)) for kind, v, bits, _ in patterns]
    scores = docs.sparkSession.createDataFrame(scored, "kind string, votes int, shape int, score double")
    # At most 6 kinds x 3**6 votes x 16 shapes.
    return found.join(F.broadcast(scores.where(F.col("score") >= threshold)), ["kind", "votes", "shape"]).select("doc_id", "kind", "start", "end", "score")
