"""Personal data by fixed rules and a semi-Markov conditional random field.

The rules find e-mail addresses, IPv4 addresses, card and phone numbers. The
field is trained on what the rules mark in a bounded sample and then reads
every text: words with a digit or an at sign form runs, each stretch of up to
``LONGEST`` words of a run is a candidate whole span, features of the whole
span score it for each type, and dynamic programming over the run chooses
boundaries and types together. Its spans are added where the rules have none.

Defined results: a null text counts as empty and has no spans; the empty list
of spans is the empty string; repeated rows are read each; without any run in
the table nothing is learned and nothing added; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, ship, text_map

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a candidate segment: the model's segment length.
LONGEST = 6
#: Bound of the training sample (runs), fixed and independent of the input.
SAMPLE_RUNS = 3000
#: Most characters of a run in the training sample; finding reads runs of any length.
SAMPLE_RUN_CHARS = 400
#: By how much an added span must beat "no entity" in log score.
MARGIN = 3.0

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that a digit precedes was already tried from its first digit.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
_RUN_WORD = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_BLANKS = frozenset(" \t\n\x0b\x0c\r")
_TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over the local part: linear in any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                    if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    out.sort()
    return out


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Neighbouring words with a digit or an at sign, one blank between them."""
    out: list[list[tuple[int, int]]] = []
    for m in _RUN_WORD.finditer(text):
        start = m.start()
        low = out[-1][-1][1] if out else 0
        while start > low and text[start - 1] not in _BLANKS:
            start -= 1
        if out and start == low + 1:
            out[-1].append((start, m.end()))
        else:
            out.append([(start, m.end())])
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in _TRIM:
        start += 1
    while end > start and text[end - 1] in _TRIM:
        end -= 1
    return start, end


def features(span: str, n_words: int) -> list[str]:
    """Whole-span features: what only the complete candidate shows."""
    digits = _NOT_DIGIT.sub("", span)
    n = len(digits)
    quad = _IP.fullmatch(span)
    size = next((k for k, top in enumerate((0, 3, 6, 9, 13, 15, 19)) if n <= top), 7)
    at = span.find("@")
    out = ["bias", f"words={min(n_words, 4)}", f"digits={size}",
           f"plus={span[:1] == '+'}", f"at={min(span.count('@'), 2)}",
           f"dots={min(span.count('.'), 4)}", f"letters={any(map(str.isalpha, span))}",
           f"pure={n == len(span)}", f"dash={'-' in span}"]
    if at > 0 and _DOMAIN.fullmatch(span, at) and set(span[:at]) <= _LOCAL:
        out.append("address")
    if quad:
        out.append(f"quad={all(map(_small, quad.groups()))}")
    if 14 <= n <= 19 and _CARD.fullmatch(span):
        out.append(f"luhn={luhn(digits)}")
    if 10 <= n <= 15 and _PHONE.fullmatch(span):
        out.append("international")
    return out


class SemiCRF:
    """Weights of (type, feature) and (type, next type); type 0 is no entity."""

    def __init__(self, weights: dict | None = None):
        self.weights = weights or {}
        self._known: dict[tuple[str, int], np.ndarray] = {}

    def scores(self, span: str, n_words: int) -> np.ndarray:
        """Score of a span for each type; no entity covers one word only."""
        key = (span, n_words)
        out = self._known.get(key)
        if out is None:
            out = np.zeros(len(KINDS) + 1)
            for f in features(span, n_words):
                w = self.weights.get(f)
                if w is not None:
                    out += w
            if n_words > 1:
                out[0] = -np.inf
            if len(self._known) > 50_000:
                self._known.clear()
            if len(span) <= 64:
                self._known[key] = out
        return out

    def steps(self, run: list[tuple[int, int, str]]) -> Iterator[tuple]:
        """(end word, length, scores) of every candidate, by end word."""
        for j in range(1, len(run) + 1):
            for n in range(1, min(LONGEST, j) + 1):
                yield j, n, self.scores(span_of(run, j - n, j), n)

    def moves(self) -> np.ndarray:
        return self.weights.get("moves", np.zeros((len(KINDS) + 1,) * 2))

    def best(self, run) -> list[tuple[int, int, int, float]]:
        """(first word, end word, kind, lead over no entity) of the best split."""
        k, n = len(KINDS) + 1, len(run)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        single: list[float] = []
        moves = self.moves()
        for j, size, score in self.steps(run):
            if size == 1:
                single.append(float(score[0]))
            into = best[j - size][:, None] + moves
            frm = into.argmax(axis=0)
            total = into.max(axis=0) + score
            for y in range(k):
                if total[y] > best[j, y]:
                    best[j, y] = total[y]
                    back[j, y] = (size, int(frm[y]))
        out, j, y = [], n, int(best[n].argmax())
        while j > 0:
            size, before = back[j, y]
            if y:
                score = self.scores(span_of(run, j - size, j), size)[y]
                out.append((j - size, j, y - 1, float(score - sum(single[j - size:j]))))
            j, y = j - size, before
        return out[::-1]

    def gradient(self, run, gold: list[tuple[int, int, int]]) -> dict:
        """Gradient of the log likelihood of a labelled run, by forward-backward."""
        k, n = len(KINDS) + 1, len(run)
        moves, steps = self.moves(), list(self.steps(run))
        alpha = np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0.0
        beta = np.full((n + 1, k), -np.inf)
        beta[n] = 0.0
        for j, size, score in steps:
            into = np.logaddexp.reduce(alpha[j - size][:, None] + moves, axis=0) + score
            alpha[j] = np.logaddexp(alpha[j], into)
        for j, size, score in reversed(steps):
            out = np.logaddexp.reduce(moves + (score + beta[j])[None, :], axis=1)
            beta[j - size] = np.logaddexp(beta[j - size], out)
        total = np.logaddexp.reduce(alpha[n])
        grad: dict = {"moves": np.zeros((k, k))}

        def add(i, j, row):
            for f in features(span_of(run, i, j), j - i):
                grad.setdefault(f, np.zeros(k))
                grad[f] += row
        for j, size, score in steps:
            joint = np.exp(alpha[j - size][:, None] + moves + (score + beta[j])[None, :] - total)
            grad["moves"] -= joint
            add(j - size, j, -joint.sum(axis=0))
        y = 0
        for i, j, kind in gold:
            grad["moves"][y, kind] += 1
            add(i, j, np.eye(k)[kind])
            y = kind
        return grad


def span_of(run: list[tuple[int, int, str]], i: int, j: int) -> str:
    """Text of the words i..j-1 of a run, without punctuation at its ends."""
    joined = " ".join(w[2] for w in run[i:j])
    start, end = trimmed(joined, 0, len(joined))
    return joined[start:end]


def label(words: list[str]) -> list[tuple[int, int, int]] | None:
    """(first word, end word, type) by the rules; None where words don't fit."""
    text, at, spans = " ".join(words), 0, []
    edges = []
    for w in words:
        edges.append((at, at + len(w)))
        at += len(w) + 1
    for s, kind, e in base_spans(text):
        if spans and s < spans[-1][2]:
            continue
        i = next((k for k, (a, b) in enumerate(edges) if a <= s < b), None)
        j = next((k + 1 for k, (a, b) in enumerate(edges) if a < e <= b), None)
        if i is None or j is None or j - i > LONGEST:
            return None
        if trimmed(text, edges[i][0], edges[j - 1][1]) != (s, e):
            return None
        spans.append((i, j, e, kind + 1))
    gold, at = [], 0
    for i, j, _, kind in spans:
        if i < at:
            return None
        gold += [(k, k + 1, 0) for k in range(at, i)] + [(i, j, kind)]
        at = j
    return gold + [(k, k + 1, 0) for k in range(at, len(words))]


def fit(samples: list[list[str]], rounds: int = 4, rate: float = 0.5) -> SemiCRF:
    """Adaptive gradient ascent over runs labelled by the rules."""
    labelled = [([(0, 0, w) for w in words], gold) for words in samples
                if (gold := label(words)) is not None]
    model, seen = SemiCRF(), {}
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for k in order.permutation(len(labelled)):
            grad = model.gradient(*labelled[k])
            for f, g in grad.items():
                total = seen.setdefault(f, np.full(g.shape, 1e-3))
                total += g * g
                model.weights.setdefault(f, np.zeros(g.shape))
                model.weights[f] = model.weights[f] * (1 - 1e-5) + rate * g / np.sqrt(total)
            model._known.clear()
    return model


def _sample_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            for run in runs(text or ""):
                # A long run is cut into pieces, each a sample of its own.
                for k in range(0, len(run), 12):
                    out.append("\x00".join(text[a:b] for a, b in run[k:k + 12]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["run"])


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE_RUNS) -> SemiCRF:
    """Fit on ``sample`` runs at most: the least by hash among all texts' runs
    of up to ``SAMPLE_RUN_CHARS`` characters."""
    ship(docs.sparkSession)
    rows = (docs.select(quoted(text)).mapInArrow(_sample_runs, "run string")
            .where(F.length("run") <= SAMPLE_RUN_CHARS).distinct()
            .orderBy(F.xxhash64("run"), "run").limit(sample).collect())
    return fit([r.run.split("\x00") for r in rows])


def added_spans(text: str, base: list[tuple[int, int, int]],
                model: SemiCRF) -> list[tuple[int, int, int]]:
    """The model's spans that touch no base span."""
    out = []
    for run in runs(text):
        if not model.weights:
            break
        for i, j, kind, lead in model.best([(a, b, text[a:b]) for a, b in run]):
            start, end = trimmed(text, run[i][0], run[j - 1][1])
            if lead >= MARGIN and start < end and not any(
                    s < end and start < e for s, _, e in base):
                out.append((start, kind, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         model: SemiCRF | None = None, sample: int = SAMPLE_RUNS) -> DataFrame:
    """Counts of base spans, their digest, all spans, and how many were added."""
    weights = (model or train(docs, text, sample)).weights

    def setup():
        crf = SemiCRF(weights)

        def compute(texts):
            rows = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                more = added_spans(t, base, crf) if "@" in t or _DIGIT.search(t) else []
                kinds = [k for _, k, _ in base]
                rows.append((*[kinds.count(k) for k in range(len(KINDS))],
                             hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(base + more), len(more)))
            return [[r[k] for r in rows] for k in range(7)]
        return compute
    fields = [*[(f"n_{k}", T.LongType()) for k in KINDS], ("base_sha256", T.StringType()),
              ("spans", T.StringType()), ("n_added", T.LongType())]
    plain = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return text_map(plain, "text", fields, setup, ["doc_id"])
