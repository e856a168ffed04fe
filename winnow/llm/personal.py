"""Personal data by weak supervision.

Spans of four kinds (email, ip, card, phone). The base patterns' valid matches always count. Wider patterns propose further
candidates: numbers inside a longer digit sequence that fails as a whole, national phone formats, spelled-out addresses.
Labelers (pattern, checksum, gazetteer, context, borders) vote for, against or not at all on every candidate, base matches
included. Expectation-maximisation over the counts of vote patterns in the whole corpus estimates how reliable every
labeler is for every kind, without labels; a logistic classifier of spans is then fitted to the resulting
probabilities, and a candidate is added where it says 0.5 or more.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import pieces, prepare, spread

KINDS = ("email", "ip", "card", "phone")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WIDE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{13,19})(?![0-9])")
WIDE_PHONE = re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
WIDE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]{1,63}){1,8}")
DIGITS = re.compile(r"[0-9]")

#: Gazetteers and context words.
SUFFIXES = frozenset("com org net edu gov mil int info biz io co de fr es it nl uk us eu ch at be pt pl se no dk fi cz ru jp cn in br au ca mx".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "36", "38", "30", "35", "6")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "5", "6", "8", "9")
FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|courriel|correo)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|client|adresse|dirección)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono|anruf)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|invoice|serial|no|nr|id|build|release|section|page|art)\b[.:#\x20]*$")
AROUND = 32

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(DIGITS.findall(s))


def base_spans(text: str) -> list[Span]:
    """Valid matches of the base patterns, leftmost and non-overlapping in each kind; in the order of KINDS, then start."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        host = HOST.match(text, at + 1)
        start = at
        if host:
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = host.end()
                out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def wide_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the wider patterns that touch no base span and no earlier candidate."""
    taken = sorted((a, b) for _, a, b in base)
    out: list[Span] = []

    def propose(kind: str, found: Iterator[re.Match]) -> None:
        spans = [(m.start(), m.end()) for m in found]
        i, fresh = 0, []
        for a, b in spans:
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if i == len(taken) or taken[i][0] >= b:
                fresh.append((a, b))
        out.extend((kind, a, b) for a, b in fresh)
        taken.extend(fresh)
        taken.sort()

    low = text if "at)" in text or "at]" in text else ""
    if low:
        propose("email", WIDE_EMAIL.finditer(low))
    if DIGITS.search(text):
        propose("card", WIDE_CARD.finditer(text))
        propose("phone", WIDE_PHONE.finditer(text))
    return out


def votes(text: str, kind: str, a: int, b: int, base: bool) -> str:
    """The labelers' votes on a span, one of + - 0 each, after its kind; then its length class and whether it has separators."""
    span = text[a:b]
    digits = _digits(span)
    before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
    if kind == "email":
        suffix = re.split(r"[.\]\)\x20]+", span)[-1]
        check, known = suffix.isalpha() and len(suffix) > 1, suffix.lower() in SUFFIXES
    elif kind == "ip":
        parts = span.split(".")
        check, known = all(p == str(int(p)) for p in parts), parts[0] not in ("0", "255")
    elif kind == "card":
        check, known = luhn(digits), digits.startswith(ISSUERS)
    else:
        check, known = 9 <= len(digits) <= 15, span.startswith("(") or digits.startswith(CODES)
    context = "-" if AGAINST.search(before) else "+" if FOR[kind].search(before) or FOR[kind].search(after[:16]) else "0"
    alone = not (before[-1:].isalnum() or after[:1].isalnum())
    sign = lambda x: "+" if x else "-"
    return f"{kind} {'+' if base else '0'}{sign(check)}{sign(known)}{context}{sign(alone)} {min(len(digits) // 4, 5)}{int(len(digits) != len(span))}"


@dataclass(frozen=True)
class Model:
    """Probability of every vote pattern seen; at most a few thousand patterns exist."""

    chance: dict[str, float]
    reliability: dict[str, list[tuple[float, float]]]


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, list[tuple[float, float]]]]:
    """EM for one kind at a time: P(span is real | votes), and every labeler's chance to vote + on real and on false spans."""
    posterior: dict[str, float] = {}
    rates: dict[str, list[tuple[float, float]]] = {}
    for kind in KINDS:
        patterns = sorted(p for p in counts if p.startswith(f"{kind} "))
        if not patterns:
            continue
        n = np.array([counts[p] for p in patterns], float)
        v = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p.split()[1]] for p in patterns])
        # labelers start as better than chance; their silence says nothing, but for the base pattern
        q = 1 / (1 + np.exp(-2.0 * v[:, :3].sum(1) - 0.5 * v[:, 3:].sum(1) + 1.0))
        for _ in range(rounds):
            share = np.clip((n @ q + 1) / (n.sum() + 2), 0.02, 0.98)
            real = [((n * q * (v[:, k] == 1)).sum() + 4) / ((n * q * (v[:, k] != 0)).sum() + 5) for k in range(v.shape[1])]
            real[1] = max(real[1], 0.99)  # the checksum labeler: a real number fails it only by a slip
            false = [((n * (1 - q) * (v[:, k] == 1)).sum() + 1) / ((n * (1 - q) * (v[:, k] != 0)).sum() + 5) for k in range(v.shape[1])]
            odds = np.full(len(n), np.log(share / (1 - share)))
            for k, (t, f) in enumerate(zip(real, false)):
                odds += np.where(v[:, k] == 1, np.log(t / f), np.where(v[:, k] == -1, np.log((1 - t) / (1 - f)), 0.0))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        rates[kind] = list(zip(map(float, real), map(float, false)))
        posterior |= dict(zip(patterns, q.tolist()))
    return posterior, rates


def _inputs(pattern: str) -> list[float]:
    kind, said, shape = pattern.split()
    signs = [{"+": 1.0, "-": -1.0, "0": 0.0}[c] for c in said]
    own = [float(kind == k) for k in KINDS]
    return [*own, *(o * s for o in own for s in signs), *(float(shape[0] == str(c)) for c in range(6)), float(shape[1])]


def fit(counts: dict[str, int]) -> Model:
    """EM on the pattern counts, then the span classifier on its probabilities (Newton steps on a ridged logistic loss)."""
    posterior, rates = reliabilities(counts)
    patterns = sorted(posterior)
    if not patterns:
        return Model({}, {})
    x = np.array([_inputs(p) for p in patterns])
    target = np.array([posterior[p] for p in patterns])
    weight = np.log1p([counts[p] for p in patterns])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (target - p)) - 0.1 * w)
    return Model(dict(zip(patterns, (1 / (1 + np.exp(-x @ w))).tolist())), rates)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()
    for batch in pieces(batches):
        for text in batch.column("text").to_pylist():
            if text:
                base = base_spans(text)
                total.update(votes(text, *s, True) for s in base)
                total.update(votes(text, *s, False) for s in wide_spans(text, base))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])


def train(docs: DataFrame, text: str = "text") -> Model:
    """Learn from the candidates of all rows; only counts of vote patterns reach the driver."""
    prepare(docs.sparkSession)
    rows = spread(docs.select(F.col(text).alias("text"))).mapInArrow(_count, "pattern string, n bigint")
    return fit({r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def spans_of(text: str | None, chance: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both in the order of KINDS, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [s for s in wide_spans(text, base) if chance.get(votes(text, *s, False), 0.0) >= 0.5]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, base counts by kind, base_sha256 and all spans as kind:start:end (code points, end exclusive).

    A null or empty text has none. Repeated rows and null ids are rows like any other; whole texts are read in time linear in their
    length; an empty table gives no rows. Only the two named columns are read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model.chance)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [spans_of(t, shared.value) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([_joined(every) for _, every in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = dict(docs.dtypes)[doc_id]
    return spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(
        scan, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with all columns and rows, the personal data in the text masked; a null text stays null.

    Empty texts stay as they are, repeated rows are masked alike, very long texts are masked whole, and an empty table stays empty."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model.chance)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            at = batch.schema.get_field_index(text)
            new = []
            for t in batch.column(at).to_pylist():
                spans = spans_of(t, shared.value)[1]
                new.append(masked(t, spans) if spans else t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return spread(docs).mapInArrow(scan, docs.schema)
