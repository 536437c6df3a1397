"""Personal data by weak supervision.

Labelers vote on candidate spans: a strict pattern (the base rule of its
kind), a checksum or validity test, a gazetteer (domain endings, issuer and
country prefixes), the words before the span, and the characters around it.
Votes are counted over the corpus by pattern, expectation-maximisation (one
two-class model a kind) estimates the labelers' reliabilities and each
pattern's probability, and a logistic span classifier is trained on these
probabilities from features of the span.  Candidates are the base spans and
looser forms (spelled-out e-mail addresses, numbers in phone or card form,
IPv6 addresses).  Base spans stay; a looser candidate is added where the
classifier gives it ``threshold`` or more and it overlaps no span before it.

What reaches the driver is the table of vote patterns: at most 2**18 codes by
construction, some hundreds in practice.

Defined results: null text counts as empty; repeated rows and null doc_ids
are handled row by row; without candidates nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
YES, NO, ABSTAIN = 1, 0, 2
LABELERS = ("pattern", "check", "gazetteer", "context", "edge")

# The base rules.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}+ ?(?:[\[({]at[\])}]| at |@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({]dot[\])}]| dot |\.) ?[A-Za-z]{2,24}+){1,4}")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
# Necessary conditions of the patterns: of a spelled-out address, and of all others (an IPv6 address may hold no digit).
_SPELLED = re.compile(r"(?:[\[({]at[\])}]| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:[\[({]dot[\])}]| dot |\.) ?[A-Za-z]{2}")
_ANCHOR = re.compile(r"[0-9@:]")
_SENTENCE_END = re.compile(r"[A-Za-z0-9-]\. ")  # 'at home. The': a full stop, no dot of a domain

# Gazetteers and context words (English, German, French, Spanish).
ENDINGS = frozenset("com org net edu gov info biz io eu de fr es at ch be uk us it nl example".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "30", "38", "39", "62")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353")
CONTEXT = {
    "email": frozenset("mail email e-mail courriel correo contact kontakt contacto write schreiben".split()),
    "ip": frozenset("ip host server address adresse dirección ping login client".split()),
    "card": frozenset("card karte carte tarjeta visa mastercard amex credit kredit crédit crédito payment".split()),
    "phone": frozenset("phone tel telephone telefon téléphone teléfono call mobile mobil handy fax rufen appelez".split()),
}
AGAINST = frozenset("version order invoice isbn issn id ref bestellung rechnung commande facture pedido factura page seite article".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the base rules, by kind, then start."""
    spans: list[tuple[int, int, int]] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            spans.append((0, start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    spans = []
    if _SPELLED.search(text):
        at = 0
        while m := _LOOSE_EMAIL.search(text, at):
            start, at = m.span()
            # '(at) example.org. The' ends before the full stop where that is an address already
            if (stop := _SENTENCE_END.search(m[0])) and (short := _LOOSE_EMAIL.fullmatch(text, start, start + stop.start() + 1)):
                at = short.end()
            if "@" not in text[start:at]:
                spans.append((0, start, at))
    if ":" in text:
        spans += [(1, *m.span()) for m in _IPV6.finditer(text)]
    for m in _CARD.finditer(text):
        if 13 <= len(_digits(m[0])) <= 19:
            spans.append((2, *m.span()))
    for m in _LOOSE_PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


def _check(kind: int, found: str) -> int:
    digits = _digits(found)
    if kind == 0:
        if _SENTENCE_END.search(found):
            return NO
        ending = re.split(r"[^A-Za-z0-9-]+", found.rstrip("])} "))[-1]
        return YES if ending.isalpha() and 2 <= len(ending) <= 24 else NO
    if kind == 1:
        return YES if ":" in found or not found.startswith(("0", "255")) else NO
    if kind == 2:
        return YES if luhn(digits) and len(set(digits)) > 2 else NO
    return YES if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else NO


def _gazetteer(kind: int, found: str) -> int:
    digits = _digits(found)
    if kind == 0:
        if _SENTENCE_END.search(found):
            return NO
        return YES if re.split(r"[^A-Za-z0-9-]+", found.lower().rstrip("])} "))[-1] in ENDINGS else ABSTAIN
    if kind == 1:
        return ABSTAIN if ":" in found else YES if 1 <= int(found.split(".")[0]) <= 223 else NO
    if kind == 2:
        return YES if digits.startswith(ISSUERS) else NO
    return YES if found.startswith("+") and digits.startswith(COUNTRY_CODES) else YES if digits.startswith("00") else ABSTAIN


def _context(kind: int, before: str) -> int:
    words = [w.strip(".,;:()[]\"'#").lower() for w in before.split()[-4:]]
    if any(w in CONTEXT[KINDS[kind]] for w in words):
        return YES
    return NO if any(w in AGAINST for w in words) else ABSTAIN


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    found = text[start:end]
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return (YES if strict else ABSTAIN, _check(kind, found), _gazetteer(kind, found),
            _context(kind, text[max(0, start - 40): start]), YES if edge else NO)


def features(text: str, start: int, end: int) -> tuple[int, int, int]:
    """Digit count (in steps of four, up to 5), separators (0 none, 1 one kind, 2 more), a plus sign in front."""
    found = text[start:end]
    kinds = {c for c in found if not c.isalnum()} - {"+"}
    return min(len(_digits(found)) // 4, 5), min(len(kinds), 2), int(found.startswith("+"))


def code_of(kind: int, vote: tuple[int, ...], feature: tuple[int, int, int]) -> int:
    code = kind
    for v in vote:
        code = code * 3 + v
    return ((code * 6 + feature[0]) * 3 + feature[1]) * 2 + feature[2]


def decode_code(code: int) -> tuple[int, tuple[int, ...], tuple[int, int, int]]:
    code, plus = divmod(code, 2)
    code, separators = divmod(code, 3)
    code, digits = divmod(code, 6)
    vote = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        vote.append(v)
    return code, tuple(reversed(vote)), (digits, separators, plus)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and looser spans that are no base span of their kind."""
    if not _ANCHOR.search(text) and not _SPELLED.search(text):
        return [], []
    base = base_spans(text)
    known = set(base)
    return base, [s for s in loose_spans(text) if s not in known]


# --- models on the driver, over vote patterns ------------------------------------

def em_probabilities(patterns: dict[int, int], rounds: int = 40) -> dict[int, float]:
    """Probability of each pattern to be personal data (two classes, votes
    independent given the class; a labeler that abstains says nothing)."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        codes = [c for c in sorted(patterns) if decode_code(c)[0] == kind]
        if not codes:
            continue
        vote = np.array([decode_code(c)[1] for c in codes])
        n = np.array([patterns[c] for c in codes], dtype=float)
        said = (vote != ABSTAIN).sum(axis=1)
        p = np.where(said > 0, ((vote == YES).sum(axis=1) + 0.5) / (said + 1.0), 0.5)
        for _ in range(rounds):
            prior = np.clip(((n * p).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
            log_odds = np.full(len(codes), np.log(prior / (1 - prior)))
            for j in range(vote.shape[1]):
                # smoothed towards a labeler that is right four times in five
                yes, no = vote[:, j] == YES, vote[:, j] == NO
                right = ((n * p)[yes].sum() + 8) / ((n * p)[yes | no].sum() + 10)
                wrong = ((n * (1 - p))[yes].sum() + 2) / ((n * (1 - p))[yes | no].sum() + 10)
                log_odds += np.where(yes, np.log(right / wrong), 0) + np.where(no, np.log((1 - right) / (1 - wrong)), 0)
            p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        out.update(zip(codes, p.tolist(), strict=True))
    return out


def _vector(code: int) -> np.ndarray:
    kind, vote, (digits, separators, plus) = decode_code(code)
    x = np.zeros(16)
    x[0] = 1
    for j, v in enumerate(vote[1:]):  # what the labelers look at, without the strict pattern
        x[1 + 2 * j] = v == YES
        x[2 + 2 * j] = v == NO
    x[9 + min(digits, 3)] = 1
    x[13 + min(separators, 1)] = 1
    x[15] = plus
    return np.concatenate([x if k == kind else np.zeros(16) for k in range(len(KINDS))])


def train_classifier(patterns: dict[int, int], probabilities: dict[int, float], steps: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression on the patterns' probabilities (accelerated gradient descent)."""
    weights = np.zeros(16 * len(KINDS))
    if not patterns:
        return weights
    codes = sorted(patterns)
    x = np.array([_vector(c) for c in codes])
    y = np.array([probabilities[c] for c in codes])
    n = np.array([patterns[c] for c in codes], dtype=float)
    kinds = np.array([decode_code(c)[0] for c in codes])
    n /= np.array([n[kinds == k].sum() if (kinds == k).any() else 1 for k in range(len(KINDS))])[kinds]
    ahead = weights.copy()
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - 1.0 * (x.T @ (n * (p - y)) + l2 * ahead)
        ahead = new + step / (step + 3) * (new - weights)
        weights = new
    return weights


def pattern_probability(code: int, weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(_vector(code) @ weights, -30, 30))))


# --- Spark ----------------------------------------------------------------------

def _pattern_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            for text in batch.column("text").slice(start, 256).to_pylist():
                base, loose = candidates(text or "")
                for strict, spans in ((True, base), (False, loose)):
                    for kind, a, b in spans:
                        counts[code_of(kind, votes(text, kind, a, b, strict), features(text, a, b))] += 1
    if counts:
        yield pa.RecordBatch.from_pydict({"code": list(counts), "n": list(counts.values())})


def learn(docs: DataFrame) -> np.ndarray:
    """Span classifier weights from all texts of ``docs``."""
    counted = docs.select("text").mapInArrow(_pattern_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    patterns = {r["code"]: r["n"] for r in counted.collect()}  # at most one row a vote pattern
    return train_classifier(patterns, em_probabilities(patterns))


def added_spans(text: str, base: list, loose: list, weights: np.ndarray, threshold: float, known: dict[int, float]) -> list[tuple[int, int, int]]:
    taken, added = [(a, b) for _, a, b in base], []
    for kind, a, b in loose:
        if any(a < d and c < b for c, d in taken):
            continue
        code = code_of(kind, votes(text, kind, a, b, False), features(text, a, b))
        if code not in known:
            known[code] = pattern_probability(code, weights)
        if known[code] >= threshold:
            added.append((kind, a, b))
            taken.append((a, b))
    return added


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _span_batches(weights: np.ndarray, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = []
                for text in part.column("text").to_pylist():
                    base, loose = candidates(text or "")
                    added = added_spans(text, base, loose, weights, threshold, known) if loose else []
                    n = Counter(k for k, _, _ in base)
                    rows.append((*[n[k] for k in range(len(KINDS))], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                                 ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def find(docs: DataFrame, weights: np.ndarray | None = None, threshold: float = 0.9) -> DataFrame:
    """Per input row: doc_id, base counts by kind, the digest of the base
    spans, all spans (``kind:start:end``) and how many the method added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_span_batches(learn(docs) if weights is None else weights, threshold), SPANS)
