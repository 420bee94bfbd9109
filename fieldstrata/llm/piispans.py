"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates are the base matches (email, ip, card, phone; they always stay), looser ones of the same kinds (mail
addresses written with " at " and " dot ", digit groups that look like cards or phone numbers but fail the base rule,
dotted quads with a part over 255) and secrets: values given to a name such as token or password, and long runs that
mix letters and digits. Regular-expression, gazetteer and context labelers each vote for (1), against (0) or
abstain (-1) on every candidate. Votes are counted by pattern over all documents; the pattern table is bounded (three to
the power of the labelers, for each kind), so expectation-maximisation for the labelers' reliabilities runs on it
alone. Its posteriors, with shape features of the spans on a bounded grid, train a logistic classifier over the counts of
all candidates, whose verdict adds candidates that overlap no span taken before (a secret may contain one).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, doc_columns, rows_of, staged, texts

KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
#: The base patterns (fixed values).
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Looser patterns.
SPELT = re.compile(r"(?<![\w.])[\w.+-]{2,} ?[\[(]at[\])] ?[\w-]{2,40}(?: ?[\[(]dot[\])] ?[a-z]{2,10}){1,3}(?!\w)|(?<![\w.])[\w.+-]{2,40} at [\w-]{2,40}(?: dot [a-z]{2,10}){1,3}(?!\w)", re.I)
LOCAL_PHONE = re.compile(r"(?<![\w+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w.-])")
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)[\"']?\s*(?:[:=]|\bis\b)\s*[\"']?([A-Za-z0-9_+/=.!@#$%^&*-]{8,})")
GIVEN = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer|credentials?)[\"']?\s*(?:[:=]|\bis\b)\s*[\"']?")
MIXED = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
#: Gazetteers (fixed values).
DOMAIN_ENDS = frozenset("com org net edu gov io co de fr es uk eu info biz".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "65", "35", "30", "36", "38", "22")
COUNTRY_CODES = ("1", "33", "34", "44", "49", "39", "31", "41", "43", "61", "81", "86", "91", "55", "52", "7")
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk_", "xox", "AIza", "eyJ", "glpat-")
HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
#: Words that stand near personal data (fixed values).
CUES = {
    "email": re.compile(r"e-?mail|contact|write|reach|@|adresse|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|logged|ping", re.I),
    "card": re.compile(r"card|visa|credit|pay|karte|carte|tarjeta|account", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|key|auth|bearer|credential|login", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|whatsapp|contact|number|anruf|appel", re.I),
}
LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: around each @, as far left as an address reaches after the one before."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of base matches, and of matches that the base rules drop."""
    good, poor = [(a, b, "email") for a, b in emails(text)], []
    for m in IP.finditer(text):
        (good if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")) else poor).append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        d = only_digits(m.group())
        if 14 <= len(d) <= 19:
            (good if luhn(d) else poor).append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        d = only_digits(m.group())
        if 10 <= len(d) <= 15:
            good.append((*m.span(), "phone"))
        elif 7 <= len(d) < 10:
            poor.append((*m.span(), "phone"))
    return good, poor


def secrets(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a name is given this value): assigned values, and other long runs of letters and digits."""
    taken: list[tuple[int, int]] = []
    for m in ASSIGNED.finditer(text):
        a, b = m.span(1)
        while b > a and text[b - 1] in ".!":  # the end of a sentence
            b -= 1
        if b - a >= 8:
            taken.append((a, b))
            yield a, b, True
    for m in MIXED.finditer(text):
        a, b = m.span()
        run = text[a:b]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not any(x < b and a < y for x, y in taken):
            yield a, b, False


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    good, poor = base_spans(text)
    if "at" in text and ("dot" in text or "DOT" in text):
        poor += [(*m.span(), "email") for m in SPELT.finditer(text)]
    poor += [(*m.span(), "phone") for m in LOCAL_PHONE.finditer(text)]
    return good, poor + [(a, b, "secret") for a, b, _ in secrets(text)]


def votes(text: str, start: int, end: int, kind: str, strict: bool) -> tuple[int, ...]:
    """Of the labelers: strict pattern, loose shape, gazetteer, context, surroundings. 1 for, 0 against, -1 abstains."""
    span, digits = text[start:end], only_digits(text[start:end])
    if kind == "secret":
        before = text[max(0, start - 60) : start]
        strict = any(m.end() >= len(before) - 1 for m in GIVEN.finditer(before))
    shape = {"secret": len(span) >= 16 and len(set(span)) >= 8 and bool(digits) and len(digits) < len(span), "email": "@" in span or "dot" in span.lower(), "ip": all(len(x) <= 3 for x in span.split(".")), "card": len(digits) in (15, 16), "phone": 9 <= len(digits) <= 13}[kind]
    if kind == "email":
        known = 1 if span.lower().rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip("])") in DOMAIN_ENDS else -1
    elif kind == "secret":
        known = 1 if span.startswith(KEY_STARTS) or HEX.fullmatch(span) else -1
    elif kind == "card":
        known = int(digits.startswith(CARD_STARTS))
    elif kind == "phone":
        known = (1 if digits.startswith(COUNTRY_CODES) else 0) if span[0] == "+" else -1
    else:
        known = 0 if digits.startswith("0") else -1
    near = text[max(0, start - 40) : start]
    cue = 1 if CUES[kind].search(near) else -1
    around = 0 if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) else 1
    return int(strict), int(shape), known, cue, around


def shape_features(span: str, kind: str) -> list[float]:
    """Each on a grid of few values, so that the table of distinct features is bounded whatever the number of spans."""
    digits, few = len(only_digits(span)), lambda n, step, most: min(n // step, most) / most
    return [1.0, *(float(kind == k) for k in EVERY), few(len(span), 4, 12), few(digits, 2, 10), round(4 * digits / max(len(span), 1)) / 4, few(sum(c in " -.()" for c in span), 1, 4), float(span[:1] == "+"), float("@" in span), few(len(set(span)), 3, 8)]


SPAN = "array<struct<start:int,end:int,kind:string,base:boolean,votes:array<tinyint>,shape:array<float>>>"


def voted(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: its candidates with votes and features. Null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("votes", pa.list_(pa.int8())), ("shape", pa.list_(pa.float32()))]))
        for batch in rows_of(batches):
            rows = []
            for t in texts(batch):
                good, poor = candidates(t)
                rows.append([{"start": a, "end": b, "kind": k, "base": base, "votes": votes(t, a, b, k, base), "shape": shape_features(t[a:b], k)} for base, spans in ((True, good), (False, poor)) for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return doc_columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id bigint, spans {SPAN}")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over (votes, count): (share of true spans, P(vote 1 | true), P(vote 1 | not)) of each labeler, abstentions ignored."""
    v = np.array([p for p, _ in patterns]).reshape(-1, LABELERS)
    n = np.array([c for _, c in patterns], np.float64)
    share, hit, alarm = 0.5, np.full(LABELERS, 0.8), np.full(LABELERS, 0.3)
    for _ in range(rounds):
        q = posteriors(v, share, hit, alarm)
        share = float(np.clip((n * q).sum() / max(n.sum(), 1), 0.02, 0.98))
        for j in range(LABELERS):
            cast, yes = v[:, j] >= 0, v[:, j] == 1
            hit[j] = ((n * q)[yes].sum() + 4) / ((n * q)[cast].sum() + 5)
            alarm[j] = ((n * (1 - q))[yes].sum() + 1) / ((n * (1 - q))[cast].sum() + 5)
        hit, alarm = np.clip(hit, 0.02, 0.98), np.clip(alarm, 0.02, 0.98)
    return share, hit, alarm


def posteriors(v: np.ndarray, share: float, hit: np.ndarray, alarm: np.ndarray) -> np.ndarray:
    z = math.log(share / (1 - share)) + np.where(v == 1, np.log(hit / alarm), np.where(v == 0, np.log((1 - hit) / (1 - alarm)), 0.0)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def vector(votes_: list[int], shape: list[float]) -> np.ndarray:
    v = np.array(votes_)
    return np.concatenate([np.array(shape, np.float64), (v == 1).astype(float), (v == 0).astype(float)])


def train(x: np.ndarray, q: np.ndarray, n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights for probabilistic targets q, by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - q)) + 1.0 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def span_model(found: DataFrame) -> dict[str, np.ndarray]:
    """Weights by kind. Reliabilities come from the votes of all spans, the classifier from all distinct (votes, shape) rows
    with their counts; both tables are bounded by the grid of votes and shapes, not by the number of spans."""
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.shape")
    rows = sorted(spans.groupBy("kind", "votes", "shape").count().collect(), key=lambda r: (r["kind"], r["votes"], r["shape"]))
    out = {}
    for k in EVERY:
        mine = [r for r in rows if r["kind"] == k]
        if mine:
            counts: dict[tuple[int, ...], int] = {}
            for r in mine:
                counts[tuple(r["votes"])] = counts.get(tuple(r["votes"]), 0) + r["count"]
            q = posteriors(np.array([r["votes"] for r in mine]), *reliabilities(sorted(counts.items())))
            n = np.array([r["count"] for r in mine], np.float64)
            out[k] = train(np.array([vector(r["votes"], r["shape"]) for r in mine]), q, n / n.mean())
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], EVERY.index(s[2]), s[1])))


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_secret.

    spans lists kind:start:end of all spans by start, then kind (code points, end exclusive): every base span, and
    candidates that the classifier takes and that overlap no span taken before, where a secret may contain spans. Ties go
    to the earlier candidate: looser kinds in their order in the text, then secrets. base_sha256 is the digest of the same list of
    the base spans alone. Null and empty texts have none. Null and repeated doc_ids are rows like any others; other
    columns are ignored; an empty table gives no rows.
    """
    found = staged(voted(docs), "spans")
    weights = span_model(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists, added, hidden = [], [], [], [], []
            for spans in column(batch, "spans").to_pylist():
                base = [(s["start"], s["end"], s["kind"]) for s in spans if s["base"]]
                every = list(base)
                for s in spans:
                    inside = lambda a, b: s["kind"] == "secret" and s["start"] <= a and b <= s["end"]  # noqa: B023, E731
                    if not s["base"] and not any(a < s["end"] and s["start"] < b and not inside(a, b) for a, b, _ in every):
                        z = float(vector(s["votes"], s["shape"]) @ weights[s["kind"]]) if s["kind"] in weights else -1.0
                        if z >= math.log(threshold / (1 - threshold)):
                            every.append((s["start"], s["end"], s["kind"]))
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(every))
                added.append(len(every) - len(base))
                hidden.append(sum(k == "secret" for _, _, k in every))
            cols = list(zip(*counts, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(added, pa.int64()), pa.array(hidden, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret"])

    return found.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_secret bigint")
