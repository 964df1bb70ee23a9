"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Base kinds (email, ip, card, phone) follow fixed patterns and always stay. The method
adds further kinds: ``iban`` (mod-97), ``ssn`` and ``secret`` tokens. A proposed span
starts with the score of its kind; a passed checksum and context words within
``CONTEXT_CHARS`` code points before or after it raise the score, and an added span stays
from ``MIN_SCORE`` on. Every pattern runs in time linear in the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import pyarrow as pa

from flightlake.llm.common import map_rows, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT_CHARS = 40
MIN_SCORE = 0.6

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": re.compile(r"mail|contact|correo|courriel|kontakt", re.I),
    "ip": re.compile(r"\bipv?4?\b|address|adresse|server|host|client", re.I),
    "card": re.compile(r"card|karte|carte|tarjeta|visa|credit|payment", re.I),
    "phone": re.compile(r"phone|fon\b|\btel\b|t[eé]l[eéè]|\bfax|call|mobil", re.I),
    "iban": re.compile(r"iban|account|bank|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
    "secret": re.compile(r"token|secret|passw|api[_ -]?key|bearer|credential", re.I),
}
#: Score of a proposed span before checks and context, and what context adds.
START = {"email": 0.9, "ip": 0.7, "card": 0.7, "phone": 0.6, "iban": 0.5, "ssn": 0.4, "secret": 0.2}
CONTEXT_ADDS = {kind: 0.1 for kind in BASE_KINDS} | {kind: 0.4 for kind in ADDED_KINDS}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    if "@" not in text:
        return
    end = 0
    at = text.find("@")
    while at >= 0:
        # The local part is the whole run before the sign, back to the last match.
        start = at
        while start > end and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _proposed(text: str):
    for m in _IBAN.finditer(text):
        yield "iban", m.start(), m.end(), 0.4 if mod97(m[0].replace(" ", "")) else -0.5
    for m in _SSN.finditer(text):
        a, b, c = m[0].split("-")
        yield "ssn", m.start(), m.end(), 0.0 if a not in ("000", "666") and a < "900" and b != "00" and c != "0000" else -0.4
    for m in _SECRET.finditer(text):
        mixed = any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0]))
        yield "secret", m.start(), m.end(), 0.1 if mixed else -0.2


def _score(text: str, kind: str, a: int, b: int, checked: float) -> float:
    """Start of the kind, the check's part, and context on either side of the span."""
    words = CONTEXT[kind]
    near = words.search(text, max(0, a - CONTEXT_CHARS), a) or words.search(text, b, b + CONTEXT_CHARS)
    return round(min(1.0, START[kind] + checked + (CONTEXT_ADDS[kind] if near else 0.0)), 3)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in ``KINDS``, then start; code points, end exclusive."""
    out = [(kind, a, b, _score(text, kind, a, b, 0.2 if kind == "card" else 0.0)) for kind, a, b in base_spans(text)]
    base = sorted((a, b) for _, a, b, _ in out)
    added = {kind: [] for kind in ADDED_KINDS}
    at = reach = 0
    for kind, a, b, checked in sorted(_proposed(text), key=lambda s: s[1]):
        while at < len(base) and base[at][0] <= a:
            at, reach = at + 1, max(reach, base[at][1])
        if reach >= b:
            continue  # a base span already covers it whole
        score = _score(text, kind, a, b, checked)
        if score >= MIN_SCORE:
            added[kind].append((kind, a, b, score))
    return out + [s for kind in ADDED_KINDS for s in added[kind]]


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """``text`` with every span replaced by its kind, as ``<EMAIL>``; overlapping spans merge into one."""
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, end, score), redacted.

    A null text is empty and has no spans. Rows with one id are handled each on its own;
    an empty table gives no rows; further columns of ``docs`` are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("redacted", pa.string())])

    def run(rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            spans = find_spans(r["body"])
            out.append({"doc_id": r["doc_id"], "spans": [dict(zip(("kind", "start", "end", "score"), s)) for s in spans], "redacted": redact(r["body"], spans)})
        return out

    ddl = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>, redacted string"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body")), run, schema, ddl)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars`` to match; columns and rows stay, null texts too.

    Repeated rows and rows without an id are each handled on their own, further columns stay
    as they are whatever their names, and an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for i in range(batch.num_rows):
                t = batch.column(at)[i].as_py()
                texts.append(t if t is None else redact(t, find_spans(t)))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns of every row of ``docs``, and ``scores`` in the order of ``spans``.

    A null text is empty: no spans, counts of 0, the digest of the empty text. Repeated rows
    each give a row; an empty table gives none; further columns of ``docs`` are ignored.
    """
    found = detect(docs)
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))
