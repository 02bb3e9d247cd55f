"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) are reported as matched. The method adds bank account numbers (IBAN, confirmed by
mod-97) and spans that only their context makes personal (national ids and birth dates next to a cue word). Rows
without '@' and without a digit cannot hold a span and never leave the JVM.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "birth_date")

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Lengths of account numbers by country, as registered; other countries may have any length from 15 to 34.
_IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in cs.split()}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DATE = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9])")

#: Cue words for the scores, by kind.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "birth_date": ("born", "birth", "dob", "birthday", "geboren", "nacimiento", "naissance"),
}
#: Score without a cue, and what a cue adds; a span of a method kind is reported from REPORT on.
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.4, "birth_date": 0.2}
CUE_BONUS, WINDOW, REPORT = 0.4, 40, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    rest = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str):
    """Leftmost matches without trying each start: a match's local part is the whole run before its '@'."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str):
    """The pattern takes along what follows a number, so each end of a token is tried: the country's length first, then the longest."""
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        ends = [m.end(), *(start + k for k, c in enumerate(m.group()) if c == " ")]
        accounts = [(text[start:end].replace(" ", ""), end) for end in ends]
        for account, end in sorted(accounts, key=lambda x: (len(x[0]) != _IBAN_LENGTHS.get(x[0][:2]), -x[1])):
            if 15 <= len(account) <= 34 and mod97(account):
                yield start, end
                at = end
                break


def _plain(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "national_id": _plain(_NATIONAL), "birth_date": _plain(_DATE)}
_HAS_DIGIT = re.compile("[0-9]")


def score(text: str, kind: str, start: int, end: int) -> float:
    """The pattern's own weight, raised if a cue word stands within WINDOW characters before or after the span."""
    near = f"{text[max(0, start - WINDOW) : start]} {text[end : end + WINDOW]}".lower()
    cued = any(re.search(rf"(?<!\w){re.escape(c)}(?!\w)", near) for c in CUES[kind])
    return min(1.0, START[kind] + CUE_BONUS * cued)


def find_spans(text: str | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind in the order of KINDS; code points, end exclusive."""
    found = []
    digits = bool(text) and _HAS_DIGIT.search(text) is not None
    for rank, kind in enumerate(KINDS):
        if text and (digits or kind == "email"):
            for start, end in _FINDERS[kind](text):
                s = score(text, kind, start, end)
                if kind in BASE or s >= REPORT:
                    found.append((start, rank, end, kind, s))
    return [(start, end, kind, s) for start, _, end, kind, s in sorted(found)]


def spell(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def redact_text(text: str, spans) -> str:
    """Each span (overlaps merged) gives way to <KIND> of the first of them."""
    out, at = [], 0
    for start, end, kind, *_ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _candidates(text):
    return F.when(text.rlike("[@0-9]"), text)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
_SPAN_DDL = "array<struct<start:int,end:int,kind:string,score:double>>"


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of start, end, kind, score) per row of docs, repeated rows and null ids included.

    Null and empty texts have no spans. Other columns of docs are not read.
    """
    def find(batches):
        for b in batches:
            rows = [[{"start": s, "end": e, "kind": k, "score": x} for s, e, k, x in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, _SPANS)], names=["id", "spans"])

    slim = docs.select(F.col(id_col).alias("id"), _candidates(F.col(text_col)).alias("text"))
    return slim.mapInArrow(find, f"id {slim.schema['id'].dataType.simpleString()}, spans {_SPAN_DDL}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by <KIND>; all columns and all rows stay, null texts stay null.

    An n_chars column, if there is one, gets the new length. One pass: texts without '@' and digits go through unread.
    """
    def rewrite(batches):
        for b in batches:
            text = b.column(at)
            touched = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, "[@0-9]"), False).to_numpy(zero_copy_only=False))
            if len(touched):
                new = [redact_text(t, find_spans(t)) for t in text.take(pa.array(touched)).to_pylist()]
                mask = np.zeros(b.num_rows, dtype=bool)
                mask[touched] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    names = docs.columns
    at = names.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    out = plain.mapInArrow(rewrite, plain.schema).toDF(*names)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans, all spans and the highest score (0 without spans)."""
    empty = hashlib.sha256(b"").hexdigest()
    spans = pii_spans(docs, id_col, text_col)
    is_base = lambda s: s["kind"].isin(*BASE)
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.when(F.size("spans") == 0, F.lit(empty)).otherwise(F.sha2(F.array_join(F.transform(F.filter("spans", is_base), one), ","), 256)).alias("base_sha256"),
        F.array_join(F.transform("spans", one), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
