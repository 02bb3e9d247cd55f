import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwarden.llm import pii


def brute(text):
    """The base kinds by the plain patterns, leftmost and not overlapping."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0 or 12 <= len(d) <= 19 and not any(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def base(text):
    return [(s, e, k) for s, e, k, _ in pii.find_spans(text) if k in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ0159.@+-_% ()é\n", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base(text) == brute(text)


def test_cases():
    text = "Mail a.b@c.org.uk, a@b.c_d@e.f or 10.0.0.1, 1.2.3.4.5.6.7.8, 999.1.1.1; card 4111 1111 1111 1111, +44 (20) 7946-0958."
    assert base(text) == brute(text)
    assert [k for *_, k in base(text)] == ["email", "email", "email", "ip", "ip", "ip", "card", "phone"][: len(base(text))]
    assert base("4111 1111 1111 1112") == [] and base(None) == [] and base("") == []
    assert base("1" * 50_000) == [] and base("a" * 50_000 + "@") == []


def test_method_adds_confirmed_and_cued_spans():
    kinds = lambda t: [k for *_, k, _ in pii.find_spans(t)]
    assert "iban" in kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") and "iban" not in kinds("GB83 WEST 1234 5698 7654 32")
    assert "national_id" in kinds("ssn 123-45-6789") and "national_id" not in kinds("part 123-45-6789")
    assert "birth_date" in kinds("born 1980-02-03") and "birth_date" not in kinds("on 1980-02-03")
    assert pii.score("call +44 20 7946 0958", "phone", 5, 21) > pii.score("what +44 20 7946 0958", "phone", 5, 21)


def test_account_numbers_end_where_other_tokens_follow():
    found = lambda t: [t[s:e] for s, e, k, _ in pii.find_spans(t) if k == "iban"]
    number = "DE89 3704 0044 0532 0130 00"
    for after in (" BIC COBADEFF", " 2024 now", " EUR 100", "", ".", " ok"):
        assert found(f"IBAN {number}{after}") == [number]
    assert found("DE89370400440532013000 2024 now") == ["DE89370400440532013000"]
    assert found("NO93 8601 1117 947 NO93 8601 1117 947") == ["NO93 8601 1117 947"] * 2
    assert found("AB12 CDEF NO93 8601 1117 947") == ["NO93 8601 1117 947"]
    assert found("DE88 3704 0044 0532 0130 00 BIC COBADEFF") == []
    text = f"pay {number} BIC COBADEFF"
    assert pii.redact_text(text, pii.find_spans(text)) == "pay <IBAN> BIC COBADEFF"


def test_digest_and_redaction(spark, docs, rows, empty):
    got = pii.pii_digest(docs).collect()
    assert len(got) == len(rows) and pii.pii_digest(empty).count() == 0
    texts = {}
    for r in rows:
        texts[r[0]] = r[1]
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in want) for x in pii.BASE)
    some = spark.createDataFrame([(1, "write to a@b.co now", 19), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(some).collect()}
    assert out[1].text == "write to <EMAIL> now" and out[1].n_chars == len(out[1].text) and out[2].text is None and out[3].text == "clean"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == len(rows)
