import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(n(m)) <= 19 and slow_luhn(n(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(n(m)) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("a1@.-+ (%é", max_size=40), st.text("0123456789.- ", max_size=60), st.text("+0123456789()- .", max_size=50)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_known_cases():
    text = "mail a.b@c.example.org. or x@y@z.example.com, 10.0.0.255 1.2.3.256 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (555) 010-9999"
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)] == [(pii.KINDS[k], text[a:b]) for a, k, b in brute(text)]
    assert [text[a:b] for a, k, b in pii.base_spans(text) if k == 0] == ["a.b@c.example.org", "y@z.example.com"]


def test_odd_texts_are_not_slow():
    for text in ("a" * 200_000 + "@", "a@" * 100_000, "1" * 200_000, "1." * 100_000, "+1" * 50_000, "9 " * 100_000):
        pii.base_spans(text)


def test_table_equals_brute_force(make_docs, sample):
    got = {r.doc_id: r for r in pii.report(make_docs(sample)).collect()}
    for i, text in sample:
        want = brute(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[1] == k for w in want) for k in range(4)]
        assert set(line.split(",")) - {""} <= set(got[i].spans.split(","))


def test_contexts_find_unseen_identifiers(make_docs):
    """Numbers that fail the check digit stand where valid cards stand; other numbers don't."""
    valid = [n for n in range(4111111111110000, 4111111111112000) if slow_luhn(str(n))]
    docs = [(k, f"pay by card number {n} before friday please {k}") for k, n in enumerate(valid[:60])]
    docs += [(1000, "pay by card number 4111111111119999 before friday please"), (1001, "the year 1234567890123456 was long ago and far")]
    got = {r.doc_id: r.spans for r in pii.report(make_docs(docs)).collect()}
    assert got[1000] == "card:19:35" and got[1001] == ""
    assert got[0].startswith("card:19:35")
    masked = {r.doc_id: r.text for r in pii.mask(make_docs(docs)).collect()}
    assert masked[1000] == "pay by card number [CARD] before friday please"
    assert masked[1001] == docs[-1][1]


def test_mixed_contexts_find_nothing(make_docs):
    valid = [n for n in range(4111111111110000, 4111111111111000) if slow_luhn(str(n))]
    docs = [(k, f"this is number {n} of the list") for k, n in enumerate(valid[:20])]
    docs += [(100 + k, f"this is number {4111111111110001 + 10 * k} of the list") for k in range(60)]
    for r in pii.report(make_docs(docs)).collect():
        assert r.spans == ("card:15:31" if r.n_card else "")


def test_odd_rows(odd_docs, no_docs, crowded_names, make_docs):
    rows = pii.report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == "" for r in rows)
    assert pii.report(no_docs).count() == 0 and pii.mask(no_docs).count() == 0
    assert sorted(pii.mask(crowded_names).collect()) == sorted(crowded_names.collect())
    twice = make_docs([(1, "at 10.1.1.1 now"), (1, "at 10.1.1.1 now"), (None, "é 10.1.1.1")])
    assert sorted(r.spans for r in pii.report(twice).collect()) == ["ip:2:10", "ip:3:11", "ip:3:11"]
    assert {r.text for r in pii.mask(twice).collect()} == {"at [IP] now", "é [IP]"}


def test_contexts_find_other_forms_of_a_kind(make_docs):
    """Local phones, e-mails without a domain and short cards where known ones stand; a pattern with other numbers finds none."""
    valid = [n for n in range(4111111111110000, 4111111111112000) if slow_luhn(str(n))]
    docs = [(k, f"just call me on +1 555 010 {1000 + k} after lunch {k}") for k in range(30)]
    docs += [(100 + k, f"please write to user{k}@example.org about it {k}") for k in range(30)]
    docs += [(200 + k, f"pay by card number {n} before friday") for k, n in enumerate(valid[:30])]
    docs += [(300 + k, f"we saw item +1 555 020 {1000 + k} in stock") for k in range(30)] + [(400 + k, f"we saw item {k} in stock") for k in range(30)]
    want = {}
    for k in range(15):
        for base, text, kind, token in (
            (500, "just call me on {} after lunch", "phone", f"555-010-{9900 + k}"),
            (600, "just call me on {} after lunch", "phone", f"(555) 010 {9900 + k}"),
            (700, "please write to {} about it", "email", f"root{k}@localhost"),
            (800, "pay by card number {} before friday", "card", f"42222222222{10 + k}"),
            (900, "we saw item {} in stock", "", f"555-030-{9900 + k}"),
        ):
            docs.append((base + k, text.format(token)))
            a = docs[-1][1].index(token)
            want[base + k] = f"{kind}:{a}:{a + len(token)}" if kind else ""
    got = {r.doc_id: r.spans for r in pii.report(make_docs(docs)).collect()}
    assert {i: got[i] for i in want} == want
    masked = {r.doc_id: r.text for r in pii.mask(make_docs(docs)).collect()}
    assert masked[600] == "just call me on [PHONE] after lunch"
