import datetime as dt
import re

import pytest

from conftest import SF0001
from llm_fixture import EDGES, edge_docs
from pdcspark.llm import pii
from pdcspark.llm.queries import PII_KEY, QUERIES

P = pii.Pseudonyms(PII_KEY)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    assert sorted(pii.permute(i, size, PII_KEY, "t") for i in range(size)) == list(range(size))
    big = 26**5 * 10**9
    assert len({pii.permute(i, big, PII_KEY, "t") for i in range(300)}) == 300


@pytest.mark.parametrize(("kind", "text", "shape"), [
    ("email", "ann.34@mail7.example.com", r"[a-z]{3}\.\d\d@mail7\.example\.com"),
    ("phone", "+1 (017) 555-7713", r"\+1 \(\d{3}\) \d{3}-\d{4}"), ("phone", "(415) 555-1234", r"\(\d{3}\) \d{3}-\d{4}"),
    ("phone", "+442071838750", r"\+44\d{10}"), ("ip", "192.168.1.77", r"(\d{1,3}\.){3}\d{1,3}"),
    ("card", "4539148803436467", r"\d{16}"), ("card", "4539 1488 0343 6467", r"(\d{4} ){3}\d{4}"),
    ("iban", "GB82 WEST 1234 5698 7654 32", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"), ("ssn", "123-45-6789", r"\d{3}-\d\d-\d{4}"),
    ("date", "2001-02-28", r"\d{4}-\d\d-\d\d"), ("date", "31.12.1999", r"\d\d\.\d\d\.\d{4}"), ("date", "25/12/2001", r"\d\d/\d\d/\d{4}"),
    ("secret", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', r'token = "[0-9a-z]{40}"'),
])
def test_formats_and_links(kind, text, shape):
    new, counts = P.text(f"###{text}, and {text}!!")
    found = re.fullmatch(rf"###({shape}), and ({shape})!!", new)
    assert found and new != f"###{text}, and {text}!!"
    assert counts[pii.KINDS.index(kind)] == 2 and sum(counts) == 2
    once = P.text(text)[0]
    assert new == f"###{once}, and {once}!!"  # equal values stay linked
    assert pii.Pseudonyms(b"another key of 16+").text(text)[0] != once
    if kind == "card":
        digits = re.sub(r"\D", "", once)
        assert pii.luhn_digit(digits[:-1]) == digits[-1]
        assert digits == P.text("4539148803436467")[0]
    if kind == "iban":
        assert pii._mod97(once.replace(" ", "")) == 1
    if kind == "date" and "-" in text:
        dt.date.fromisoformat(once)


@pytest.mark.parametrize("text", [
    "plain text.", "4539148803436468", "999.1.1.1", "1.2.3.4.5", "2001-02-29", "000-12-3456", "v1.2.3", "a@b", "token of", "tokens: aaaaaaaaaaaaaaaaaaaa",
    "1111111111111111", "", None, "x" * 100_000 + "@", "0" * 100_000, "1-" * 50_000, "12 " * 50_000])
def test_what_is_not_valid_stays(text):
    assert P.text(text) == (text, [0] * len(pii.KINDS))


def test_a_day_is_one_value_in_every_spelling():
    key = pii.Pseudonyms(PII_KEY)

    def days(y, m, d):
        new = [key.text(t)[0] for t in (f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d:02d}-{m:02d}-{y}", f"{m:02d}/{d:02d}/{y}")]
        read = [dt.datetime.strptime(t, f).date() for t, f in zip(new, ("%Y-%m-%d", "%d.%m.%Y", "%d-%m-%Y", "%m/%d/%Y"), strict=True)]
        if d > 12:
            read.append(dt.datetime.strptime(key.text(f"{d}/{m:02d}/{y}")[0], "%d/%m/%Y").date())
        return read

    for given in ((2020, 5, 20), (2020, 5, 6), (1999, 12, 31), (2000, 2, 29), (1900, 1, 1)):
        assert len(set(days(*given))) == 1
    every = [dt.date(2001, 1, 1) + dt.timedelta(i) for i in range(730)]
    new = [key.text(d.isoformat())[0] for d in every]
    assert len(set(new)) == 730 and all((int(n[8:]) > 12) == (d.day > 12) for n, d in zip(new, every, strict=True))


def test_addresses_are_linked_whatever_their_case():
    names = [P.text(t)[0] for t in ("ann.lee@x.com", "Ann.Lee@x.com", "ANN.LEE@X.com")]
    assert names[0] != "ann.lee@x.com" and names[1] == names[0].title().replace("X.Com", "x.com") and names[2] == names[0].upper().replace(".COM", ".com")
    assert P.text("anm.lee@x.com")[0] != names[0]
    assert P.text("password: annie99@x.com")[0] == "password: " + P.text("annie99@x.com")[0]


@pytest.mark.parametrize(("text", "found"), [
    ("token=abcdefghijklmnopqrstuvwxyz", True), ("api_key: QwErTyUiOpAsDfGhJkLz", True), ("password: hunter2", True), ("token: 24be64439e3e49cf", True),
    ("secret: internationalization", False), ("token: aaaaaaaaaaaaaaaaaaaaaaaaaaaa", False), ("secret: /usr/local/share/documents/plain", False),
    ("password: required", False), ("password: 20201231", False), ("token: hunter2", False), ("secret = some-well-known-words-joined", False)])
def test_secrets_without_digits_and_passwords(text, found):
    new, counts = P.text(text)
    assert (new != text) == found and counts[pii.KINDS.index("secret")] == found and len(new) == len(text)


def test_a_value_within_what_looked_like_another():
    assert P.text("ab12 4539148803436467 190")[1][pii.KINDS.index("card")] == 1


def test_edges(spark):
    rows = [*EDGES, (9, "mail ann.34@mail7.example.com now", "en", "a"), (10, "mail ann.34@mail7.example.com now", "en", "a")]
    docs = edge_docs(spark, rows)
    got = pii.pseudonymised(docs, PII_KEY).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(P.text(t)[0])) for i, t, _, _ in rows)
    assert sum(r.n_found for r in got) == 2
    assert pii.pseudonymised(edge_docs(spark, []), PII_KEY).count() == 0
    new = pii.replaced_text(docs, PII_KEY)
    assert new.columns == docs.columns and new.where("n_chars <> length(text)").count() == 0


def test_op10_leaves_no_private_value_and_clean_texts_alone(spark):
    private = re.compile(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    for r in QUERIES["op10_pii_pseudonyms"](spark, SF0001).collect():
        found = private.findall(texts[r.doc_id] or "")
        assert not any(value in r.text for value in found)
        if not re.search(r"[0-9@]", texts[r.doc_id] or ""):
            assert r.text == texts[r.doc_id]


def test_a_long_secret_goes_whole():
    value = "Ab3-" * 100
    other = value[:-1] + "+x7"
    made = [P.text(f"token={v}.")[0] for v in (value, other, value)]
    assert made[0] == made[2] and all(re.fullmatch(r"token=[A-Za-z0-9+-]+\.", m) for m in made)
    for i in range(0, 400, pii.BLOCK):  # every block changes, and differs as soon as the values do
        assert len({m[6 + i : 6 + i + 16] for m in (made[0], made[1], f"token={value}")}) == 3
    assert len(made[0]) == len(value) + 7
    values = [f"{a}{'x' * 126}{b}{c}" for a in "0123" for b in "ab" for c in "yz45"]
    assert len({pii.permute_secret(v, PII_KEY) for v in values}) == len(values)


@pytest.mark.parametrize(("kind", "value"), [
    ("iban", "ES91 2100 0418 4502 0005 1332"), ("iban", "BE68 5390 0754 7034"), ("iban", "BE68539007547034"), ("iban", "NO93 8601 1117 947"),
    ("phone", "+44 20 7183 8750"), ("phone", "+442071838750")])
@pytest.mark.parametrize("after", [" EUR", " 2021", " EUR 100", " TOTAL", " PAID 2021", " and more", ""])
def test_a_value_before_capitals_and_numbers(kind, value, after):
    new, counts = P.text(f"to {value}{after}")
    assert new == f"to {P.text(value)[0]}{after}" and value not in new
    assert counts[pii.KINDS.index(kind)] == 1 and sum(counts) == 1
