import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mendset.llm.pseudonyms import iban_rest, luhn, only_digits, permute, pseudonymise, pseudonymised
from mendset.llm.queries import QUERIES

KEY = b"a key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permute_is_a_permutation(size):
    assert sorted(permute(v, size, KEY, "t") for v in range(size)) == list(range(size))


def test_key_and_tweak_matter():
    runs = {tuple(permute(v, 1000, k, t) for v in range(20)) for k in (b"a", b"b") for t in ("x", "y")}
    assert len(runs) == 4


VALUES = {
    "card": ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486"],
    "date": ["2021-03-14", "14.03.2021", "03/14/2021", "25/12/1999", "2021/3/4"],
    "phone": ["+1 (017) 555-7713", "(017) 555-7713", "+49 30 1234567", "555-123-4567"],
    "ip": ["97.51.17.173", "8.8.8.8"],
    "email": ["und.34@mail7.example.com", "Ann.Lee@x.org"],
    "ssn": ["123-45-6789"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
}
INVALID = ["4539578763621487", "2021-02-30", "1.2.3.400", "000-12-3456", "DE88370400440532013000", "3.14159", "99999", "12:30"]


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_each_kind(kind, value):
    new, kinds = pseudonymise(f"Réoi {value}, and {value}.", KEY)
    assert kinds == [kind, kind]
    made = new[5 : 5 + len(value)]
    assert new == f"Réoi {made}, and {made}." and made != value
    assert pseudonymise(made, KEY)[1] == [kind]  # valid in its format again
    shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in value)
    assert "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in made) == shape


def test_linked_across_layouts():
    assert only_digits(pseudonymise("4539578763621486", KEY)[0]) == only_digits(pseudonymise("4539-5787-6362-1486", KEY)[0])
    assert luhn(pseudonymise("4539578763621486", KEY)[0]) == 0
    made = pseudonymise("DE89370400440532013000", KEY)[0]
    assert 98 - iban_rest(made[:2], made[4:]) == int(made[2:4])


@pytest.mark.parametrize("text", [*INVALID, "", "no value at all", "token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\""])
def test_rest_stays(text):
    assert pseudonymise(text, KEY) == (text, [])


CLOSE = [
    ("7,4111111111111111", ["card"]),
    ("4111111111111111,2024-01-02", ["card", "date"]),
    ("1,4111111111111111,2024-01-02,10.1.2.3,123-45-6789,5", ["card", "date", "ip", "ssn"]),
    ('{"n":1,"card":[4539578763621486,4111111111111111],"at":"2024-03-05T10:00Z"}', ["card", "card", "date"]),
    ("2024-03-05T10:00:00.123Z", ["date"]),
    ("2024-03-05,12", ["date"]),
    ("10.1.2.3:8080", ["ip"]),
    ("10.1.2.3-10.1.2.9", ["ip", "ip"]),
    ("1,555-123-4567,2", ["phone"]),
    ("ES91 2100 0418 4502 0005 1332 2024", ["iban"]),
    ("1111 4539 5787 6362 1486", ["card"]),
    ("+49 30 1234567 20240101", ["phone"]),
    ("+49 30 1234567 2024-01-02", ["date", "phone"]),
]


@pytest.mark.parametrize("text,kinds", CLOSE)
def test_values_close_together(text, kinds):
    new, found = pseudonymise(text, KEY)
    assert sorted(found) == kinds and len(new) == len(text)
    assert [c.isdigit() for c in new] == [c.isdigit() for c in text]


@pytest.mark.parametrize("text", ["0.4111111111111111", "4111111111111111.5", "2024-03-05Tea", "1-2024-03-05", "1.10.1.2.3", "10.1.2.3.4", "1-123-45-6789"])
def test_parts_of_longer_values_stay(text):
    assert pseudonymise(text, KEY) == (text, [])


@settings(max_examples=100, deadline=None)
@given(st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)))
def test_dates_stay_dates(day):
    made = pseudonymise(day.isoformat(), KEY)[0]
    assert dt.date.fromisoformat(made).year in range(1900, 2100)


def test_touching_values_and_long_texts():
    text = "a@b.co 8.8.8.8 " * 3 + "x" * 200_000 + " 2021-03-14"
    assert pseudonymise(text, KEY)[1] == ["email", "ip"] * 3 + ["date"]


def test_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "8.8.8.8", 6)], "doc_id bigint, text string, kinds int")
    rows = pseudonymised(docs, KEY).collect()
    assert [(r.doc_id, r.kinds) for r in rows] == [(1, 5), (1, 5), (2, 6)]
    assert [r.text for r in rows][:2] == [None, ""] and rows[2].text != "8.8.8.8"
    assert pseudonymised(docs.filter("false"), KEY).count() == 0


def test_query(spark, sf):
    rows = QUERIES["op10_pseudonyms"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    assert all(len(r.text) == len(texts[r.doc_id]) for r in rows)
    assert all((r.text != texts[r.doc_id]) == bool(r.kinds) for r in rows) and any(r.kinds for r in rows)
