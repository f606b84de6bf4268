import time

import pytest

from sedgemill.llm import pii as P

LEX = P.Lexicon({"norno", "ember", "sage", "grilwick"}, {"yarraquist", "kelmsson"}, {"approved", "to", "on"}, {"owner:", "asked", "notes for", "call with"}, {"sage", "satchel", "corridor", "cursor"})
FIND = P.Finder(LEX)


def kinds(text, whole=False):
    return [(text[a:b], k) for a, b, k in FIND.find(text, whole)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b+c@mail.tallow.example now", ["a.b+c@mail.tallow.example"]),
        ("<x_y [at] kernhaus.example>", ["x_y [at] kernhaus.example"]),
        ("mailto:z@ostwick.test.", ["z@ostwick.test"]),
        ("norno.kelmsson (at) fernau dot example", ["norno.kelmsson (at) fernau dot example"]),
        ("meet at noon @ the dot", []),
    ],
)
def test_email(text, want):
    assert [t for t, k in kinds(text) if k == "email"] == want and all(k == "email" for _, k in kinds(text))


@pytest.mark.parametrize("number", ["+49 30 23125 478", "+1.646.555.0135", "030/23125481", "+1 (212) 555-0150", "0049-30-23125-865", "020 7946 0969", "555-0112", "01 99 00 71 76", "(415) 555-0153", "+33 1 99 00 76 31"])
def test_phone(number):
    assert kinds(f"Call {number} when done.") == [(number, "phone")]


@pytest.mark.parametrize("text", ["order 9555-88-20313 once", "ticket KB-179847", "143 540 rows", "host 192.0.2.8 was slow between 0900-1730", "ISBN 978-0-00-387226-1", "part 404-646-3 of 2026-03-13", "v2.7.2 at commit a471f711c"])
def test_no_numbers(text):
    assert kinds(text) == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("SSN 941 01 5539", "941 01 5539"), ("id 968-01-9180 seen", "968-01-9180"), ("national id: 295595-3352.", "295595-3352"), ("passport no. XK6154326 by hand", "XK6154326"),
        ("QQ 89 35 91 C", "QQ 89 35 91 C"), ("QQ893591D", "QQ893591D"), ("DNI 18474757K", "18474757K"), ("NIR 1 85 68 78 230 446 68", "1 85 68 78 230 446 68"), ("tax number 340/790/99234 for", "340/790/99234"),
    ],
)
def test_id(text, want):
    assert kinds(text) == [(want, "id_number")]


@pytest.mark.parametrize("number", ["AB 12 34 56 C", "AB123456C", "QQ 12 34 56 A", "12345678Z", "12345678-Z", "X1234567L", "1 85 05 78 006 084 91", "2 55 08 2A 168 025 97", "86095742719", "86 095 742 719", "340/790/99234"])
def test_id_without_cue(number):
    assert kinds(f"It was {number} then.") == [(number, "id_number")]


@pytest.mark.parametrize("text", ["part 12345678A", "build 12345678901", "GB 12 34 56 C", "ref KXAB123456C", "v-AB123456C", "took 1 85 05 78 006 084 92 bytes", "X1234567A seen", "commit ab123456c", "at 12/345/678"])
def test_no_id_without_cue(text):
    assert not [t for t, k in kinds(text) if k == "id_number"]


@pytest.mark.parametrize(
    "address",
    ["340 West Damson Avenue", "356 Ostenmere Street, Apt 6B, Ostwick 33977", "247B Tamber Rd., Valdeoro", "avenue Damson 242, Ostwick", "31 bis, rue des Ostens, 56213 Fernau", "Calle Tamber 15, 3.º B, 47076 Brisolle", "Harrowweg 364", "Larkenstraße 99a, 83491 Brisolle", "P.O. Box 37005, Brisolle"],
)
def test_address(address):
    assert kinds(f"Ship to {address}.") == [(address, "address")] and kinds(address, True) == [(address, "address")]


@pytest.mark.parametrize("text", ["Street view tiles", "La calle del mapa beacon sigue", "Die Straße zum silo ist", "lane 3 of it"])
def test_no_address(text):
    assert kinds(text) == []


@pytest.mark.parametrize(
    "text, whole, want",
    [
        ("Norno Yarraquist approved it", False, ["Norno Yarraquist"]), ("Yarraquist, Norno on it", False, ["Yarraquist, Norno"]), ("Owner: Norno K. Kelmsson.", False, ["Norno K. Kelmsson"]),
        ("people: Dr. Zolfeth", True, ["Dr. Zolfeth"]), ("Asked Frau Zolfeth to go", False, ["Frau Zolfeth"]), ("NORNO KELMSSON", True, ["NORNO KELMSSON"]),
        ("Ember cache cleared", False, []), ("the sage order", False, []), ("Sage Corridor", True, []), ("Satchel Cursor", True, []), ("Owner: Sage.", False, ["Sage"]), ("in Norno_x and norno/y", False, []),
        ("Kelmsson", True, []), ("Norno Zolfeth", True, ["Norno Zolfeth"]),
    ],
)
def test_names(text, whole, want):
    assert [t for t, k in kinds(text, whole) if k == "name"] == want


def test_tables(spark):
    names = spark.createDataFrame([("Norno", "given"), ("Ember", "given"), ("Kelmsson", "family"), (None, "given")], "name string, role string")
    rows = [
        ("a", "Call 555-0112", "Mail x@y.test and z@y.test.", ["Urla Kelmsson", None, "x@y.test"], 1), ("a", "Call 555-0112", "Mail x@y.test and z@y.test.", ["Urla Kelmsson", None, "x@y.test"], 1),
        ("b", None, "Urla approved it. Norno Kelmsson approved it. Norno Kelmsson approved that.", None, 1), ("c", "", "", [], 1),
    ]
    history = spark.createDataFrame(rows, "id string, title string, summary string, entities array<string>, nth int")
    words = P.learn(history, names)
    lexicon = P.lexicon_of((r["word"], [r["sort"]]) for r in words.collect())
    assert "urla" in lexicon.given and lexicon.after == {"approved"}
    got = sorted(map(tuple, P.occurrences(history, words).collect()))
    assert sorted(map(tuple, P.occurrences(history, words, bound=0).collect())) == got
    assert got == [
        ("a", "entities", "email", 1), ("a", "entities", "name", 1), ("a", "summary", "email", 1), ("a", "summary", "email", 2), ("a", "title", "phone", 1),
        ("b", "summary", "name", 1), ("b", "summary", "name", 2), ("b", "summary", "name", 3),
    ]
    clean = {r["id"]: r for r in P.redact(history, words).collect()}
    assert {r["id"]: r for r in P.redact(history, words, bound=0).collect()} == clean
    assert clean["a"]["summary"] == "Mail [EMAIL] and [EMAIL]." and clean["a"]["entities"] == ["[NAME]", None, "[EMAIL]"] and clean["a"]["nth"] == 1
    assert clean["b"]["title"] is None and clean["b"]["entities"] is None and clean["c"]["entities"] == []
    assert P.occurrences(history.limit(0), P.learn(history.limit(0), names.limit(0))).count() == 0


def test_rare_evidence_counts_in_large_data(spark):
    """One small-letter word among 1.2 million, and a name seen once."""
    names = spark.createDataFrame([("Norno", "given"), ("Kelmsson", "family")], "name string, role string")
    rows = [("a", "the satchel", "Satchel open. Urla Kelmsson left. Norno Zolfeth met. never capital", ["x"])]
    many = spark.range(600).selectExpr("string(id) as id", "repeat('word ', 2000) as title", "'' as summary", "array('Norno Kelmsson') as entities")
    words = P.learn(spark.createDataFrame(rows, "id string, title string, summary string, entities array<string>").unionByName(many), names)
    lexicon = P.lexicon_of((r["word"], [r["sort"]]) for r in words.collect())
    assert "satchel" in lexicon.plain and "urla" in lexicon.given and "zolfeth" in lexicon.family and "never" not in lexicon.plain


@pytest.mark.parametrize(
    "text, want",
    [
        ("see https://user:pw@host.example.com/x?y now", []), ("see https://host.example/?mail=z@ostwick.test now", [("z@ostwick.test", "email")]), ("ftp://z@ostwick.test", []),
        ("pay to DE89 3704 0044 0532 0130 00 today", [("DE89 3704 0044 0532 0130 00", "id_number")]), ("GB29NWBK60161331926819.", [("GB29NWBK60161331926819", "id_number")]), ("card 4111 1111 1111 1111,", [("4111 1111 1111 1111", "id_number")]),
        ("build 4111 1111 1111 1112,", []), ("code DE89 3704 0044 0532 0130 01", []),
    ],
)
def test_schemes_and_accounts(text, want):
    assert kinds(text) == want


def test_an_address_is_expanded_at_its_street_word_only():
    assert kinds("The street was long. Ship to 340 West Damson Avenue, then (Harrowweg 364) or Larkenstraße 99a.") == [("340 West Damson Avenue", "address"), ("Harrowweg 364", "address"), ("Larkenstraße 99a", "address")]
    assert kinds("12 Long Names Here And Street") == []


@pytest.mark.parametrize("part", ["a@b.test ", "Norno Kelmsson ", "street ", "12 West Street ", "Dr. ", "https://", "a.", "DE89 ", "1234 ", "x@", "Calle "])
def test_long_texts_take_linear_time(part):
    times = []
    for n in (1_000, 4_000):
        began = time.time()
        FIND.find(part * n)
        P.evidence(part * n, LEX.given, LEX.family)
        times.append(time.time() - began)
    assert times[1] < 10 * times[0] + 0.5
