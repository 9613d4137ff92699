"""Personal information inside free text."""

import pytest

from tokenloom.llm import personal


def mentions(text):
    return [(k, text[b:e]) for b, e, k in personal.spans(text)]


@pytest.mark.parametrize("text, found", [
    ("the login is Ann.Lee+x1@corp.example.test, same", [("email", "Ann.Lee+x1@corp.example.test")]),
    ("contact: ann-lee (at) mail (dot) example | x", [("email", "ann-lee (at) mail (dot) example")]),
    ("bounce for a_b at mail dot example.", [("email", "a_b at mail dot example")]),
    ("mailto:ann＠mail.example.", [("email", "ann＠mail.example")]),
    ("git checkout HEAD@{2} pinned padkit@4.5.6 @cached_property user@{upstream}", []),
    ("meet at noon dot", []),
    ("Phone: +44 7700 900044, and", [("phone", "+44 7700 900044")]),
    ('"phone":"+49 (0)30 23125 798"', [("phone", "+49 (0)30 23125 798")]),
    ("call me on (617) 555-0132;", [("phone", "(617) 555-0132")]),
    ("Rückruf unter 030/23125-435, fax 01.99.00.37.70.", [("phone", "030/23125-435"), ("phone", "01.99.00.37.70")]),
    ("rows 100-200-3000 kept, host 192.0.2.17, run finished at 1736512345, 7700 900 rows, phone_home=false", []),
    ("my social security number is 999 22 6812;", [("id_number", "999 22 6812")]),
    ("identity no. 99947049 C on the form", [("id_number", "99947049 C")]),
    ("SSN QQ 13 79 55 B, \"national_id\": \"99.448.196-Z\"", [("id_number", "QQ 13 79 55 B"), ("id_number", "99.448.196-Z")]),
    ("see REL-912-14-2207, part no. QX 12 34 96164 passed", []),
    ("I live at 73 Lutiston St., Gravenholm 00532", [("street_address", "73 Lutiston St., Gravenholm 00532")]),
    ("ship the laptop to calle de las Fuentes 240, 2.º B, Norwick;", [("street_address", "calle de las Fuentes 240, 2.º B, Norwick")]),
    ("pick it up from Kerkpad 173, 9380 ZZ Port Ellery tomorrow", [("street_address", "Kerkpad 173, 9380 ZZ Port Ellery")]),
    ("address: P.O. Box 213, Ninodal 00685", [("street_address", "P.O. Box 213, Ninodal 00685")]),
    ("Lake Street Dataset v2, street_view.rs:214", []),
    ("assign it to Dr. Tavric Raveski for now", [("person_name", "Tavric Raveski")]),
    ("cc Ms Vashtori, Cendra", [("person_name", "Vashtori, Cendra")]),
    ("reviewed by van der Hoeven-Lask, Brisca |", [("person_name", "van der Hoeven-Lask, Brisca")]),
    ("on behalf of A. O'Carrick\n The", [("person_name", "A. O'Carrick")]),
    ("no match oszuvin osbelmond said the totals were off", [("person_name", "oszuvin osbelmond")]),
    ("please ask NÚRISA VASHTORI before merging this", [("person_name", "NÚRISA VASHTORI")]),
    ("late! Kola M. Trezuski <kola@mail.example>;", [("person_name", "Kola M. Trezuski"), ("email", "kola@mail.example")]),
    ("si ça casse <lioba@mail.example>", [("email", "lioba@mail.example")]),
    ("Monday Morning Report, Copper Finch is only the project name, Bloom Filter and Merkle Tree", []),
    ("Lieferung an Am Mühlgraben 87, 00832 Griliburgh", [("street_address", "Am Mühlgraben 87, 00832 Griliburgh")]),
    ("Lieferung an Kirchgasse 129, 00235 Kolimere; I live at Weberstraße 149, 00711 Port Ellery", [("street_address", "Kirchgasse 129, 00235 Kolimere"), ("street_address", "Weberstraße 149, 00711 Port Ellery")]),
    ("Monday Morning Report <kola@mail.example>", [("email", "kola@mail.example")]),
    ("Monday Morning Report Kola Trezuski <kola@mail.example>", [("person_name", "Kola Trezuski"), ("email", "kola@mail.example")]),
    ("Monday Morning Report SHATISSA OSLIMURA said the totals were off", [("person_name", "SHATISSA OSLIMURA")]),
    ("", []), (None, [])])
def test_mentions(text, found):
    assert mentions(text) == found


def test_rest_of_the_text_stays():
    text = "  From: Ann Lee (ann@mail.example)\n\tID: QQ123456A;  ok "
    assert personal.redact(text) == "  From: [NAME] ([EMAIL])\n\tID: [ID_NUMBER];  ok "
    assert personal.redact(None) is None and personal.redact("") == ""


def test_very_long_text():
    filler = "The dashboard reads it from the beginning. " * 20_000
    assert mentions(filler + "reply-to ann@mail.example. " + filler) == [("email", "ann@mail.example")]


def test_rows(spark):
    rows = [(1, "cc Mr Ann Lee", None, "x"), (2, None, "tel 07700 900123, tel 07700 900123", "y"), (2, None, "tel 07700 900123", "y"), (3, "", "", None)]
    df = spark.createDataFrame(rows, "event_id long, title string, detail string, mention string")
    assert sorted(tuple(r) for r in personal.found(df).collect()) == [(1, "title", "person_name", "Ann Lee"), (2, "detail", "phone", "07700 900123"), (2, "detail", "phone", "07700 900123")]
    out = sorted((r.event_id, r.title or "", r.detail or "", r.mention or "") for r in personal.redacted(df).collect())
    assert out == [(1, "cc Mr [NAME]", "", "x"), (2, "", "tel [PHONE]", "y"), (2, "", "tel [PHONE], tel [PHONE]", "y"), (3, "", "", "")]
    assert personal.found(df.where("false")).count() == 0


#: Written for this test, with other phrases and names than any table: text, mentions.
HELD_OUT = [
    ("We met Peter Jackson yesterday", ["Peter Jackson"]), ("pass it on to John Smith.", ["John Smith"]), ("Thanks,\nAlice Johnson", ["Alice Johnson"]),
    ("Sarah Connor will join tomorrow.", ["Sarah Connor"]), ("Reach Jane Roe (jane@x.io)", ["Jane Roe", "jane@x.io"]), ("send to 5 Rue de la Paix, 75002 Paris", ["5 Rue de la Paix, 75002 Paris"]),
    ("NI number AB123456C", ["AB123456C"]), ("card 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("IBAN DE89370400440532013000", ["DE89370400440532013000"]),
    ("Please email Tavric Raveski about the outage", ["Tavric Raveski"]), ("Best wishes,\n  Orla Quent", ["Orla Quent"]), ("Hello Milo Brandt, are you in?", ["Milo Brandt"]),
    ("My name is Ines Okafor and my fax is +351 21 123 4567", ["Ines Okafor", "+351 21 123 4567"]), ("Invoice for Klaus Meier, 12 Harbour Lane, Ashford", ["Klaus Meier", "12 Harbour Lane, Ashford"]),
    ("iban: GB82 WEST 1234 5698 7654 32 (main)", ["GB82 WEST 1234 5698 7654 32"]), ("The parcel went to Calle Mayor 7, 28013 Madrid last week", ["Calle Mayor 7, 28013 Madrid"]),
    ("Mary Ann Smith joined the call", ["Mary Ann Smith"]), ("the draft was prepared by Wolfgang Amsel", ["Wolfgang Amsel"]), ("María López told me to wait", ["María López"]),
    ("write to support@shop.example or to j.doe+a@mail.shop.example today", ["support@shop.example", "j.doe+a@mail.shop.example"]), ("Ring 020 7946 0958 after six", ["020 7946 0958"]),
    ("passport number K1234567 expires soon", ["K1234567"]), ("My flatmate Giulia Ferri lives at Via Roma 12, 00184 Roma", ["Giulia Ferri", "Via Roma 12, 00184 Roma"]),
    ("Postfach 1234, 8021 Zürich", ["Postfach 1234, 8021 Zürich"]), ("Rahel Zuber schrieb gestern", ["Rahel Zuber"]), ("the winner, Aiko Tanabe, left early", ["Aiko Tanabe"]),
    ("card 4111 1111 1111 1112 was refused", []), ("Bloom Filter beats Merkle Tree", []), ("Peter Street is closed", []), ("Hello All Hands", []), ("Contact Us Now", []), ("The Victoria Station line", []),
    ("version 10.2.33 of build 20240602", []), ("Monday Morning Report", []), ("meet at noon", []), ("order 1234-5678-90 arrived", []), ("account 12345678 is empty", []), ("Dear Sir or Madam", []),
]


def test_held_out_phrases():
    found = [set(t for _, t in mentions(text)) for text, _ in HELD_OUT]
    true = [set(m) for _, m in HELD_OUT]
    both, n_found, n_true = (sum(map(len, x)) for x in ([f & t for f, t in zip(found, true)], found, true))
    print(f"held-out phrases: recall {both / n_true:.3f}, precision {both / n_found:.3f}")
    assert both / n_true > 0.9 and both / n_found > 0.95


def test_check_digits():
    assert personal._checked("4111-1111 11111111") and not personal._checked("4111111111111112")
    assert personal._checked("FR14 2004 1010 0505 0001 3M02 606") and not personal._checked("FR15 2004 1010 0505 0001 3M02 606")


def test_mentions_longer_than_usual():
    long = "a." * 200 + "b@mail.example"
    assert mentions(f"to {long}, ok") == [("email", long)]
    lines = "cc Ann Lee\nSmith Street" * 2
    assert [k for k, _ in mentions(lines)] == ["person_name", "person_name"]


def test_crowded_text_takes_linear_time():
    import time

    seconds = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        assert len(personal.spans("Jane Roe <jane@mail.example> " * n)) == 2 * n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0]


def test_lexicon_is_a_table(spark):
    given = personal.lexicon(spark.createDataFrame([(" Zorblax",), (None,), ("",), ("zorblax",)], "given_name string"))
    assert given == {"zorblax"}
    df = spark.createDataFrame([(1, "Zorblax Quill left", "Zorblax Quill left")], "event_id long, title string, detail string")
    assert personal.found(df, given=given).count() == 2 and personal.found(df).count() == 0
    assert personal.redacted(df, given=given).first().title == "[NAME] left"
