import pytest

from scarp.llm.personal import confirms, find_spans, luhn, mod97, personal_items, redact


def items(text):
    return {(k, text[s:e]) for s, e, k in find_spans(text)}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mail anna.b@mail.example, please.", {("email", "anna.b@mail.example")}),
        ("queued for anna [at] labnet [dot] example after 3 ms", {("email", "anna [at] labnet [dot] example")}),
        ("git clone git@repo.tool.example:group/x.git and pin utils@4.20.35", set()),
        ("DSN postgresql://reader@db.tool.example:5432/x1", set()),
        ("Ring me on +1 (810) 555-0120 if urgent", {("phone", "1 (810) 555-0120")}),
        ("Anna Lindby (020 7946 0332) holds the licence", {("phone", "020 7946 0332"), ("name", "Anna Lindby")}),
        ("Order 9033-44-8827 was delayed. Build 2031.0143.5550. CAS number 618-73-87.", set()),
        ("read 12 rows from 192.0.2.45 at 2023-05-11 10:00:01.123", set()),
        ("my SSN 937 08 5799, is that normal?", {("id_number", "937 08 5799")}),
        ("National Insurance no. QQ 19 11 28 C", {("id_number", "QQ 19 11 28 C")}),
        ("Samples go to 12B Long Mill Avenue, Flat 3\nEast Harbour 00123. The", {("address", "12B Long Mill Avenue, Flat 3\nEast Harbour 00123")}),
        ("Adres: ul. Stara Olcha 109 m. 12\n00-860 Brzozin.", {("address", "ul. Stara Olcha 109 m. 12\n00-860 Brzozin")}),
        ("Thanks\n/Iris Haskover", {("name", "Iris Haskover")}),
        ("Best regards\nLUNDBY, HANNA\nhanna@mail.example", {("name", "LUNDBY, HANNA"), ("email", "hanna@mail.example")}),
        ("The Velmar-Ostrik correction and the Torvane coefficient", set()),
        ("", set()),
        ("IBAN GB82 WEST 1234 5698 7654 32, card 4111 1111 1111 1111", set()),
        ("see page 12 High Street", set()),
        ("We met at 12 High Street.", {("address", "12 High Street")}),
    ],
)
def test_items(text, expected):
    assert items(text) == expected


def test_time_grows_with_the_text():
    import time

    def seconds(n):
        text = "".join(f"We met at {i} High Street, Unit 4. " for i in range(n))
        start = time.process_time()
        assert len(find_spans(text)) == n
        return time.process_time() - start

    seconds(100)
    assert seconds(8000) < 4 * 2.5 * seconds(2000)


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")
    assert confirms("card", "12345678Z") and not confirms("card", "12345678A")
    assert confirms("pesel", "44051401359") and not confirms("pesel", "44051401358")


def test_redaction_keeps_the_rest():
    assert redact("Mail anna@mail.example today.") == "Mail [EMAIL] today."


def test_frame(spark):
    rows = [(1, "a@mail.example a@mail.example"), (2, None), (3, ""), (None, "b@mail.example"), (4, "x " * 50_000 + "c@mail.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as pii_type", "1 as pii_text")
    assert {tuple(r) for r in personal_items(df).collect()} == {(1, "email", "a@mail.example"), (4, "email", "c@mail.example")}
    assert personal_items(df.limit(0)).count() == 0
