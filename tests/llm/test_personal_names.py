import pytest

from scarp.llm.personal import find_spans, given_names, personal_items


def names(text, known=frozenset()):
    return {text[s:e] for s, e, k in find_spans(text, known) if k == "name"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Contact John Smith for details.", {"John Smith"}),
        ("Contact Quorin Velmarsen for details.", {"Quorin Velmarsen"}),
        ("The script was written by Zelina Harding last year.", {"Zelina Harding"}),
        ("Regards, Trevik Walker and the rest", {"Trevik Walker"}),
        ("Ask Dr. Ozmund Okafor about it.", {"Ozmund Okafor"}),
        ("Please note: Kaviel Nowak (020 7946 0332) has it.", {"Kaviel Nowak"}),
        ("ask dr kaviel nowak about it", {"kaviel nowak"}),
        ("all done\n\nbest regards\nyarenka moreau\n", {"yarenka moreau"}),
        ("Contact Customer Support or Contact Sales Team.", set()),
        ("It took 12 ms Starting Worker again", set()),
        ("Mark Items as done", set()),
        ("the contact form below", set()),
    ],
)
def test_names_outside_the_list(text, expected):
    assert names(text) == expected


def test_given_names_are_learned_from_telling_places(spark):
    texts = [
        "It broke.\n\nBest regards,\nQuorin Velmarsen",
        "Quorin Nastby <q.nastby@mail.example> wrote it",
        "Name: Ozmunda Kell, phone +1 810 555 0120",
        "Frau Ozmunda Harding (020 7946 0332) has it",
        "Dr. Zelva Strand, then Dr. Zelva Strand again",  # one surname only
        "Dr. Open Access and Dr. Open Source", *["Open Source is fine"] * 30,  # mostly elsewhere
        "Contact Sales Team, Contact Sales Desk", "Contact Sales Office", None, "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert given_names(df) == {"quorin", "ozmunda"}
    more = df.unionByName(spark.createDataFrame([(100, "The idea of Quorin Abelard was good, and that of quorin abelard too."), (101, "It said Ozmunda Lillby did it")], df.schema))
    found = {(r.doc_id, r.pii_text) for r in personal_items(more).collect() if r.pii_type == "name"}
    assert {(100, "Quorin Abelard"), (101, "Ozmunda Lillby"), (0, "Quorin Velmarsen")} <= found
    assert given_names(df.limit(0)) == frozenset()


def test_given_names_are_learned_beside_any_number_of_other_texts(spark):
    few = spark.createDataFrame([(-1, "Frau Quorin Velmarsen has it"), (-2, "Dr. Quorin Nastby has it"), (-3, "The idea of Quorin Abelard was good")], "doc_id long, text string")
    many = spark.range(40_001).selectExpr("id as doc_id", "concat('Name: Ozmunda ', if(id % 2 = 0, 'Kell', 'Harding')) as text")
    assert given_names(few) == {"quorin"}
    assert given_names(few.unionByName(many)) == {"quorin", "ozmunda"}


@pytest.mark.parametrize("words", range(6))
def test_lower_case_names_after_any_number_of_words(words):
    before = " ".join("so then we could really".split()[:words])
    known = frozenset(("anna", "milo"))
    assert names(f"{before} ask anna smith", known) == {"anna smith"}
    assert names(f"{before} colleague milo haskover", known) == {"milo haskover"}
