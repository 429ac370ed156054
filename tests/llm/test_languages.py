"""Dictionaries of many languages."""

from lodestone.llm import language_id


def test_every_language_is_learned(spark):
    rows = [(i, f"text {'ab' * (i % 7)} of language", f"l{i % 80:02d}") for i in range(160)]
    rows += [(7777, f"hot row {i}", "hot") for i in range(1000)]
    learned = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {f"l{i:02d}" for i in range(80)} | {"hot"} and next(iter(learned)) == "hot"


def test_dictionaries_hold_some_of_every_row():
    made = language_id._even([b"a" * 1500, b"b" * 10] + [b"c" * 1500] * 398)
    assert len(made) <= language_id.DICTIONARY_BYTES and made.count(b" ") == 399 and b"b" * 10 in made
    assert language_id._even([b"ab", b"c"]) == b"ab c"
