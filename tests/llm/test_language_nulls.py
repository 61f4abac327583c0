"""Language training rows without a text."""

from fraudloom.llm import language_codes


def test_null_texts_take_no_training_place(spark):
    words = {"en": "the cat and the dog went home", "de": "der Hund und die Katze gehen heim"}
    rows = [(i, None if i % 3 else f"{words[lang]} {i}", lang) for i in range(60) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_codes.fit(docs, per_language=10)
    asked = docs.where("text IS NOT NULL")
    found = language_codes.predict(asked, model, ["doc_id", "lang"]).collect()
    assert len(found) == 40 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, None, "de")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(3, "some words")], "doc_id long, text string")
    for source in (docs, docs.limit(0)):
        row = language_codes.predict(asked, language_codes.fit(source), ["doc_id"]).first()
        assert (row["lang_pred"], row["score"], row["ambiguous"]) == ("und", 0.0, True)
