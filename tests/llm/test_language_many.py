"""Language identification with more labels than a word has bits."""

import random

from paperloom.llm import language_id


def test_every_label_is_learned(spark):
    rnd = random.Random(9)
    rows, letters = [], [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 6)]
    for k in range(70):
        own = letters[6 * k : 6 * k + 6]
        rows += [(100 * k + i, " ".join("".join(rnd.choices(own, k=4)) for _ in range(30)), f"l{k:02}") for i in range(3 if k % 2 else 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame)
    assert len(model.languages) == 70 and model.masks.shape[0] == 2
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(frame, model, "doc_id").collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_filters_of_many_labels_are_bounded(spark, monkeypatch):
    """With more labels than fit, slots are halved as often as needed, and every label is still learned."""
    monkeypatch.setattr(language_id, "MOST_WORDS", 1)
    docs = spark.createDataFrame([(i, f"{chr(97 + i % 20)}{chr(97 + i // 20)} word{chr(97 + i % 20)} {chr(97 + i // 20) * 4}", f"l{i:03}") for i in range(150)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, slot_bits=16)
    assert model.masks.shape == (3, 1 << 14) and model.slot_bits == 14 and len(model.languages) == 150
    assert language_id.fit(docs.filter("doc_id < 60"), slot_bits=16).masks.shape == (1, 1 << 16)
    assert sum(model.predict(r["text"])[0] == r["lang"] for r in docs.collect()) > 100
