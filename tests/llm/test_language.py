import zlib

import numpy as np

from pagemill.llm import language, queries


def test_held_out_accuracy(spark, small, documents):
    rows = queries.op2_language_id(spark, small).collect()
    truth = {r.doc_id: (r.lang, r.n_chars) for r in documents.collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [r for r in rows if r.held_out and truth[r.doc_id][1] >= 20]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in judged) >= 0.97 * len(judged)


def test_lookup_returns_every_language_of_a_gram(make):
    docs = make([(i, t, lang) for i, (t, lang) in enumerate([("abcabc zzz", "x"), ("abcabc yyy", "y")] * 3)])
    model = language.train_filter(docs)
    assert model.languages == ["x", "y"]

    def mask(gram):
        found = ~np.uint64(0)
        for slot in language._slots(np.concatenate([g for g in language._grams(gram)])[-1:]):
            found &= model.slots[0][slot][0]
        return int(found)

    assert mask("abca") == 0b11 and mask("zz ") in (0b01,) and mask("yyy") == 0b10 and mask("qqqq") == 0


def test_chunks_do_not_matter(monkeypatch):
    text = language._letters("Der schnelle braune Fuchs springt über den faulen Hund. " * 30)
    whole = np.sort(np.concatenate(list(language._grams(text))))
    monkeypatch.setattr(language, "CHUNK", 37)
    assert np.array_equal(np.sort(np.concatenate(list(language._grams(text)))), whole)
    assert len(whole) == sum(len(text) - n + 1 for n in language.SIZES)


def test_false_positives_are_taken_off():
    slots = np.zeros((1, language.SLOTS), dtype=np.uint64)
    slots[0, ::2] |= np.uint64(1)  # half full: a quarter of unknown grams look like language a
    clean = language._letters("the only words there are")
    for g in language._grams(clean):
        for s in language._slots(g):
            slots[0, s] |= np.uint64(2)
    model = language.LanguageFilter(["a", "b"], slots)
    assert 0.24 < model.false_rate[0] < 0.26 and model.predict("the only words there are")[0] == "b"


def test_odd_rows(odd, nothing, documents):
    model = language.train_filter(documents, per_language=50)
    got = sorted(((r.doc_id, r.lang_pred) for r in language.identify_language(odd, model).collect()), key=repr)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.identify_language(odd, language.train_filter(nothing)).collect())
    assert language.identify_language(nothing, model).count() == 0
    assert model.predict("123 ²² !?")[0] == "und"


def test_the_most_frequent_labels_are_learned(make):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} here", f"l{i:04d}") for i in range(300)] + [(1000 + i, "many of these", "zz") for i in range(3)]
    model = language.train_filter(make(rows))
    assert len(model.languages) == 301 and len(model.slots) == 5 and model.predict("many of these")[0] == "zz"
    few = language.train_filter(make(rows), max_languages=2)
    assert few.languages == ["l0000", "zz"]
