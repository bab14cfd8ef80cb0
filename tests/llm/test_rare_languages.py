"""Languages with few labelled texts are learned whole, and calibrated on texts of their own or not at all."""

import random

from hintwise.llm import language_id


def labelled(sizes):
    rng, rows = random.Random(3), []
    for lang, n in sizes.items():
        letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}[lang]
        rows += [(f"{lang}{i}", " ".join("".join(rng.choices(letters, k=5)) for _ in range(30)), lang) for i in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, lang string")


def test_rare_language_is_learned(spark):
    rows = labelled({"aa": 3000, "bb": 3000, "cc": 5})
    docs = frame(spark, rows)
    model = language_id.fit(docs, fit_documents=300, calibration_documents=100)
    assert model.languages == ["aa", "bb", "cc"]
    assert set(model.limits) == {"aa", "bb"}
    fresh = frame(spark, [(f"n{i}", t[::-1], lang) for i, (_, t, lang) in enumerate(labelled({"cc": 20}))])
    got = language_id.predict(fresh, model).collect()
    assert all(r.lang_pred == "cc" and not r.rejected for r in got)


def test_samples_are_bounded_by_language(spark):
    rows = labelled({"aa": 3000, "bb": 400, "cc": 5})
    rows += [(f"copy{i}", rows[i % 50][1], "aa") for i in range(200)]
    fit_on, calibrate_with = (x.collect() for x in language_id.samples(frame(spark, rows), 900, 600))
    taken = [{x: sum(r.lang == x for r in part) for x in ("aa", "bb", "cc")} for part in (fit_on, calibrate_with)]
    assert taken[0]["cc"] == taken[1]["cc"] == 5
    assert taken[0]["bb"] == 400 and 400 < taken[0]["aa"] < 600
    assert 220 < taken[1]["bb"] < 380 and 220 < taken[1]["aa"] < 380
    folds = [{r.text for r in fit_on + calibrate_with if r.fold == fold} for fold in (0, 1)]
    assert all(folds) and not folds[0] & folds[1]


def test_limits_come_from_texts_that_were_not_learned(spark):
    # every text has letters of its own: a model that has seen it explains it, others do not
    rows = [(f"d{i}", " ".join(chr(0x4E00 + 40 * i + j % 40) * 2 for j in range(200)), "aa") for i in range(40)]
    model = language_id.fit(frame(spark, rows))
    seen = max(r.cross_entropy for r in language_id.predict(frame(spark, rows), model).collect())
    assert model.limits["aa"] > seen + 0.5


def test_level():
    assert language_id._level([], 10) == language_id.LEAST_DOCUMENTS
    assert language_id._level([5000, 5000, 100], 12_000) == 5000
    assert language_id._level([50_000, 50_000, 1000], 12_000) == 5500
