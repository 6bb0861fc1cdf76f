import random

import numpy as np
import pytest
from llm_odd import ODD

from tarn.llm import langid

STEMS = {"aa": "the ing and tion er", "bb": "che ung ich sch ein", "cc": "os ción ar que la"}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(STEMS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy():
    rng = random.Random(1)
    model = langid.fit({k: [text(rng, k) for _ in range(60)] for k in STEMS})
    truth = [rng.choice(sorted(STEMS)) for _ in range(300)]
    names, scores = model.predict([text(rng, k, rng.randint(5, 80)) for k in truth])
    assert sum(a == b for a, b in zip(names, truth, strict=True)) >= 290
    assert all(0 <= s <= 1 for s in scores)


def test_kernel_is_cosine_of_presences():
    model = langid.fit({"x": ["abc abd", "xyz"], "y": ["qqq www"]})
    k = model.kernel(["abc abd"])
    assert abs(k[0, 0] - 1) < 1e-6 and k[0, 2] < 0.5


def test_odd_texts_and_nothing_learned(docs, spark):
    model = langid.fit({"x": ["abc def"], "y": ["ghi jkl"], "z": []})
    rows = langid.identify(docs(list(enumerate(ODD))).selectExpr("*", "1 AS score", "'q' AS Lang_Pred"), model).orderBy("doc_id").collect()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert letters or r.score == 0
    nothing = langid.fit({})
    assert {r.lang_pred for r in langid.identify(docs([(1, "abc")]), nothing).collect()} == {"und"}
    empty = spark.createDataFrame([], "text string, lang string")
    assert langid.sample(empty) == {}


def test_the_sample_is_bounded(spark):
    rows = [(f"text {'abcdefghij'[i % 10]}{i}", "aa") for i in range(2000)] + [("hot copy", "bb")] * 500 + [("x", None), (None, "cc")]
    found = langid.sample(spark.createDataFrame(rows, "text string, lang string"), 20)
    shown = lambda x: {k: [b.tolist() for b in v] for k, v in x.items()}
    assert len(found["aa"]) == 20 and shown(found)["bb"] == [np.unique(langid.buckets("hot copy")).tolist()] and "cc" not in found
    assert shown(found) == shown(langid.sample(spark.createDataFrame(rows[::-1], "text string, lang string"), 20))


def test_query_never_reads_labels_of_held_out(spark, tmp_path):
    import zlib

    from tarn.llm.queries import op4_langid

    rng = random.Random(2)
    rows = [(i, text(rng, k := sorted(STEMS)[i % 3]), "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else k, "s", 1) for i in range(300)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = op4_langid(spark, str(tmp_path)).collect()
    assert len(got) == 301 and "wrong" not in {r.lang_pred for r in got}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert r.lang_pred == sorted(STEMS)[r.doc_id % 3]


def test_against_plain_kernel_ridge():
    """With every text a landmark the scores are those of kernel ridge regression on n-gram sets, written out."""
    rng = random.Random(4)
    samples = {k: [text(rng, k, 12) for _ in range(6)] for k in sorted(STEMS)}
    model = langid.fit(samples)

    def grams(t):
        t = " ".join(t.lower().split())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    texts = [t for k in samples for t in samples[k]]
    target = np.array([[1.0 if k == own else -1.0 for own in samples] for k in samples for _ in samples[k]])
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    # Ridge on the Nystroem features of all texts is ridge in the kernel: alpha = (K + c I)^-1 y.
    alpha = np.linalg.solve(k + langid.RIDGE * len(texts) / len(samples) * np.eye(len(texts)), target)
    asked = [text(rng, rng.choice(sorted(STEMS)), 9) for _ in range(20)]
    want = np.array([[kernel(a, b) for b in texts] for a in asked]) @ alpha
    got = model.kernel(asked).astype(float) @ model.weights
    assert np.abs(got - want).max() < 0.02 and model.predict(asked)[0] == [model.names[i] for i in want.argmax(axis=1)]


def test_many_languages_stay_bounded(monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANDMARKS", 6)
    model = langid.fit({f"l{i}": [f"{chr(97 + i) * n}" for n in range(1, 9)] for i in range(4)})
    assert len(model.landmarks) == 4 and model.predict(["aaaa", "dddd"])[0] == ["l0", "l3"]
    with pytest.raises(ValueError):
        langid.fit({f"l{i}": ["x"] for i in range(7)})


def test_very_long_text_and_clashing_columns(docs):
    rng = random.Random(9)
    model = langid.fit({k: [text(rng, k) for _ in range(20)] for k in STEMS})
    long = " ".join(text(rng, "bb", 500) for _ in range(300))
    df = docs([(1, long), (1, long), (2, "the and tion ing")]).selectExpr("*", "'k' AS lang", "1 AS low", "2 AS buckets", "3 AS rank")
    rows = langid.identify(df, model).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)] == ["bb", "bb", "aa"]
    assert all((r.lang, r.low, r.buckets, r.rank) == ("k", 1, 2, 3) for r in rows)
    assert langid.identify(docs([]), model).count() == 0
