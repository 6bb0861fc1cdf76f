import random
import re
from collections import Counter

from llm_odd import ODD
from pyspark.sql import functions as F

from tarn.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORDS.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


TEXTS = [*ODD, "a b c a b c d e f\na b c\n\na b c", "w # * $ % & | < >", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 7}" for i in range(100)), "x\ny\nx\n \nx"]


def test_base_counts(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs(list(enumerate(TEXTS))), labels).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert r.score == 0 and r.kept == (not r.base_failed)


def test_scores_against_brute_force(docs, spark):
    """Scores, threshold and verdicts by counting different words, and pairs by bucket, in plain Python."""
    from math import log

    import numpy as np

    good = [" ".join(f"good{(i * j) % 83}" for j in range(1, 70)) for i in range(1, 9)]
    bad = [" ".join(f"junk{(i * j) % 83}" for j in range(1, 70)) for i in range(1, 9)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)] * 2 + [(None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    df = docs(rows)
    size = quality.buckets_for(sum(len(t) for _, t in rows))
    listed = {r.doc_id: r.h for r in df.select("doc_id", quality.hashes(quality.words(F.col("text"))).alias("h")).collect()}
    paired = {r.doc_id: r.p for r in df.select("doc_id", quality._pairs(quality.hashes(quality.words(F.col("text")))).alias("p")).collect()}
    own = {d: [("w", x) for x in set(listed[d])] + [("p", x) for x in {p % size for p in paired[d]}] for d in listed}
    place = lambda g: g[1] % size if g[0] == "w" else size + g[1]
    raw, trusted = Counter(), Counter()
    for d, g in own.items():
        raw.update(map(place, g))
        trusted.update(map(place, g) if d < 8 else [])
    share = sum(trusted.values()) / sum(raw.values())
    evidence = lambda b, left=0: log((max(0, trusted[b] - left) + 1) / (max(0, raw[b] - 1) * share + 1))
    # Counts hold an n-gram once for each text; the mean is over all n-grams of a text.
    said = {d: [("w", x) for x in listed[d]] + [("p", x % size) for x in paired[d]] for d in listed}
    score = {d: sum(evidence(place(g)) for g in said[d]) / len(said[d]) for d in said}
    out = {d: sum(evidence(place(g), 1) for g in said[d]) / len(said[d]) for d in range(8)}
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    limit = np.quantile([out[d] for d in out if not got[d].base_failed], quality.QUANTILE)
    for d, w in score.items():
        assert abs(got[d].score - w) < 1e-4
        assert got[d].kept == (not got[d].base_failed and w >= limit)
        assert not got[d].kept or d < 8


def test_verdicts_do_not_depend_on_size_or_on_the_label(docs, spark):
    """Clean texts that nobody labelled are kept about as often as labelled ones, at any size."""
    rng = random.Random(8)
    for n in (120, 1000):
        rows = [(i, " ".join(f"word{int(2000 * rng.random() ** 2)}" for _ in range(rng.choice((60, 150, 300))))) for i in range(n)]
        rows += [(n + i, " ".join(f"junk{int(2000 * rng.random() ** 2)}" for _ in range(150))) for i in range(n // 5)]
        known = spark.createDataFrame([(i, 1, 0) for i in range(0, n, 3)], "doc_id long, quality int, toxic int")
        got = {r.doc_id: r.kept for r in quality.judge(docs(rows), known).collect()}
        unlabelled = [got[i] for i in range(n) if i % 3]
        assert sum(unlabelled) >= 0.95 * len(unlabelled) and all(got[i] for i in range(0, n, 3))
        assert sum(got[n + i] for i in range(n // 5)) <= 0.1 * (n // 5)


def test_buckets_follow_the_input():
    sizes = [quality.buckets_for(n) for n in (0, 10**6, 10**7, 3 * 10**7, 10**14)]
    assert sizes == sorted(sizes) and sizes[0] == quality.LEAST_BUCKETS and sizes[-1] == quality.MOST_BUCKETS and len(set(sizes)) >= 4


def test_clashing_columns_and_long_texts(docs, spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    names = ["words_", "hash_", "box", "words", "hash", "damned", "trusted_", "gram", "a.b"]
    df = docs([(1, long), (2, None), (1, long)]).selectExpr("*", *[f"'{i}' AS `{n}`" for i, n in enumerate(names)])
    got = quality.judge(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert got.columns[: len(df.columns)] == df.columns
    for r in got.collect():
        assert [r[n] for n in names] == [str(i) for i in range(len(names))]
        assert (r.n_words, r.kept) == ((120_000, True) if r.doc_id == 1 else (0, False))


def test_native_and_whole(docs, spark):
    df = docs(list(enumerate(TEXTS))).selectExpr("*", "1 AS kept", "'x' AS Score", "3 AS lang")
    labels = spark.createDataFrame([(17, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(df, labels)
    assert sorted(c.lower() for c in judged.columns) == sorted(["doc_id", "text", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"])
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert judged.count() == len(TEXTS)
    assert quality.judge(docs([]), labels).count() == 0


def test_a_filter_does_not_repeat_work(docs, spark):
    """A verdict filtered away from its columns still takes about linear time."""
    import time

    text = " ".join(f"w{i * i % 997}" for i in range(20_000))
    judged = quality.judge(docs([(1, text)]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    began = time.monotonic()
    assert judged.filter("kept").select("doc_id").count() in (0, 1)
    assert time.monotonic() - began < 30


def test_damning_words(docs, spark):
    """Insults in long clean texts are found without toxic labels, and copies of one text damn nothing."""
    rng = random.Random(3)
    clean = lambda: [f"word{int(400 * rng.random() ** 2)}" for _ in range(300)]
    toxic = {i for i in range(600) if i % 10 == 7}
    rows = [(i, " ".join(clean() + (["moron"] if i in toxic else []))) for i in range(600)]
    copy = " ".join([*clean(), "unusual"])
    rows += [(600 + i, copy) for i in range(60)]
    known = [(i, 1, 0) for i in range(0, 600, 2) if i not in toxic] + [(1, 1, 0), (3, 1, 0)]
    got = {r.doc_id: r.kept for r in quality.judge(docs(rows), spark.createDataFrame(known, "doc_id long, quality int, toxic int"), threshold=-9.0).collect()}
    assert not any(got[i] for i in toxic)
    assert all(k for i, k in got.items() if i not in toxic)


def test_all_trusted_texts_count(docs, spark):
    """Counts and threshold are of every trusted text, also where there are many."""
    import numpy as np

    rng = random.Random(5)
    n = 20_300
    df = docs([(i, " ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(52))) for i in range(n)])
    found = quality.Evidence(df, spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic"))
    assert found.good == n and found.each_good == found.raw and found.good_sum == found.raw_sum
    own = quality.rules(df, quality.constant(found.ratios(own=1)), found.size, 0.0).filter("not base_failed")
    scores = [r.score for r in own.select("score").collect()]
    assert len(scores) > 20_000 and abs(found.threshold() - np.quantile(scores, quality.QUANTILE)) < 1e-12


def test_quantile_is_exact(spark, monkeypatch):
    """Few cells, ties and far ends change nothing."""
    rng = random.Random(6)
    lists = [[], [None], [2.5], [1.0] * 50, [-1e300, 0.0, 5e-324, 1e-9, 1e9] * 9, [round(rng.gauss(0, 1), 1) for _ in range(500)], [rng.gauss(0, 1) for _ in range(300)] + [None] * 9]
    for cells in (4, 1 << 12):
        monkeypatch.setattr(quality, "CELLS", cells)
        for values in lists:
            df = spark.createDataFrame([(v,) for v in values], "score double").cache()
            for share in (0.005, 1.0):
                assert quality.quantile(df, share) == df.agg(F.percentile("score", F.lit(share))).first()[0]


def test_verdicts_by_joins_are_the_same(docs, spark, monkeypatch):
    """Damning words as a table, and ids too many to broadcast, give the verdicts of constants and broadcasts."""
    rng = random.Random(3)
    clean = lambda: [f"word{int(400 * rng.random() ** 2)}" for _ in range(150)]
    toxic = {i for i in range(600) if i % 10 == 7}
    rows = [(i, " ".join(clean() + (["moron", "moron", "idiot"] if i in toxic else []))) for i in range(600)]
    rows += [(7, rows[7][1]), (600, rows[7][1]), (None, rows[17][1]), (None, rows[3][1]), (601, None), (602, "")]
    df = docs(rows).selectExpr("*", "1 AS key", "2 AS held", "3 AS gram", "4 AS `a.b`")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 600, 2)] + [(2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    judged = lambda: sorted(quality.judge(df, labels, threshold=-9.0).collect(), key=order)
    limit = quality.Evidence(df, labels).threshold()
    want = judged()
    assert len(want) == len(rows) and not any(r.kept for r in want if "moron" in (r.text or "")) and sum(r.kept for r in want) > 500
    monkeypatch.setattr(quality, "MOST_DAMNING", 0)
    assert judged() == want
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    try:
        assert judged() == want and quality.Evidence(df, labels).threshold() == limit
    finally:
        spark.conf.set(key, before)
