import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_odd import ODD

from tarn.llm import suffixdedup
from tarn.llm.shelf import Shelf


def brute(texts, length):
    """(removed, runs, digest) of each text, by counting every string of the length."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, whole = text(330), text(700)
    rows = [*ODD, whole, whole, whole[:300] + "!" + whole[301:], text(100) + passage + text(50), passage + text(400), text(400) + passage[:250], text(150) + passage * 3, "ab" * 700, "z" * 900, "z" * 230, passage[:199], passage[:200], passage[-200:]]
    rows += [whole[: rng.randint(200, 690)] + text(30) for _ in range(25)]
    return rows


def measured(df, **options):
    return sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.measured(df, **options).collect())


@pytest.mark.parametrize(("batches", "widths"), [(1, (16, 4, 1)), (5, (64, 8, 1)), (3, (1,))])
def test_against_brute_force(docs, batches, widths, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CELLS", widths)
    texts = corpus(batches)
    want = sorted((i, *w) for i, w in enumerate(brute(texts, 200)))
    assert measured(docs(list(enumerate(texts))).repartition(4), batches=batches) == want


def test_other_lengths(docs):
    texts = corpus(7)
    want = sorted((i, *w) for i, w in enumerate(brute(texts, 40)))
    assert measured(docs(list(enumerate(texts))).repartition(3), length=40, seed=8) == want


def test_chunks_change_nothing(docs, monkeypatch):
    texts = corpus(8)
    from numpy import frombuffer, uint8

    data = frombuffer((texts[15] + texts[19]).encode(), uint8)
    whole = suffixdedup.stretches(data)
    monkeypatch.setattr(suffixdedup, "CHUNK", 256)
    parts = suffixdedup.stretches(data)
    covered = lambda found: sorted(p + i for place in found[2].tolist() for p in [place >> 16] for i in range((place & 255) + 1))
    assert covered(whole) == covered(parts) == list(range(len(data) - 199))


def test_levels_merge_geometrically(docs, spark):
    index = suffixdedup.SuffixIndex(spark, 40, 8)
    levels = []
    texts = [t for t in corpus(9) if t]
    for i in range(6):
        index.add(docs(list(enumerate(texts[i::6]))).select("text"))
        levels.append([level for level, _, _ in index.arrays])
    assert levels == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    once = suffixdedup.SuffixIndex(spark, 40, 8)
    once.add(docs(list(enumerate(texts))).select("text"))
    rows = lambda x: sorted(map(tuple, x.entries().collect()))
    assert rows(index) == rows(once)
    # The matches found on arrival are the anchors that occur twice in the end.
    found = {r.anchor for frame, _ in index.matches for r in frame.collect()}
    total = Counter()
    for anchor, _, n in rows(once):
        total[anchor] += n
    assert found == {a for a, n in total.items() if n >= 2} and len(index.matches) == 6
    index.drop()
    once.drop()


def test_query_and_stage(docs):
    base = "".join(chr(97 + i * i % 23) + "é"[: i % 2] for i in range(400))
    rows = [(1, base), (1, base), (None, base + "x"), (2, None), (3, "short")]
    got = suffixdedup.measured(docs(rows).selectExpr("*", "1 AS ranges", "2 AS key_id")).collect()
    want = sorted(repr((i, len((t or "").encode()), *w)) for (i, t), w in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert sorted(repr(tuple(r)) for r in got) == want
    cut = suffixdedup.without_repeats(docs(rows).selectExpr("doc_id", "text", "doc_id * 2 AS more")).collect()
    assert sorted(str(tuple(r)) for r in cut) == sorted(str(x) for x in [(1, "", 2), (1, "", 2), (None, "x", None), (2, None, 4), (3, "short", 6)])
    assert suffixdedup.measured(docs([])).count() == 0 and suffixdedup.without_repeats(docs([])).count() == 0


def test_cells_lie_at_multiples_of_their_size():
    for width in (16, 4, 1):
        for dist in range(169):
            for size in range(1, dist + 2):
                _, at, top, n = suffixdedup.cells(np.array([5]), np.array([dist]), np.array([size]), width)
                assert [a + i for a, k in zip(at.tolist(), n.tolist(), strict=True) for i in range(k)] == list(range(5, 5 + size))
                assert (at + top == 5 + dist).all() and (top // width == (top - n + 1) // width).all() and len(set((top // width).tolist())) == len(top)


@pytest.mark.parametrize("kinds", [511, 512, 513, 2500])
def test_rows_follow_the_ends_of_matches(spark, docs, kinds):
    """One passage in many contexts: a few rows for each text, at any number of kinds."""
    rng = random.Random(kinds)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = noise(260)
    texts = [noise(200) + passage + noise(200) for _ in range(kinds)]
    shelf = Shelf(docs(list(enumerate(texts))))
    index = suffixdedup.SuffixIndex(spark)
    index.add(shelf.rows.select("text"))
    fates, _ = suffixdedup._with_kinds(index.fates(), "anchor")
    hits = suffixdedup.places(shelf.rows, 200, 32).join(fates, ["anchor", "stretch"])
    left = hits.filter("kinds >= 2 and n = 1").selectExpr("row", "shiftright(place, 16) AS at", "shiftright(place, 8) & 255 AS dist", "(place & 255) + 1 AS size")
    made = []
    for width in suffixdedup.CELLS:
        made.append(suffixdedup._cut(shelf, left, width, 200).count())
        _, left, _ = suffixdedup._refined(shelf, left, width, 200)
    assert left.count() == 0 and sum(made) <= 60 * kinds and made[2] <= 8 * kinds
    index.drop()
    shelf.drop()


def test_very_long_text(docs, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 1 << 12)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    got = {r[0]: r[1:3] for r in measured(docs([(1, long), (2, long[150_000:150_400]), (3, long[4000:4300] + "zzz" + long[9:300])]))}
    assert got == {1: (991, 3), 2: (400, 1), 3: (591, 2)}


def test_clashing_columns_come_back(docs):
    text = "".join(chr(97 + i * i % 23) for i in range(300)) + "end"
    names = ["row", "rest", "files", "ranges", "both_", "cut_", "text_0", "key_id", "key_text", "at", "a.b"]
    df = docs([(1, text), (2, text + "x"), (3, None)]).selectExpr("*", *[f"concat('v', doc_id, {i}) AS `{n}`" for i, n in enumerate(names)], "current_timestamp() AS t", "map('k', doc_id) AS m")
    df = df.select("row", "text", *[f"`{c}`" for c in df.columns if c not in ("row", "text")])
    got = suffixdedup.without_repeats(df)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    for r in got.collect():
        assert [r[n] for n in names] == [f"v{r.doc_id}{i}" for i in range(len(names))] and r.m == {"k": r.doc_id}
