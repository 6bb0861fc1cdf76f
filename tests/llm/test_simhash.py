import random

import pytest
import xxhash
from llm_odd import ODD

from tarn.llm import simhash


def brute_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(rows):
    """doc_id: smallest id reachable by links of at most 4 bits."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints():
    texts = [*ODD, "The Quick brown fox jumps over the lazy dog", "ÀÉ àé A b C d e"]
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == brute_fingerprint(t), t


def test_masks_meet_every_pair():
    rng = random.Random(1)
    for blocks in (6, 7, 8, 10):
        masks = simhash.block_masks(blocks)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(diff & m == 0 for m in masks)


@pytest.mark.parametrize("n", [10, 10**7, 10**12])
def test_links_and_components(spark, n, monkeypatch):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for base in list(fps)[:30]:
        at = base
        for _ in range(rng.randint(1, 12)):
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5)))
            fps.add(at)
    for _ in range(150):  # a dense ball
        fps.add(sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.link_forest(frame, n)
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    got = [roots.get(f, f) for f in fps]
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    groups = lambda keys: {frozenset(i for i, k in enumerate(keys) if k == x) for x in set(keys)}
    assert groups(got) == groups(want)


def test_query(docs):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word200 ", "other ")
    rows = [*enumerate(ODD), (50, base), (40, near), (41, base), (41, base), (None, base), (None, "alone and without an id at all")]
    got = simhash.near_duplicates(docs(rows).selectExpr("*", "1 AS fp", "2 AS component_id")).collect()
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(repr((d, f"{f:016x}", c)) for (d, f), c in zip(fps, brute_components(fps), strict=True))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(docs([])).count() == 0


def jaccard(a, b, size=5):
    cut = lambda t: {tuple(t.split()[i : i + size]) for i in range(max(1, len(t.split()) - size + 1))}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_one_stays(docs):
    base = " ".join(f"word{i}" for i in range(6000))
    rows = [(3, base), (2, base.replace("word200 ", "other ")), (2, base.replace("word200 ", "other ")), (None, base), (9, "something else entirely here"), (None, "no id here at all but words"), (None, None), (12, " ")]
    names = ["key_id", "key_text", "fp", "row", "rest", "first", "id", "files", "node"]
    df = docs(rows).selectExpr("*", *[f"concat('v', doc_id) AS {n}" for n in names], "7 AS more")
    found = simhash.without_near_duplicates(df)
    assert found.columns == df.columns and found.dtypes == df.dtypes
    kept = found.collect()
    assert sorted((str(r.doc_id), r.more) for r in kept) == [("12", 7), ("2", 7), ("9", 7), ("None", 7)]
    assert all(r[n] == (f"v{r.doc_id}" if r.doc_id else None) for r in kept for n in names)
    assert simhash.without_near_duplicates(docs([])).count() == 0


def test_near_copies_of_a_similarity_are_found(docs):
    """Of pairs about as similar as asked for most are found, of closer ones all, and none that are far apart."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(160):
        words = rng.choices(vocabulary, k=300)
        other = list(words)
        for at in rng.sample(range(300), (1, 3, 6, 25)[i % 4]):
            other[at] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((i % 4, jaccard(rows[-2][1], rows[-1][1])))
    assert min(j for k, j in pairs if k == 2) > 0.8 and max(j for k, j in pairs if k == 3) < 0.65
    kept = {r.doc_id for r in simhash.without_near_duplicates(docs(rows)).select("doc_id").collect()}
    gone = [sum(2 * i + 1 not in kept for i in range(160) if i % 4 == k) for k in range(4)]
    assert gone[0] == gone[1] == 40 and gone[2] >= 31 and gone[3] <= 1 and all(2 * i in kept for i in range(160))


def test_keys_keep_their_recall_at_any_size():
    for n in (10, 10**4, 10**7, 10**11):
        keys = simhash.wide_keys(n, 0.8)
        meets = (1 - simhash.share_of_bits(0.8)) ** keys.shape[1]
        assert 1 - (1 - meets) ** len(keys) >= 0.95 and keys.max() < simhash.WIDE
        assert all(len(set(k)) == len(k) for k in keys.tolist())


def test_wide_links_are_verified(spark):
    """Every link of a key forest is within the radius; whatever shares a key and a distance is connected."""
    rng = random.Random(5)
    fps = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(60)]
    for base in fps[:20]:
        for flips in (1, 5, 20, 60):
            x = int.from_bytes(base) ^ sum(1 << b for b in rng.sample(range(256), flips))
            fps.append(x.to_bytes(32))
    rows = list(enumerate(dict.fromkeys(fps)))
    edges = simhash.wide_links(spark.createDataFrame(rows, "node long, fp binary"), len(rows)).collect()
    fp = dict(rows)
    apart = lambda a, b: (int.from_bytes(fp[a]) ^ int.from_bytes(fp[b])).bit_count()
    assert edges and all(apart(e.a, e.b) <= simhash.radius_of(0.8) == 46 for e in edges)
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges)).collect()}
    close = [(a, b) for a, _ in rows for b, _ in rows if a < b and apart(a, b) <= 6]
    assert close and all(roots.get(a, a) == roots.get(b, b) for a, b in close)


def test_very_long_text(docs):
    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{i}" for i in range(5000)], k=300_000))
    rows = [(1, text), (2, text + " end"), (3, "x " * 200_000)]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got[1][0] == brute_fingerprint(text) and got[2][1] == 1 and got[3][1] == 3
    assert {r.doc_id for r in simhash.without_near_duplicates(docs(rows)).collect()} == {1, 3}
