"""Quality rules in DataFrame functions only.

Every text gets counts of words, symbols, repeated lines and repeated 3-word
windows. The different words of a text, by 64-bit hash, and its different word
pairs, by bucket, are counted over all documents (raw) and over the trusted ones
(good), in one distributed table that grows with the words of the input. Words and
pairs have buckets of their own, whose number follows the bytes of the input up to
MOST_BUCKETS, so that the ratios can be a constant of the plan of the last pass.

Of an n-gram in r other documents, good texts should hold due = r * G / R, where
G and R are the sums of all good and raw counts; its evidence is the log of
(good + SMOOTH) / (due + SMOOTH), so n-grams seen seldom weigh little at any size
of input. A text's score is the mean evidence of its n-grams. The threshold is
the QUANTILE of the scores of trusted texts that pass the base rules, each scored
with its own n-grams left out of both counts, as any other text is; so it follows
the input, and few clean texts fall below it.

A mean over hundreds of n-grams hides a few telling ones, so single words count
too, by their exact hashes: a word is damning when at least EXPECTED trusted
texts are due to hold it and at most one in RARE of these do. A word must also lie
in texts of SPREAD of 64 classes of text hashes, so that copies of one text damn
nothing. A text is kept when no base rule rejects it, its score reaches the
threshold and it holds no damning word; the same text always has one verdict.

The trusted texts are all labelled documents (quality 1, toxic 0), at any number of
them: their ids are a table of their own that meets the documents in a join, their
scores are stored, and the threshold is found by counts of scores. Up to MOST_DAMNING
damning words are a constant of the plan; more are a table that meets the words of
the texts, with the same verdicts.

Defined cases: a null or wordless text has zero counts, score zero and fails the
base rules; a text of one word has a single n-gram; texts of any length are read
whole; in the counts an n-gram stands once for a text, so a very long text has no
more weight than its different n-grams; repeated rows are further documents; repeated labels
count once; without trusted texts that pass the base rules, scores are zero or
decide nothing and the base rules decide; an empty table gives an empty table;
other columns come back unchanged, but those with the names of the new ones (in
any case) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Buckets of words, and as many of pairs: the least and the most.
LEAST_BUCKETS = 1 << 12
MOST_BUCKETS = 1 << 15
#: Characters of a plan that the driver keeps as text; a plan here holds all ratios.
PLAN_TEXT = 1 << 16
#: Ids of trusted documents that are broadcast; more meet the documents as Spark finds best, by a shuffle of texts.
BROADCAST_IDS = 1 << 20
#: Damning words in the plan of the last pass; more meet the texts in a join.
MOST_DAMNING = 1 << 15
#: Cells that one round of a quantile counts, and scores that the driver sorts at the end.
CELLS = 1 << 12
QUANTILE = 0.005
SMOOTH = 1.0
EXPECTED = 8
RARE = 10
SPREAD = 16
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, inside one expression.

    A plain column will not do: the optimizer may put its definition back into a
    lambda, which then computes it once for each element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes(listed: Column) -> Column:
    return F.transform(listed, lambda w: F.xxhash64(w))


def _pairs(h: Column) -> Column:
    """Hashes of neighbouring words; none for fewer than two."""
    return F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda b, i: F.xxhash64(h[i], b))


def grams(h: Column, size: int) -> Column:
    """Different n-grams of hashed words: hashes of words, and buckets of pairs (from 0 to size - 1)."""
    pairs = F.transform(_pairs(h), lambda x: F.pmod(x, F.lit(size)))
    return F.concat(F.array_distinct(h), F.array_distinct(pairs))


def buckets_for(octets: int) -> int:
    """A power of two that follows the number of different n-grams to expect in so many bytes."""
    wanted = max(1, octets) ** 0.7 / 4
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << round(math.log2(max(1, wanted)))))


def repeated(h: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more."""

    def covered(at: Column) -> Column:
        # Each window covers three words, less where the next repeated window starts sooner.
        gap = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(at[i + 1] - p, F.lit(3))).otherwise(3))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, b: a + b)

    def twice(rows: Column) -> Column:
        same = F.filter(rows, lambda r, i: ((i > 0) & (F.get(rows, i - 1)["h"] == r["h"])) | ((i + 1 < F.size(rows)) & (F.get(rows, i + 1)["h"] == r["h"])))
        return let(F.sort_array(F.transform(same, lambda r: r["p"])), covered)

    def counted(w: Column) -> Column:
        rows = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(rows, twice)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda c, i: F.xxhash64(h[i], h[i + 1], c))
    return let(windows, counted)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents, with trusted_, 1; stored, so that their number and size are known to joins."""
    known = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    ids, _ = stored(known.withColumn("trusted_", F.lit(1)), "trusted")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of the stored column score, between neighbours in proportion; None without scores.

    Each round counts the scores by CELLS equal steps and goes on in the cell that
    holds the place, so that neither a task nor the driver holds all scores.
    """

    def place(part: DataFrame, k: int) -> float:
        while True:
            n, low, high = part.agg(F.count("score"), F.min("score"), F.max("score")).first()
            if low == high:
                return low
            if n <= CELLS:
                return sorted(r.score for r in part.collect())[k]
            # The least and the greatest score never share a cell, so each round leaves fewer.
            cell = F.floor((F.col("score") - low) / (high - low) * CELLS)
            for r in sorted(part.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()):
                if k < r.n:
                    break
                k -= r.n
            part = part.filter(cell == r.cell)

    known = scores.filter("score is not null")
    n = known.count()
    if not n:
        return None
    at = share * (n - 1)
    below = place(known, math.floor(at))
    above = place(known, math.ceil(at))
    return below if below == above else (math.ceil(at) - at) * below + (at - math.floor(at)) * above


class Evidence:
    """What the corpus says: counts of n-grams, ratios by bucket, damning words and the threshold."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        key, spark = "spark.sql.maxPlanStringLength", docs.sparkSession
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or int(now) > PLAN_TEXT:
            spark.conf.set(key, f"{PLAN_TEXT}b")
        self.docs, self.trusted = docs.select("doc_id", "text"), trusted(labels)
        # Lengths instead of texts meet the ids here.
        lengths = self.docs.select("doc_id", F.octet_length("text").cast("long").alias("octets")).join(self.trusted, "doc_id", "left")
        octets, self.good = lengths.agg(F.sum("octets"), F.count("trusted_")).first()
        self.size = buckets_for(octets or 0)
        if not self.good:
            return
        kind = F.expr("shiftleft(1L, cast(pmod(xxhash64(text), 64) AS int))")
        # The class of a text is computed before its n-grams are dealt out, and the text left behind.
        texts = self.docs.join(self.trusted, "doc_id", "left").select("trusted_", kind.alias("kind"), let(hashes(words(F.col("text"))), lambda h: grams(h, self.size)).alias("grams"))
        held = texts.select("trusted_", "kind", F.explode("grams").alias("gram"))
        counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted_").alias("good"), F.bit_or("kind").alias("kinds"))
        self.counts, _ = stored(counts, "grams")
        self.raw_sum, self.good_sum = self.counts.agg(F.sum("raw"), F.sum("good")).first()
        self.raw, self.each_good = self._table()

    def is_pair(self) -> Column:
        return F.col("gram").between(0, self.size - 1)

    def _table(self) -> tuple[list[int], list[int]]:
        """Raw and good counts of the buckets of words, then of those of pairs; at most 2 * MOST_BUCKETS rows come to the driver."""
        place = F.when(self.is_pair(), F.col("gram") + self.size).otherwise(F.pmod("gram", F.lit(self.size))).cast("int")
        raw, good = [0] * (2 * self.size), [0] * (2 * self.size)
        for r in self.counts.groupBy(place.alias("place")).agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
            raw[r.place], good[r.place] = r.raw, r.good
        return raw, good

    def ratios(self, own: int = 0) -> list[float]:
        """Evidence of each bucket for a text that is in the raw counts, and ``own`` times in the good ones."""
        if not self.good:
            return [0.0] * (2 * self.size)
        share = (self.good_sum / self.raw_sum) if self.raw_sum else 0.0
        return [math.log((max(0, g - own) + SMOOTH) / (max(0, r - 1) * share + SMOOTH)) for r, g in zip(self.raw, self.each_good, strict=True)]

    def damning(self) -> list[int] | DataFrame:
        """Hashes of the words that trusted texts avoid: a list, or beyond MOST_DAMNING a table (gram)."""
        if not self.good:
            return []
        due = F.col("raw") * F.lit(self.good_sum / self.raw_sum if self.raw_sum else 0.0)
        found = self.counts.filter(~self.is_pair() & (due >= EXPECTED) & (RARE * F.col("good") <= due) & (F.bit_count("kinds") >= SPREAD))
        table, _ = stored(found.select("gram"), "damning")
        return table if table.count() > MOST_DAMNING else sorted(r.gram for r in table.collect())

    def threshold(self) -> float:
        """The QUANTILE of the scores of all trusted texts, each left out of the counts."""
        if not self.good:
            return -math.inf
        # Where texts were shuffled to be counted, those files are not needed any more.
        release(self.docs.sparkSession)
        texts = self.docs.join(self.trusted, "doc_id")
        own = texts.select(verdict(F.col("text"), constant(self.ratios(own=1)), self.size, -math.inf, []).alias("found"))
        scores, _ = stored(own.select(F.when(~F.col("found.base_failed"), F.col("found.score")).alias("score")), "scores")
        found = quantile(scores, QUANTILE)
        return -math.inf if found is None else found


def constant(values: list[float]) -> Column:
    """A bounded list of numbers as a foldable expression."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<float>")


def _measured(text: Column, listed: Column, h: Column, ratio: Column, size: int, avoided: list[int] | Column) -> Column:
    """Base counts, score and whether a word is damning (one of a list, or as a column says), as a struct, from a text, its words and their hashes."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD))
    word = F.transform(h, lambda x: F.pmod(x, F.lit(size)).cast("int"))
    pair = F.transform(_pairs(h), lambda x: (F.pmod(x, F.lit(size)) + size).cast("int"))
    mean = let(F.concat(word, pair), lambda at: F.when(F.size(at) > 0, F.aggregate(at, F.lit(0.0), lambda a, x: a + ratio[x]) / F.size(at)).otherwise(F.lit(0.0)))
    if isinstance(avoided, Column):
        damned = avoided
    else:
        damned = F.exists(h, lambda x: x.isin(avoided)) if avoided else F.lit(False)
    return F.struct(
        F.size(listed).cast("long").alias("n_words"),
        F.length(F.array_join(listed, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated(h).alias("n_repeat_words"),
        mean.alias("score"),
        damned.alias("damned"),
    )


NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept")


def verdict(text: Column, ratio: Column, size: int, threshold: float, avoided: list[int] | Column) -> Column:
    """All new columns of a text as one struct: a text is split and hashed once, wherever the struct is used once."""

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & (m["score"] >= F.lit(threshold)) & ~m["damned"]
        return F.struct(*[m[c].alias(c) for c in NEW[:6]], failed.alias("base_failed"), kept.alias("kept"))

    return let(words(text), lambda w: let(hashes(w), lambda h: let(_measured(text, w, h, ratio, size, avoided), judged)))


def _key(text: Column) -> Column:
    """A text by 128 bits of hashes."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def holders(docs: DataFrame, avoided: DataFrame) -> DataFrame:
    """Keys of the texts that hold a word of the table (gram); the words of a text leave it behind."""
    said = docs.select(_key(docs["text"]).alias("key"), F.explode(F.array_distinct(hashes(words(docs["text"])))).alias("gram"))
    found = said.join(avoided, "gram", "left_semi").select("key").distinct()
    return stored(found.withColumn("held", F.lit(True)), "damned")[0]


def rules(docs: DataFrame, ratio: Column, size: int, threshold: float, avoided: list[int] | DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text and any others) with base counts, score and verdict; avoided are hashes of damning words, as a list or a table (gram)."""
    kept = [c for c in docs.columns if c.lower() not in NEW]
    # Columns of the input travel in a struct, beside which no name is taken.
    boxes = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in kept]).alias("box"))
    text, damned = F.col("box").getField("text"), avoided
    if isinstance(avoided, DataFrame):
        boxes = boxes.withColumn("key", _key(text)).join(holders(docs, avoided), "key", "left")
        damned = F.col("held").isNotNull()
    made = boxes.select("box", verdict(text, ratio, size, threshold, [] if damned is None else damned).alias("found"))
    return made.select(*[F.col("box").getField(c).alias(c) for c in kept], *[F.col("found").getField(c).alias(c) for c in NEW])


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """Both passes: evidence over all documents, then every document's verdict; threshold overrides that of the evidence."""
    found = Evidence(docs, labels)
    return rules(docs, constant(found.ratios()), found.size, found.threshold() if threshold is None else threshold, found.damning())
