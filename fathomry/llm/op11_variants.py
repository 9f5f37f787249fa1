"""Spelling variants: words one edit apart, found by their rarest bigrams.

1. ``count_words`` counts the words of whole texts; a task adds up what it sees, up to a bound of
   distinct words, before anything is shuffled.
2. All bigrams of the counted words are ordered by their number of words, rarest first. One edit
   touches at most two of a word's bigrams, so of the three rarest of either word at least one
   is the same, untouched bigram in both (equal bigrams are ordered by position, which an edit doesn't
   change). Those three are all that is joined.
3. Position limits: the edit lies after that bigram or before it. In the first case the bigram stands
   at the same distance from the start, with the same letters before it; in the second at the same
   distance from the end, with the same letters behind it. A word is looked up under both, with its own
   length and the next. Where these letters are few, the rest of the word is cut in the middle of the
   shorter one: one of its halves is untouched as well and completes the key. The join is one of
   two shuffled tables, whose large partitions adaptive execution splits, so no bigram's words are one task's.
   No table of words goes through the driver.
4. A pair whose letters differ in more than two places of a 64-bit parity mask is left (one edit changes two
   at most); the others are verified by their edit distance.
5. A word's form is its near word of largest count, if that is large enough; ``root`` follows forms
   by pointer jumping. Counts grow by RATIO with every step, so the rounds are few.

The alphabet bounds the bigrams: 26 + 64 letters make 8,100, which is what is broadcast.
How many pairs meet under one key grows with the vocabulary, not with the documents.

Defined results: a null or empty text has no words; a null doc_id is written as an empty string
in the seed; repeated rows count each; a run of any length is a word like any other; of near
words with equal counts the smallest in code-point order is the form; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import bound_batches, with_bytes
from ._work import Work

#: Code points and occurrences of a word at least, and how many times as frequent its form is.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many (by the crc32 of document and run) loses a letter.
NOISE = 199
#: Distinct words that a task counts before it hands them on: about 30 MB.
PARTIAL_WORDS = 200_000
#: Bigrams that are joined: 2 for each edit, and one more.
PREFIX = 3
#: Letters up to the bigram that make a key by themselves; with fewer, half of the others completes it.
TELLING = 5


def counted(docs: DataFrame, least_chars: int = LEAST_CHARS, noise: int = NOISE) -> DataFrame:
    """(word, n): partial counts of what each task saw; words of fewer than least_chars code points are left out."""

    def run(batches):
        find = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least_chars).findall
        seen: Counter = Counter()

        def flush():
            kept = [(w, n) for w, n in seen.items() if n and len(w) >= least_chars]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs = find((text.as_py() or b"").lower().decode("utf-8", "replace"))
                seen.update(runs)
                # The seed depends on document and run alone, so all of a run's occurrences here change alike.
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                hit = [w for w in set(runs) if not zlib.crc32(w.encode(), start) % noise]
                if hit:
                    times = Counter(w for w in runs if w in set(hit))
                    for w in hit:
                        at = zlib.crc32(w.encode(), start) % len(w)
                        seen[w] -= times[w]
                        seen[w[:at] + w[at + 1 :]] += times[w]
                if len(seen) >= PARTIAL_WORDS:
                    yield flush()
        if seen:
            yield flush()

    bound_batches(docs.sparkSession)
    return with_bytes(docs.select("doc_id", "text")).mapInArrow(run, "word string, n long")


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of the words with at least so many code points and occurrences."""
    return counted(docs, least_chars, noise).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mask(word: Column) -> Column:
    """The parity of each letter's number, folded into 64 bits: one edit changes two of them at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(bit(c)))


def _dealt(words: DataFrame) -> DataFrame:
    """A side that grows with the vocabulary is dealt out by the join's key: the size of its compressed file, or the row
    that Spark takes for the many that a word is exploded to, would else make it a broadcast, whole in the driver."""
    return words.hint("merge")


def prefixes(work: Work, words: DataFrame) -> DataFrame:
    """(word, n, size, mask, places): where the three rarest bigrams of every word stand (from 1), written.

    words(word, n) has words of at least four code points.
    """
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.struct(i.alias("at"), F.substring("word", i, 2).alias("gram")))
    distinct = words.select(F.explode(F.array_distinct(F.transform(grams, lambda g: g.gram))).alias("gram"))
    rank = work.save(distinct.groupBy("gram").agg(F.count("*").alias("words")), "bigrams", rows=0)
    # One shuffle by word: what is gathered is a word's own bigrams.
    dealt = words.repartition("word").select("word", "n", F.inline(grams))
    order = F.array_sort(F.collect_list(F.struct("words", "gram", "at")))
    by_word = dealt.join(F.broadcast(rank), "gram").groupBy("word", "n").agg(F.transform(F.slice(order, 1, PREFIX), lambda x: x["at"]).alias("places"))
    return work.save(by_word.select("word", "n", F.char_length("word").alias("size"), _mask(F.col("word")).alias("mask"), "places"), "prefixes")


def near_pairs(work: Work, words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words(word, n) that are exactly one edit apart, written."""
    found = prefixes(work, words)
    before = lambda i: F.struct(F.lit(1).alias("side"), F.substring("word", i, F.col("size")).alias("part"), F.substring("word", F.lit(1), i - 1).alias("rest"))
    after = lambda i: F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), i + 1).alias("part"), F.substring("word", i + 2, F.col("size")).alias("rest"))
    sides = F.flatten(F.transform("places", lambda i: F.array(after(i), before(i))))
    keyed = found.select("word", "n", "size", "mask", F.explode(sides).alias("k")).select("word", "n", "size", "mask", "k.*")
    rest = F.char_length("rest")

    def keys(longer: int, size: Column, short: Column) -> Column:
        """Keys of a word as one of two of equal length, or as one of two whose shorter has this size and rest."""
        half = F.floor(short / 2).cast("int")
        halves = F.array(F.struct(F.lit(0).alias("half"), F.left("rest", half).alias("piece")), F.struct(F.lit(1).alias("half"), F.right("rest", short - half).alias("piece")))
        whole = F.array(F.struct(F.lit(2).alias("half"), F.lit("").alias("piece")))
        pieces = F.when(F.char_length("part") >= TELLING, whole).otherwise(halves)
        return F.transform(pieces, lambda p: F.xxhash64(F.lit(longer), "side", "part", size, p.half, p.piece))

    alike, size = keys(0, F.col("size"), rest), F.col("size")
    probes = keyed.select("word", "n", "size", "mask", F.explode(F.concat(alike, keys(1, size, rest))).alias("key"))
    index = keyed.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("mask").alias("other_mask"), F.col("size").alias("other_size"), F.explode(F.concat(alike, keys(1, size - 1, rest - 1))).alias("key"))
    met = probes.join(_dealt(index), "key").where((F.col("size") < F.col("other_size")) | (F.col("word") < F.col("other")))
    met = met.where(F.bit_count(F.col("mask").bitwiseXOR(F.col("other_mask"))) <= 2).where(F.levenshtein("word", "other", 1) == 1)
    once = work.save(met.select("word", "n", "other", "other_n").distinct(), "pairs")
    return once.union(once.select("other", "other_n", "word", "n"))


def follow(work: Work, forms: DataFrame) -> DataFrame:
    """(word, root): where forms(word, form) lead to in the end, by pointer jumping; written."""
    n, round_no = forms.count(), 0
    roots = work.save(forms.select("word", F.col("form").alias("root")), "roots-0", rows=n)
    while True:
        round_no += 1
        beyond = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumped = roots.join(_dealt(beyond), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        jumped = work.save(jumped, f"roots-{round_no}", rows=n)
        work.drop(f"roots-{round_no - 1}")
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return roots


def variants(work: Work, docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = work.save(count_words(docs, least_chars, least_count, noise), "words")
    pairs = near_pairs(work, words)
    # The largest count, then the smallest word; strings compare by UTF-8, which is code-point order.
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = work.save(near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")), "near")
    held = words.join(_dealt(near), "word", "left")
    formed = (F.col("other_n") >= ratio * F.col("n")).alias("formed")
    held = held.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("other")).alias("form"), F.when(formed, F.col("other_n")).alias("form_n"))
    held = work.save(held, "held")
    roots = follow(work, held.where("form IS NOT NULL").select("word", "form"))
    work.drop("words", "bigrams", "prefixes", "pairs", "near")
    return held.join(_dealt(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
