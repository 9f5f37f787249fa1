"""Spelling variants, packing and periodic runs on small tables with every awkward case, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import _packing, op11_variants, op12_packing, op13_runs, queries
from fathomry.llm._work import Work

DOCS = "doc_id long, text string, word string, n long, key string, runs string, length string, __row long, __number long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with what operators compute."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "l", 5, 6) for i, t in rows], DOCS)


def table(spark, tmp_path, rows):
    docs_of(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# -- 11 ----------------------------------------------------------------------------------


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:]


def brute_variants(rows, least=5, noise=199):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("noise", [199, 5])
def test_variants_equal_brute_force(spark, noise):
    rng = np.random.default_rng(4)
    letters = list("abcdeéÿxz")
    words = ["".join(rng.choice(letters, int(rng.integers(5, 10)))) for _ in range(25)]
    for w in list(words):  # one edit away, at either end and inside
        for at in (0, len(w) // 2, len(w)):
            words += [w[:at] + "q" + w[at:], w[:at] + w[at + 1 :], w[:at] + "w" + w[at + 1 :]]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaab", "baaaaa", "l" * 3000, "l" * 3001]
    rows = [(i, " ".join(rng.choice(words, 60)).upper() if i % 3 else ", ".join(rng.choice(words, 200))) for i in range(120)]
    rows += [(i, " ".join([words[k]] * 40)) for i, k in ((500, 0), (501, 7), (502, 30), (None, 3), (500, 0))] + [(7, None), (8, ""), (9, "ÀÉ×÷ 12 short")]
    rows += [(None, "Ärgernis " * 30 + "argernis " * 6 + "l" * 3001 + " hyphen-ated under_score")]
    rows += [(600, "chainaaa " * 300), (601, "chainaa " * 40), (602, "chaina " * 6)]
    got = {tuple(r) for r in op11_variants.variants(Work(spark, "t"), docs_of(spark, rows), noise=noise).collect()}
    want = brute_variants(rows, noise=noise)
    assert got == want and any(r[4] == 0 for r in want)
    assert ("chaina", "chainaa", "chainaaa", 6, 1, 40) in want or noise == 5


def test_variants_keep_partial_counts(spark, monkeypatch):
    """Counts handed on early add up, and an empty table or one of nulls has no words."""
    rows = [(i, f"common words {'abcdefgh'[: 6 + i % 3]} written{'s' * (i % 2)}") for i in range(60)]
    monkeypatch.setattr(op11_variants, "PARTIAL_WORDS", 1)
    assert {tuple(r) for r in op11_variants.variants(Work(spark, "t"), docs_of(spark, rows)).collect()} == brute_variants(rows)
    for none in ([], [(1, None), (None, "")]):
        assert op11_variants.variants(Work(spark, "t"), docs_of(spark, none)).isEmpty()


def test_variants_broadcast_no_table_of_words(spark, monkeypatch):
    """Only the bigrams, which the alphabet bounds, are broadcast, however small the words' files are."""
    rows, plans, save = [(i, f"common words written{'s' * (i % 2)} {'chain' * 40}") for i in range(60)], {}, Work.save

    def saved(self, df, name, *args, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name, *args, **options)

    monkeypatch.setattr(Work, "save", saved)
    out = op11_variants.variants(Work(spark, "t"), docs_of(spark, rows))
    plans["out"] = out._jdf.queryExecution().executedPlan().toString()
    assert {n for n, p in plans.items() if "Broadcast" in p} == {"prefixes"}
    assert {"pairs", "held", "roots-1", "out"} <= {n for n, p in plans.items() if "SortMergeJoin" in p}


# -- 12 ----------------------------------------------------------------------------------


def held(blocks, capacity):
    """How many documents of each length the blocks hold; their numbers are a length's from 0, each once."""
    counts, ranges = np.zeros(capacity + 1, int), defaultdict(list)
    for b in blocks:
        assert 0 < b.used <= capacity and b.count > 0
        at = 0
        for length, first, each, offset in b.entries:
            assert offset == at
            at += length * each
            counts[length] += b.count * each
            ranges[length].append((first, first + b.count * each))
        assert at == b.used
    for r in ranges.values():
        ends = [0, *(e for _, e in sorted(r))]
        assert [s for s, _ in sorted(r)] == ends[:-1]
    return counts


def sequences_of(blocks):
    return sum(b.count for b in blocks)


@pytest.mark.parametrize("kind", ["mixed", "thirds", "hot", "few", "small", "full", "none"])
def test_packing_is_whole_and_tight(kind):
    rng, capacity = np.random.default_rng(3), 512
    lengths = {
        "mixed": rng.integers(1, 512, 5000), "thirds": rng.integers(128, 225, 5000), "hot": np.r_[np.full(9000, 171), rng.integers(1, 500, 300)],
        "few": [400, 300, 200, 112, 100], "small": rng.integers(1, 20, 800), "full": [512] * 7 + [511], "none": [],
    }[kind]
    counts = np.bincount(np.array(lengths, int), minlength=capacity + 1)
    for share in (1 / 2, 1 / 3, 1 / 5):
        assert (held(_packing.grouped(counts, capacity, int(capacity * share) + 1, 16), capacity) == counts).all()
    best = _packing.pack(counts, capacity, op12_packing.SHARES, 32, 0.001)
    assert (held(best, capacity) == counts).all()
    alone = sequences_of(_packing.best_fit(counts, np.zeros(capacity + 1, np.int64), [], capacity))
    least = -(-int(sum(lengths)) // capacity)
    assert least <= sequences_of(best) <= alone
    if kind == "thirds":  # where best fit alone wastes a tenth
        assert sequences_of(best) < 0.95 * alone
    if kind in ("small", "few", "none"):
        assert sequences_of(best) - least <= 1


def test_configurations_cover_demands():
    sizes, demands = [400, 300, 212, 150], [100, 77, 310, 45]
    configs = _packing.configurations(sizes, demands, 512)
    assert len(configs) <= len(sizes) and all(sum(a * s for a, s in zip(c, sizes)) <= 512 for c, _ in configs)
    covered = [sum(c[i] * n for c, n in configs) for i in range(4)]
    assert all(d - c <= len(sizes) * 512 // s for c, d, s in zip(covered, demands, sizes))


def test_sequences_equal_tokenizer(spark, monkeypatch):
    from tokenizers import Tokenizer

    vocabulary = op12_packing.vocabulary(None)
    tokenizer = Tokenizer.from_str(vocabulary)
    monkeypatch.setattr(op12_packing, "BLOCK", 1000)
    monkeypatch.setattr(op12_packing, "KEPT_WORDS", 40)
    rng = np.random.default_rng(8)
    odd = ["J̌ a, Åx.", "<|endoftext|> a<|ENDOFTEXT|>b", "it's we're, don't. 'S", "É.x È, éa. naïve; İ", "3.14 $5—b “q” 中文。", "\x1c \x85 ", "x" * 9000, "a.́b c,́"]
    rows = list(enumerate(odd)) + [(20 + i, " ".join(rng.choice(["The", "the", "naïve,", "Été", "word.", "It's", "x9"], int(rng.integers(0, 900))))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "many words " * 5000), (None, "no id"), (20, "twice"), (20, "twice")]
    placed = op12_packing.sequences(Work(spark, "t"), docs_of(spark, rows), with_ids=True)
    got = placed.collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[i, k, at, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in by.values():
        ends = [0, *np.cumsum([n for _, n, _ in sorted(parts)])]
        assert [o for o, _, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    alone = _packing.best_fit(np.bincount([r.length for r in got], minlength=2049), np.zeros(2049, np.int64), [], 2048)
    assert -(-sum(r.length for r in got) // 2048) <= len(by) <= sequences_of(alone)
    for r in op12_packing.packed(placed).collect():
        assert bytes(r.ids) == b"".join(p for _, _, p in sorted(by[r.sequence_id])) and len(r.documents) == len(by[r.sequence_id])
    plain = op12_packing.sequences(Work(spark, "t"), docs_of(spark, rows))
    assert plain.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and plain.count() == len(got)
    assert op12_packing.sequences(Work(spark, "t"), docs_of(spark, [])).isEmpty()


# -- 13 ----------------------------------------------------------------------------------


def brute_runs(w):
    """(start, length, period) of all runs: every period, every place."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_report(i, text):
    words = SPACE.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_runs_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13_runs, "BLOCK", 100)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        w = [f"w{k}" for k in rng.integers(0, int(rng.choice([1, 2, 3, 40])), int(rng.integers(0, 90)))]
        if w and i % 2:
            a, p = int(rng.integers(0, len(w))), int(rng.integers(1, 8))
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        rows.append((i, " \t\n"[i % 3].join(w)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a"), (904, "é x " * 6), (905, "A a " * 3), (906, "a b " * 4 + "a " * 6 + "c"), (904, "twice"), (904, "twice"), (20, "long words run " * 4000)]
    got = Counter(tuple(r) for r in queries.op13_runs(spark, table(spark, tmp_path, rows)).collect())
    assert got == Counter(brute_report(*r) for r in rows)


def test_runs_of_any_rows(spark):
    """Null and repeated ids, clashing names, and no rows at all; the texts and spans themselves."""
    rows = [(None, "x y x y x y x y tail"), (1, "a a a a a"), (1, "a a a a a a")]
    got = {tuple(r) for r in op13_runs.find_runs(docs_of(spark, rows)).select("doc_id", "n_words", F.col("runs").cast("string"), "collapsed").collect()}
    assert got == {(None, 9, "[{0, 8, 2}]", "x y tail"), (1, 5, "[]", "a a a a a"), (1, 6, "[{0, 6, 1}]", "a")}
    assert op13_runs.find_runs(op13_runs.planted(docs_of(spark, []))).isEmpty()
    assert op13_runs.planted(docs_of(spark, rows)).count() == 3


def test_extensions():
    x = np.random.default_rng(2).integers(0, 2, 300).astype(np.int32)
    lce = op13_runs.Extensions(x)
    i, j = (a.ravel() for a in np.meshgrid(np.arange(300), np.arange(300)))
    i, j = i[i != j], j[i != j]

    def length(a, b):
        k = 0
        while max(a, b) + k < 300 and x[a + k] == x[b + k]:
            k += 1
        return k

    assert lce(i, j).tolist() == [length(a, b) for a, b in zip(i, j)]
