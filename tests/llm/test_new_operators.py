"""Substring dedup, importance resampling and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from musterroll.llm import lexical, queries, resampling, superkmers
from musterroll.llm.bestposition import Best, ImpactLists
from musterroll.llm.common import WORD_BYTES, table

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_kept(rows, size):
    """(words, kept words) per row by looking at every window of every smaller id."""
    listed = [(d, SPACES.findall(t or "")) for d, t in rows]
    first = {}
    for d, words in listed:
        for i in range(len(words) - size + 1):
            if d is not None:
                w = tuple(words[i : i + size])
                first[w] = min(first.get(w, d), d)
    out = []
    for d, words in listed:
        gone = set()
        for i in range(len(words) - size + 1):
            if d is not None and first[tuple(words[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(words), [w for j, w in enumerate(words) if j not in gone]))
    return out


def substring_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["été", "x.", "X."]
    passage = [rng.choice(words) for _ in range(70)]
    rows = []
    for d in range(60):
        own = [rng.choice(words) for _ in range(rng.choice([0, 5, 49, 50, 51, 120, 400]))]
        if d % 3 == 0:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[rng.randrange(15) : rng.randrange(55, 71)]
        if d % 10 == 9:
            own = rows[d - 4][1].split() + own
        rows.append((d, rng.choice([" ", "\n", "\t ", " \x0b"]).join(own)))
    rows += [(60, "a " * 3000), (61, "b " + "a " * 200), (62, "b " + "a " * 200), (62, "c " + "a " * 60), (63, None), (64, ""), (None, rows[0][1]),
             (5, rows[5][1]), (70, rows[5][1]), (70, rows[5][1])]
    return rows


@pytest.mark.parametrize("hot_strings", [2000, 2, 0])
def test_windows_equal_brute_force(spark, hot_strings):
    rows = substring_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, cut int, first int, ranges int")
    found = superkmers.drop_repeated_windows(docs, n_words="n", n_removed="gone", hot_strings=hot_strings)
    assert found.columns == ["doc_id", "text", "cut", "first", "ranges", "n", "gone"]
    got = sorted(((r.doc_id, r.n, r.gone, r.text or "") for r in found.collect()), key=repr)
    wanted = sorted(((d, n, n - len(kept), " ".join(kept)) for d, n, kept in plain_kept(rows, 50)), key=repr)
    assert got == wanted
    assert sum(r[2] for r in got) > 1000
    assert {(r.cut, r["first"], r.ranges) for r in found.collect()} == {(1, 2, 3)}


def test_windows_with_text_ids_and_small_sizes(spark):
    rows = [(f"d{d:02}", t) for d, t in substring_rows() if d is not None]
    found = superkmers.drop_repeated_windows(spark.createDataFrame(rows, "doc_id string, text string"), size=12, gram=3, hot_strings=5)
    got = sorted(((r.doc_id, r.text or "") for r in found.collect()), key=repr)
    assert got == sorted(((d, " ".join(kept)) for d, _, kept in plain_kept(rows, 12)), key=repr)


def test_windows_of_odd_rows(odd_docs, no_docs):
    rows = superkmers.drop_repeated_windows(odd_docs).collect()
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, (r.doc_id for r in odd_docs.collect())))
    assert [r.text for r in rows if r.doc_id == 3] == [None]
    assert all((r.score, r.component_id, r.kept, r.nth) == ("clash", 7, None, 3) for r in rows)
    long = next(r.text for r in odd_docs.collect() if r.doc_id == 4)
    assert [r.text for r in rows if r.doc_id == 4] == [long]
    assert superkmers.drop_repeated_windows(no_docs).collect() == []


def test_super_kmers_hold_every_window_once():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 30, 5000).astype(np.uint64)
    hashes[1000:3500] = 7
    bounds = np.array([0, 0, 3, 52, 102, 102, 4000, 5000])
    starts, windows, least = superkmers.super_kmers(bounds, hashes, 50, 8)
    held = [(a + i) for a, n in zip(starts, windows, strict=True) for i in range(n)]
    assert held == [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - 49)]
    assert windows.max() <= superkmers.MOST_WINDOWS
    by_content = {}
    for a, n, m in zip(starts, windows, least, strict=True):
        for i in range(a, a + n):
            assert by_content.setdefault(hashes[i : i + 50].tobytes(), m) == m


def test_window_ranks_are_exact():
    codes = np.random.default_rng(2).integers(0, 2, 4000)
    for size in (1, 5, 12):
        ranks = superkmers.window_ranks(codes, size)
        runs = [tuple(codes[i : i + size]) for i in range(len(codes) - size + 1)]
        assert len(set(zip(ranks.tolist(), runs, strict=True))) == len(set(runs)) == len(set(ranks.tolist()))


def plain_ranks(docs, target, longest, buckets, least_words, percent, seed):
    def features(text):
        words = plain_terms(text)
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for d, n, f in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    large = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = large[: percent * len(large) // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in rows if r not in drawn], key=repr)


@pytest.mark.parametrize("longest, least_words, percent", [(1, 20, 10), (2, 5, 50), (3, 0, 100)])
def test_resampling_equals_plain_version(spark, sf, longest, least_words, percent):
    docs, target = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = resampling.importance_ranks(docs, target, longest=longest, buckets=997, least_words=least_words, percent=percent, seed=7)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found.collect()), key=repr)
    wanted = plain_ranks([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], longest, 997, least_words, percent, 7)
    assert got == wanted


def test_resampling_of_odd_rows(spark, odd_docs, no_docs):
    target = odd_docs.select("text").limit(3)
    rows = resampling.importance_ranks(odd_docs, target, least_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, odd_docs.count() + 1))
    assert all(r.n_features == r.weight == 0 for r in rows if r.doc_id in (2, 3, 6))
    assert resampling.importance_ranks(no_docs, target).collect() == []
    assert len(resampling.importance_ranks(odd_docs, no_docs).collect()) == odd_docs.count()
    drawn = resampling.resampled(odd_docs, target, least_words=1, percent=100)
    assert drawn.columns == odd_docs.columns
    assert sorted(map(repr, drawn.collect())) == sorted(repr(r) for r in odd_docs.collect() if plain_terms(r.text))
    assert resampling.resampled(odd_docs, target, least_words=1, percent=50).count() == len(drawn.collect()) // 2


def test_features_of_long_texts_cross_parts(monkeypatch):
    text = " ".join(f"Word{i % 977}, x{i % 31}" for i in range(4000))
    whole = Counter(c for _, sums in resampling.feature_checksums(text, 3) for c in sums)
    monkeypatch.setattr("musterroll.llm.common.word_runs.__defaults__", (500,))
    parts = list(resampling.feature_checksums(text, 3))
    assert len(parts) > 5 and Counter(c for _, sums in parts for c in sums) == whole
    assert sum(n for n, _ in parts) == 8000


def test_places_of_many_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 501).alias("v"), "id")
    found = resampling.numbered(rows, [F.desc("v"), F.col("id")], "at").collect()
    wanted = sorted(((r.v, r.id) for r in found), key=lambda r: (-r[0], r[1]))
    assert {(r.v, r.id): r.at for r in found} == {r: i + 1 for i, r in enumerate(wanted)}


def test_word_bytes_are_the_stated_class():
    for b in range(128):
        kept = re.match(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", chr(b).translate(LOWER))
        assert WORD_BYTES[b] == (ord(chr(b).translate(LOWER)) if kept else 32)
    assert WORD_BYTES[128:] == bytes(range(128, 256))


def plain_search(docs, items, k, weights):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in set(plain_terms(text)) if df[t]]
        rows = []
        for d, c, n in counts:
            m = 100 - weights.slope + weights.slope * n * n_docs // total
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + weights.saturation * m)) for t, w in asked if c[t])
            if score > 0:
                rows.append((-score, d is None, d if d is not None else 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, postings", [(10, 1_000_000), (3, 500), (1, 1)])
def test_search_equals_plain_version(spark, sf, monkeypatch, k, postings):
    docs, items = table(spark, sf, "documents").limit(120), table(spark, sf, "benchmark").limit(15)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    found = lexical.search(docs.repartition(3), items, k=k, most_bytes=2000)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)
    wanted = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k, lexical.Weights())
    assert got == wanted and got


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "The CAT and the dog", 1), (1, "the cat and the dog", 1), (2, None, 1), (3, "!!", 1), (None, "maison", 1), (5, "unheard", 1)],
        "item_id int, text string, score int",
    )
    found = lexical.search(odd_docs, items, k=4)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got == plain_search(rows, [(r.item_id, r.text) for r in items.collect()], 4, lexical.Weights())
    assert lexical.search(no_docs, items).collect() == lexical.search(odd_docs, items.limit(0)).collect() == []


def test_best_positions_stop_early():
    """Skewed lists: the best documents come first in all of them, so few are met."""
    rng = np.random.default_rng(4)
    n, terms = 20_000, 6
    impacts = np.sort(rng.integers(1, 1000, (n, terms)), axis=0)[::-1] + (np.arange(n)[:, None] < 20) * 5000
    docs = np.repeat(np.arange(n), terms)
    lists = ImpactLists(docs, np.tile(np.arange(terms), n), impacts.ravel(), np.arange(n).astype(object), terms)
    best = Best.none(10)
    lists.search(np.arange(terms), best)
    totals = impacts.sum(axis=1)
    order = sorted(range(n), key=lambda i: (-totals[i], i))[:10]
    assert best.keys.tolist() == order and best.scores.tolist() == totals[order].tolist()
    assert best.met < 200
    again = Best.none(10)
    lists.search(np.array([1, 3]), again)
    two = impacts[:, [1, 3]].sum(axis=1)
    assert again.keys.tolist() == sorted(range(n), key=lambda i: (-two[i], i))[:10]


def test_best_position_lies_ahead_of_reads():
    """Direct accesses see positions that were never read in that list."""
    docs = np.repeat(np.arange(100), 2)
    impacts = np.stack([np.arange(100, 0, -1), np.roll(np.arange(100, 0, -1), 1)], axis=1)
    lists = ImpactLists(docs, np.tile([0, 1], 100), impacts.ravel(), np.arange(100).astype(object), 2)
    best = Best.none(2)
    lists.search(np.array([0, 1]), best)
    totals = impacts.sum(axis=1)
    assert best.scores.tolist() == sorted(totals.tolist(), reverse=True)[:2]


def test_registered(spark, sf):
    for name, columns in {
        "op11_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op12_importance": ["doc_id", "n_features", "weight", "score", "rank"],
        "op13_lexical": ["item_id", "rank", "doc_id", "score"],
    }.items():
        assert queries.QUERIES[name](spark, sf).columns == columns and name in queries.ORACLES
