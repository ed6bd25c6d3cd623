"""Near copies, personal data in long texts, languages of many scripts, and names that clash."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from musterroll.llm import bpe, langid, linededup, nearcopies, pii, quality, simhash, superkmers

CLASHING = [
    "found", "known", "found_language", "found_score", "cut_doc", "cut_body", "cut_runs", "cut_text", "cut", "cut_ranges",
    "head_doc", "own_doc", "nth_of_doc", "base_with_hits", "added", "base_spans", "all_spans", "apart_spans",
    "_found", "_cut", "_cut_runs", "_head", "_nth", "_language", "_base", "_added", "_more", "_own", "_all", "_id", "_label", "_text",
]


@pytest.fixture(scope="module")
def clashing(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    return docs.withColumns({c: F.lit(f"v-{c}") for c in CLASHING})


def plain_heads(rows, width, least):
    """Groups by all pairs, then members like their head."""
    sets = [nearcopies.shingles(t, width) for _, t in rows]
    words = [" ".join((t or "").lower().split()) for _, t in rows]
    like = [[words[i] == words[j] or nearcopies.jaccard(sets[i], sets[j]) >= least for j in range(len(rows))] for i in range(len(rows))]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if like[i][j]) for i in range(len(rows))]
    heads = {}
    for i, g in enumerate(group):
        heads[rows[i][0]] = rows[g][0] if like[i][g] else rows[min(j for j in range(len(rows)) if words[j] == words[i])][0]
    return heads


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(0, 300, 6):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200, 500]))]
        rows.append((d, " ".join(text)))
        for k in range(1, rng.choice([2, 4, 6])):
            other = list(text)
            for _ in range(rng.choice([0, 1, len(text) // 120, len(text) // 60, len(text) // 20])):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((d + k, "  ".join(other).upper() if k == 1 else " ".join(other)))
    rows += [(400, ""), (401, None), (402, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc: r["head"] for r in nearcopies.near_copies(docs, recall=0.9999).collect()}
    wanted = plain_heads(rows, 5, 0.8)
    assert found == wanted and sum(d != h for d, h in found.items()) > 40
    sets = {d: nearcopies.shingles(t, 5) for d, t in rows}
    assert all(nearcopies.jaccard(sets[d], sets[h]) >= 0.8 for d, h in found.items())


def test_planned_recall_holds(spark):
    """Pairs just above the similarity, at a table size of a million."""
    import numpy as np

    rng = np.random.default_rng(3)
    bits, pieces = nearcopies.plan_pieces(1_000_000, 0.8, 0.93)
    lanes = -(-bits * pieces // 64)
    met = 0
    for _ in range(200):
        base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        left, right = base[:850], base[50:]  # 800 of 900 shingles: 0.89, then cut to 0.8
        left, right = left[:800], np.concatenate([base[89:800], rng.integers(0, 1 << 63, 89, dtype=np.uint64)])
        assert 0.79 < nearcopies.jaccard(np.unique(left), np.unique(right)) < 0.81
        two = [nearcopies.fingerprint(s, lanes)[: bits * pieces].reshape(pieces, bits) for s in (left, right)]
        met += bool(((two[0] != two[1]).sum(axis=1) <= 2).any())
    assert met >= 180


def test_shingles_of_long_texts(monkeypatch):
    text = " ".join(f"W{i % 300}" for i in range(2000))
    whole = nearcopies.shingles(text, 5)
    monkeypatch.setattr("musterroll.llm.common.word_runs.__defaults__", (300,))
    assert (nearcopies.shingles(text, 5) == whole).all() and len(whole) == 300


def test_one_of_each_of_odd_rows(odd_docs, no_docs):
    rows = nearcopies.one_of_each(odd_docs).collect()
    # Texts without words are alike, rows that repeat are one, rows without id stay.
    assert sorted((r.doc_id for r in rows), key=repr) == sorted([1, 2, 4, 5, 7, 8, 9, None, None], key=repr)
    assert nearcopies.one_of_each(no_docs).collect() == []


def test_clashing_names_pass_through(spark, clashing):
    model, selector = langid.fit_on(clashing), pii.fit(clashing)
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id bigint, quality int")
    results = [
        langid.predict(clashing, model, "text", "a", "b", "c"),
        linededup.drop_repeated_lines(clashing), superkmers.drop_repeated_windows(clashing),
        simhash.one_of_each(clashing), nearcopies.one_of_each(clashing), pii.redact(clashing, selector),
        pii.find_spans(clashing, selector, "text", "x", "y"), quality.score(clashing, quality.fit_on(clashing, labels, epochs=2), out="p"),
        *[stage(spark, clashing, None) for name, stage in corpus_pipeline.STAGES[:-1]],
    ]
    for found in results:
        assert found.columns[: len(clashing.columns)] == clashing.columns
        rows = found.collect()
        assert rows and all(r[c] == f"v-{c}" for r in rows for c in CLASHING)


def test_many_spans_in_one_text(spark, sf):
    """Cost grows in proportion: 16,000 spans in 0.4 MB are found and replaced within seconds."""
    selector = pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    lines = [f"{i} user{i}@mail.example.com from 10.0.{i % 250}.{i % 199}" for i in range(8000)]
    docs = spark.createDataFrame([(1, " ".join(lines))], "doc_id bigint, text string")
    start = time.time()
    spans = pii.find_spans(docs, selector, "text", "base", "spans").first().base
    assert len(spans) == 16_000 and time.time() - start < 60
    text = " ".join(lines)
    assert [text[s.start : s.end] for s in spans[:3]] == [f"user{i}@mail.example.com" for i in range(3)]
    assert text[spans[-1].start : spans[-1].end] == "10.0.249.39"
    assert pii.redact(docs, selector).first().text == " ".join(f"{i} [EMAIL] from [IP]" for i in range(8000))


def test_written_out_mail_and_national_numbers_are_found(spark):
    rng = random.Random(4)
    rows = []
    for d in range(400):
        n = rng.randrange(10**4)
        rows.append((d, rng.choice([
            f"write to user{n}@mail.example.com today", f"the value a{n}@b was read", f"phone: ({rng.randrange(201, 290)}) 555-{n:04}",
            f"part 011-{rng.randrange(100, 199)}-{n:04} in stock", "nothing here",
        ])))
    texts = ["write to jane.doe [at] mail [dot] example today", "phone: (212) 555-0199", "the value q@z was read", "part 011-155-0199 in stock"]
    rows += [(1000 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_spans(docs, pii.fit(docs), "text", "base", "spans").where("doc_id >= 1000").orderBy("doc_id").collect()
    shown = [[(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in found]
    assert shown == [[("email", "jane.doe [at] mail [dot] example")], [("phone", "(212) 555-0199")], [], []]
    assert all(r.base == [] for r in found)


def test_languages_of_many_scripts():
    rng = random.Random(6)

    def text(first, last):
        return "".join(chr(rng.randrange(first, last)) if rng.random() > 0.1 else " " for _ in range(300))

    scripts = {"aa": (0x61, 0x7B), "el": (0x3B1, 0x3C9), "zh": (0x4E00, 0x5A00), "ko": (0xAC00, 0xB800)}
    train = [(text(*s), name) for name, s in scripts.items() for _ in range(60)]
    model = langid.fit([t for t, _ in train], [name for _, name in train])
    presence = langid.Presence(model.alphabet, model.longest)
    for name, s in scripts.items():
        names, scores, known = model.predict(presence, [text(*s) for _ in range(20)])
        assert names == [name] * 20 and scores.min() > 0.5 and known.all()
    names, _, known = model.predict(presence, [text(0x0E01, 0x0E2F), "  ", "123"])
    assert not known[0] and names[0] in scripts and names[1:] == ["und", "und"]


def test_labels_are_not_capped(spark):
    rows = [(f"word{i} text{i} more{i} again{i}", f"l{i:03}") for i in range(260) for _ in range(1)]
    model = langid.fit_on(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 260


def test_presence_lists_equal_tables(monkeypatch):
    alphabet = {g: i for i, g in enumerate(sorted(langid.word_ngrams("überall", 3) | langid.word_ngrams("the", 3)))}
    texts = ["Überall the", "", "zzz", "the überall allüber"]
    table = langid.Presence(alphabet, 3).rows(texts)
    monkeypatch.setattr(langid, "_TABLE", 1)
    assert (langid.Presence(alphabet, 3).rows(texts) == table).all()


def test_bpe_cache_is_bounded_by_bytes():
    cache = bpe.Recent(lambda w: (1, 2), 3000)
    for i in range(1000):
        assert cache[f"word{i}"] == (1, 2)
    assert len(cache) < 20 and len(cache.older) < 20


def test_counts_above_32_bits_stay_whole():
    import numpy as np
    import pandas as pd

    from musterroll.llm import katz

    keys = katz.squeeze(np.array([5, 9], dtype=np.uint64))
    rows = pd.DataFrame({"bucket": [0] * 3, "keys": [keys] * 3, "counts": [katz.squeeze(np.array([2**32 - 1, 7], dtype=np.uint64))] * 3})
    found = katz._summed("u8", 10)(rows).iloc[0]
    assert katz.loosen(found["counts"], "u8").tolist() == [3 * (2**32 - 1), 21]
    assert found["total"] == 3 * (2**32 + 6)


def test_crowded_variants_lose_no_pair(spark, monkeypatch):
    """All texts share every variant, and those that are alike lie far apart in it."""
    import numpy as np

    rng = random.Random(9)
    words, rows = [f"w{i}" for i in range(500)], []
    for g in range(30):
        text = [rng.choice(words) for _ in range(120)]
        for k in range(rng.choice([1, 2, 3])):
            other = list(text)
            for i in range(k):
                other[10 + 50 * i] = rng.choice(words)
            rows.append((g + 30 * k, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4, F.rand(1))
    monkeypatch.setattr(nearcopies, "fingerprint", lambda hashes, lanes: np.zeros(64 * lanes, dtype=np.uint8))
    found = {r.doc: r["head"] for r in nearcopies.near_copies(docs).collect()}
    wanted = plain_heads(rows, 5, 0.8)
    assert found == wanted and sum(d != h for d, h in found.items()) > 20


def around(rng, words, texts, most):
    """Variants of a few templates, with up to ``most`` words changed."""
    base = [[rng.choice(words) for _ in range(150)] for _ in range(3)]
    base.append([w if rng.random() > 0.03 else rng.choice(words) for w in base[0]])
    for d in range(texts):
        text = list(base[d % 4])
        for _ in range(rng.randrange(most + 1)):
            text[rng.randrange(len(text))] = rng.choice(words)
        yield d, " ".join(text[: rng.choice([150, 150, 140, 60])])


def test_crowded_variants_need_no_square_of_pairs(spark, monkeypatch):
    """All texts share every variant and few are alike: pairs grow with the texts, not with their square."""
    import numpy as np

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    compared, similar = [], nearcopies._similar
    monkeypatch.setattr(nearcopies, "fingerprint", lambda hashes, lanes: np.zeros(64 * lanes, dtype=np.uint8))
    monkeypatch.setattr(nearcopies, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    rows = list(around(rng, words, 400, 14))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4, F.rand(1))
    found = {r.doc: r["head"] for r in nearcopies.near_copies(docs).collect()}
    assert found == plain_heads(rows, 5, 0.8)
    assert sum(compared) < 12 * len(rows)


@pytest.mark.parametrize("similarity", [0.6, 0.8])
def test_crossings_connect_all_that_is_similar(spark, similarity):
    """Whatever the hubs and groups: pairs and groups together connect what all pairs connect."""
    rng = random.Random(int(10 * similarity))
    words = [f"w{i}" for i in range(40)] + [f"r{i}" for i in range(3000)]
    rows = list(around(rng, words, 160, 12)) + [(160 + i, " ".join(rng.choice(words) for _ in range(i))) for i in range(1, 9)]
    sets = [nearcopies.shingles(t, 5) for _, t in rows]
    like = [(i, j) for i in range(len(rows)) for j in range(i) if nearcopies.jaccard(sets[i], sets[j]) >= similarity]

    def joined(pairs):
        group = list(range(len(rows)))
        for a, b in pairs:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
        return group

    for known in ([], rng.sample(like, len(like) // 3)):
        roots = joined(known)
        hubs = [(d, len(s), roots[d], roots[rng.choice([d % 4, d % 4, rng.randrange(len(rows))])]) for d, s in enumerate(sets)]
        docs = spark.createDataFrame(rows, "doc bigint, text string")
        classes = docs.select(F.col("doc").alias("at"), F.col("doc").alias("first"), F.xxhash64("text").alias("body"))
        hubs = spark.createDataFrame(hubs, "at bigint, size int, root bigint, hub bigint")
        found = {(r.b, r.a) for r in nearcopies._crossings(hubs, docs, classes, 5, similarity).collect()}
        assert joined([*known, *(p for p in found if p in set(like))]) == joined(like)
        assert {p for p in like if roots[p[0]] != roots[p[1]]} and len(found) < len(rows) ** 2 / 8
