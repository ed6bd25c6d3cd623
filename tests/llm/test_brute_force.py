"""Operators against plain versions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from musterroll.llm import boosting, bpe, covertree, cuttingstock, katz, langid, linededup, packing, queries, simhash, vecdedup
from musterroll.llm.components import components


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.word_bpe())


def test_packing_covers_every_id_once(spark, sf, texts, library):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op1_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used += at
    assert used >= 0.97 * 4096 * len(sequences) - 4096


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 400), max_size=12))
def test_patterns_hold_exactly_the_items(histogram):
    patterns = cuttingstock.plan(histogram, 24)
    held = Counter()
    for p in patterns:
        assert sum(s * c for s, c in p.copies.items()) <= 24
        for size, copies in p.copies.items():
            held[size] += copies * p.bins
    assert dict(held) == histogram
    # Rounding leaves at most one bin per size above what single items in best fit need.
    single = cuttingstock.fit_decreasing([s for s, n in histogram.items() for _ in range(n)], 24)
    assert sum(p.bins for p in patterns) <= len(single) + len(histogram)


def test_bpe_gives_the_ids_of_the_library(spark, sf, texts, library):
    for r in queries.QUERIES["op2_bpe"](spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@pytest.fixture(scope="module")
def own_bpe():
    return bpe.WordBpe(queries.word_bpe()), packing.IdBytes(queries.word_bpe(), 2)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabcdeehilnorstt'’ .,!-12éßΣİ\n\t\x1c\x85<|>_"), max_size=60))
def test_bpe_on_any_text(own_bpe, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    encoder, packer = own_bpe
    assert encoder.encode(text).tolist() == ids
    assert np.frombuffer(packer.of([text])[0], dtype="<u4").tolist() == [*ids, 2]


def test_special_tokens_in_a_text(own_bpe, library):
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|> <|endoftext", "x <|endoftext|>"):
        assert own_bpe[0].encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_quality_on_held_out_labels(spark, sf):
    scored = queries.QUERIES["op3_quality"](spark, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in scored.collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.85 * len(rows)


def test_top_k_equals_its_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    found = queries.QUERIES["op4_topk"](spark, sf)
    theirs = duck.sql(queries.ORACLES["op4_topk"])
    assert found.columns == theirs.columns
    assert sorted(map(tuple, found.collect())) == sorted(theirs.fetchall())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_dual_search(spread):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 6)) * 60
    points = np.floor(np.repeat(centers, 80, axis=0) + rng.normal(size=(960, 6)) * 60 * spread)
    ids = rng.permutation(len(points))
    mine = np.arange(0, len(points), 7)
    search = covertree.DualSearch(points[mine], ids[mine], points, ids, 5, np.full(len(mine), -np.inf), leaf=16)
    search.run()
    for at, row in enumerate(mine):
        scores = points @ points[row]
        order = [j for j in np.lexsort((ids, -scores)) if j != row][:5]
        assert search.ids[at].tolist() == ids[order].tolist()
        assert search.scores[at].tolist() == scores[order].tolist()


def plain_spans(text):
    out = []

    def digits(s):
        return [int(c) for c in s if c.isdigit()]

    def luhn(s):
        weighed = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits(s)[::-1])]
        return sum(weighed) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(s)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    for kind, (pattern, valid) in rules.items():
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if valid(m[0])]
    return out


def test_personal_data_base_spans(spark, sf, texts):
    rng = random.Random(9)
    extra = ["".join(rng.choice("a.@-+0123456789 ()😀") for _ in range(60)) for _ in range(400)]
    extra += ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 0255.1.1.01 256.1.1.1", "9" * 3000 + "@", "a@b" + ".c" * 4000, "4111 1111 1111 1111 " * 3]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*texts.values(), *extra])], schema)
    from musterroll.llm import pii

    rows = pii.find_spans(docs, pii.fit(docs), "text", "base", "spans").collect()
    for r in rows:
        assert [tuple(s) for s in r.base] == plain_spans(r.text or ""), r.text
        base = {tuple(s) for s in r.base}
        assert base <= {tuple(s) for s in r.spans}
        for kind, start, end in {tuple(s) for s in r.spans} - base:
            assert all(end <= b[1] or b[2] <= start for b in base), (kind, start, end)


def test_boosting_column_equals_its_array_form(spark):
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 5, (60, 3)).astype(float)
    total = rng.integers(1, 9, 60).astype(float)
    positive = np.where(cells[:, 0] + cells[:, 1] > 4, total, 0)
    model = boosting.boost(cells, positive, total)
    frame = spark.createDataFrame([tuple(map(int, c)) for c in cells], "a int, b int, c int")
    column = model.column([F.col(c) for c in "abc"])
    assert np.allclose([r[0] for r in frame.select(column).collect()], model.probability(cells))
    least = boosting.threshold_for(model.probability(cells), positive, total, 0.95)
    chosen = model.probability(cells) >= least
    assert positive[chosen].sum() >= 0.95 * total[chosen].sum()


def test_language_on_held_out_rows(spark, sf):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.QUERIES["op6_langid"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.95 * len(rows)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbBé \n\t😀"), max_size=30))
def test_presence_of_ngrams(text):
    alphabet = {"a": 0, " a": 1, "ab": 2, "ab ": 3, "é": 4, "bb": 5}
    grams = set().union(*(langid.word_ngrams(w, 3) for w in text.lower().split()))
    row = langid.Presence(alphabet, 3).rows([text])[0]
    assert {g for g, c in alphabet.items() if row[c] > 0} == grams & set(alphabet)


def test_near_vectors_recall(spark, sf):
    rows = {r.vec_id: r for r in queries.QUERIES["op7_vector_dedup"](spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r.vec_id for r in table]
    units = np.array([r.embedding for r in table], dtype=float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = (units @ units.T >= 0.9).sum(axis=1) - 1
    assert all(rows[i].n_links <= n for i, n in zip(ids, links))
    assert sum(r.n_links for r in rows.values()) >= 0.9 * links.sum()


@pytest.mark.parametrize("count", [4096, 100_000, 1_000_000, 20_000_000])
def test_planted_vectors_meet_at_any_table_size(count):
    rng = np.random.default_rng(3)
    units = vecdedup.unit_rows(list(rng.normal(size=(3000, 24)) @ rng.normal(size=(24, 64)) + 0.3 * rng.normal(size=(3000, 64))))
    index = vecdedup.fit(units[:2000], count, 0.9, 0.95, 16, 384, 5)
    assert index.bits == round(math.log2(count))
    for cosine in (0.9, 0.92, 0.95):
        for left, right in vecdedup.planted(units[2000:], cosine, 2000, 8):
            assert np.allclose((left * right).sum(axis=1), cosine)
            assert (index.strings(left) == index.strings(right)).any(axis=1).mean() >= 0.92


def test_planted_vectors_link(spark):
    rng = np.random.default_rng(4)
    units = vecdedup.unit_rows(list(rng.normal(size=(30_000, 64))))
    pairs = [vecdedup.planted(units, c, 500, 6)[0] for c in (0.905, 0.92, 0.95)]
    table = np.vstack([units, *[right for _, right in pairs]]).astype(np.float32)
    frame = spark.createDataFrame(list(enumerate(table.tolist())), "vec_id bigint, embedding array<float>")
    found = {r.vec_id: r for r in vecdedup.near_vectors(frame).where("n_links > 0").collect()}
    exact = vecdedup.unit_rows(list(table))
    links = sum((exact[at : at + 1000] @ exact.T >= 0.9).sum() for at in range(0, len(exact), 1000)) - len(exact)
    assert all(r.n_links < 10 for r in found.values())
    assert 0.93 * links <= sum(r.n_links for r in found.values()) <= links


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b" end "]


def test_scoring_base_columns(spark, sf, texts):
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in words_of(t))
    total, kinds = sum(train.values()), len(train)
    for r in queries.QUERIES["op8_katz"](spark, sf).collect():
        words = words_of(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in words))


def plain_katz(train, texts):
    """Katz bigrams by the book: a table of probabilities per history; and the scores of texts."""
    words = Counter(w for t in train for w in words_of(t))
    pairs = Counter()
    for t in train:
        run = [None, *words_of(t)]
        pairs.update(zip(run, run[1:]))
    factors = [katz.discounts([sum(c == r for c in counts.values()) for r in range(1, 7)]) for counts in (words, pairs)]

    def cut(count, level):
        return count * (factors[level][count] if count <= 5 else 1)

    total = sum(words.values())
    kept = total - sum(cut(c, 0) for c in words.values())
    room = total if kept > 1e-9 else total + 1
    lower = {w: cut(c, 0) / room for w, c in words.items()}
    unseen = (kept if kept > 1e-9 else 1) / room
    after = Counter()
    for (h, _), c in pairs.items():
        after[h] += c

    def conditional(h):
        own = {w: c for (g, w), c in pairs.items() if g == h}
        if not own:
            return lower, 1.0
        mass = sum(cut(c, 1) for c in own.values())
        room = after[h] if after[h] - mass > 1e-6 * after[h] else after[h] + 1
        weight = (1 - mass / room) / (1 - sum(lower[w] for w in own))
        return {w: cut(own[w], 1) / room if w in own else weight * p for w, p in lower.items()}, weight

    scores, tables = [], {}
    for t in texts:
        score, h = 0.0, None
        for w in words_of(t):
            table, weight = tables.setdefault(h, conditional(h))
            score += math.log10(table.get(w, weight * unseen))
            h = w
        scores.append(score)
    for table, weight in tables.values():
        assert sum(table.values()) + weight * unseen == pytest.approx(1)
    return scores


def test_scoring_equals_katz_by_the_book(spark):
    rng = random.Random(1)
    vocabulary = ["w%d" % min(int(rng.paretovariate(0.7)), 60) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += ["new words here w1", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = katz.score(docs, F.col("doc_id") % 5 == 1, vocabulary=1000, hot_pairs=7).collect()
    wanted = plain_katz([t for i, t in enumerate(texts) if i % 5 != 1], texts)
    found = {r.doc_id: r.score for r in rows}
    assert [found[i] for i in range(len(texts))] == pytest.approx(wanted)


def plain_line_dedup(docs, words):
    """Lines of at least ``words`` words that occurred earlier are gone."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        kept = []
        for line in text.split("\n"):
            key = tuple(line.split())
            if len(key) < words or key not in seen:
                kept.append(line)
            if len(key) >= words:
                seen.add(key)
        out[doc] = "\n".join(kept)
    return out


def test_line_dedup_where_every_long_line_is_a_window(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(6, 12))) for _ in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"own line of document {i} number {k} here" for k in range(8))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = linededup.drop_repeated_lines(frame, gram_words=6, window_words=6).collect()
    assert {r.doc_id: r.text for r in found} == plain_line_dedup(docs, 6)


def test_long_passages_across_documents_go(spark):
    rng = random.Random(2)
    passage = [" ".join(f"p{i}{k}" for k in range(9)) for i in range(7)]
    docs = []
    for i in range(30):
        own = [" ".join(f"d{i}x{rng.randrange(9999)}" for _ in range(rng.randint(1, 15))) for _ in range(6)]
        at = rng.randint(0, 6)
        docs.append((i, "\n".join(own[:at] + passage + own[at:])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: r for r in linededup.drop_repeated_lines(frame, n_removed="gone").collect()}
    assert found[0].text == docs[0][1]
    assert all(found[i].gone == 7 and "p00" not in found[i].text for i in range(1, 30))


def repeated_in_long_runs(docs, least):
    """(document, line) of lines in a run of ``least`` words that occurred earlier, by brute force."""
    flat = [(d, n, tuple(line.split())) for d, text in docs for n, line in enumerate(text.split("\n"))]
    out = set()
    for at in range(len(flat)):
        for to in range(at):
            size, words = 0, 0
            while at + size < len(flat) and flat[at + size][0] == flat[at][0] and flat[to + size][0] == flat[to][0] \
                    and flat[at + size][2] == flat[to + size][2]:
                words += len(flat[at + size][2])
                size += 1
            if words >= least:
                out |= {flat[at + k][:2] for k in range(size)}
    return out


def test_every_long_repeat_goes_around_frequent_lines(spark):
    rng = random.Random(6)
    frequent = [" ".join(f"f{i}w{k}" for k in range(10)) for i in range(3)]
    pool = [" ".join(f"p{i}w{k}" for k in range(rng.choice((3, 14, 25, 44)))) for i in range(14)]
    docs = [(i, "\n".join(rng.choice(frequent if k % 2 else pool) for k in range(6))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: r for r in linededup.drop_repeated_lines(frame, n_removed="gone").collect()}
    runs = linededup.repeated_runs(frame.selectExpr("doc_id doc", "xxhash64(text) body", "text"), 10, 50)
    gone = {(r.doc, n) for r in runs.collect() for x in r.runs for n in range(x["first"], x["last"] + 1)}
    wanted = repeated_in_long_runs(docs, 50)
    assert len(wanted) > 50
    assert wanted <= gone
    assert all(found[i].gone == sum(d == i for d, _ in gone) for i, _ in docs)


def plain_simhash(text):
    words = words_of(text)[:-1]
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, sf, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_simhash"](spark, sf).collect()}
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and least[b] < least[a]:
                    least[a], changed = least[b], True
    assert {i: r.component_id for i, r in rows.items()} == least


def test_ball_links_connect_all_near_fingerprints(spark):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) - (1 << 63) for _ in range(30)}
    for p in list(prints):
        for _ in range(4):
            prints.add(p ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    links = {tuple(r) for r in simhash.ball_links(frame, "fp").collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in links)
    roots = {r.node: r.root for r in components(simhash.ball_links(frame, "fp"), "a", "b").collect()}
    for a in prints:
        for b in prints:
            if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                assert roots[a] == roots[b]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(40, 41), (41, 40), (50, 50), (None, 3)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    roots = {r.node: r.root for r in components(frame, "a", "b").collect()}
    assert {roots[i] for i in range(100, 161)} == {100}
    assert {roots[i] for i in range(1, 30)} == {1} and roots[41] == 40 and 50 not in roots


@pytest.mark.parametrize("vocabulary, hot_pairs", [(25, 7), (3, 0), (0, 5)])
def test_scoring_is_katz_whatever_tasks_know(spark, vocabulary, hot_pairs):
    """Words beyond the vocabulary are second words and histories of counted pairs too."""
    rng = random.Random(8)
    words = ["w%d" % min(int(rng.paretovariate(0.6)), 90) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["new words w80 w81 w1", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = katz.score(docs, F.col("doc_id") % 5 == 1, vocabulary=vocabulary, hot_pairs=hot_pairs, bucket_tokens=200).collect()
    wanted = plain_katz([t for i, t in enumerate(texts) if i % 5 != 1], texts)
    found = {r.doc_id: r.score for r in rows}
    assert [found[i] for i in range(len(texts))] == pytest.approx(wanted)
