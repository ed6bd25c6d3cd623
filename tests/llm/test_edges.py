"""Defined results on odd rows and empty tables."""


from pyspark.sql import functions as F

import corpus_pipeline
from musterroll.llm import bpe, katz, langid, linededup, packing, pii, quality, queries, simhash, topk, vecdedup


def ids(rows, field="doc_id"):
    return sorted((r[field] for r in rows), key=repr)


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, queries.word_bpe(), with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert len([r for r in rows if r.start == 0]) == odd_docs.count()
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id in (2, 3, 6))
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(no_docs, queries.word_bpe()).collect() == []


def test_bpe(odd_docs, no_docs):
    rows = bpe.decode(bpe.encode(odd_docs, queries.word_bpe()), queries.word_bpe()).collect()
    assert ids(rows) == ids(odd_docs.collect())
    assert all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (2, 3, 6))
    assert bpe.encode(no_docs, queries.word_bpe()).collect() == []


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 1), (None, 1), (7, None)], "doc_id bigint, quality int")
    model = quality.fit_on(odd_docs, labels, epochs=3)
    rows = quality.score(odd_docs, model, out="p").collect()
    assert ids(rows) == ids(odd_docs.collect()) and all(0 <= r.p <= 1 for r in rows)
    nothing = quality.fit_on(odd_docs, labels.limit(0))
    assert {r.p for r in quality.score(odd_docs, nothing, out="p").collect()} == {0.5}
    assert quality.score(no_docs, model).collect() == []


def test_top_k(odd_vectors):
    rows = topk.top_k(odd_vectors, F.col("vec_id") % 20 == 0, k=3).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # Query 20 meets id 1 twice, since the table holds it twice, and then the longer one.
    assert found[20] == [(7, 10240), (1, 5120), (1, 5120)]
    assert found[60] == [(61, 20480)]
    assert 40 not in found and set(found) == {20, 60, 80}
    assert found[80] == [(8, 3648), (9, 3648), (7, 384)]
    assert topk.top_k(odd_vectors.limit(0), F.lit(True)).collect() == []


def test_near_vectors(odd_vectors):
    rows = vecdedup.near_vectors(odd_vectors).collect()
    assert ids(rows, "vec_id") == ids(odd_vectors.collect(), "vec_id")
    by = {r.vec_id: r for r in rows}
    assert by[20].component_id == by[1].component_id == by[7].component_id == 1
    assert by[7].n_links == 3 and by[8].n_links == 2 and by[9].component_id == 8 and by[80].component_id == 8
    assert all(by[i].n_links == 0 and by[i].kept for i in (2, 3, 4, 5, 6, 40, None))
    assert by[60].n_links == 1 and not by[61].kept
    assert vecdedup.near_vectors(odd_vectors.limit(0)).collect() == []


def test_personal_data(odd_docs, no_docs):
    selector = pii.fit(odd_docs)
    rows = pii.find_spans(odd_docs, selector, "text", "base", "spans").collect()
    assert ids(rows) == ids(odd_docs.collect())
    assert {r.doc_id: [s.kind for s in r.base] for r in rows}[7] == ["email", "phone"]
    clean = pii.redact(odd_docs, selector)
    assert clean.columns == odd_docs.columns
    assert {r.doc_id: r.text for r in clean.collect()}[7] == "call [PHONE] or [EMAIL]"
    assert pii.find_spans(no_docs, pii.fit(no_docs), "text", "base", "spans").collect() == []


def test_language(odd_docs, no_docs):
    rows = langid.predict(odd_docs, langid.fit_on(odd_docs), "text", "found", "p").collect()
    assert ids(rows) == ids(odd_docs.collect())
    assert all(r.found == "und" and r.p == 0 for r in rows if r.doc_id in (2, 3, 6, 8))
    assert {r.found for r in rows if r.doc_id in (1, 5)} == {"en"}
    untaught = langid.fit_on(no_docs)
    assert {r.found for r in langid.predict(odd_docs, untaught, "text", "found", "p").collect()} == {"und"}


def test_scoring(odd_docs, no_docs):
    rows = katz.score(odd_docs, F.col("doc_id") == 7).collect()
    assert ids(rows) == ids(odd_docs.collect())
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 6))
    assert {r.held_out for r in rows if r.doc_id != 7} == {False}
    assert all(r.score < 0 for r in rows)
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in katz.score(odd_docs, F.lit(True)).collect())
    assert katz.score(no_docs, F.lit(False)).collect() == []


def test_line_dedup(odd_docs, no_docs):
    rows = linededup.drop_repeated_lines(odd_docs, n_removed="gone", gram_words=5, window_words=5).collect()
    assert ids(rows) == ids(odd_docs.collect())
    text = {r.doc_id: r.text for r in rows}
    assert text[1] == "the cat and the dog went out" and text[5] == "" and text[3] is None and text[6] == " \n\t \n"
    assert text[9] == "a line of ten words that will come back again here"
    assert linededup.drop_repeated_lines(no_docs).collect() == []


def test_simhash(odd_docs, no_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert ids(rows) == ids(odd_docs.collect())
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3, 6, None} and {r.component_id for r in zero} == {2}
    heads = simhash.one_of_each(odd_docs)
    assert heads.columns == odd_docs.columns
    kept = ids(heads.collect())
    assert kept.count(5) == 1 and 3 not in kept and kept.count(None) == 2
    assert simhash.near_groups(no_docs).collect() == []


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for number, (stage, function) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{number}"
            out = function(spark, docs, "unused")
            assert number == 4 or out.columns == odd_docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() == 0) == (name == "none")


def test_pipeline_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


