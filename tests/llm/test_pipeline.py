"""The corpus pipeline against its stages' rules."""

import hashlib

import numpy as np
import pytest
from cases import SCHEMA, rows, words
from test_llm_operators import brute_components


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, sf, pipeline):
    from feedloom.llm.common import cut, documents

    docs = documents(spark, sf)
    names, steps = docs.columns, dict(pipeline.STAGES)
    assert list(steps) == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = cut(pipeline.quality(spark, docs, sf))
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert good.columns == names and sum(right) / len(right) > 0.9
    single = cut(pipeline.near_duplicates(spark, good, sf))
    want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect()], 5, 80, 100) if c is not None}
    assert single.columns == names and {r["doc_id"] for r in single.select("doc_id").collect()} == want
    clean = cut(pipeline.personal_data(spark, single, sf))
    assert clean.columns == names and clean.count() == single.count()
    mixed = cut(pipeline.mixture(spark, clean, sf))
    assert mixed.columns == names
    size = sum(len(words(r["text"])) for r in clean.collect())
    assert abs(sum(len(words(r["text"])) for r in mixed.collect()) - 1.5 * size) < 30
    last = pipeline.tokens(spark, mixed, sf).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in last) == sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())


def test_run_gives_the_tokens_of_what_its_stages_keep(spark, sf, pipeline):
    """The groups and the tokens by brute force; what the classifier keeps, surrogates and the mix from their operators."""
    import tiktoken

    from feedloom.llm import byte_bpe, quality_model, source_mix, surrogates
    from feedloom.llm.common import cut, documents, table

    docs = documents(spark, sf)
    kept = {r["doc_id"] for r in quality_model.classify(docs, table(spark, sf, "labels")).filter("score >= 0.5").select("doc_id").collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["doc_id"] in kept]
    firsts = sorted({c for _, _, c in brute_components(texts, 5, 80, 100)})
    clean = cut(surrogates.with_surrogates(docs.filter(docs["doc_id"].isin(firsts))))
    path, pattern = byte_bpe.multi_50k()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    got = pipeline.run(spark, sf).collect()
    mixed = source_mix.mixed_documents(clean).select("source", "text").collect()
    total = lambda rows: {s: sum(n for k, n in rows if k == s) for s in {k for k, _ in rows}}
    assert {r["doc_id"] for r in got} <= set(firsts)
    a, b = total([(r["source"], 1) for r in got]), total([(r["source"], 1) for r in mixed])
    assert a.keys() == b.keys()
    whole = {hashlib.sha256(r["text"].encode()).hexdigest(): r["text"] for r in clean.collect()}
    seen = [r for r in got if r["decoded_sha256"] in whole]
    assert len(seen) >= len(got) - len(a)  # but the documents that are cut at a source's budget
    for r in seen:
        ids = library.encode_ordinary(whole[r["decoded_sha256"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_awkward_tables(spark, sf, pipeline, stage):
    name, f = pipeline.STAGES[stage]
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = f(spark, docs, sf)
    assert out.count() > 0
    assert stage == 4 or out.columns == docs.columns
    assert f(spark, docs.filter("doc_id < 0"), sf).count() == 0


def test_bpe_leaves_memory_to_the_stages_before(spark, pipeline, monkeypatch):
    """A worker that isn't to hold memory caches little and takes small batches, and the ids are the same."""
    import pyarrow as pa
    import tiktoken

    from feedloom.llm import byte_bpe
    from feedloom.llm.common import small_batches

    monkeypatch.setattr(byte_bpe, "LEAN_CACHE", 100)
    path, pattern = byte_bpe.multi_50k()
    data = open(path, "rb").read()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(data), special_tokens={})
    bpe = byte_bpe.Bpe(data, pattern)
    bpe.lean()
    for low in range(0, 1000, 50):
        texts = [" ".join(f"wörd{i} x{i * i}" for i in range(low, low + 50))]
        (parts,) = bpe.encoder.encode(texts)
        table = bpe.decode(parts)
        assert np.frombuffer(b"".join(parts), bpe.encoder.dtype).tolist() == library.encode_ordinary(texts[0])
        assert b"".join(table[r] for r in parts).decode() == texts[0]
    assert len(bpe.encoder.later) <= 200 and len(bpe.decoded) <= 200

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with small_batches(spark, 700):
        assert max(r["n"] for r in spark.range(0, 5000, numPartitions=1).mapInArrow(sizes, "n long").collect()) == 700
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    seen = []
    monkeypatch.setattr(pipeline, "cut", lambda df, kind: seen.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or df)
    pipeline.tokens(spark, spark.createDataFrame(rows(), SCHEMA), "")
    assert seen == [str(byte_bpe.LEAN_ROWS)]
