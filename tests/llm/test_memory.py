"""What the pipeline's processes hold: workers small batches and a compact automaton, the driver models but no sample."""

import gc
import json
import os
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from routelens.llm import bpe, common, decontaminate, jaccard, phrases, quality, toxicity


def measure():
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return sizes


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
        lambda d: toxicity.score_documents(d, None),
        lambda d: quality.score_documents(d, None),
        lambda d: jaccard.classes_of(d, 5, 80),
        lambda d: decontaminate.find_leaks(d, d.limit(0).withColumnRenamed("doc_id", "item_id")),
    ],
)
def test_rows_reach_workers_in_small_batches(spark, operator):
    session = spark.newSession()
    docs = session.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('a word or two ', 700) AS text")
    operator(docs)
    got = docs.mapInArrow(measure(), "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) <= 2 * common.BATCH_BYTES


def test_blocks_of_words_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    session = spark.newSession()
    monkeypatch.setattr(phrases, "GROUP", 1 << 21)
    docs = session.range(0, 40_000, 1, 1).selectExpr("array_join(transform(sequence(1, 100), i -> concat('w', pmod(xxhash64(id, i), 5000))), ' ') AS text", "'en' AS lang")
    texts = phrases.saved_blocks(phrases.blocks(docs))
    got = texts.mapInArrow(measure(), "n long, size long").collect()
    assert texts.agg({"words": "sum"}).first()[0] == 4_000_000 and max(r.size for r in got) <= 2 * common.BATCH_BYTES
    groups = [m.row_group(k).total_byte_size for m in (pq.ParquetFile(f.removeprefix("file://")).metadata for f in texts.inputFiles()) for k in range(m.num_row_groups)]
    assert len(groups) > 1 and max(groups) <= 2 * phrases.GROUP, groups


def test_a_limit_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set(common.BATCH_LIMIT, "1m")
    common.map_batches(session.range(3), measure(), "n long, size long")
    assert session.conf.get(common.BATCH_LIMIT) == "1m"


def test_automaton_is_compact():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    gc.collect()
    tracemalloc.start()
    automaton = bpe.Automaton(spec)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert automaton.decode(automaton.encode("It holds what it must.")) == "It holds what it must."
    assert held < 25e6


def test_table_of_arcs_grows_and_starts_anew():
    automaton = bpe.Automaton(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}))
    assert automaton.encode_texts(pa.array(["aabba", "ab" * 300, "b" * 300]))[0].tolist() == [0, 2, 1, 0, *[2] * 300, *[1] * 300]
    table = bpe.HashedTable(4, bpe.np.int8)
    table.put(bpe.np.arange(8), bpe.np.ones(8, bpe.np.int8))
    assert table.roomy(0, 6) is table
    larger = table.roomy(1, 6)
    assert larger.bits == 5 and larger.used == 8 and larger.get(bpe.np.arange(9)).tolist() == [1] * 8 + [-1]
    assert larger.roomy(30, 6).used == 0


@pytest.mark.parametrize("text", ["acb", "acb" * 200])
def test_a_vocabulary_without_a_byte(text):
    automaton = bpe.Automaton(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}))
    with pytest.raises(ValueError, match="lacks a byte"):
        automaton.encode(text)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_models_are_fitted_outside_the_driver(spark, monkeypatch, operator):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text", "CAST(id % 2 AS int) AS label")
    monkeypatch.setattr(operator, "fit", lambda sample, *_: (os.getpid(), len(sample)))
    pid, n = operator.learn(docs, docs.select("doc_id", "label"))
    assert pid != os.getpid() and n == docs.where(~common.held_out(docs.doc_id)).count()
    assert operator.learn(docs.limit(0), docs.select("doc_id", "label"))[1] == 0


def toxicity_sample(n=1500):
    rng = np.random.default_rng(5)
    plain = np.array([f"{a}{b}{c}" for a in ("ri", "sto", "gen", "win", "mor") for b in ("ver", "dow", "pa") for c in ("", "ly", "ing", "est")])
    return [(" ".join([*rng.choice(plain, 300), *["blockhead."] * (i % 2)]), i % 2) for i in range(n)]


def test_toxicity_is_fitted_a_few_texts_at_a_time():
    sample = toxicity_sample()
    tracemalloc.start()
    model = toxicity.fit(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert toxicity.score_texts(pa.array(["a blockhead", "a window"]), model).round().tolist() == [1, 0]
    assert peak < 120e6


def test_a_sample_without_words_teaches_nothing():
    assert toxicity.fit([("...", 1), ("!", 0)]) is None
