"""The corpus pipeline against a brute-force version of each stage on a small table."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_llm_operators import brute_components, brute_smith_waterman
from tokenizers import Tokenizer

import corpus_pipeline
from routelens.llm import quality, toxicity
from routelens.llm.common import bounded_sample


def documents():
    rng = np.random.default_rng(11)
    plain = [f"{a}{b}{c}" for a in ("ri", "sto", "gen", "win", "mor") for b in ("ver", "dow", "pa") for c in ("", "ly", "ing", "est")]
    item = " ".join(f"quiz{k}" for k in range(30))
    rows, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, 60))
        kind = i % 6
        if kind == 1:
            words[5], words[30], words[41] = "blockhead", "nitwit", "blockhead"
        if kind == 2:
            words = [w + "$$$" for w in words]
        if kind == 3:
            words = words[:20] + item.split() + words[20:]
        if kind == 4 and i > 60:
            words = rows[(i - 60) // 6 * 6][1].split()[:59] + ["changed"]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(kind != 2), int(kind == 1)))
    rows += [(0, rows[0][1]), (None, rows[6][1]), (None, "own text of nobody in this table at all here"), (None, item), (300, None), (301, ""), (302, " \n")]
    return rows, labels, [(1, item), (2, None), (3, "")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rows, labels, items = documents()
    path = tmp_path_factory.mktemp("pipeline")
    text = [r[1] for r in rows]
    table = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": text, "lang": ["en"] * len(rows), "source": ["x"] * len(rows), "n_chars": pa.array([None if t is None else len(t) for t in text], pa.int64()), "tox_score": ["mine"] * len(rows), "__mark": [7] * len(rows)}
    pq.write_table(pa.table(table), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}), path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [x[0] for x in items], "text": pa.array([x[1] for x in items], pa.string())}), path / "benchmark.parquet")
    return str(path)


def test_pipeline_equals_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    tox = toxicity.fit(bounded_sample(docs, labels.selectExpr("doc_id", "toxic AS label"), toxicity.SAMPLE, toxicity.SAMPLE_BYTES))
    rows = [r for r in rows if toxicity.score_texts(pa.array([r[1]], pa.string()), tox)[0] < 0.5]
    assert not any("blockhead" in (r[1] or "") for r in rows) and len(rows) > 180
    # quality: sums over pairs of features, one by one
    machine = quality.learn(docs, labels.selectExpr("doc_id", "quality AS label"), ("n_chars",))
    rows = [r for r in rows if score_by_pairs(r[1], r[2], machine) >= 0.3]
    assert not any("$$$" in (r[1] or "") for r in rows) and len(rows) > 140
    # near copies: one row of each component
    numbered = [(k, r[1]) for k, r in enumerate(rows)]
    component = {int(k): int(c) for k, _, c in brute_components(numbered, 5, 80)}
    kept = {}
    for k, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if component[k] not in kept or key < kept[component[k]][0]:
            kept[component[k]] = key, r
    rows = [r for _, r in kept.values()]
    assert sum(r[0] is None for r in rows) == 1 + 1
    # leaks
    item = documents()[2][0][1].split()
    code = lambda words: [zlib.crc32(w.encode()) for w in words]
    rows = [r for r in rows if brute_smith_waterman(code((r[1] or "").replace(".", " ").split()), code(item)) < 0.4 * 2 * len(item)]
    assert not any("quiz" in (r[1] or "") for r in rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t, _ in rows)
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r.doc_id), r.ids_sha256) for r in got.collect()) == want


def score_by_pairs(text, n_chars, machine):
    flat, value, _, _ = quality._rows(pa.array([text], pa.string()), np.array([[np.nan if n_chars is None else n_chars]], float), machine.edges)
    z = machine.bias + sum(float(machine.linear[i]) * float(x) for i, x in zip(flat, value))
    v = machine.factors[flat].astype(float) * value[:, None]
    z += sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
    assert np.isclose(quality.score_texts(pa.array([text], pa.string()), np.array([[np.nan if n_chars is None else n_chars]], float), machine)[0], 1 / (1 + np.exp(-z)), atol=1e-4)
    return 1 / (1 + np.exp(-z))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {r.tox_score for r in out.select("tox_score").distinct().collect()} == {"mine"}


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_leaks_go_by_text_where_the_id_is_shared(spark):
    from routelens.llm import decontaminate

    item = " ".join(f"quiz{k}" for k in range(30))
    rows = [(None, "a fine text"), (None, item), (5, item.replace(" ", "\u2014")), (5, "another fine text"), (6, "\u201c" + item.replace(" ", "\u00a0") + "\u201d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == ["(5, 'another fine text')", "(None, 'a fine text')"]
