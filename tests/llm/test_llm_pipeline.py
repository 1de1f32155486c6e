import base64
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from logweave.llm import jaccard_join, toxicity
from logweave.llm.queries import toxicity_model

from test_llm_decontaminate import brute as brute_hits
from test_llm_suffix_dedup import brute as brute_cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def sets(text, size):
    words = [w for w in text.encode().translate(jaccard_join.ASCII_LOWER).replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name + " in"] = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(seen[n][0].asDict()) == columns for n, _ in corpus_pipeline.STAGES[:-1])
    model = toxicity_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    for r in seen["toxicity in"]:
        total = model.bias + sum(model.weights.get(f, 0.0) for w in set(re.findall(r"\w+", r["text"].lower())) for f in toxicity.word_features(w))
        assert (total >= 0) == (r["doc_id"] not in {x["doc_id"] for x in seen["toxicity"]})

    rows = seen["jaccard_join in"]
    shingles = {r["doc_id"]: sets(r["text"], 5) for r in rows}
    root = {d: d for d in shingles}
    ids = sorted(shingles)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = shingles[a], shingles[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root[a], root[b]
                root = {d: min(ra, rb) if r in (ra, rb) else r for d, r in root.items()}
    assert {r["doc_id"] for r in seen["jaccard_join"]} == {d for d, r in root.items() if d == r}

    before = seen["suffix_dedup in"]
    cut = dict(zip([r["doc_id"] for r in before], brute_cut([r["text"] for r in before], 400)))
    after = {r["doc_id"]: r for r in seen["suffix_dedup"]}
    assert set(after) == {d for d, c in cut.items() if c[1] < c[0] or c[0] == 0}
    for d, r in after.items():
        lost = cut[d][0] - cut[d][1] - len(r["text"].encode())
        assert 0 <= lost <= 6 * cut[d][2] and r["n_chars"] == len(r["text"])

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in seen["decontamination in"] if not brute_hits(r["text"], bench, 10)[1]}
    assert {r["doc_id"] for r in seen["decontamination"]} == clean

    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in seen["byte_bpe in"]}
    for r in seen["byte_bpe"]:
        assert r["token_ids"] == plain.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five six", "en", "s", 1), (3, "one two three four five six", "en", "s", 1),
            (4, "one two three four five six", None, None, None), (None, None, None, None, None), (5, "w" * 300_000, "en", "s", 1), (6, "é" * 400, "en", "s", 1), (7, "é" * 350, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_passages(spark, kept, SF).collect()}
    assert set(cut) == {None, 1, 2, 3} and cut[3] == rows[2][1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_cut_characters(spark):
    body = "aé\ufffd".encode()
    df = spark.createDataFrame([(1, bytearray(b"x\xa9y"), 5), (2, bytearray(body), 0), (3, bytearray(b"q\xc3"), 3)], "doc_id long, kept binary, n_removed long")
    assert {r["doc_id"]: r["t"] for r in df.select("doc_id", corpus_pipeline.whole_text().alias("t")).collect()} == {1: "xy", 2: "aé\ufffd", 3: "q"}


def test_columns_named_like_those_of_operators_stay(spark):
    names = ["score", "predicted", "n_bytes", "kept", "n_removed", "n_spans", "items", "n_words", "n_hit", "contaminated", "_text_key", "_th", "component_id", "decoded"]
    docs = spark.createDataFrame([(i, f"{i} some words here", "en", "s", 1, *(f"mine {i} {n}" for n in names)) for i in range(4)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == 4 and all(r[n] == f"mine {r['doc_id']} {n}" for r in rows for n in names)


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
