"""run() against the brute-force versions of its stages, one after the other."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tokenizers
from test_decontam import brute as brute_decontam
from test_line_dedup import brute_words as brute_lines
from test_near_dedup import brute as brute_near

import corpus_pipeline as cp
from kinsum.llm import line_dedup, quality_cnn
from kinsum.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = list(zip(docs["doc_id"], docs["text"], strict=True))
    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    scorer = quality_cnn.Scorer(quality_cnn.train(table(spark, SF, "documents"), table(spark, SF, "labels")))
    data = [t.encode() for _, t in rows]
    scores = scorer.scores(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= quality_cnn.THRESHOLD]
    assert 0 < len(rows) < len(data)
    rows = sorted((i, text) for i, *_, text in brute_lines(rows, line_dedup.RUN, line_dedup.WORDS))
    rows = [(i, t) for (i, t), (j, _, c) in zip(rows, sorted(brute_near(rows, 5)), strict=True) if i == j == c]
    bad = {d for d, *_, hit in brute_decontam(rows, list(zip(bench["item_id"], bench["text"], strict=True))) if hit}
    rows = [r for r in rows if r[0] not in bad]
    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(want)


def test_stages_keep_columns_and_handle_odd_tables(make, odd, spark):
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    for rows in ([], [*enumerate(odd), (None, "null id"), (3, "")]):
        docs = make(rows)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = cp.STAGES[-1][1](spark, docs, SF).collect()
        assert len(left) <= len(rows)
