"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
import public_tokenizers
import tiktoken

from folio.llm import bpe
from folio.llm.store import materialize
from tests.llm.test_operators import groups, removed


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"  # enough labelled documents to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), name)[0])
        if name != "bpe":
            assert kept[-1].columns == columns and kept[-1].dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    gone = set(rows[0]) - set(rows[1])
    assert len(gone & toxic) >= 0.5 * len(toxic & set(rows[0])) and len(gone - toxic) <= 0.1 * len(rows[0])
    near = groups([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (_, c) in near.items() if c == i}
    cut = removed(sorted((i, r.text) for i, r in rows[2].items()))
    assert set(rows[3]) == set(rows[2])
    assert all((rows[3][i].text == rows[2][i].text) == (cut[i][1] == 0) for i in cut)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(rows[4]) == {i for i, r in rows[3].items() if not any(t in r.text for t in items)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: r.token_ids for i, r in rows[5].items()} == {i: enc.encode_ordinary(r.text) for i, r in rows[4].items()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert "token_ids" in out.columns and out.count() > 0
