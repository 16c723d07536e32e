"""The pipeline's stages, each on what the one before kept."""

import hashlib

import corpus_pipeline
from cladeforge.llm import bpe, mixing, quality_rules
from cladeforge.llm.common import materialize

from .helpers import awkward, near_components, repeats


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, at = dict(corpus_pipeline.STAGES), {}
    assert list(stages) == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "byte_bpe"]
    now = docs
    for name, stage in stages.items():
        now = at[name] = materialize(stage(spark, now, sf_dir), name)
        assert name == "byte_bpe" or now.columns == docs.columns
    rows = {name: t.collect() for name, t in at.items()}
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert {r.doc_id for r in rows["quality_rules"]} == kept
    components, _ = near_components([(r.doc_id, r.text) for r in rows["quality_rules"]])
    assert {r.doc_id for r in rows["near_dedup"]} == {i for i, c in components.items() if i == c}
    before = sorted(rows["near_dedup"], key=lambda r: r.doc_id)
    left = {r.doc_id: e[3].decode(errors="ignore") for r, e in zip(before, repeats([r.text for r in before]), strict=True)}
    assert {r.doc_id: r.text for r in rows["suffix_dedup"]} == {i: t for i, t in left.items() if t.strip(" ")}
    copies = {r.doc_id: r.mix.copies for r in mixing.counted(at["suffix_dedup"], *mixing.plan(at["suffix_dedup"])).collect()}
    assert sorted(r.doc_id for r in rows["mix_sources"]) == sorted(i for i, n in copies.items() for _ in range(n))
    coder = bpe._coder(bpe.tokenizer_path())
    for r in rows["byte_bpe"]:
        assert coder.decode(bytes(r.ids)).decode() == left[r.doc_id] and r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, rows["byte_bpe"]))


def test_awkward_rows_and_empty_table(spark, sf_dir):
    docs, _ = awkward(spark)
    for table in (docs, docs.limit(0)):
        now = table.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            now = materialize(stage(spark, now, sf_dir), "awkward")
        now.collect()
