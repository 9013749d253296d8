import corpus_pipeline
from geoloom.llm import packing, pii, quality, simhash, substring
from geoloom.llm.pipeline import COLUMNS
from geoloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    """Each stage does to its own input what its operator says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs if not outs else outs[-1], SF)
        rows = out.collect()
        outs.append(spark.createDataFrame(rows, out.schema))
    for out in outs[:-1]:
        assert tuple(out.columns) == COLUMNS and out.schema == docs.schema

    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.assess(docs, model).collect() if r.kept}
    assert {r.doc_id for r in outs[0].collect()} == kept
    first = {r.doc_id for r in simhash.near_duplicates(outs[0]).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in outs[1].collect()} == first
    removed = {r.doc_id: r.n_words - r.n_removed for r in substring.report(outs[1]).collect()}
    assert {r.doc_id: len(r.text.encode().split()) for r in outs[2].collect()} == removed
    spans = {r.doc_id: r.spans for r in pii.find(outs[2]).collect()}
    texts = {r.doc_id: r.text for r in outs[2].collect()}
    assert {r.doc_id: r.text for r in outs[3].collect()} == {i: pii.masked(texts[i], [s.asDict() for s in spans[i]]) for i in texts}
    assert all(r.n_chars == len(r.text) for r in outs[3].collect())
    pieces = packing.pieces(outs[3], tokenizer_path("word_bpe_49k.json"))
    want = sorted((m.doc_id, m.piece, m.ids_crc32) for r in pieces.collect() for m in r.members)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in outs[4].collect()) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 100
