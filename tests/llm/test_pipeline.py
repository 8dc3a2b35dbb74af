import corpus_pipeline as cp
from tidewell.llm import pieces
from tidewell.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns, name
        sizes.append(after.count())
        if name in ("quality", "near_duplicates"):
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in docs.collect()} and sizes[-1] < sizes[-2]
        docs = after
    assert sizes[3] == sizes[2]
    assert docs.where("text RLIKE '[a-z]+[.][0-9]+@mail'").count() == 0
    lib = pieces.PieceCodec(tokenizer_path("piece_bpe_32k.model")).lib
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    out = sorted((r.doc_id, r.ids) for r in cp.STAGES[-1][1](spark, docs, SF).collect())
    assert out == sorted((i, lib.encode(t, add_eos=True)) for i, t in texts)


def test_run(spark):
    rows = cp.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and rows.count() > 0
