import corpus_pipeline
import pytest

from fieldloom.llm import packing, queries, sentences
from helpers import ODD, empty, frame

SF = "/root/testdata/sf0.001"


def test_counted_tokens_are_those_of_the_encoder(spark):
    docs = frame(spark, [*ODD, (50, "unverzüglich " * 3000)])
    want = sorted((r.doc_id, r.n_tokens) for r in sentences.encode(docs, parity=False).collect() if r.doc_id is not None)
    assert sorted((r.doc_id, r.n_tokens) for r in packing.counted(docs).collect() if r.doc_id is not None) == want
    assert packing.counted(empty(spark)).count() == 0


@pytest.mark.parametrize("packed", [lambda spark: queries.op8_packing(spark, SF), lambda spark: corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)])
def test_queries_pack_the_tokens_of_the_model(spark, packed):
    processor = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentences.MODEL)
    want = {r.doc_id: len(processor.encode(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    rows = packed(spark).toPandas()
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in want.items() if v}
    assert (rows.n_tokens <= packing.CAPACITY).all() and (rows.sequence_tokens <= packing.CAPACITY).all()
