"""Ids of the registered packing query against an unmodified tokenizer."""

import zlib

import numpy as np

from lexmill.llm import queries


def test_strings_of_added_tokens_are_those_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["a<|endoftext|>b", "plain text, it's here", "<|endoftext|>", "  x <|endoftext|> \n<|endoftext|><|endoftext|> \u00e9", "<|endoftext>", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in queries.QUERIES["op10_best_fit_packing"](spark, str(tmp_path)).collect()}
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert 50256 in ids[0]
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}
