"""The query's ids are those of the tokenizers file as it is, added tokens included."""

import zlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from transpark.llm.packing import op10_best_fit_packing

TEXTS = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|><|endoftext|> x", "<|endoftext|", "plain é text 😀"]


def test_added_tokens(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (op10_best_fit_packing(spark, str(tmp_path)), cp.best_fit_packing(spark, docs, str(tmp_path))):
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got.collect()) == want
