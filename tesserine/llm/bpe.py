"""BPE encoding and decoding of whole texts by per-prefix dynamic programming (tokens.PrefixEncoder)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, pick
from .tokens import encoder


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", real: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with real also ids (binary) and decoded.

    ids are little-endian unsigned 32-bit integers. Null text counts as empty: no ids. A null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; other columns, whatever their names, are left out.
    The strings of special tokens become their ids, as the library does. Row-local: no shuffle, no state but a bounded table.
    """

    def make():
        bpe = encoder(tokenizer)

        def work(columns):
            keys, texts = columns
            ids = [bpe.encode(t or "") for t in texts]
            out = [bpe.decode(x) for x in ids]
            got = {
                "doc_id": keys,
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in out],
            }
            return got | ({"ids": ids, "decoded": out} if real else {})

        return work

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * real, make)
