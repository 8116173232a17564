"""Token ids against a fresh tokenizer, for texts that hold an added token."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veritab.llm.token_output import token_output


def test_added_tokens_have_their_own_ids(spark):
    fresh = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = [(1, "one two"), (2, "one <|endoftext|> two"), (3, "<|endoftext|>"), (4, "<|endoftext|><|endoftext|>\nx <|endoftext"), (5, "one two")]
    at, want = 0, []
    for i, t in rows:
        ids = [*fresh.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_output(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
