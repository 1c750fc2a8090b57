"""Token counts of whole texts under a public tokenizer."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary file lies on every machine; a parameter of all that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this public vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}
_WITHIN: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a vocabulary file, loaded once for each process."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each whole text, an int; 0 for an empty text, null for null."""

    def count(column: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode_ordinary
        return pa.array([None if x is None else len(encode(x)) for x in column.to_pylist()], pa.int32())

    count.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, T.IntegerType())(F.col(text) if isinstance(text, str) else text)


def _within(vocabulary: str) -> np.ndarray:
    """For each token, whether its first byte continues a character."""
    if vocabulary not in _WITHIN:
        encoding = encoder(vocabulary)
        _WITHIN[vocabulary] = np.zeros(encoding.n_vocab, bool)
        for token, i in encoding._mergeable_ranks.items():
            _WITHIN[vocabulary][i] = token[0] & 0xC0 == 0x80
    return _WITHIN[vocabulary]


def token_sizes(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """(n_tokens int, inside array<int>) of each whole text; null for null.

    ``inside`` are the positions of tokens that begin within a character, where a text can't be cut.
    """

    def measure(column: pa.Array) -> pa.Array:
        encode, within = encoder(vocabulary).encode_ordinary, _within(vocabulary)
        out = []
        for x in column.to_pylist():
            tokens = None if x is None else encode(x)
            out.append(None if x is None else {"n_tokens": len(tokens), "inside": np.flatnonzero(within[tokens]).tolist() if tokens else []})
        return pa.array(out, pa.struct([("n_tokens", pa.int32()), ("inside", pa.list_(pa.int32()))]))

    measure.__annotations__ = {"column": pa.Array, "return": pa.Array}
    kind = T.StructType([T.StructField("n_tokens", T.IntegerType()), T.StructField("inside", T.ArrayType(T.IntegerType()))])
    return F.arrow_udf(measure, kind)(F.col(text) if isinstance(text, str) else text)
