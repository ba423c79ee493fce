"""Public tokenizers: vocabulary pieces and sizes of texts in tokens. The files' folder is a parameter; nothing is copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Where the vocabulary files lie, on every machine.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The tokenizer in whose tokens texts are measured.
SIZE_TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary whose pieces the language models share.
PIECES = "piece_bpe_32k.model"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    try:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    except ImportError:
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS, name: str = SIZE_TOKENIZER) -> Column:
    """Tokens of the whole text; null for null, 0 for an empty text."""
    path = os.path.join(folder, name)

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        e = encoder(path)
        return s.map(lambda t: len(e.encode_ordinary(t)), na_action="ignore").astype("Int64")

    return count(text)


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """The pieces of a SentencePiece vocabulary that are text, with their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not skip(i)}
