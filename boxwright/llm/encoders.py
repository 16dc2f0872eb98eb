"""Token ids of whole texts with the byte-level vocabulary of 50k and the sentencepiece one of 32k.

The ids of ``byte_bpe_50k.json`` come from the same vocabulary as ranks, ``byte_bpe_50k.tiktoken``: the library for ranks
gives the ids that the tokenizers library gives (tests compare both on odd texts) in a quarter of its time.
"""

from __future__ import annotations

import base64
import os

import numpy as np

from .tokens import public_path

SPECIAL = "<|endoftext|>"


class ByteLevel:
    """Byte-level BPE. With ``plain`` the string of the special token is ordinary text; else it is that token."""

    def __init__(self, plain: bool = False, ranks: str = "byte_bpe_50k.tiktoken", special_id: int = 50256):
        import public_tokenizers
        import tiktoken

        with open(public_path(ranks), "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.model = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={SPECIAL: special_id})
        self.allowed = set() if plain else {SPECIAL}
        self.plain, self.library = plain, None
        self.token_bytes = [b""] * (special_id + 1)
        for token, rank in table.items():
            self.token_bytes[rank] = token

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.model.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # white space of hundreds of thousands of characters in a row is too deep for its pattern
            return np.asarray(self._library().encode(text, add_special_tokens=False).ids, np.uint32)

    def _library(self):
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
            self.library.encode_special_tokens = self.plain
        return self.library


class Spaced:
    """A sentencepiece BPE; the model puts a space before each text that isn't empty."""

    def __init__(self, model: str = "piece_bpe_32k.model"):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_path(model))
        piece = self.model.id_to_piece
        #: U+2581 stands for a space, <0xHH> for a byte.
        self.token_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_KEPT: dict[tuple, object] = {}


def encoder(kind: type, *args):
    """One encoder a worker."""
    if (kind, args) not in _KEPT:
        _KEPT[kind, args] = kind(*args)
    return _KEPT[kind, args]
