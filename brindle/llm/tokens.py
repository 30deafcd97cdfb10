"""Token ids of whole texts with a published byte-level BPE vocabulary; the file's path is a parameter.

The ids are those of the `tokenizers` library. Over the default vocabulary they are computed by tiktoken, which holds
the same merges and is several times as fast; a text with a special token's string goes to the tokenizer itself.
"""

from __future__ import annotations

import numpy as np

#: End-of-document id of the packing contract.
END_ID = 1


class Encoder:
    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.quick = self._quick(path)

    def _quick(self, path):
        """tiktoken over the same vocabulary, where that is the default file; else the tokenizer itself."""
        if path is not None:
            return lambda s: self.whole.encode(s, add_special_tokens=False).ids
        import base64

        import public_tokenizers as P
        import tiktoken

        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, as unsigned 32-bit."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.quick(text), "<u4")
