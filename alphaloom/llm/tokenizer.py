"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of the pieces between single spaces."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Pieces kept per Python worker; the cache starts afresh beyond that.
CACHE = 250_000
#: A space inside a longer run of blanks: there, pieces between spaces are not independent.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """ids(text) equals Tokenizer.from_file(json).encode(text, add_special_tokens=False).ids.

    The vocabulary's pattern starts a new pre-token at each space that follows a non-blank or ends its run of
    blanks, so the text's ids are those of its pieces. Texts for which this does not hold are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache = _Pieces(self.plain.encode_ordinary)

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _INNER_SPACE.search(text):
            return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        if len(self.cache) > CACHE:
            self.cache.clear()
        head = np.array(self.plain.encode_ordinary(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.cache.__getitem__, rest))


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        self[piece] = out = np.array(self.encode(" " + piece), "<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    """The worker's encoder for a file of public_tokenizers, or a path to such a json file beside its ranks."""
    import public_tokenizers as P

    path = name if "/" in name else str(P.path(name))
    return Encoder(path, path.removesuffix(".json") + ".tiktoken", P.PATTERN)
