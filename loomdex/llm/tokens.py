"""Token ids of a public word-end BPE vocabulary, with a cache of blank-delimited chunks.

The vocabulary's pre-tokenizer never crosses white space, so a text is the concatenation of its chunks.
Chunks repeat; each is encoded once per cache generation. Texts with characters for which that
is not proven equal (outside Latin-1 and Latin Extended-A, or with special tokens' marks) go to
the tokenizer whole.
"""

from __future__ import annotations

import re

#: A character that rules out the chunk cache.
UNSAFE = re.compile("[^\t\n\r -~¡-įı-ſ]")
#: The vocabulary's own pre-tokenizer on lower-cased text of the other characters.
PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\\s0-9a-zªµºß-öø-ſ²³¹¼½¾]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class ChunkCache(dict):
    """chunk -> little-endian 32-bit ids; emptied when it holds ``limit`` chunks."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.model, self.limit, self.letters = model, limit, byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        parts = PARTS.findall(chunk)
        if parts == [chunk]:
            word = chunk if chunk.isascii() else "".join([self.letters[b] for b in chunk.encode()])
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])
        else:
            ids = b"".join([self[p] for p in parts])
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.cache = ChunkCache(self.whole.model, limit)

    def ids(self, text: str | None) -> bytes:
        """Ids without special tokens, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" in text or UNSAFE.search(text):
            return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.cache.__getitem__, text.lower().split()))


_own: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The process's encoder: a file's path, or the name of a file of the public tokenizers."""
    if vocabulary not in _own:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _own[vocabulary] = Encoder(path)
    return _own[vocabulary]
