"""Encoding texts word by word with a bounded memo.

The split pattern of byte-level BPE never matches across a space that stands
between two characters that are not white space: a match takes at most one space, and only
at its start. So a text may be cut before each such space, and equal words have
equal ids. Where white space meets a space, the whole text is encoded at once.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

# Fixed value: the split pattern of byte-level pre-tokenizers.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MAX_WORDS = 500_000
MAX_WORD = 64
GROUP_CHARS = 1 << 21


class WordMemo:
    """`pack` gives the ids of whole texts as little-endian unsigned 32-bit
    integers. They are kept by word, with the space before it. The memo is
    emptied when it is full, so memory stays bounded and results the same."""

    def __init__(self, pack: Callable[[list[str]], list[bytes]]):
        self.pack, self.known = pack, {}

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def encode(self, text: str) -> bytes:
        return self._group([text])[0]

    def _group(self, texts: list[str]) -> list[bytes]:
        words = [t.split(" ") for t in texts]
        heads = [w.pop(0) for w in words]
        met = set().union(*words)
        odd = {w for w in met.difference(self.known) if not w or w[0].isspace() or w[-1].isspace()}
        whole = [i for i, (h, w) in enumerate(zip(heads, words, strict=True)) if h[-1:].isspace() or odd and not odd.isdisjoint(w)]
        for i in whole:
            heads[i], words[i] = texts[i], []
        met -= odd
        new = list(met.difference(self.known))
        if len(self.known) + len(new) > MAX_WORDS:
            self.known.clear()
            new = list(met)
        packed = self.pack([" " + w for w in new] + heads)
        self.known.update(zip(new, packed, strict=False))
        out = [head + b"".join(map(self.known.__getitem__, w)) for head, w in zip(packed[len(new) :], words, strict=True)]
        for w in new:
            if len(w) > MAX_WORD:
                del self.known[w]
        return out


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the rest from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The ranks that give the same ids as a byte-level tokenizer file, or None if
    its ids are not in merge order or it does more than merge bytes."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel":
        return None
    if before.get("add_prefix_space", True) or not before.get("use_regex", True) or model.get("dropout"):
        return None
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    order = sorted((t for t in vocabulary if len(t) == 1), key=vocabulary.__getitem__) + merged
    if len(order) != len(vocabulary) or any(vocabulary.get(t) != i for i, t in enumerate(order)):
        return None
    symbols = byte_symbols()
    return {bytes(symbols[c] for c in token): rank for rank, token in enumerate(order)}


class LibraryEncoder:
    """Ids as a tokenizer file gives them without special tokens added. Words go
    through the rank form of the same vocabulary, which is faster; a text that
    holds an added token, and every text of a file that ranks cannot stand for,
    goes to the library itself."""

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.memo, ranks = None, ranks_of(spec)
        if ranks:
            fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.memo = WordMemo(lambda texts: [array("I", fast.encode_ordinary(t)).tobytes() for t in texts])
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        slow = [self.memo is None or any(a in t for a in self.added) for t in texts]
        fast = self.memo.encode_all(t for t, s in zip(texts, slow, strict=True) if not s) if self.memo else iter(())
        for text, is_slow in zip(texts, slow, strict=True):
            if is_slow:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield next(fast)


@lru_cache(maxsize=2)
def library_encoder(tokenizer_path: str) -> LibraryEncoder:
    return LibraryEncoder(tokenizer_path)
