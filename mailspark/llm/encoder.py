"""Token ids of a text under ``word_bpe_49k.json``, memoised by word.

The tokenizer drops white space and never merges across it, and its
normaliser works character by character, so the ids of a text are the ids of
its white-space separated words in order.  Invented and rare words make most
of the cost; every distinct word is therefore encoded once per worker, as far
as a memo of bounded bytes remembers it.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

SEPARATOR, SEPARATOR_ID = "<|endoftext|>", 49407
WORD_END = "</w>"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: words in one of the memo's two generations, at ``ENTRY_BYTES`` and 48 bytes of key and
#: ids each; the larger one is for steps that hold little beside it
MEMO_WORDS = 150_000
LARGE_MEMO_WORDS = 300_000
#: of a dictionary entry beside the contents of key and value
ENTRY_BYTES = 200
#: longer words are encoded whenever they are met: in scripts without white space a text is one word
WORD_BYTES = 64
#: of the texts whose new words are encoded together
CHUNK_CHARS = 1 << 21


class WordEncoder:
    """``word -> little-endian uint32 ids``, or with ``counts`` the number of
    these, with a bounded memo."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS, counts: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # plain a-z words need neither normaliser nor pattern
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = max(self.full.get_vocab(with_added_tokens=True).values()) + 1
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.full.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(WORD_END)
        self.memo_bytes = memo_words * (ENTRY_BYTES + 48)
        self.held = 0
        self.counts = counts
        self.memo: dict[bytes, bytes | int] = {}
        self.older: dict[bytes, bytes | int] = {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        """White-space separated words; A-Z folded as the tokenizer does
        (not where special tokens, which are case sensitive, may occur)."""
        raw = text.encode()
        return (raw if b"<|" in raw else raw.lower()).split()

    def _ids(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes | int]:
        """Encodes ``new`` words; long ones come back, the others join the memo."""
        memo, older, found, plain, other, tailed = self.memo, self.older, {}, [], [], []
        for w in new:
            core = w
            if len(w) > 1 and w[-1:] in (b".", b",") and w[-2] in _ALNUM:
                core = w[:-1]  # a letter or digit and the mark after it never merge
                tailed.append(w)
                if core in memo or core in new:
                    continue
                if core in older:
                    found[core] = older[core]
                    continue
            (plain if core.isalpha() and core.islower() else other).append(core)
        if tailed:
            other += [m for m in (b".", b",") if m not in memo]
        plain, other = list(dict.fromkeys(plain)), list(dict.fromkeys(other))
        if plain:
            found.update(self._split(plain, self._ids(self.plain, " ".join([w.decode() for w in plain])), None))
        odd = [w for w in other if b"<|" in w]
        for w in odd:
            ids = self._ids(self.full, w.decode())
            found[w] = len(ids) if self.counts else ids.tobytes()
        other = [w for w in other if b"<|" not in w]
        if other:
            found.update(self._split(other, self._ids(self.full, SEPARATOR.join([w.decode() for w in other])), SEPARATOR_ID))
        for w in tailed:
            core, mark = w[:-1], w[-1:]
            found[w] = (found[core] if core in found else memo[core]) + (found[mark] if mark in found else memo[mark])
        return self._keep(found)

    def _keep(self, found: dict[bytes, bytes | int]) -> dict[bytes, bytes | int]:
        """Puts words of at most ``WORD_BYTES`` into the memo, returns the rest."""
        once = {w: v for w, v in found.items() if len(w) > WORD_BYTES}
        for w in once:
            del found[w]
        self.memo.update(found)
        self.held += ENTRY_BYTES * len(found) + sum(map(len, found)) + (0 if self.counts else sum(map(len, found.values())))
        return once

    def _split(self, words: list[bytes], ids: np.ndarray, separator: int | None) -> Iterator[tuple[bytes, bytes | int]]:
        if separator is None:
            end = np.flatnonzero(self.ends[ids]) + 1
            start = np.concatenate([[0], end[:-1]])
        else:
            cut = np.flatnonzero(ids == separator)
            start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ids)]])
        if len(start) != len(words):
            raise ValueError(f"{len(words)} words gave {len(start)} groups of ids")
        if self.counts:
            return zip(words, (end - start).tolist())
        raw = ids.tobytes()
        return ((w, raw[a:b]) for w, a, b in zip(words, (start * 4).tolist(), (end * 4).tolist()))

    def _admit(self, words: set[bytes]) -> dict[bytes, bytes | int]:
        """After this the memo holds all of ``words`` but the long ones, which are returned."""
        new = words.difference(self.memo)
        if not new:
            return {}
        if self.held > self.memo_bytes:
            # words not met again in the next generation are forgotten
            self.older, self.memo, self.held = self.memo, {}, 0
            new = words
        known = {w: self.older[w] for w in new if w in self.older}
        self._keep(known)
        new = new.difference(known) if known else new
        return self._learn(new) if new else {}

    def word_ids(self, words: list[bytes]) -> list[bytes | int]:
        """Ids of each word as bytes, or their number."""
        once, memo = self._admit(set(words)), self.memo
        return [once[w] if w in once else memo[w] for w in words] if once else list(map(memo.__getitem__, words))

    def _values(self, texts: Iterable[str]) -> Iterator[list[bytes | int]]:
        """``word_ids`` of each text; the new words of ``CHUNK_CHARS`` characters
        are encoded together."""
        held, size = [], 0
        for text in texts:
            held.append(self.words(text))
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _chunk(self, held: list[list[bytes]]) -> Iterator[list[bytes | int]]:
        once, memo = self._admit(set().union(*held)), self.memo
        for words in held:
            yield [once[w] if w in once else memo[w] for w in words] if once else list(map(memo.__getitem__, words))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        return (b"".join(v) for v in self._values(texts))

    def count_all(self, texts: Iterable[str]) -> Iterator[int]:
        """Numbers of ids; the encoder must hold ``counts``."""
        return (sum(v) for v in self._values(texts))

    def token_counts(self, texts: Iterable[str]) -> Iterator[int]:
        """Numbers of ids, whatever the memo holds."""
        return self.count_all(texts) if self.counts else (sum(map(len, v)) // 4 for v in self._values(texts))

    def token_count(self, text: str) -> int:
        return next(self.token_counts([text]))

    def encode(self, text: str) -> bytes:
        return b"".join(self.word_ids(self.words(text)))

    def count(self, text: str) -> int:
        """Number of ids of ``text``; the encoder must hold ``counts``."""
        return sum(self.word_ids(self.words(text)))


@lru_cache(maxsize=1)
def encoder(path: str, memo_words: int = MEMO_WORDS, counts: bool = False) -> WordEncoder:
    """The encoder of this Python worker."""
    return WordEncoder(path, memo_words, counts)


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
