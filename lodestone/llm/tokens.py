"""Token ids of whole texts by a public tokenizer, with a bounded cache of words.

The tokenizer never joins characters across white space: its pre-tokenizer drops it. Ids of a text are therefore
the ids of its white-space separated words in order, and a word's ids can be kept. Only ASCII white space is
split on here; what else the tokenizer takes for white space it finds inside a word.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable

import numpy as np

#: Ids are kept and joined as little-endian unsigned 32-bit integers.
ID = np.dtype("<u4")
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: A run of these after a letter is a pre-token of its own.
TAIL = b".,!?;:"
WORD_END = "</w>"
#: Words of more bytes are not kept.
LONG = 80


def tokenizer_path(path: str | None = None) -> str:
    """``path``, or the installed public tokenizer's file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


class WordEncoder:
    """``encode(texts)`` gives each text's ids as bytes. ``limit`` bounds the words kept; what is long is never kept."""

    def __init__(self, path: str | None = None, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        # For stems, which are normalized here and are one pre-token each: the same model, held once, without the slower steps.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocab_size = max(vocab.values()) + 1
        self.ends_word = np.zeros(self.vocab_size, dtype=bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.limit = limit
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    def encode(self, texts: Iterable[str | None], group: int = 200) -> list[bytes]:
        out: list[bytes] = []
        texts = list(texts)
        for at in range(0, len(texts), group):
            split = [(t or "").encode().split() for t in texts[at : at + group]]
            unknown = set().union(*split).difference(self.words)
            self._learn(unknown)
            get = self.words.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            for word in [w for w in unknown if len(w) > LONG]:
                del self.words[word]
            if len(self.words) > self.limit:
                self.words.clear()
            if len(self.stems) > self.limit:
                self.stems.clear()
        return out

    def forget(self) -> None:
        """Drop the words kept."""
        self.words, self.stems = {}, {}

    def _learn(self, unknown: set[bytes]) -> None:
        words, stems, odd, later, new = self.words, self.stems, [], [], set()
        for word in unknown:
            if len(word) > LONG:
                odd.append(word)
                continue
            raw = word.rstrip(TAIL)
            if raw.isalpha():  # ASCII letters
                stem = raw.lower()
            else:
                text = unicodedata.normalize("NFC", raw.decode())
                # The tokenizer lower-cases letter by letter; of all letters, a sigma's lower case depends on its neighbours.
                text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
                if not text.isalpha() or not raw.decode().isalpha():
                    odd.append(word)
                    continue
                stem = text.encode()
            if stem == word:
                stem = word  # one object as the key of both
            tail = word[len(raw) :]
            if tail and tail not in stems:
                stems[tail] = self._alone([tail.decode()])[0]
            if (ids := stems.get(stem)) is None:
                new.add(stem)
                later.append((word, stem, tail))
            else:
                words[word] = ids + stems[tail] if tail else ids
        if new:
            ordered = list(new)
            stems.update(zip(ordered, self._joined(ordered), strict=True))
            for word, stem, tail in later:
                words[word] = stems[stem] + stems[tail] if tail else stems[stem]
        if odd:
            words.update(zip(odd, self._alone([w.decode() for w in odd]), strict=True))

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=ID).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, stems: list[bytes]) -> list[bytes]:
        """Ids of stems of letters alone: each is one pre-token, so its last id is the only one that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids, dtype=ID)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(stems):
            return self._alone([s.decode() for s in stems])
        raw, cuts = ids.tobytes(), [0, *(ends * ID.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[tuple[str | None, int], WordEncoder] = {}


def encoder(path: str | None = None, limit: int = 600_000) -> WordEncoder:
    """One encoder for each tokenizer and limit in a worker process."""
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = WordEncoder(path, limit)
    return _ENCODERS[path, limit]
