"""Token ids of whole texts by the tokenizers library, one lookup per word that was seen before."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

from alleleflow.llm.shared import own_cache

#: Word and id string of a cached word take about 180 bytes: at most about 200 MB a worker.
CACHED_WORDS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters, then marks that are neither letters, digits nor apostrophes: two pre-tokens at most.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w\s']*)")


class _Seen(dict):
    """Ids of words; words that it lacks gather in `new`."""

    def __init__(self):
        super().__init__()
        self.new = set()

    def __missing__(self, word):
        self.new.add(word)


class WordEncoder:
    """Encodes with a tokenizer whose pre-tokenizer drops white space and lower-cases, so that the
    pieces between ASCII white space are encoded alone. Pieces are lower-cased in ASCII before the
    lookup (the normaliser does it anyway). Texts that hold '<|', where a special token might
    begin, are encoded as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.seen = _Seen()
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _pack(self, ids) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _learn(self) -> None:
        """Encode the new words: plain ones together in one text, whose ids are cut after each
        token that ends a word, others alone."""
        seen, plain, alone = self.seen, {}, []
        todo, parts = list(seen.new), set()
        seen.new.clear()
        for word in todo:
            if word.isalpha():  # in bytes: ASCII letters alone
                parts.add(word)
                continue
            if word[:-1].isalpha() and word[-1] in b".,;:!?":
                pair = plain[word] = [word[:-1], word[-1:]]
                parts.update(pair)
                continue
            text = word.decode("utf-8", "surrogateescape").lower()
            m = _PLAIN.fullmatch(text)
            if m and m[1].isalpha() and "\u03c2" not in text and unicodedata.is_normalized("NFC", text):
                pair = plain[word] = [x.encode() for x in m.groups() if x]
                parts.update(pair)
            else:
                alone.append(word)
        parts = [p for p in parts if p not in seen]
        seen.new.clear()
        if parts:
            joined = [b" ".join(parts[k:k + 2000]).decode() for k in range(0, len(parts), 2000)]
            got = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.array([i for e in got for i in e.ids], dtype=self.dtype)
            cuts = np.flatnonzero(self.word_end[ids]) + 1
            if len(cuts) == len(parts):
                raw, at = ids.tobytes(), [0, *(cuts * self.dtype.itemsize).tolist()]
                seen.update((p, raw[at[k]:at[k + 1]]) for k, p in enumerate(parts))
            else:
                alone += [*plain, *parts]
                plain = {}
        seen.update((w, b"".join(seen[p] for p in pair)) for w, pair in plain.items())
        for word in alone:
            seen[word] = self._pack(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null."""
        seen, out, late = self.seen, [], []
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            if b"<|" in data:
                out.append(self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            words = data.lower().split()
            parts = list(map(seen.__getitem__, words))
            if None in parts:
                late.append((len(out), words, parts))
                out.append(b"")
            else:
                out.append(b"".join(parts))
        if late:
            self._learn()
            for k, words, parts in late:
                out[k] = b"".join(p if p is not None else seen[w] for p, w in zip(parts, words))
        return [np.frombuffer(x, dtype=self.dtype) for x in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, whose cache lasts over tasks that encode."""
    own_cache("encode", lambda: [e.seen.clear() for e in _encoders.values()])
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
