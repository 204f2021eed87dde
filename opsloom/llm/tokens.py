"""Token ids of whole texts with a public word-level BPE vocabulary, many rows at a time.

The vocabulary's pre-tokeniser never joins text across white space, so texts are cut at ASCII blanks, every different
piece is encoded once per worker, and ids are put together again by numpy.  Full stops and commas at the end of a piece are encoded
apart only if what stands before them still ends in a letter after the vocabulary's own normalisation (composed, lower case): a
letter that falls apart into a letter and a mark would take them into one token.  Same ids as encoding whole texts, at a
fraction of the cost.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from opsloom.llm import words as wd

#: Bytes of pieces and ids remembered by each Python worker; beyond it, new pieces are encoded again when met.
REMEMBERED, EACH = 64 << 20, 160
#: Bytes of text that are encoded at a time.
CHUNK = 2 << 20
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _normal(piece: str) -> str:
    return piece if piece.isascii() else unicodedata.normalize("NFC", piece).lower()


class Encoder:
    """Ids of a vocabulary file of the ``tokenizers`` library that drops white space between words (two-byte ids)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids must fit two bytes")
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces without ASCII blanks.  Pieces of letters only are one word each and are encoded in one run."""
        stems: dict[str, bytes] = {}
        shape = []
        for w in pieces:
            stem = w.rstrip(".,")
            if not stem or not _normal(stem)[-1].isalpha():
                stem = w
            tail = w[len(stem) :]
            stem = stem.lower() if stem.isascii() else stem
            shape.append((w, stem, tail))
            for x in (stem, tail):
                if x and x not in self.known:
                    stems[x] = b""
        plain = [s for s in stems if _normal(s).isalpha()]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.concatenate(([0], np.flatnonzero(self.closes[ids]) + 1)) * 2
            if len(cuts) == len(plain) + 1:
                raw, cuts = ids.tobytes(), cuts.tolist()
                stems.update((s, raw[a:b]) for s, a, b in zip(plain, cuts, cuts[1:], strict=False))
            else:  # some word was not one unit after all
                stems.update((s, self.ids(s)) for s in plain)
        alone = list(set(stems).difference(plain))
        for s, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            stems[s] = np.array(found.ids, "<u2").tobytes()
        own = {w: (stems.get(stem) or self.known.get(stem, b"")) + (stems.get(tail) or self.known.get(tail, b"")) for w, stem, tail in shape}
        for more in (stems, own):
            for piece, ids in more.items():
                if self.held < REMEMBERED and piece not in self.known:
                    self.known[piece] = ids
                    self.held += EACH + 2 * len(piece) + len(ids)
        return own

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint16) and their number by row; a null text is an empty one."""
        words, counts = wd.split_words(text)
        if not len(words):
            return np.zeros(0, "<u2"), np.zeros(len(counts), np.int64)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        new = self.learn([w for w in own if w not in self.known])
        parts = [self.known[w] if w in self.known else new[w] for w in own]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        pool, begin = np.frombuffer(b"".join(parts), "<u2"), np.concatenate(([0], np.cumsum(size)[:-1]))
        codes = coded.indices.to_numpy()
        lengths = size[codes]
        ends = np.cumsum(lengths)
        ids = pool[np.arange(int(ends[-1])) + np.repeat(begin[codes] - (ends - lengths), lengths)]
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(edges)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row with ``end`` after them."""
    return np.insert(ids, np.cumsum(counts), end).astype("<u2"), counts + 1
