"""Token ids of the lower-casing word-end BPE vocabulary, a word at a time.

Its pre-tokenizer drops white space and never joins letters, digits and marks across white space, nor across the edge
between a run of Latin-1 letters and ASCII. Such pieces are encoded alone, once per worker, by the ``tokenizers`` library
and looked up afterwards, which gives the ids of the whole text. Any other character keeps its surroundings up to the next
ASCII white space in one piece.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARKS = r"!-&(-/:-@\[-`{-~"
#: letters before ASCII or the end; ASCII marks before a letter, a digit, white space or the end; else all up to a space
_PIECE = re.compile(rf"[a-zß-öø-ÿ]++(?=[\x00-\x7f]|\Z)|[{_MARKS}]++(?=[a-z0-9]|\Z)|.+", re.DOTALL)
_PLAIN = re.compile(rf"[a-zß-öø-ÿ]+|[{_MARKS}]+")  # one word each, so many are encoded in one call
CHUNKS, PIECES = 300_000, 500_000  # entries a worker keeps; what is met first, so the frequent ones, stays


class WordEncoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids; ``spec`` is the JSON text of the tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        normalizer = json.loads(spec).get("normalizer") or {}
        if not any(k.get("type") == "Lowercase" for k in normalizer.get("normalizers", [normalizer])):
            raise ValueError("the word cache needs the lower-casing vocabulary")
        suffix = json.loads(spec)["model"]["end_of_word_suffix"]
        self.word_ends = {i for word, i in self.tokenizer.get_vocab().items() if word.endswith(suffix)}
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; one that holds an added token, whose string is cut out before words are, is encoded whole."""
        odd = {k for k, t in enumerate(texts) if any(token in t.translate(_LOWER) for token in self.added)}
        if odd:
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in odd]))
            return [np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
                    if k in odd else next(rest) for k, t in enumerate(texts)]
        done = []
        for at in range(0, len(texts), 64):
            get = self.chunks.get
            cut = [t.translate(_LOWER).split() for t in texts[at: at + 64]]
            codes = [list(map(get, chunks)) for chunks in cut]
            new: dict[bytes, bytes] = {}
            gaps = []
            for chunks, code in zip(cut, codes):
                if None in code:
                    k = -1
                    for _ in range(code.count(None)):
                        k = code.index(None, k + 1)
                        new[chunks[k]] = b""
                        gaps.append((code, k, chunks[k]))
            if new:
                self._learn(new)
                for code, k, chunk in gaps:
                    code[k] = new[chunk]
            done += map(b"".join, codes)
        return done

    def _learn(self, new: dict[bytes, bytes]) -> None:
        """Fill in the ids of white-space-free chunks from those of their pieces."""
        cut = {chunk: _PIECE.findall(chunk.decode("utf-8", "replace")) for chunk in new}
        known = self.pieces
        unknown = list({piece for pieces in cut.values() for piece in pieces if piece not in known})
        if len(known) + len(unknown) > PIECES and unknown:
            known = {piece: known[piece] for pieces in cut.values() for piece in pieces if piece in known}
        plain = [piece for piece in unknown if _PLAIN.fullmatch(piece)]
        for part in (plain[at: at + 256] for at in range(0, len(plain), 256)):
            code = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ends = [k + 1 for k, i in enumerate(code) if i in self.word_ends]
            if len(ends) != len(part):
                raise ValueError("a run of letters or marks is not one word of this vocabulary")
            code = np.array(code, "<u4").tobytes()
            known.update(zip(part, [code[4 * a: 4 * b] for a, b in itertools.pairwise([0, *ends])]))
        for piece in unknown:
            if piece not in known:
                known[piece] = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        for chunk, pieces in cut.items():
            new[chunk] = b"".join([known[piece] for piece in pieces])
        room = CHUNKS - len(self.chunks)
        self.chunks.update(itertools.islice(new.items(), max(0, room)))


_encoders: dict[int, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]
