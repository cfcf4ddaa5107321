"""Token ids of whole texts by the tokenizers library, with a bounded cache.

The vocabulary used here drops white space and never joins pieces: words, single
digits and runs of other signs are encoded each by itself.  Each worker keeps
the packed ids of the pieces it has met; a miss goes to the library.  The cache
is emptied when it reaches its bound, so memory does not grow with the corpus.
Whether a vocabulary splits so is tried when it is loaded; with any other, texts
go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Entries at which the cache is emptied, and characters that are looked up at a time.
PIECES, CHUNK = 500_000, 1_000_000

# Words of printable ASCII and Latin-1 letters split as the library's own
# pre-tokenizer does; any other word goes to the library whole.
_WS = "\\x20\\x09-\\x0D"
_ODD = re.compile(f"[^{_WS}!-~À-ÖØ-öø-ÿ]|<\\|")
_ODD_WORD = re.compile(f"(?<![^{_WS}])([^{_WS}]*?(?:{_ODD.pattern})[^{_WS}]*)")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^{_WS}a-z0-9ß-öø-ÿ]+")
_SPACE = re.compile(f"[{_WS}]")

#: What a vocabulary has to split as pieces do.
_TRIAL = "It's 12.5% of DON'T, we'll--(x86) Straße, naïve: «Ñandú» é İx 日本 a<|b don''t 'S 's9 ab12cd ... ²½ " * 2

_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This process's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


class Coder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # The same vocabulary for pieces that are split and normalised already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[str, bytes] = {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.by_pieces = self.packed_by_pieces(_TRIAL) == self._each([_TRIAL])[0]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece, encoded as one line.

        Ids part after tokens that end a word; where that does not give as many
        runs as pieces, each piece is encoded by itself.
        """
        ids = np.array(self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        flat = ids.tobytes()
        if len(cuts) == len(pieces) and cuts[-1] == len(flat):
            return [flat[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return self._each(pieces)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], encode) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            self.pieces.update(zip(part, encode(part), strict=True))

    def _chunk(self, text: str) -> bytes:
        if _ODD.search(text):
            pieces, odd = [], set()
            for i, part in enumerate(_ODD_WORD.split(text)):
                if i % 2:
                    pieces.append(part)
                    odd.add(part)
                else:
                    pieces += _PIECE.findall(part.lower())
        else:
            pieces, odd = _PIECE.findall(text.lower()), set()
        known = self.pieces
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > PIECES:
                known.clear()
                new = set(pieces)
            self._learn(list(new - odd if odd else new), self._encode)
            if odd:
                self._learn(list(new & odd), self._each)
        return b"".join(map(known.__getitem__, pieces))

    def packed_by_pieces(self, text: str) -> bytes:
        if len(text) <= CHUNK:
            return self._chunk(text)
        out, at = [], 0
        while at < len(text):
            space = _SPACE.search(text, at + CHUNK)
            end = space.start() if space else len(text)
            out.append(self._chunk(text[at:end]))
            at = end
        return b"".join(out)

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        return self.packed_by_pieces(text) if self.by_pieces else self._each([text])[0]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
