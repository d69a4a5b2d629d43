"""Fast exact tokenisation with the ``tokenizers`` library.

A byte-level BPE splits a text before any merge, and never merges across that
split. A text is therefore cut into the split's units; each distinct unit is
encoded by the library once per task and looked up after that. Texts with characters on whose class the two regex engines could
differ, or with a special token's string, go through the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

TOKENIZER = "byte_bpe_50k.json"

_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: The public split pattern of this vocabulary, its letter and number classes
#: restricted to the characters of safe texts.
_UNIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
#: Safe texts: printable ASCII, tab, line feed, Latin letters, and punctuation
#: that is neither a letter nor a number in any Unicode version.
_UNSAFE = re.compile(f"[^\t\n\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6\xb7\xbb\xbf\xd7\xf7{_LETTER}]")
_SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class _Spelling(dict):
    """Characters to the printable ones that a byte-level vocabulary spells their
    bytes with, as a table for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        from tokenizers.pre_tokenizers import ByteLevel
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self[code] = "".join(part for part, _ in level.pre_tokenize_str(chr(code)))
        return self[code]


class _Units(dict):
    """Ids of units by the library's merges alone (no text is split again), made
    when first asked for. The first ``most`` stay; any other is held in ``beyond``."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most, self.spell, self.beyond = merge, most, _Spelling(), {}

    def __missing__(self, unit: str) -> bytes:
        out = self.beyond.get(unit)
        if out is None:
            ids = [t.id for t in self.merge(unit.translate(self.spell))]
            out = struct.pack(f"<{len(ids)}I", *ids)
            (self if len(self) < self.most else self.beyond)[unit] = out
        return out


class IdEncoder:
    """Texts to little-endian unsigned 32-bit token ids, as bytes.

    ``max_units`` bounds the look-up table (the first units seen stay; any
    other is encoded once per call), not what can be encoded.
    """

    def __init__(self, path: str | None = None, max_units: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path or tokenizer_path())
        self.units = _Units(self.tok.model.tokenize, max_units)

    def _ids(self, texts: list[str]) -> list[bytes]:
        enc = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in enc]

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.units.__getitem__, []
        for t in texts:
            whole = _UNSAFE.search(t) is not None or _SPECIAL in t
            out.append(self._ids([t])[0] if whole else b"".join(map(get, _UNIT.findall(t))))
        self.units.beyond.clear()
        return out


@lru_cache(maxsize=2)
def shared_encoder(path: str | None = None) -> IdEncoder:
    """One encoder per Python worker, so its look-up table serves later tasks too."""
    return IdEncoder(path)
