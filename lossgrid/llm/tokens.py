"""Token ids of whole texts, equal to the tokenizers library's, faster for everyday characters.

Byte-pair merging never crosses the pieces that a tokenizer's pre-tokenizer cuts, so the ids of a
text are those of its pieces in turn. For texts of common characters only, where the piece pattern means the
same here and in the library, pieces are cut here and the library's ids of each distinct piece are
kept; any other text, and any that holds an added token's content, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

#: Fixed value: the piece pattern of byte-level tokenizers that name none of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 2
#: Bytes of the pieces and ids that a worker keeps: of the first that it meets, so the frequent ones are among them. An entry counts
#: what its objects take beside their content too.
KEEP_BYTES = 112 << 20
ENTRY_BYTES = 240
#: White space and assigned characters up to U+024F whose class, case and normal form no library version disputes.
_EVERYDAY = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*")


assert sys.byteorder == "little" and array("I").itemsize == 4


def _byte_chars() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


def _class(kind: str) -> str:
    """The everyday characters of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind and _EVERYDAY.fullmatch(chr(c)))


def _here(pattern: str) -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    for outer, inner in (("[\\p{L}]", f"[{letters}]"), ("[\\p{N}]", f"[{numbers}]"), ("[^\\s\\p{L}\\p{N}]", f"[^\\s{letters}{numbers}]"), ("\\p{L}", f"[{letters}]"), ("\\p{N}", f"[{numbers}]")):
        pattern = pattern.replace(outer, inner)
    return re.compile(pattern)


class Encoder(dict):
    """encode(text) gives the ids as little-endian unsigned 32-bit bytes. As a dict: the bytes of each piece met."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lower = kinds == ["NFC", "Replace", "Lowercase"]
        self.added = [t["content"].lower() if self.lower else t["content"] for t in spec.get("added_tokens") or []]
        pattern = None
        if not spec["normalizer"] and len(steps) == 1 and steps[0].get("use_regex") and not steps[0]["add_prefix_space"]:
            pattern = BYTE_LEVEL
        elif self.lower and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            pattern = steps[0]["pattern"]["Regex"]
        self.merge = self.library.model.tokenize
        self.pieces = pattern and _here(pattern).findall
        self.room = KEEP_BYTES

    def __missing__(self, piece: str) -> bytes:
        merged = self.merge(piece.encode().decode("latin-1").translate(_BYTE_CHARS))
        ids = array("I", [t.id for t in merged]).tobytes()
        size = ENTRY_BYTES + 4 * len(piece) + len(ids)
        if size <= self.room:
            self.room -= size
            self[piece] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.pieces or not _EVERYDAY.fullmatch(text):
            return self.whole(text)
        seen = text.lower() if self.lower else text
        if any(a in seen for a in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.pieces(seen)))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
