"""Token ids of whole texts by the tokenizers library, in bulk.

Both public vocabularies cut a text at white space before they merge bytes, so the ids of a text are those of
its runs of non-space characters one after another (byte level: with the space before them). A worker keeps the
ids of the runs that it has met and asks the library's model for new ones only. Texts with characters for which
the cut could depend on a Unicode version or a normaliser (beyond Latin letters and common punctuation), texts with
one of the vocabulary's added tokens, and all texts under a vocabulary that cuts in another way go through the
library's whole chain.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

# How the two vocabularies cut a text before they merge bytes.
BYTE_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The normaliser and cut that a vocabulary file of either style declares.
DECLARED = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": WORD_CUT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
}
# Characters for which the runs' ids are the whole text's ids.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ňŊ-ž‐-―‘-‟•…€]*")
RUNS = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: White space other than one space or line feed between words.
UNTIDY = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
CACHED_RUNS = 500_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or 256 onwards for the rest."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece (what the vocabulary's cut leaves whole) -> its ids as bytes; new pieces go to the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        written = piece.encode().decode("latin-1").translate(self.letters)
        self[piece] = out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
        return out


class _Runs(dict):
    """Run of non-space characters -> its ids as bytes; ``before`` is what stands before it in its first piece."""

    def __init__(self, pieces: _Pieces, cut, before: str):
        super().__init__()
        self.pieces, self.cut, self.before = pieces, cut, before

    def __missing__(self, run: str) -> bytes:
        whole = self.before + run
        if run.isalpha():
            out = self.pieces[whole]
        elif run[:-1].isalpha() and run[-1] in ".,;:!?":
            out = self.pieces[whole[:-1]] + self.pieces[run[-1]]
        else:
            out = b"".join([self.pieces[piece] for piece in self.cut(whole)])
        self[run] = out
        return out


class BulkTokenizer:
    """Ids of texts as bytes (little-endian unsigned 32-bit); ``style`` is "byte" or "word" (lower-cased, no spaces)."""

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library, self.style = Tokenizer.from_file(path), style
        with open(path, encoding="utf-8") as f:
            declared = json.load(f)
        self.added = [t["content"] for t in declared["added_tokens"]]
        plain = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in declared["added_tokens"])
        self.known = plain and (declared["normalizer"], declared["pre_tokenizer"]) == DECLARED[style]
        cut = regex.compile(BYTE_CUT if style == "byte" else WORD_CUT).findall
        self.pieces = _Pieces(self.library.model)
        self.bare, self.spaced = _Runs(self.pieces, cut, ""), _Runs(self.pieces, cut, " ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _one(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.known or not PLAIN.fullmatch(text) or any(t in text for t in self.added):
            return self._whole(text)
        bare, spaced = self.bare.__getitem__, self.spaced.__getitem__
        if self.style == "word":
            return b"".join(map(bare, text.lower().split()))
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in UNTIDY):
            return b"".join([spaced(r[1:]) if r[0] == " " and r != " " and not r.isspace() else bare(r) for r in RUNS.findall(text)])
        parts: list[bytes] = []
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(bare(words[0]))
            parts += map(spaced, words[1:])
            parts.append(bare("\n"))
        return b"".join(parts[:-1])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        out = []
        for text in texts:
            if len(self.bare) + len(self.spaced) > CACHED_RUNS:
                for known in (self.bare, self.spaced):
                    known.clear()
            if len(self.pieces) > CACHED_RUNS:
                self.pieces.clear()
            out.append(self._one(text or ""))
        return out


_loaded: dict[tuple[str, str], BulkTokenizer] = {}


def tokenizer(path: str, style: str) -> BulkTokenizer:
    """The worker's own tokenizer for this file, loaded once."""
    if (path, style) not in _loaded:
        _loaded[path, style] = BulkTokenizer(path, style)
    return _loaded[path, style]
