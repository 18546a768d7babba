"""Token ids of whole texts, equal to those of the ``tokenizers`` library for a byte-level BPE file of its format.

The file's vocabulary is also that of a ``tiktoken`` encoding, which merges by the same ranks many times faster; it
takes the parts of a text whose characters all have settled Unicode classes.  Everything else (unusual white space,
rare scripts, special tokens inside a text) goes through the library or is cut out at places where both have a
border, so the ids of the parts are those of the whole.
"""
from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

ID = np.dtype("<u4")

#: Characters that Python and the tokenizer's regular expressions may class differently as white space.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Anything but Latin, Cyrillic, kana, Han and Hangul letters that no Unicode version has reclassed (and NUL, which
#: marks word ends here, and one letter whose lower case is two characters).
_UNSETTLED = re.compile("[^\x01-\u012f\u0131-\u024f\u0400-\u045f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_SPACED = re.compile(r"\s*\S+|\s+")
_TWO_SPACES = re.compile(r"\s\s")

# The pre-tokenisation patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white-space characters meet, without the lookahead that slows the search down.
BYTE_PATTERN_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: The word vocabulary's pattern for settled characters, in Python's classes.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_WORD_END = "\0"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each of the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


_LETTERS = byte_letters()
_BYTE_OF = {c: i for i, c in enumerate(_LETTERS)}


def unlettered(letters: str) -> bytes:
    return bytes(map(_BYTE_OF.__getitem__, letters))


class Encoder:
    """Encodes whole texts with one tokenizer file; ``encode`` returns little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.words = spec["model"].get("end_of_word_suffix")      # set: lower case, white space dropped
        self.ranks = {self._raw(t): i for t, i in vocabulary.items() if t not in self.special}
        self.size = max(*vocabulary.values(), *self.special.values()) + 1
        self.plain_special = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _raw(self, token: str) -> bytes:
        if self.words and token.endswith(self.words):
            return unlettered(token[:-len(self.words)]) + _WORD_END.encode()
        return unlettered(token)

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer, for what the fast path leaves."""
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def _fast(self, pattern: str) -> tiktoken.Encoding:
        # without any special token the library would look for an empty one at each character
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={"\0\0\0": self.size})

    @functools.cached_property
    def any_spaces(self) -> tiktoken.Encoding:
        return self._fast(BYTE_PATTERN)

    @functools.cached_property
    def single_spaces(self) -> tiktoken.Encoding:
        return self._fast(rf"[^{_WORD_END}]+{_WORD_END}" if self.words else BYTE_PATTERN_SINGLE)

    # -- parts of a text -----------------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """Parts that encode alone as they do within ``text`` (which holds no odd space and no special token)."""
        return text.replace("\n", " ").split(" ") if self.words else _SPACED.findall(text)

    def segments(self, text: str) -> list[tuple[str, str]]:
        """The text's parts as ("plain" | "whole" | "special", part), in order."""
        parts = [text]
        if any(s in text for s in self.special):
            if not self.plain_special:
                return [("whole", text)]
            parts = self.special_split.split(text)
        return [("special" if p in self.special else "whole" if _ODD_SPACE.search(p) else "plain", p)
                for p in parts if p]

    # -- encoding ------------------------------------------------------------------------------------------

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token of a vocabulary without word ends."""
        return self.single_spaces._core_bpe.encode_single_piece(raw)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def _settled(self, text: str) -> bytes:
        if self.words:
            words = _WORDS.findall(text.lower())
            if not words:
                return b""
            text, encoding = _WORD_END.join(words) + _WORD_END, self.single_spaces
        else:
            encoding = self.any_spaces if _TWO_SPACES.search(text) else self.single_spaces
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(ID).tobytes()

    def _plain(self, text: str) -> bytes:
        if not _UNSETTLED.search(text):
            return self._settled(text)
        glue = " " if self.words else ""
        return b"".join([(self._whole if rare else self._settled)(glue.join(units)) for rare, units in itertools.groupby(
            self.units(text), lambda u: bool(_UNSETTLED.search(u)))])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (None: empty) as bytes."""
        if not text:
            return b""
        by = {"plain": self._plain, "whole": self._whole, "special": lambda s: self.special[s].to_bytes(4, "little")}
        return b"".join([by[kind](part) for kind, part in self.segments(text)])

    # -- decoding ------------------------------------------------------------------------------------------

    @functools.cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes that each id of a vocabulary without word ends stands for."""
        table = [b""] * self.size
        for raw, i in (*self.ranks.items(), *((s.encode(), i) for s, i in self.special.items())):
            table[i] = raw
        return table

    def decode(self, ids: bytes) -> str:
        """The text of byte-level ids; bytes that are not UTF-8 become the replacement character."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, ID).tolist()]).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, once per Python worker."""
    return Encoder(path)
