"""Exact, memoised encoding with the tokenizers library.

Both vocabularies split text into pre-tokens before any merge, and no pre-token crosses the units cut here, so the ids
of a text are the ids of its units, joined. Natural text repeats its words: each task encodes a unit once and looks it
up afterwards. The memo holds at most ``MEMO_UNITS`` units, the recently used ones, so its memory is bounded.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

from . import common

MEMO_UNITS = 800_000
#: Longer units (text without spaces) are encoded but not kept.
MEMO_CHARS = 64
#: Units looked up together.
CHUNK_UNITS = 200_000
#: The white space of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


_RARE = re.compile(f"[\0{WHITE.replace(' ', '').replace(chr(9) + '-' + chr(13), chr(9) + chr(11) + '-' + chr(13))}]")


def byte_units(text: str) -> list[str]:
    """Units of the byte-level vocabulary: a run of non-spaces with the one space before it, or white space."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _RARE.search(text):
        return _UNIT.findall(text)
    # only single spaces and line ends: cutting before each of them gives the same units
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def word_units(text: str) -> list[bytes]:
    """Units of the word vocabulary, which drops white space and case: runs without ASCII white space, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


#: Letters of ASCII and Latin-1, and other signs of ASCII: how plain units, made of these alone, fall into pre-tokens is told here.
_LETTERS, _SIGNS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "!-/:-@[-`{-~"
_PLAIN = re.compile(f" ?[0-9{_LETTERS}{_SIGNS}]+")
#: Pre-tokens of plain units in lines, a line's end being one of its own. The word vocabulary has each digit apart.
_PRETOKENS = {
    byte_units: re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n"),
    word_units: re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[{_SIGNS}]+|\n"),
}
#: Units in one text for the library.
JOINED = 1_000


class UnitEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes, equal to encoding each text at once."""

    def __init__(self, path: str, units):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._units, self._pretokens = units, _PRETOKENS[units]
        # the same merges over pre-tokens that are cut already: finding them costs the library more than merging
        self._merges = Tokenizer(self._tokenizer.model)
        self._merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\0")
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str  # how both vocabularies spell bytes
        self._spelling = {k: spelt(chr(k))[0][0] for k in (10, *range(32, 127), *range(160, 256))} | {0: "\0"}
        self._line_end = self._merges.encode(self._spelling[10]).ids
        # a text that may hold an added token, spelt in whatever case, goes to the library as it is
        added = sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        self._at_added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self._added_start = os.path.commonprefix(added).partition("|")[0] + "|" if added and all("|" in t for t in added) else ""
        self._memo: dict = {}
        self._old: dict = {}  # the memo before this one; units still in use move over

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _encode_units(self, units: list) -> dict:
        """The ids of different units. Plain ones go as lines of a text; the one token of a line's end tells their ids apart."""
        texts = {u: u.decode("utf-8").lower() if isinstance(u, bytes) else u for u in units}
        plain = [u for u, text in texts.items() if _PLAIN.fullmatch(text)] if len(self._line_end) == 1 else []
        found: dict = {}
        for k in range(0, len(plain), JOINED):
            part = plain[k : k + JOINED]
            lines = "\n".join(map(texts.pop, part))
            ids = array("I", self._merges.encode_batch_fast(["\0".join(self._pretokens.findall(lines)).translate(self._spelling)])[0].ids).tobytes()
            ends = (np.flatnonzero(np.frombuffer(ids, "<u4") == self._line_end[0]) * 4).tolist()
            found.update(zip(part, [ids[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(ids)], strict=True)], strict=True))
        found.update(zip(texts, self._encode(list(texts.values()))))
        return found

    def lookup(self, lists: list[list]) -> list[list[bytes]]:
        """The ids of each unit of each list."""
        found = [list(map(self._memo.get, units)) for units in lists]
        new = {u for units, ids in zip(lists, found) if None in ids for u, x in zip(units, ids) if x is None}
        if not new:
            return found
        if len(self._memo) + len(new) > MEMO_UNITS // 2:
            self._old, self._memo = self._memo, {}
        fresh = {u: ids for u in new if (ids := self._old.get(u)) is not None}
        fresh |= self._encode_units(list(new.difference(fresh)))
        self._memo.update((u, ids) for u, ids in fresh.items() if len(u) <= MEMO_CHARS)
        return [[fresh[u] if x is None else x for u, x in zip(units, ids)] if None in ids else ids for units, ids in zip(lists, found)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; null counts as empty."""
        out: list[bytes] = []
        chunk: list[list] = []
        size = 0
        for text in texts:
            text = text or ""
            if self._added_start in text and self._at_added.search(text):
                out += map(b"".join, self.lookup(chunk))
                out += self._encode([text])
                chunk, size = [], 0
                continue
            chunk.append(self._units(text))
            size += len(chunk[-1])
            if size >= CHUNK_UNITS:
                out += map(b"".join, self.lookup(chunk))
                chunk, size = [], 0
        return out + list(map(b"".join, self.lookup(chunk)))


def encoder(name: str) -> UnitEncoder:
    """This process's encoder for one of the public vocabularies, by file name or by path."""

    def make() -> UnitEncoder:
        if os.path.sep in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        return UnitEncoder(path, word_units if "word_" in os.path.basename(name) else byte_units)

    return common.held(("encoder", name), make)
