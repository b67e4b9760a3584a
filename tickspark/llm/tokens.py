"""Token ids of whole texts by a public tokenizer file, a distinct word or piece at a time.

Both vocabularies split a text at white space, and what lies between is encoded alone, so a
word goes through the tokenizers library when a worker meets it first and is looked up while it stays in use.
Words are cut to pieces by the pattern of the vocabulary, which the merge model of the library encodes.  The vocabulary that lowers has no pieces with white space,
so :meth:`Encoder.column` cuts a whole column of texts to pieces in Arrow and looks up each distinct piece once.  The texts are cut here
only where that is sure to agree with the library: Latin letters (code points up to U+024F), which
every Unicode version treats alike, and, for the byte vocabulary, single spaces.  Any other text goes to
the library whole, and so does one that may hold the string of a special token.  Such strings give the special
id, as in the library's plain call; ``special_as_text`` treats them as ordinary text.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Anything that is not plain Latin text.
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")
#: Control characters other than tab and line ends.
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: How the strings of special tokens begin in these vocabularies.
SPECIAL = "<|"
#: White space before a space, which the byte vocabulary may join to one piece.
GAPS = ("  ", "\n ", "\t ", "\r ")
#: Code points of texts that are cut here, and of these in lower case, which some have beyond the range.
POINTS = [9, 10, 13, *range(0x20, 0x250)]
LOWERED = sorted({*POINTS, *(ord(c) for k in POINTS for c in chr(k).lower())})
LETTERS, NUMBERS = ("".join(chr(k) for k in LOWERED if unicodedata.category(chr(k))[0] == kind) for kind in "LN")
#: What the vocabularies make of a text, by whether they lower it.
PIECES = {
    False: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"),
    True: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"),
}
#: :data:`OTHER` and control characters, for Arrow's expressions.
ARROW_OTHER = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]"
#: All pieces of the vocabulary that lowers but letters, which end where one of these or white space begins.
ARROW_MARKS = rf"('s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+)"


class Remembered(dict):
    """Values by key, made where they are missing.  Of more than ``limit`` keys, those stay that were asked for
    among the last ``limit`` to twice as many different ones.  Very long keys are not kept."""

    #: Characters of the longest key kept.
    LONGEST = 100

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        self.make, self.limit = make, limit
        self.before: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > self.LONGEST:
            return value
        if len(self) >= self.limit:
            self.before = self.copy()
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes texts to little-endian unsigned integers of ``width`` bytes."""

    #: Words remembered as in use; as many that were so before.
    LIMIT = 250_000
    #: Bytes of text of a column that are cut to pieces at once; a longer text alone.
    LOT = 4 << 20

    def __init__(self, path: str, lower: bool, width: int = 2, special_as_text: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = None if special_as_text else SPECIAL
        self.lower, self.kind = lower, {2: "H", 4: "I"}[width]
        self.cut = PIECES[lower].findall
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {k: mapped(chr(k))[0][0] for k in LOWERED}
        self.merge, self.space = self.tokenizer.model.tokenize, "" if lower else self.bytes[32]
        self.known = Remembered(self._word, self.LIMIT)
        self.pieces = Remembered(self._piece, self.LIMIT // 4)

    def _piece(self, piece: str) -> bytes:
        """Ids of what the vocabulary takes as one piece: the library's merge model alone does."""
        return array(self.kind, [t.id for t in self.merge(piece.translate(self.bytes))]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word, with the space before it where the vocabulary has one."""
        if word.isalpha():
            # ASCII letters stand for themselves.
            mapped = word if word.isascii() else word.translate(self.bytes)
            return array(self.kind, [t.id for t in self.merge(self.space + mapped)]).tobytes()
        first, *rest = self.cut(word if self.lower else " " + word)
        bare = first if self.lower else first[1:]
        head = self.known[bare] if bare.isalpha() else self.pieces[first]
        return b"".join([head, *map(self.pieces.__getitem__, rest)])

    def _whole(self, text: str) -> bytes:
        """Ids of a text by the library itself."""
        return array(self.kind, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each whole text, in order; empty for null."""
        return map(self, texts)

    def column(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of each whole text with ``end`` behind, as an Arrow column; for a vocabulary that lowers.  Null texts are empty."""
        texts, last = pc.fill_null(texts, ""), array(self.kind, [end]).tobytes()
        lot = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // self.LOT
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([self._lot(texts[a:b], last) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _lot(self, texts: pa.Array, last: bytes) -> pa.Array:
        """Part of a column: the distinct pieces are looked up, and their ids dealt out to where the pieces stand."""
        odd = pc.match_substring_regex(texts, ARROW_OTHER + (f"|{re.escape(self.special)}" if self.special else ""))
        plain = pc.utf8_lower(pc.if_else(odd, "", texts))
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, ARROW_MARKS, r" \1 "))
        found = pieces.flatten().dictionary_encode()
        # White space at the ends of a text leaves empty pieces.
        known = [self.known[p] if p else b"" for p in found.dictionary.to_numpy(zero_copy_only=False)]
        # Behind the pieces of a text stands its end; texts that the library encodes are one piece with it.
        whole = [self._whole(t) + last for t in texts.filter(odd).to_pylist()]
        behind, is_odd = np.full(len(texts), len(known)), odd.to_numpy(zero_copy_only=False)
        behind[is_odd] += 1 + np.arange(len(whole))
        ends = pieces.offsets.to_numpy()[1:]
        order = np.insert(found.indices.to_numpy(), ends, behind)
        ids = pa.array([*known, last, *whole], pa.binary()).take(pa.array(order))
        _, place, data = ids.buffers()
        ends = np.frombuffer(place, np.int32)[np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), data])

    def __call__(self, text: str | None) -> bytes:
        """Ids of one whole text; empty for null."""
        if not text:
            return b""
        if (
            (not text.isascii() or CONTROL.search(text)) and OTHER.search(text)
            or (not self.lower and any(gap in text for gap in GAPS)) or (self.special and self.special in text)
        ):
            return self._whole(text)
        if self.lower:
            return b"".join(map(self.known.__getitem__, text.lower().split()))
        # Every word but the first has its space before it.
        first, *words = text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, self.cut(first)), *map(self.known.__getitem__, words)])


@cache
def encoder(path: str, lower: bool, width: int = 2, special_as_text: bool = False) -> Encoder:
    """The encoder of this worker process; it keeps the words it knows from task to task."""
    return Encoder(path, lower, width, special_as_text)
