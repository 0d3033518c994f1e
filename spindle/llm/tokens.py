"""Encoding with a public tokenizer file, a bounded cache of encoded words in front of it.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so that the ids of the
pieces, joined, are the ids of the text. Words repeat, so most pieces are found in the cache, and
the texts of a batch are cut together, so that a piece is looked up once for all of them, all
pieces at a time. Tokenizers of other kinds encode each text whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Unicode White_Space, as the tokenizers' patterns read \s.
_WS = "\t-\r \x85\xa0  -     　"
#: A word with the space before it, or a run of white space without the space that leads a word.
_LED = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_BARE = re.compile(f"[^{_WS}]+")

#: Byte-level tokenizers write a byte that isn't a visible Latin-1 character as one from 256 on, in order.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}

#: Pieces in each of the cache's two generations.
CACHE_ENTRIES = 450_000
CACHE_CHARS = 48
#: Pieces in the table for texts that are cut together (some 60 bytes each), checked before each look-up.
TABLE_ENTRIES = 1_000_000
#: Bytes of the longest piece in that table.
TABLE_BYTES = 23

#: Where a cut before each space differs from the pattern's: in runs of white space.
_RUN = f"[{_WS}] (?:[{_WS}]|\\z)"
#: Texts that are cut together, and their bytes, unless one alone is larger.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20
#: Bytes of distinct words that are looked up at once.
WORDS_BYTES = 1 << 19

_BYTES = np.arange(256)
#: Bytes of ASCII punctuation, and of all visible ASCII characters.
_MARK = np.isin(_BYTES, list(punctuation.encode()))
_SEEN = (_BYTES > 0x20) & (_BYTES < 0x7F)
#: A word without any other byte is of the letters A to Z and \xc0 to \xff, but for \xd7 and \xf7, in UTF-8.
_LETTER = np.isin(_BYTES & 0xDF, range(0x41, 0x5B)) & (_BYTES < 0x80) | (_BYTES == 0xC3) | (_BYTES & 0xC0 == 0x80) & (_BYTES & 0xDF != 0x97)
#: The bytes of such a word in lower case.
_LOWER = (_BYTES + 0x20 * (_SEEN & _LETTER & (_BYTES < 0x5B) | _LETTER & (_BYTES >= 0x80) & (_BYTES < 0x9F))).astype(np.uint8)
#: What a piece's first 0 to 8 bytes hold of a 64-bit integer.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _cutter(spec: dict):
    """The pattern whose matches can be encoded one by one, or None if the kind isn't known."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return _LED
    if pre.get("type") == "Sequence":
        first = pre["pretokenizers"][0]
        drops_space = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        kinds = {x.get("type") for x in (norm or {}).get("normalizers", [])}
        if drops_space and kinds <= {"NFC", "Replace", "Lowercase"}:
            return _BARE
    return None


class _Table:
    """The ids of short pieces, looked up for many at once: a hash table in arrays, without an object for each piece."""

    def __init__(self):
        self.size = self.kept = 0
        self.pieces, self.starts, self.ids = np.empty((0, 3), np.uint64), np.zeros(1, np.int64), np.empty(0, np.int32)
        self.used, self.slots = np.empty(0, bool), np.full(1 << 12, -1, np.int32)

    @staticmethod
    def keys(raw: np.ndarray, at: np.ndarray, to: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """The bytes of each piece, its length and whether a space leads it; 24 bytes are read from where it begins."""
        n, ahead = to - at, np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        keys = np.stack([ahead[at + 8 * i] & _FIRST[np.clip(n - 8 * i, 0, 8 - i // 2)] for i in range(3)], 1)
        keys[:, 2] |= (n + 32 * lead).astype(np.uint64) << np.uint64(56)
        return keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = np.bitwise_xor.reduce(keys * _ODD, 1)
        mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD[0]
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it isn't in the table."""
        found, todo, slot = np.full(len(keys), -1), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            held = self.slots[slot]
            same = (held >= 0) & (self.pieces[held] == keys[todo]).all(1) if self.kept else np.zeros(len(todo), bool)
            found[todo[same]] = held[same]
            on = (held >= 0) & ~same
            todo, slot = todo[on], slot[on] + 1 & len(self.slots) - 1
        self.used[found[found >= 0]] = True
        return found

    def _enter(self, first: int) -> None:
        """Give the pieces from ``first`` on a slot; at most half of the slots are taken."""
        if 2 * self.kept > len(self.slots):
            self.slots, first = np.full(1 << (4 * self.kept).bit_length() - 1, -1, np.int32), 0
        todo = np.arange(first, self.kept, dtype=np.int32)
        slot = self._slot(self.pieces[first : self.kept])
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several, the last one has it
            on = self.slots[slot] != todo
            todo, slot = todo[on], slot[on] + 1 & len(self.slots) - 1

    def add(self, ids: list[bytes], keys: np.ndarray | None) -> int:
        """Append pieces that aren't in the table, to be found if they have keys. Returns the place of the first."""
        first, self.size = self.size, self.size + len(ids)
        flat, ends = np.frombuffer(b"".join(ids), "<i4"), self.starts[first] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
        self.starts = _put(self.starts, first + 1, ends)
        self.ids = _put(self.ids, int(self.starts[first]), flat)
        if keys is not None:
            self.kept = self.size
            self.pieces = _put(self.pieces, first, keys)
            self.used = _put(self.used, first, np.zeros(len(ids), bool))
            self._enter(first)
        return first

    def lists(self) -> pa.LargeListArray:
        starts = self.starts[: self.size + 1]
        return pa.LargeListArray.from_arrays(pa.array(starts), pa.array(self.ids[: starts[-1]]))

    def forget_longer(self) -> None:
        self.size = self.kept

    def shrink(self) -> None:
        """Of a full table, keep what was found again since it was last full, at most half of it."""
        if self.kept < TABLE_ENTRIES:
            return
        again = np.flatnonzero(self.used[: self.kept])[-(TABLE_ENTRIES // 2) :]
        ids, pieces = self.lists().take(pa.array(again)), self.pieces[again]
        self.__init__()
        self.size = self.kept = len(again)
        self.pieces, self.starts, self.ids, self.used = pieces, ids.offsets.to_numpy().copy(), ids.values.to_numpy().copy(), np.zeros(len(again), bool)
        self._enter(0)


def _put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """The array, made longer if need be, with ``new`` from ``at`` on; what stood behind is lost."""
    if len(array) < at + len(new):
        array, old = np.empty((at + len(new) + (at + len(new)) // 2, *array.shape[1:]), array.dtype), array[:at]
        array[:at] = old
    array[at : at + len(new)] = new
    return array


class Encoder(dict):
    """Maps a piece of text to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cut: bool = True):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        self.table = _Table()
        self.pattern = _cutter(json.loads(self.tokenizer.to_str())) if cut else None

    def _ids(self, piece: str, body: str) -> bytes:
        """The ids of a piece. What both kinds of pre-tokenizer leave as it is goes to the model at once."""
        if not body.isalpha() or not body.isascii() and max(body) > "\xff":
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if piece.isascii():
            mapped = "\u0120" + body if body is not piece else piece
        else:
            mapped = piece.encode().decode("latin1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _make(self, piece: str) -> tuple[bytes, bool]:
        """The ids of a piece, and whether it isn't made of others."""
        body = piece[1:] if piece[:1] == " " else piece
        if not body.isalpha():
            word = body.rstrip(punctuation)
            if word != body and word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                return self[piece[: len(word) - len(body)]] + self[body[len(word) :]], False  # letters and marks are always cut apart
            parts = self.pattern.findall(piece)
            if parts != [piece]:
                return b"".join(map(self.__getitem__, parts)), False
        elif self.pattern is _BARE and (low := piece.lower()) != piece and (body.isascii() or max(body) <= "\xff"):
            return self[low], False
        return self._ids(piece, body), True

    def __missing__(self, piece: str) -> bytes:
        """Only pieces that aren't made of others are kept."""
        ids = self.old.get(piece)
        if ids is None:
            ids, single = self._make(piece)
            if not single:
                return ids
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:  # pieces that are still used move on from the old generation
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.pattern is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's begin, then the end of the last.

        The texts are cut at their spaces at once, and each distinct piece is encoded once. A piece
        that holds other white space is cut again by the pattern.
        """
        led = self.pattern is _LED
        if self.pattern is None or led and pc.any(pc.match_substring_regex(texts, _RUN)).as_py():
            ids = [self.encode(t) for t in texts.to_pylist()]
            at = np.cumsum([0, *(len(x) // 4 for x in ids)])
            return np.frombuffer(b"".join(ids), "<i4"), at
        cut = pc.split_pattern(texts if led else pc.replace_substring(texts, "\n", " "), " ")
        at = cut.offsets.to_numpy()
        found = cut.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at, place = at - at[0], found.indices.to_numpy()
        words = found.dictionary
        if led:  # all pieces but the first of a text have their space before them
            first, place = found.indices.take(pa.array(at[:-1])), place.copy()
            place[at[:-1]] = len(words) + np.arange(len(first))
            ids = pa.concat_arrays([*self._words(words, True), *self._words(words.take(first), False)])
        else:
            ids = pa.concat_arrays(self._words(words, False))
        taken = ids.take(pa.array(place))
        starts = taken.offsets.to_numpy()[at]
        return taken.values.to_numpy()[starts[0] : starts[-1]], starts - starts[0]

    def _words(self, words: pa.Array, lead: bool) -> list[pa.LargeListArray]:
        """The ids of each word, with a space before it if ``lead``, some of the words at a time."""
        lists, lo = [pa.array([], pa.large_list(pa.int32()))], 0
        chars = words.buffers()[2]
        ends = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32)[: len(words) + 1] if len(words) else [0]
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, int(ends[lo]) + WORDS_BYTES, "right")) - 1)
            if ends[hi] - ends[lo] > WORDS_BYTES:  # one word
                ids = np.frombuffer(self[lead * " " + words[lo].as_py()], "<i4")
                lists.append(pa.LargeListArray.from_arrays(pa.array([0, len(ids)], pa.int64()), pa.array(ids)))
            else:
                at = ends[lo : hi + 1].astype(np.int64)
                lists.append(self._some(np.frombuffer(chars or b"", np.uint8)[at[0] : at[-1]], at - at[0], lead))
            lo = hi
        return lists

    def _some(self, chars: np.ndarray, ends: np.ndarray, lead: bool) -> pa.LargeListArray:
        """The ids of words that stand one after the other.

        One line end between visible characters, and marks behind letters, are always cut off. What
        remains are pieces, of which the table holds the shorter ones.
        """
        raw = np.concatenate([[0], chars, np.zeros(31)], dtype=np.uint8, casting="unsafe")
        begins, ends = ends[:-1] + 1, ends[1:] + 1
        lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        broken = np.flatnonzero(lines[ends] - lines[begins] == 1)
        line = np.flatnonzero(raw == 0x0A)[lines[begins[broken]]]
        cut = (line > begins[broken]) & (line < ends[broken] - 1) & _SEEN[raw[line - 1]] & (_SEEN | (_BYTES == 0xC3))[raw[line + 1]]
        broken, line = broken[cut], line[cut]
        # columns: what stands before the line end (or all), marks behind it, the line end, and both of what follows
        at, to = np.zeros((2, len(begins), 5), np.int64)
        at[:, 0], to[:, 1] = begins, ends
        at[broken, 2], to[broken, 1], to[broken, 2] = line, line, line + 1
        at[broken, 3], to[broken, 4] = line + 1, ends[broken]
        other = np.concatenate([[0], np.cumsum(~_LETTER[raw])])
        last = np.maximum.accumulate(np.where(_MARK[raw], 0, np.arange(len(raw))))  # byte that is no mark
        plain = np.zeros(at.shape, bool)
        for i in (0, 3):
            a, b = at[:, i], to[:, i + 1]
            mid = np.maximum(last[b - 1] + 1, a)
            plain[:, i] = (mid > a) & (other[mid] == other[a])
            mid = np.where(plain[:, i], mid, b)
            to[:, i] = at[:, i + 1] = mid
        there = to > at
        there[:, 0] = True  # an empty word may have a space before it
        lead = (there & [lead, False, False, False, False])[there]
        at, to, plain = at[there], to[there], plain[there]
        if self.pattern is _BARE:  # the words of letters once more, in lower case
            at, to, raw = np.where(plain, at + len(raw), at), np.where(plain, to + len(raw), to), np.concatenate([raw, _LOWER[raw]])
        self.table.shrink()
        short, found, text = to - at <= TABLE_BYTES, np.full(len(at), -1), raw.tobytes()
        keys = self.table.keys(raw, at, to, lead)
        found[short] = self.table.find(keys[short])
        for kept in (True, False):  # longer pieces stay in the table until this call ends
            some = np.flatnonzero((found < 0) & (short == kept))
            new: dict[str, int] = {}
            words = [text[a:b].decode() for a, b in zip(at[some].tolist(), to[some].tolist())]
            place = np.array([new.setdefault(" " + p if s else p, len(new)) for p, s in zip(words, lead[some].tolist())], np.int64)
            which = np.empty(len(new), np.int64)
            which[place] = some
            ids = [self._make(p)[0] for p in new] if kept else list(map(self.__getitem__, new))
            found[some] = self.table.add(ids, keys[which] if kept else None) + place
        ids = self.table.lists().take(pa.array(found))
        self.table.forget_longer()
        ends = np.append(0, np.cumsum(there.sum(1)))
        return pa.LargeListArray.from_arrays(pa.array(ids.offsets.to_numpy()[ends]), ids.values)


_encoders: dict[str, Encoder] = {}
common.caches["tokens"] = _encoders.clear


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts are cut together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        most = SLICE_BYTES + (ends[lo - 1] if lo else 0)
        hi = max(lo + 1, min(lo + SLICE_ROWS, int(np.searchsorted(ends, most, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
