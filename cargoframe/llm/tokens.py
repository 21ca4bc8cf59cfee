"""Token ids of whole texts. Texts are cut into units that a worker encodes once and remembers.

A unit ends where the tokenizer's split pattern ends a pre-token whatever follows: after a letter
before ASCII that is no letter, and after a character that is no white space before ASCII white
space. So the ids of a text are those of its units in order. That holds for the two split patterns
known here; a text that holds an added token, and every text of another tokenizer, goes to the library
as a whole. A Python worker keeps one encoder per tokenizer for all its tasks.

Units are found and looked up as arrays: the bytes of a unit of up to ``WIDTH`` bytes, with its
length, are its key in an open table; longer ones are kept by their bytes.
"""

import json
from itertools import chain

import numpy as np
import pyarrow as pa

from cargoframe.llm.words import LOWER, SPACES, buffers, mix

#: Units (and ids of units) a worker remembers, texts of a call of the library, words joined to one text.
REMEMBERED, HELD_IDS, LEARNT, JOINED = 1_000_000, 1 << 23, 4096, 32
#: Bytes of texts cut at once, bytes of a unit kept as a key of three 64-bit words.
PIECE, WIDTH = 1 << 20, 23

_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Kinds of bytes: letter, ASCII that is no letter, ASCII that shows, white space, no ASCII.
_LETTER, _OTHER, _SHOWN, _SPACE, _HIGH = 1, 2, 4, 8, 16
_KINDS = np.where(np.arange(256) < 128, _OTHER, _HIGH).astype(np.uint8)
_KINDS[33:127] |= _SHOWN
_KINDS[SPACES] |= _SPACE
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER | _SHOWN
_IS_LETTER = (_KINDS & _LETTER).astype(bool)
# the characters that stand for bytes in a byte-level vocabulary
_SIGNS = np.arange(256, dtype=np.uint32)
_HIDDEN = [*range(33), *range(127, 161), 173]
_SIGNS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _pattern(normal: dict | None, split: dict | None) -> str | None:
    """``bytes``: blanks stay with the word after them; ``words``: white space goes, small letters."""
    split = split or {}
    if normal is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return "bytes"
    parts, steps = split.get("pretokenizers") or [], (normal or {}).get("normalizers") or []
    if ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
            and [p["type"] for p in parts] == ["Split", "ByteLevel"] and not parts[1]["use_regex"]
            and not parts[1]["add_prefix_space"] and parts[0]["pattern"] == {"Regex": _WORDS}
            and parts[0]["behavior"] == "Removed" and parts[0]["invert"]):
        return "words"
    return None


def _ends(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Per byte: a letter up to U+023F ends here; no white space ends here; part of any other
    non-ASCII character (None without one)."""
    letter, shown, high = ((kinds & kind).astype(bool) for kind in (_LETTER, _SHOWN, _HIGH))
    if not high.any():
        return letter, shown, None
    one, two = np.zeros_like(data), np.zeros_like(data)
    one[1:], two[2:] = data[:-1], data[:-2]
    # without the signs of multiplication and division, and the letter whose small form ends with a mark
    latin = high & (one >= 0xC3) & (one <= 0xC8) & ~((one == 0xC3) & ((data == 0x97) | (data == 0xB7))) & ~(
        (one == 0xC4) & (data == 0xB0))
    blank = (one == 0xC2) | ((two == 0xE1) & (one == 0x9A)) | ((two == 0xE2) & (one & 0xFE == 0x80)) | (
        (two == 0xE3) & (one == 0x80))
    odd = high & ~latin
    odd[:-1] &= ~latin[1:]
    return letter | latin, shown | (high & ~blank), odd


class Units:
    """Units of some texts: their bytes ``data[starts:ends]`` and the first unit of every text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, words: bool):
        text = raw.tobytes()
        kinds = np.frombuffer(text.translate(_KINDS.tobytes()), np.uint8)
        letter, shown, odd = _ends(raw, kinds)
        space, other = (kinds & _SPACE).astype(bool), (kinds & _OTHER).astype(bool)
        begins = np.zeros(len(raw), bool)
        begins[1:] = (letter[:-1] & other[1:]) | (shown[:-1] & space[1:])
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        self.data, self.ends = raw, np.append(starts[1:], len(raw))
        self.first = np.searchsorted(starts, offsets)
        if words and len(starts):
            # capitals are made small only where no normal form depends on them
            self.data = np.frombuffer(bytearray(text.translate(LOWER.tobytes())), np.uint8)
            if odd is not None:
                self.data[1:][(raw[:-1] == 0xC3) & (raw[1:] < 0x9F) & (raw[1:] != 0x97)] += 32
                mixed = np.logical_or.reduceat(odd, starts)
                if mixed.any():
                    keep = np.repeat(mixed, self.ends - starts)
                    self.data[keep] = raw[keep]
            starts += space[starts]
            at = np.flatnonzero(space[np.minimum(starts, len(raw) - 1)] & (starts < self.ends))
            if len(at):
                solid = np.flatnonzero(~space)
                starts[at] = np.minimum(np.append(solid, len(raw))[np.searchsorted(solid, starts[at])], self.ends[at])
        self.starts = starts

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Three 64-bit words per unit, the last byte being its length; and which units are longer."""
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(32, np.uint8)])
        eight = np.ndarray(len(self.data) + 24, "<u8", padded, strides=(1,))
        out = np.empty((len(size), 3), np.uint64)
        for k in range(3):
            out[:, k] = eight[self.starts + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]
        out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
        return out, np.flatnonzero(size > WIDTH)


class Encoder:
    """Ids as the library's ``encode(text, add_special_tokens=False)`` gives them; with ``plain`` the
    special tokens' strings inside texts are text like any other."""

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = [part and json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.tokenizer.encode_special_tokens = plain
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.pattern = _pattern(*parts)
        self.added = [t.content.encode() for t in added]
        # no unit of a text without an added token may hold one
        for t in added:
            one = np.frombuffer(t.content.encode(), np.uint8)
            if (t.normalized or t.lstrip or t.rstrip or t.single_word
                    or Units(one, np.array([0, len(one)]), False).first[-1] < 2):
                self.pattern = None
        # the model alone, for words of which the arrays give the pre-tokens
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.tokenizer.get_vocab_size()
        # ids need no more than 16 bits in a small vocabulary
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        # tokens that open (or close) a word show where the words of a joined text begin
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.closes = any(x.endswith("</w>") for x in names)
        self.edge = np.array([x.endswith("</w>") if self.closes else x.startswith("Ġ") for x in names])
        self.most = REMEMBERED
        self._forget()

    def _forget(self) -> None:
        self.noted = self.end = 0
        self.long: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, self.kind)
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.keys = np.zeros((1 << 12, 3), np.uint64)
        self.slots = np.full(1 << 14, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        folded = keys[:, 0] ^ keys[:, 1] * np.uint64(0x9FB21C651E98DF25) ^ keys[:, 2] * np.uint64(0xD6E8FEB86659FD93)
        return (mix(folded) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Number of every key, -1 of an unknown one."""
        out = np.full(len(keys), -1, np.int64)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            number = self.slots[slot]
            used = number >= 0
            if not used.all():
                at, slot, number = at[used], slot[used], number[used]
            there, here = self.keys.take(number, 0), keys if len(at) == len(keys) else keys.take(at, 0)
            same = (there[:, 0] == here[:, 0]) & (there[:, 1] == here[:, 1]) & (there[:, 2] == here[:, 2])
            out[at[same]] = number[same]
            at, slot = at[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _insert(self, numbers: np.ndarray) -> None:
        """Put distinct keys that are not in the table into it."""
        slot = self._slot(self.keys[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _room(self, more: int) -> np.ndarray:
        """Numbers for as many new units."""
        while self.noted + more > len(self.counts):
            self.starts, self.counts, self.keys = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.keys))
            self.slots = np.full(2 * len(self.slots), -1, np.int32)
            short = np.arange(self.noted)
            self._insert(short[self.keys[:self.noted, 2] > 0])
        self.noted += more
        return np.arange(self.noted - more, self.noted)

    def _learn(self, units: list[bytes], numbers: np.ndarray) -> None:
        """Encode new units one by one."""
        for low in range(0, len(units), LEARNT):
            some = [u.decode() for u in units[low:low + LEARNT]]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._store(numbers[low:low + LEARNT], lists)

    def _learn_rows(self, rows: np.ndarray, numbers: np.ndarray) -> None:
        """Encode new units given as keys: words joined, straight by the model; others one by one."""
        size = rows[:, WIDTH].astype(np.int64)
        pure = np.flatnonzero(self._pure(rows, size))
        signs = _SIGNS[rows[pure]]
        signs[np.arange(len(pure)), size[pure]] = 32
        flat = signs[np.arange(WIDTH + 1) <= size[pure, None]]
        ends, missed = np.cumsum(size[pure] + 1), []
        for low in range(0, len(pure), JOINED * LEARNT):
            cuts = range(low, min(len(pure), low + JOINED * LEARNT), JOINED)
            groups = [np.arange(i, min(i + JOINED, cuts.stop)) for i in cuts]
            found = self.bare.encode_batch_fast(
                [flat[ends[g[0]] - size[pure[g[0]]] - 1:ends[g[-1]] - 1].tobytes().decode("utf-32-le") for g in groups],
                add_special_tokens=False)
            for group, one in zip(groups, found):
                ids = np.array(one.ids, self.kind)
                edges = np.flatnonzero(self.edge[ids])
                if len(edges) != len(group):
                    missed.append(pure[group])
                    continue
                edges = np.concatenate([[0], edges + 1]) if self.closes else np.append(edges, len(ids))
                self._keep(numbers[pure[group]], np.diff(edges), ids)
        single = np.concatenate([np.setdiff1d(np.arange(len(rows)), pure), *missed])
        self._learn([rows[i, :size[i]].tobytes() for i in single], numbers[single])

    def _pure(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys that are a word of letters, small ones where the tokenizer makes them so, after one blank
        where blanks are kept."""
        inside = np.arange(WIDTH + 1) < size[:, None]
        lead = (rows >= 0xC3) & (rows <= (0xC3 if self.pattern == "words" else 0xC8))
        sign = ((rows == 0x97) | (rows == 0xB7)) & np.roll(rows == 0xC3, 1, 1)
        good = _IS_LETTER[rows] | lead | (rows >= 128) & np.roll(lead, 1, 1) & ~sign
        if self.pattern == "words":
            capital = (rows < 0x9F) & np.roll(lead, 1, 1)
            return (size > 0) & (good & ~capital & ((rows < 65) | (rows > 90)) | ~inside).all(1)
        good[:, 0] = rows[:, 0] == 32
        return (size > 1) & (good | ~inside).all(1)

    def _store(self, numbers: np.ndarray, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self._keep(numbers, counts, np.fromiter(chain.from_iterable(lists), self.kind, int(counts.sum())))

    def _keep(self, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Keep the ids of units that follow each other; the flat array doubles when full."""
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.end:self.end + len(ids)] = ids
        self.counts[numbers], self.starts[numbers] = counts, self.end + np.cumsum(counts) - counts
        self.end += len(ids)

    def _numbers(self, units: Units) -> np.ndarray:
        """Number of every unit; new ones are learnt."""
        keys, longer = units.keys()
        keys[longer] = 0  # the key of no unit but the empty one, whose number is replaced below
        out = self._find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            rows, back = np.unique(np.ascontiguousarray(keys[new]).view("V24").ravel(), return_inverse=True)
            numbers = self._room(len(rows))
            self.keys[numbers] = rows.view(np.uint64).reshape(-1, 3)
            self._insert(numbers)
            out[new] = numbers[back]
            self._learn_rows(rows.view(np.uint8).reshape(-1, WIDTH + 1), numbers)
        if len(longer):
            texts = [units.data[a:b].tobytes() for a, b in zip(units.starts[longer], units.ends[longer])]
            unknown = list(dict.fromkeys(t for t in texts if t not in self.long))
            numbers = self._room(len(unknown))
            self.long.update(zip(unknown, numbers.tolist()))
            self._learn(unknown, numbers)
            out[longer] = [self.long[t] for t in texts]
        return out

    def _take(self, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
        shift = np.repeat(self.starts[which] - (np.cumsum(counts) - counts), counts)
        return self.ids[shift + np.arange(len(shift))]

    def batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """One array of ids per text; a missing text has none."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        data, offsets = buffers(column)
        out, low = [], 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, side="right")) - 1)
            out += self._piece(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
            low = high
        return out

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw, spans = data.tobytes(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        whole = range(len(spans)) if self.pattern is None else [
            i for i, (a, b) in enumerate(spans) if any(x in raw[a:b] for x in self.added)] if any(
            x in raw for x in self.added) else []
        out = [np.zeros(0, np.uint32)] * len(spans)
        if self.pattern is not None and len(data):
            if self.noted > self.most or self.end > HELD_IDS:
                self._forget()
            units = Units(data, offsets, self.pattern == "words")
            which = self._numbers(units)
            counts = self.counts[which].astype(np.int64)
            ids = self._take(which, counts).astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(counts)])[units.first].tolist()
            out = [ids[a:b] for a, b in zip(at, at[1:])]
        for i in whole:
            text = raw[slice(*spans[i])].decode()
            out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


#: One encoder per Python worker, tokenizer and treatment of special tokens.
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def shared(path: str, plain: bool = False) -> Encoder:
    """The encoder of this Python worker, with all it has learnt in earlier tasks."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]
