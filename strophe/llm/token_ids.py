"""Token ids of whole texts with the tokenizers library, each distinct unit encoded once per worker.

A text is cut before each white space that follows something else. The
pre-tokenizers of the vocabularies used here end a piece at each such cut, and no
character composes across it, so the ids of a text are those of its units in
turn. They also end a piece after a letter that an ASCII sign or digit follows
(unless the letter folds to a letter and a mark), so a new unit like ``word.`` is
put together from its parts. Parts not met before are encoded together: plain words with spaces between them, told apart by the
vocabulary's marks of word starts or ends; others with its end-of-text token between.
A vocabulary file with another normalizer or pre-tokenizer than those known here
has whole texts encoded by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from unicodedata import normalize

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

# The code points of Unicode's White_Space property.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_BARE = ""  # marks a unit without a space before it; texts that hold it are cut by _UNIT
_TWICE = re.compile(f"[{_SPACE}][{_SPACE}]")

# A unit's line break, its word, and what follows; the last starts with an ASCII sign or digit.
_PARTS = re.compile(f"({_BARE}\n(?=[^\\W\\d_]))?({_BARE}?[^\\W\\d_]+)?((?=[!-@\\[-`{{-~]).+)?", re.DOTALL)

_BREAK = "<|endoftext|>"
_WORD_START = "Ġ"  # how byte-level vocabularies write a space

MEMO_UNITS = 600_000  # about 120 MB of a worker
WINDOW = 1 << 18  # characters cut into units at once

# The parts of a vocabulary file for which a cut before white space changes no id.
_PLAIN_START = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuts_hold(settings: dict) -> bool:
    """Whether a vocabulary file's normalizer and pre-tokenizer are among those known here."""
    if any(settings.get(k) for k in ("truncation", "padding")) or settings["model"].get("type", "BPE") != "BPE":
        return False
    first, then = settings.get("normalizer"), settings.get("pre_tokenizer") or {}
    if first is None:
        return then == _PLAIN_START
    steps = then.get("pretokenizers") or [{}]
    return (
        first == {"type": "Sequence", "normalizers": _LOWER}
        and steps[0] == {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
        and steps[1:] == [{**_PLAIN_START, "use_regex": False}]
    )


def _units(text: str) -> list[str]:
    """Keys of the units of a text: the unit without its leading space, or marked as bare."""
    if _BARE in text or text[:1].isspace() or text[-1:].isspace() or _TWICE.search(text):
        return [_BARE + u for u in _UNIT.findall(text)]
    return (_BARE + text.replace("\n", f" {_BARE}\n")).split(" ")


def _unit(key: str) -> str:
    return key[1:] if key[:1] == _BARE else " " + key


def _steady(key: str) -> bool:
    """Whether composing and lower-casing turn no letter of a unit into a letter and a mark."""
    return all(c.isalpha() for c in normalize("NFC", "".join(filter(str.isalpha, key))).lower())


def _windows(text: str) -> Iterator[str]:
    """The text in parts of bounded length that end where units end (one unit may be longer)."""
    start = 0
    while len(text) - start > WINDOW:
        held = _CUT.search(text, start + WINDOW)
        if held is None:
            break
        yield text[start : held.start() + 1]
        start = held.start() + 1
    yield text[start:] if start else text


_CUT = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")


class _Numbers(dict):
    """Numbers keys as they are first asked for, and lists those not learned yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Encoder:
    """Encodes texts; remembers the ids of the first ``memo_units`` units or so that it meets.

    The strings of the vocabulary's special tokens give those tokens' ids, or with
    ``specials_as_text`` the ids of ordinary text.
    """

    def __init__(self, path: str, memo_units: int = MEMO_UNITS, specials_as_text: bool = False):
        from tokenizers import Tokenizer

        self.memo_units, self.specials_as_text = memo_units, specials_as_text
        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        special = [t["content"] for t in settings.get("added_tokens", [])]
        self.by_units = cuts_hold(settings) and all(t.startswith("<|") and not re.search(r"\s", t) for t in special)
        self.stop = self.tokenizer.token_to_id(_BREAK)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.by_ends = bool(suffix)
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that end, or else start, a word
        for token, number in self.tokenizer.get_vocab().items():
            self.edge[number] = token.endswith(suffix) if suffix else token.startswith(_WORD_START)
        self.at = _Numbers()
        self.size = np.zeros(1 << 12, np.int64)
        self.begin = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _fresh(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after the other, and how many each has."""
        if self.stop is None or any("<|" in u for u in new):
            self.tokenizer.encode_special_tokens = self.specials_as_text
            got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.tokenizer.encode_special_tokens = False
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter((i for ids in got for i in ids), np.uint32, int(sizes.sum())), sizes
        joined = self.tokenizer.encode_batch_fast([_BREAK.join(new)], add_special_tokens=False)[0]
        ids = np.array(joined.ids, np.uint32)
        cuts = np.flatnonzero(ids == self.stop)
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return np.delete(ids, cuts), sizes

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_fresh`` for words of letters after a space; None if their ids cannot be told apart."""
        ids = np.array(self.tokenizer.encode(" " + " ".join(words), add_special_tokens=False).ids, np.uint32)
        edges = np.flatnonzero(self.edge[ids])
        # Each word has an edge at least, so as many edges as words means one for each.
        if len(edges) != len(words) or edges[-1 if self.by_ends else 0] != (len(ids) - 1 if self.by_ends else 0):
            return None
        return ids, np.diff(edges, prepend=-1) if self.by_ends else np.diff(edges, append=len(ids))

    def _keep(self, keys: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of keys that have their numbers."""
        while len(self.at) > len(self.size):
            self.size, self.begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self.size, self.begin))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        number = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        self.size[number] = sizes
        self.begin[number] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def _joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered keys one after the other, and where each key's end."""
        size = self.size[number]
        stop = np.cumsum(size)
        return self.ids[np.repeat(self.begin[number] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)], stop

    def _learn(self, new: list[str]) -> list[str]:
        """Learn new keys and those of their parts; returns all keys learned."""
        simple, whole, parts, ends = [], [], [], []
        for key in new:
            held = _PARTS.fullmatch(key)
            found = [p for p in held.groups() if p] if held else []
            if len(found) < 2 or not (key.isascii() or _steady(key)):
                simple.append(key)
                continue
            whole.append(key)
            for at, part in enumerate(found):
                follows = at and part[0] != _BARE
                parts.append(self.at[_BARE + part if follows else part])
            ends.append(len(parts))
        simple += self.at.new
        every, self.at.new = new + self.at.new, []
        words = [k for k in simple if k.isalpha()]
        got = self._plain(words) if words else None
        if got is not None:
            self._keep(words, *got)
            simple = [k for k in simple if not k.isalpha()]
        if simple:
            self._keep(simple, *self._fresh([_unit(k) for k in simple]))
        if whole:
            flat, stop = self._joined(np.array(parts, np.int64))
            self._keep(whole, flat, np.diff(stop[np.array(ends) - 1], prepend=0))
        return every

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = self.specials_as_text
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_units(t) if t else [] for t in texts]
        keys = [k for units in cut for k in units]
        used, full = self.used, len(self.at) >= self.memo_units
        place = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        new, self.at.new = self.at.new, []
        if new:
            new = self._learn(new)
        if full:  # the units met first, the frequent ones among them, stay
            self.used = used
            for key in new:
                del self.at[key]
        ids, stop = self._joined(place)
        ends = np.cumsum([len(units) for units in cut])[:-1]
        return np.split(ids, np.concatenate([[0], stop])[ends])

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a bounded number of characters is cut at once."""
        group: list[str] = []
        held = 0
        if not self.by_units:
            for text in texts:
                yield self._whole([text])[0]
            return
        for text in texts:
            if len(text) > WINDOW:
                if group:
                    yield from self._group(group)
                group, held = [], 0
                yield np.concatenate([self._group([part])[0] for part in _windows(text)])
                continue
            group.append(text)
            held += len(text)
            if held >= WINDOW:
                yield from self._group(group)
                group, held = [], 0
        if group:
            yield from self._group(group)


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def release() -> None:
    """Forget the worker's encoder, for tasks that encode nothing."""
    _ENCODERS.clear()


def encoder(path: str, memo_units: int = MEMO_UNITS, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    key = path, memo_units, specials_as_text
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
