"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

A byte-level pre-tokenizer always starts a new piece at a space that is followed
by a character other than white space, so the words between such spaces can be
encoded one by one and their ids joined: the ids are those of the whole text.
Arrow splits a batch into words and finds the distinct ones; words not seen
before are cut into pieces by the pre-tokenizer's rule, and the library's model
encodes the pieces not seen before.  Texts with white space after a space, texts
that hold the string of an added token (which the library takes for that token),
words that hold more than Latin letters, digits and ASCII signs, and tokenizers of
another kind are given to the library whole.

What is remembered of words and pieces is bounded in number and in ids, and dropped
when the bound is reached: a worker's memory does not grow with what it has read.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARK = "\x01"  # stands between words
#: The byte-level rule for words of Latin letters, digits and ASCII signs without white space but single line ends.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|[ \n]|\x01")
ODD = re.compile(r"[^\x01\n -~À-ÖØ-öø-ɏ]|\n\n").search


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte; bytes without a visible one come after U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + n) for n, b in enumerate(others)}


LETTERS = {b: x for b, x in _byte_letters().items() if chr(b) != MARK}


class _Store:
    """Id sequences one after another in one array."""

    def __init__(self):
        self.count = self.used = 0
        self.starts = np.zeros(1024, dtype=np.int64)
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.uint32)

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, m = self.count + len(sizes), self.used + len(flat)
        if n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(max(n, len(x)), dtype=np.int64)]) for x in (self.starts, self.sizes))
        if m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(m, len(self.ids)), dtype=np.uint32)])
        self.starts[self.count : n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : n] = sizes
        self.ids[self.used : m] = flat
        self.count, self.used = n, m

    def gather(self, which: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``which`` one after another, and how many fall to each group of so many members."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(groups)])]
        return ids, np.diff(bounds)


class _Index(dict):
    """Gives each new word the next number and remembers it as still to be encoded."""

    def __init__(self, store: _Store, waiting: list, lead: str = ""):
        super().__init__()
        self.store, self.waiting, self.lead = store, waiting, lead

    def __missing__(self, word: str) -> int:
        number = self[word] = self.store.count + len(self.waiting)
        self.waiting.append(self.lead + word)
        return number


class Encoder:
    def __init__(self, spec: str, max_words: int = 260_000, max_ids: int = 1_900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.units = Tokenizer(self.tokenizer.model)  # takes pieces as they are
        form = json.loads(spec)
        pre = form.get("pre_tokenizer") or {}
        self.by_word = (
            form.get("normalizer") is None
            and form.get("post_processor") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and isinstance(form["model"].get("vocab"), dict)
            and not form["model"].get("unk_token")
        )
        self.vocabulary = self.tokenizer.get_vocab_size()
        added = [x["content"] for x in form.get("added_tokens") or [] if x["content"]]
        self.by_word = self.by_word and len(added) <= 500
        self.whole = "|".join([SPACES, *map(re.escape, added)])  # texts that are not cut into words
        if self.by_word:
            self.letters = np.zeros(max(form["model"]["vocab"].values()) + 1, dtype=np.int64)
            for x, i in form["model"]["vocab"].items():
                self.letters[i] = len(x)
        self.max_words, self.max_ids = max_words, max_ids
        self.new_words: list[str] = []
        self.new_pieces: list[str] = []
        self._clear_words()
        self._clear_pieces()

    def _clear_words(self) -> None:
        self.words = _Store()
        self.first, self.rest = _Index(self.words, self.new_words), _Index(self.words, self.new_words, " ")

    def _clear_pieces(self) -> None:
        self.pieces = _Store()
        self.piece = _Index(self.pieces, self.new_pieces)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn_pieces(self) -> None:
        for at in range(0, len(self.new_pieces), 50_000):
            part = self.new_pieces[at : at + 50_000]
            units = MARK.join(part).encode("utf-8").decode("latin-1").translate(LETTERS).split(MARK)
            found = self.units.encode_batch_fast([units[i : i + 500] for i in range(0, len(units), 500)], is_pretokenized=True, add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found])
            ends = np.searchsorted(np.cumsum(self.letters[flat]), np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units))), side="right")
            self.pieces.add(np.diff(ends, prepend=0), flat)
        self.new_pieces.clear()

    def _learn(self) -> None:
        """The new words: by their pieces, most of which the cache has, or whole."""
        words, whole = self.new_words, []
        joined = MARK.join(words) + MARK
        if ODD(joined) or joined.count(MARK) != len(words):
            whole = [k for k, x in enumerate(words) if MARK in x or ODD(x)]
            texts = [words[k] for k in whole]
            for k in whole:
                words[k] = ""
            joined = MARK.join(words) + MARK
        found = np.array(PIECES.findall(joined), dtype=object)
        marks = found == MARK
        groups = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        which = np.array(list(map(self.piece.__getitem__, found[~marks])), dtype=np.int64)
        self._learn_pieces()
        ids, sizes = self.pieces.gather(which, groups)
        if whole:
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for k, x in zip(whole, self._whole(texts)):
                each[k] = x
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        self.words.add(sizes, ids)
        words.clear()
        if self.pieces.count > self.max_words or self.pieces.used > self.max_ids:
            self._clear_pieces()

    def encode(self, texts, block: int = 2_000_000) -> list[np.ndarray]:
        """Ids of each text (NULL: none).  ``texts``: strings or an Arrow array of them."""
        texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
        sizes = pc.fill_null(pc.binary_length(texts), 0)
        easy = pc.invert(pc.fill_null(pc.match_substring_regex(texts, self.whole), False)) if self.by_word else pa.array([False] * len(texts), pa.bool_())
        easy = easy.to_numpy(zero_copy_only=False)
        sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(easy & (sizes > 0))
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // block)) + 1):
            if len(part):
                self._block(part, pc.split_pattern(texts.take(pa.array(part)), " "), out)
        slow = np.flatnonzero(~easy & (sizes > 0))
        for at in range(0, len(slow), 64):
            for k, ids in zip(slow[at : at + 64], self._whole(texts.take(pa.array(slow[at : at + 64])).to_pylist())):
                out[k] = ids
        return out

    def _block(self, rows: np.ndarray, split: pa.ListArray, out: list[np.ndarray]) -> None:
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        groups = np.diff(split.offsets.to_numpy())
        heads = np.cumsum(groups) - groups
        which = np.array(list(map(self.rest.__getitem__, distinct)), dtype=np.int64)[codes]
        which[heads] = [self.first[distinct[k]] for k in codes[heads]]
        if self.new_words:
            self._learn()
        ids, sizes = self.words.gather(which, groups)
        for k, part in zip(rows, np.split(ids, np.cumsum(sizes)[:-1])):
            out[k] = part
        if self.words.count > self.max_words or self.words.used > self.max_ids:
            self._clear_words()


_ENCODERS: dict[int, Encoder] = {}


def encoder(spec: str, cached_words: int = 260_000) -> Encoder:
    """This process's encoder for a tokenizer file's content; tasks of one worker share it."""
    key = hash((spec, cached_words))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, cached_words, 8 * cached_words)
    return _ENCODERS[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
