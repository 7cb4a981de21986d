"""Exact tokenisation with public tokenizer files, word by word, on whole Arrow arrays.

Both supported tokenizers split a text into pieces before any merge, and a piece never reaches over the places where texts are cut
here.  So the ids of a text are those of its words one after another, and every distinct word is encoded once: words are found and
made distinct by array operations, the library encodes those that are new, and the ids are put together by one gather.  New words of
Latin letters go to the library's model alone, already normalised and written as its bytes' letters.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes (about) of the pieces that an encoder remembers, in two generations.
CACHE_BYTES = 48 << 20
#: Bytes of text read together (a longer text stands alone) and words looked up together.
SLICE_BYTES, SLICE_WORDS = 2 << 20, 1 << 18
#: Code points that row-wise readers handle together.
SLICE_CHARS = 1_000_000
#: New words encoded as one text.
JOINED = 256
#: Letters for bytes as both kinds of files write them: printable bytes stand for themselves, others for what follows U+00FF; but the
#: space stays, as it parts words here.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = np.zeros(256, "<u2")
BYTE_LETTERS[_PRINTED] = _PRINTED
BYTE_LETTERS[[b for b in range(256) if b not in _PRINTED]] = np.arange(256, 512 - len(_PRINTED))
BYTE_LETTERS[32] = 32
#: Words of letters below U+0250, but for U+0130.
LATIN = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+$"

#: ASCII punctuation but for the apostrophe, which begins contractions.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The characters of the White_Space property.
SPACES = "\t\n\v\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[ord(c) for c in SPACES if ord(c) < 128]] = True
_WIDE = [c.encode() for c in SPACES if ord(c) >= 128]

#: How the two kinds of files part a text, as their JSON says it.
SPACED = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
UNSPACED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_tokenizers: dict = {}


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class _Pieces:
    """Ids of pieces, in one flat array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.ids = self.bytes = 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        return a if need <= len(a) else np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)])

    def add(self, keys: list[str], flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers that these pieces get."""
        n, ids = self.n + len(keys), self.ids + len(flat)
        self.flat, self.start, self.size = self._room(self.flat, ids), self._room(self.start, n), self._room(self.size, n)
        self.flat[self.ids : ids], self.size[self.n : n], self.start[self.n : n] = flat, size, self.ids + starts(size)
        self.number.update(zip(keys, range(self.n, n), strict=True))
        self.bytes += sum(map(len, keys)) + 170 * len(keys) + 4 * len(flat)
        self.n, self.ids = n, ids
        return np.arange(n - len(keys), n)


class Encoder:
    """Token ids of texts, as the library gives them with add_special_tokens=False.

    The strings of special tokens in a text are those tokens, as in a plain call of the library; with special_as_text they are
    ordinary text.  Files that part texts in another way than the two kinds known here are read text by text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        if path not in _tokenizers:  # what the file says, once for each worker process
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            spaced, added = {k: said.get(k) for k in SPACED} == SPACED, said.get("added_tokens") or []
            known = spaced or {k: said.get(k) for k in SPACED} == UNSPACED and said["model"].get("end_of_word_suffix") == "</w>"
            plain = all(t.get("special") and not (t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
            vocabulary = said["model"]["vocab"] if known else {}
            marked = np.zeros(max(list(vocabulary.values()) + [t["id"] for t in added], default=-1) + 1, bool)  # tokens that begin (spaced) or end a word
            marked[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if spaced else t.endswith("</w>"))]] = True
            tokenizer = Tokenizer.from_file(path)
            bare = Tokenizer(tokenizer.model)  # the same model, not a copy
            bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            _tokenizers[path] = tokenizer, bare, spaced, known and plain, [t["content"] for t in added], marked
        self.tokenizer, self.bare, self.spaced, self.known, added, self.marked = _tokenizers[path]
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else added
        self.new, self.old = _Pieces(), _Pieces()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has) of an Arrow array of strings; null is empty."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in byte_slices(texts):
            got, size = self._slice(texts.slice(lo, hi - lo))
            flat.append(got)
            sizes.append(size)
        return np.concatenate(flat), np.concatenate(sizes)

    def _slice(self, texts):
        import pyarrow.compute as pc

        if not self.known:
            parts = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)
        at, data = text_bytes(texts)
        cut = self._cuts(data, at)
        flat, counts = [], []
        for lo in range(0, len(cut), SLICE_WORDS):
            part = np.append(cut[lo : lo + SLICE_WORDS], cut[lo + SLICE_WORDS] if lo + SLICE_WORDS < len(cut) else len(data))
            got, count = self._words(data, part)
            flat.append(got)
            counts.append(count)
        got, count = np.concatenate(flat or [np.zeros(0, np.uint32)]), np.concatenate(counts or [np.zeros(0, np.int64)])
        upto = np.r_[0, np.cumsum(count)][np.searchsorted(cut, at)]
        size = np.diff(upto)
        odd = [pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special]
        if any(x.any() for x in odd):
            parts = np.split(got, upto[1:-1])
            for i in np.flatnonzero(np.logical_or.reduce(odd)).tolist():
                parts[i] = self.whole(texts[i].as_py())
                size[i] = len(parts[i])
            got = np.concatenate(parts)
        return got, size

    def _cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where words begin.  White space goes with the word behind it; a spaced tokenizer gives it only one space, and what is
        before that in a run is a piece of its own, as is any other white space before a word."""
        n = len(data)
        space = _SPACE_BYTE[data]
        for c in _WIDE if n and data.max() > 0xC1 else ():
            hit = data[: n - len(c) + 1] == c[0]
            for k in range(1, len(c)):
                if hit.any():
                    hit = hit & (data[k : n - len(c) + 1 + k] == c[k])
            for k in range(len(c) if hit.any() else 0):
                space[np.flatnonzero(hit) + k] = True
        first = np.zeros(n + 1, bool)
        first[at] = True
        cut = first[:n] | (space & ~np.r_[False, space[:-1]])
        if self.spaced:
            last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])  # last byte of white space before a word
            byte = data[last]
            cut[last[byte == 32]] = True
            other, byte = last[byte != 32], byte[byte != 32]
            cut[other + 1] = True
            cut[other - np.where(byte < 128, 0, np.where(data[other - 1] == 0xC2, 1, 2))] = True
        return np.flatnonzero(cut)

    def _words(self, data: np.ndarray, cut: np.ndarray):
        """(ids, how many of each) of the words data[cut[i] : cut[i + 1]]."""
        import pyarrow as pa
        import pyarrow.compute as pc

        base = int(cut[0])
        words = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - base).astype(np.int32)), pa.py_buffer(data[base : int(cut[-1])])])
        found = words.dictionary_encode()
        words = found.dictionary.cast(pa.string())
        if not self.spaced:
            words = pc.utf8_ltrim(words, characters=SPACES)
            words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
        # a word's end and the ASCII punctuation behind it (none of it an apostrophe) are always parted
        body = pc.utf8_rtrim(words, characters=PUNCTUATION)
        body = pc.if_else(pc.match_substring_regex(body, "[0-9A-Za-zÀ-ÖØ-öø-ÿ]$"), body, words)
        at, letters = text_bytes(words)
        size, held = np.diff(at), np.diff(text_bytes(body)[0])
        tails = np.flatnonzero(size > held)
        tail = pa.StringArray.from_buffers(len(tails), pa.py_buffer(np.r_[0, np.cumsum((size - held)[tails])].astype(np.int32)), pa.py_buffer(gather(letters, (at[:-1] + held)[tails], (size - held)[tails])))
        pieces = pa.concat_arrays([body, tail]).dictionary_encode()
        number = self._numbers(pieces.dictionary)[pieces.indices.to_numpy()]
        two = np.full((len(words), 2), -1)
        two[:, 0], two[tails, 1] = number[: len(words)], number[len(words) :]
        size = np.where(two < 0, 0, self.new.size[two])
        flat = gather(self.new.flat, self.new.start[two].ravel(), size.ravel())
        size = size.sum(1)
        word = found.indices.to_numpy()
        return gather(flat, starts(size)[word], size[word]), size[word]

    def _numbers(self, pieces) -> np.ndarray:
        """Where the ids of these distinct pieces stand among the new ones; pieces not seen before are encoded."""
        if self.new.bytes > CACHE_BYTES // 2:
            self.new, self.old = _Pieces(), self.new
        keys = pieces.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.new.number.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        lost = np.flatnonzero(number < 0)
        missing = [keys[i] for i in lost.tolist()]
        before = np.fromiter(map(self.old.number.get, missing, itertools.repeat(-1)), np.int64, len(missing))
        known, at = lost[before >= 0], before[before >= 0]
        number[known] = self.new.add([keys[i] for i in known.tolist()], gather(self.old.flat, self.old.start[at], self.old.size[at]), self.old.size[at])
        lost = lost[before < 0]
        number[lost] = self._learn(pieces.take(lost))
        return number

    def _learn(self, pieces) -> np.ndarray:
        """Where the ids of these pieces, encoded now, stand.

        Words of Latin letters are encoded many as one text, cut again where the tokens' own marks say; others one by one.
        """
        import pyarrow.compute as pc

        keys = pieces.to_numpy(zero_copy_only=False)
        latin = pc.match_substring_regex(pieces, ("^ " if self.spaced else "^") + LATIN).to_numpy(zero_copy_only=False)
        fit = np.flatnonzero(latin)
        groups = [fit[i : i + JOINED] for i in range(0, len(fit), JOINED)]
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for group, got in zip(groups, self._joined([keys[g].tolist() for g in groups]), strict=True):
            ids = np.array(got.ids, np.uint32)
            marks = np.flatnonzero(self.marked[ids])
            if len(marks) != len(group) or marks[0 if self.spaced else -1] != (0 if self.spaced else len(ids) - 1):
                latin[group] = False
            else:
                flat.append(ids)
                sizes.append(np.diff(np.r_[marks, len(ids)] if self.spaced else np.r_[-1, marks]))
        number = np.empty(len(keys), np.int64)
        number[latin] = self.new.add(keys[latin].tolist(), np.concatenate(flat), np.concatenate(sizes))
        rest = keys[~latin].tolist()
        got = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        size = np.array(list(map(len, got)), np.int64)
        number[~latin] = self.new.add(rest, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum())), size)
        return number

    def _joined(self, groups: list[list[str]]) -> list:
        """Encodings of each group's words as one text.

        Letters below U+0250 are composed and, but for U+0130, one letter in lower case too; words of them are never parted, and a
        space before them is one more letter of a spaced file.  So all that a file does before the model is done here.
        """
        texts = (_lettered("".join(g)).replace(" ", " Ġ") if self.spaced else _lettered(" ".join(g).lower()) for g in groups)
        return self.bare.encode_batch_fast(list(texts), add_special_tokens=False)


def _lettered(words: str) -> str:
    """Words with their bytes as BYTE_LETTERS."""
    return words if words.isascii() else BYTE_LETTERS[np.frombuffer(words.encode(), np.uint8)].tobytes().decode("utf-16-le")


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an Arrow array of strings without nulls."""
    import pyarrow as pa

    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at - at[0], (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]


def byte_slices(texts, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes; a longer text stands alone."""
    at, _ = text_bytes(texts)
    lo, most = 0, most or SLICE_BYTES
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def with_end(ids: np.ndarray, size: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, each with end_id behind."""
    return (ids, size) if end_id is None else (np.insert(ids, np.cumsum(size), end_id), size + 1)


def text_slices(keys: Iterable, texts: Iterable) -> Iterator[tuple[list, list[str]]]:
    """Rows in slices of bounded text size; null texts are empty; a longer text stands alone."""
    ks, ts, n = [], [], 0
    for k, t in zip(keys, texts, strict=True):
        t = t or ""
        if n and n + len(t) > SLICE_CHARS:
            yield ks, ts
            ks, ts, n = [], [], 0
        ks.append(k)
        ts.append(t)
        n += len(t) + 16
    if ks:
        yield ks, ts
