"""Token ids of whole texts, by the ``tokenizers`` library, with a store of stems in each Python worker.

A byte-level BPE never joins what its pre-tokeniser has split. That one always splits before a single blank that a
non-blank follows, around each of one or two line feeds before a non-blank, and between a letter or digit and the marks
after it. So a text whose white space is such blanks and line feeds is cut there into pieces (a word with its blank, or
a line feed with the word behind it), and pieces into stems and trailing marks. Arrow cuts the texts and tells a batch's
distinct stems; those that the worker has not met are encoded by the library, and the document's ids are those of its
stems and marks one after the other, gathered by Arrow. Any other text, or one that holds the string of an added token,
is encoded whole. ``tests/llm`` holds both against the library's own encoding of whole texts.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCAB_FILE = "byte_bpe_50k.json"
#: Distinct stems that a worker keeps before it starts anew; longer ones are not kept.
STORED, LONGEST = 700_000, 48
#: Marks that are taken off a word's end, and what a word must end with to stand without them.
MARKS, _STEM = ".,;:!?", "[A-Za-z0-9À-ÖØ-öø-ÿ]$"
_WORD = re.compile("[\n\0]?[A-Za-zÀ-ÖØ-öø-ÿ]*")

_ENCODERS: dict[tuple[str, bool, int], "Encoder"] = {}


def vocabulary(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCAB_FILE)


def encoder(path: str | None = None, plain: bool = False, stored: int = STORED) -> "Encoder":
    """This process's encoder for a vocabulary file; each executor's Python loads its own copy of the file. A ``plain``
    one takes the strings of added tokens as any other text, so that no text has an added token's id. At most
    ``stored`` stems are kept."""
    key = vocabulary(path), plain, stored
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def release() -> None:
    """Let go of this process's encoders and of the memory that Arrow keeps for later: for tasks that encode nothing, in
    workers that have encoded before and stay."""
    _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return dict(zip(printable, printable)) | {b: 256 + i for i, b in enumerate(others)}


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, path: str, plain: bool = False, stored: int = STORED):
        self.stored = stored
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.split, self.letters = self.library.model.tokenize, _byte_letters()
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if not (plain and t.special)]
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.letter_of = np.array([self.letters[b] for b in range(256)], "<u4")
        self._forget()

    def _forget(self) -> None:
        #: A stem's place in the store; marks, and stems at a text's start, have a zero character in front.
        self.places: dict[str, int] = {}
        self.packed, self.ends = bytearray(), array("i", [0])

    def whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def regular(self, text: str) -> bool:
        """Whether a text may be cut before its blanks and line feeds."""
        if self.feed is None or not text.replace("\n", "").isprintable() or any(a in text for a in self.added):
            return False
        return not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith((" ", "\n\n")))

    def _letters_of(self, texts: list[str]) -> list[str]:
        """Texts without line feeds as the library's BPE takes them: a letter for each byte."""
        raw = self.letter_of[np.frombuffer("\n".join(texts).encode(), np.uint8)].tobytes()
        return raw.decode("utf-32-le").split(chr(self.letters[10]))

    def _encode_stems(self, words: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stems without line feeds, and how many each has. Words of letters go to the library's BPE as they are;
        all others go through the library in one call, with line feeds between them, whose id no stem has."""
        ids, ends, split = [], [0], self.split
        for w in self._letters_of(words) if words else ():
            ids += [t.id for t in split(w)] if w else ()
            ends.append(len(ids))
        if not rest:
            return np.array(ids, self.dtype), np.diff(ends)
        others = np.array(self.library.encode_batch_fast(["\n".join(rest)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(others == self.feed)
        if len(cuts) != len(rest) - 1:
            raise ValueError("a stem has a line feed's id")
        sizes = np.diff(np.r_[-1, cuts, len(others)]) - 1
        return np.concatenate([np.array(ids, self.dtype), np.delete(others, cuts)]), np.concatenate([np.diff(ends), sizes])

    def _placed(self, stems: list[str]) -> tuple[np.ndarray, list[bytes]]:
        """Places of ``stems``; those from the store's end on are in the list, for this batch only."""
        got = np.fromiter(map(self.places.get, stems, repeat(-1)), np.int64, len(stems))
        new = np.flatnonzero(got < 0)
        if not len(new):
            return got, []
        names = list(map(stems.__getitem__, new.tolist()))
        word = np.fromiter(map(bool, map(_WORD.fullmatch, names)), bool, len(names))
        order = np.argsort(~word, kind="stable")
        names = list(map(names.__getitem__, order.tolist()))
        plain = [s[1:] if s[0] in "\n\0" else " " + s for s in names]
        ids, sizes = self._encode_stems(plain[: word.sum()], plain[word.sum() :])
        fed = np.fromiter((s[0] == "\n" for s in names), bool, len(names))
        if fed.any():
            ids, sizes = np.insert(ids, (np.cumsum(sizes) - sizes)[fed], self.feed), sizes + fed
        kept, late = np.fromiter(map(len, names), np.int64, len(names)) <= LONGEST, []
        if not kept.all():
            late = [i.tobytes() for i, k in zip(np.split(ids, np.cumsum(sizes)[:-1]), kept.tolist()) if not k]
            ids, sizes, names = ids[np.repeat(kept, sizes)], sizes[kept], [s for s, k in zip(names, kept.tolist()) if k]
        before = len(self.ends) - 1
        self.places.update(zip(names, range(before, before + len(names))))
        self.ends.frombytes((self.ends[-1] + np.cumsum(sizes * self.dtype.itemsize)).astype(np.int32).tobytes())
        self.packed += ids.tobytes()
        placed = np.cumsum(kept) - 1
        placed[~kept] = len(names) + np.arange(len(late))
        got[new[order]] = before + placed
        return got, late

    def encode_many(self, texts: list[str | None], end: bytes = b"") -> pa.Array:
        """The texts' ids, each with ``end`` behind, packed as little-endian integers of ``dtype``; a null or empty text
        has none. An Arrow array of binaries."""
        texts = [t or "" for t in texts]
        odd = [k for k, t in enumerate(texts) if not self.regular(t)]
        cut = [t.replace("\n", " \n") for t in texts]
        for k in odd:
            cut[k] = ""
        pieces = pc.split_pattern(pa.array(cut, pa.string()), " ")
        offsets, flat = pieces.offsets.to_numpy().astype(np.int64), pieces.values.dictionary_encode()
        codes = flat.indices.to_numpy().astype(np.int64)
        # The first piece of a text has no blank before it: it is a word of its own, marked by a zero character.
        heads = pa.array(["\0" + h for h in flat.dictionary.take(pa.array(codes[offsets[:-1]])).to_pylist()], pa.string()).dictionary_encode()
        codes[offsets[:-1]] = len(flat.dictionary) + heads.indices.to_numpy()
        words = pa.concat_arrays([flat.dictionary, heads.dictionary])
        short = pc.utf8_rtrim(words, MARKS)
        short = pc.if_else(pc.match_substring_regex(short, _STEM), short, words)
        stems = short.dictionary_encode()
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(short), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        tails, n_chars = _strings(words.take(pa.array(marked))), pc.utf8_length(short).to_numpy()[marked].tolist()
        tails = ["\0" + w[n:] for w, n in zip(tails, n_chars)]
        names = {t: k for k, t in enumerate(dict.fromkeys(tails))}
        keys = ["\0" if s == "" else s for s in _strings(stems.dictionary)] + list(names)
        if len(self.places) + len(keys) > self.stored:
            self._forget()
        places, extra = self._placed(keys)
        n_stems, stored = len(stems.dictionary), len(self.ends) - 1
        none, end_at = stored + len(extra), stored + len(extra) + 1
        extra += [b"", end, *map(self.whole, map(texts.__getitem__, odd))]
        tail_of = np.full(len(words), none)
        tail_of[marked] = places[[n_stems + names[t] for t in tails]]
        where = np.stack([places[stems.indices.to_numpy()][codes], tail_of[codes]], 1)
        where[offsets[odd], 0] = end_at + 1 + np.arange(len(odd))
        where = np.insert(where.reshape(-1), 2 * offsets[1:], end_at)
        sizes = np.fromiter(map(len, extra), np.int64, len(extra))
        ends = np.concatenate([np.frombuffer(self.ends, np.int32), (self.ends[-1] + np.cumsum(sizes)).astype(np.int32)])
        store = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(bytes(self.packed) + b"".join(extra))])
        out = store.take(pa.array(where))
        at = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1)[np.concatenate([[0], 2 * offsets[1:] + np.arange(1, len(texts) + 1)])]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), out.buffers()[2]])

    def encode_one(self, text: str | None) -> bytes:
        return self.encode_many([text])[0].as_py()


def as_u4(ids: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(ids, dtype).astype("<u4")
