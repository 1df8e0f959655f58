"""Token ids of whole texts with a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from arborscan.llm import buffers

#: Kinds of bytes. Spaces part words for the byte-level BPE; graphic characters are no spaces; marks are neither letters, digits nor the
#: apostrophe, which may start a contraction.
_SPACE, _GRAPHIC, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(4))
_SPACE[9:14] = _SPACE[32] = True
_GRAPHIC[33:127] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = ~_LETTER[33:127]
_MARK[48:58] = _MARK[ord("'")] = False

_REMEMBERED, _LONG, _ROW, _CHARACTERS = 100_000, 64, 256, 1 << 21
_ENCODERS: dict[int, Encoder] = {}


def pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of pieces whose ends are also ends of the byte-level BPE's own pieces: ids of a text are those of its pieces.

    The BPE's pattern looks ahead for spaces only and never back. A cut is certain between a
    character that is no space and a space, between a letter and a mark, and after a single line end before a
    graphic character. Of characters beyond ASCII only those of two bytes from U+00C0 on are known to be no spaces,
    and letters up to U+023F (but for two signs); others do not cut.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 1:
        last, lead = data[:-1], np.concatenate([data[:1], data[:-2]])
        double = (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
        sign = (lead == 0xC3) & ((last == 0x97) | (last == 0xB7))
        letter = _LETTER[last] | (double & (lead <= 0xC8) & ~sign)
        cut[1:] = (_SPACE[data[1:]] & (_GRAPHIC[last] | double)) | (_MARK[data[1:]] & letter)
        cut[1:] |= (last == 10) & _GRAPHIC[lead] & _GRAPHIC[data[1:]]
    cut[bounds[bounds < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes with the tokenizers library, each distinct piece once as long as it is remembered.

    The memory has two generations of at most ``_REMEMBERED`` short pieces and those of one step: when the younger is full
    it becomes the older, and pieces that are met again move on. Strings of special tokens in a
    text are ordinary text, as the files' own description has it: a document cannot smuggle in an end of text.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of every id: its name has one character for each
        self.width[list(vocabulary.values())] = [len(name) for name in vocabulary]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > _REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [known.get(p) or older.get(p) for p in distinct]
        new = [i for i, ids in enumerate(found) if ids is None]
        # words that start with a blank stay apart when they stand in a row
        words = [i for i in new if distinct[i][0] == " " and distinct[i][1:].isalnum()]
        rows = [words[k: k + _ROW] for k in range(0, len(words), _ROW)]
        for row, made in zip(rows, self.tokenizer.encode_batch_fast(["".join([distinct[i] for i in row]) for row in rows], add_special_tokens=False)):
            ids = np.array(made.ids, "<u4")
            stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(distinct[i].encode()) for i in row])) + 1
            body, start = ids.tobytes(), 0
            for i, stop in zip(row, (4 * stops).tolist()):
                found[i] = body[start:stop]
                start = stop
        new = [i for i in new if found[i] is None]
        for i, made in zip(new, self.tokenizer.encode_batch_fast([distinct[i] for i in new], add_special_tokens=False)):
            found[i] = array("I", made.ids).tobytes()
        known.update((p, ids) for p, ids in zip(distinct, found) if len(p) <= _LONG)
        return found

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text of a buffer."""
        if not len(data):
            yield from [b""] * (len(bounds) - 1)
            return
        starts = pieces(data, bounds)
        ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), ends, pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)
        bodies = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(bodies), "<u4")
        sizes = np.array([len(b) for b in bodies]) // 4
        size = sizes[number]
        after = np.cumsum(size)
        ids = flat[np.arange(after[-1]) + np.repeat((np.cumsum(sizes) - sizes)[number] - after + size, size)]
        places = np.append(0, after)[np.searchsorted(starts, bounds)]
        for low, high in zip(places[:-1], places[1:]):
            yield ids[low:high].tobytes()


def encoder(definition: str) -> Encoder:
    """The encoder of this worker process; workers are used again, so its memory lasts over tasks."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def encoded(texts: pa.Array, definition: str) -> Iterator[bytes]:
    """Ids of each text of a string column (null: empty), in order, some texts at a time so that memory stays bounded."""
    own = encoder(definition)
    for _, _, data, bounds in buffers.parts(texts, _CHARACTERS):
        yield from own.encode(data, bounds)


def definition(path: str) -> str:
    """The tokenizer file's text; jobs carry it to the workers, which need no file of their own."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def public(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
