"""Token ids of whole texts by a tokenizer file, each distinct piece between blanks encoded once."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a task remembers before it keeps only those of the slice at hand.
REMEMBERED = 200_000
#: UTF-8 bytes that are encoded together.
SLICE_BYTES = 4 << 20
#: The sign that stands for each byte in a byte-level vocabulary: itself if it is printable, else
#: one of those from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGNS = {b: chr(b) for b in _PRINTED}
_SIGNS |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _SIGNS)}
#: Marks that both vocabularies' patterns cut off a word before them.
_MARKS = ".,;:!?"
_OPEN: dict[tuple, Encoder] = {}


class Encoder:
    """Encodes columns of texts as ``tokenizers`` does, special tokens' strings as ordinary text.

    A text is cut at its single blanks and line feeds, the distinct pieces of a slice of texts
    are encoded once, and the ids are put together by position. ``keeps_space`` tells that the
    vocabulary joins a blank to the word behind it: then a piece carries its blank, and a text
    in which white space meets white space, or starts or ends it, is encoded whole, because
    there a cut could change the ids. With ``leading`` every text stands behind one more blank.
    """

    leading = False

    def __init__(self, path: str, keeps_space: bool, leading: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.keeps_space, self.leading = keeps_space, leading
        self.marks = {x: self._tokenized(x) for x in _MARKS}
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())

    def _tokenized(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _plain(self, piece: str) -> bytes | None:
        """Ids of a blank, if kept, and a Latin-1 word, straight from the vocabulary's merges."""
        space = self.keeps_space and piece[:1] == " "
        word = piece[1:] if space else piece
        if not word.isalpha() or max(word) > "\xff":
            return None
        if not self.keeps_space:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(_SIGNS.__getitem__, word.encode()))
        found = self.model.tokenize("\u0120" + word if space else word)
        return array("I", [t.id for t in found]).tobytes()

    def _new(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that are not remembered, 32 bits each.

        A word and the mark behind it are two words to the tokenizer; the word is encoded once
        for all its marks.
        """
        bare, found, unknown = {}, [], []
        for piece in pieces:
            mark = self.marks.get(piece[-1:], b"")
            word = piece[:-1] if mark else piece
            if word not in bare:
                bare[word] = self._plain(word)
            if (ids := bare[word]) is None:
                unknown.append(len(found))
            found.append(None if ids is None else ids + mark)
        encoded = self.tokenizer.encode_batch_fast(
            [pieces[i] for i in unknown], add_special_tokens=False
        )
        for i, x in zip(unknown, encoded, strict=True):
            found[i] = array("I", x.ids).tobytes()
        return found

    def _look_up(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words as bytes, 32 bits each."""
        at = pc.index_in(words, self.words)
        missing = words.filter(at.is_null())
        ids = pa.concat_arrays([self.ids, pa.array(self._new(missing.to_pylist()), pa.large_binary())])
        at = at.to_numpy(zero_copy_only=False)
        absent = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), dtype=bool)
        places = np.where(absent, len(self.words) + np.cumsum(absent) - 1, np.nan_to_num(at))
        found = ids.take(pa.array(places.astype(np.int64)))
        known = pa.concat_arrays([self.words, missing])
        self.words, self.ids = (words, found) if len(known) > REMEMBERED else (known, ids)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), and where each text's ids start and the last ones end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        ids, sizes, at = [], [], 0
        while at < len(texts):
            limit = (ends[at - 1] if at else 0) + SLICE_BYTES
            to = max(at + 1, int(np.searchsorted(ends, limit, "right")))
            flat, lengths = self._slice(texts.slice(at, to - at))
            ids.append(flat)
            sizes.append(lengths)
            at = to
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return flat, np.concatenate(([0], *map(np.cumsum, [np.concatenate(sizes)] if sizes else [])))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), dtype=bool)
        if self.keeps_space:
            odd = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
            whole = odd.astype(bool)
            lines = pc.replace_substring(texts, "\n", " \n ")
        else:
            lines = pc.replace_substring(texts, "\n", " ")
        lines = pc.if_else(pa.array(whole), "", lines)
        lists = pc.split_pattern(lines, " ")
        pieces = lists.flatten().dictionary_encode()
        keys = pieces.indices.to_numpy()
        words = pieces.dictionary
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        if self.keeps_space:
            feed = pc.index(words, "\n").as_py()
            bare = np.zeros(len(keys), dtype=bool)
            bare[first[:-1][np.diff(first) > 0]] = not self.leading
            bare[1:] |= keys[:-1] == feed
            bare |= keys == feed
            keys = 2 * keys + bare
            used = np.flatnonzero(np.bincount(keys, minlength=2 * len(words)))
            place = np.zeros(2 * len(words), np.int32)
            place[used] = np.arange(len(used))
            keys = place[keys]
            words = words.take(pa.array(used >> 1))
            blank = pa.scalar(" ", words.type)
            spaced = pc.binary_join_element_wise(blank, words, pa.scalar("", words.type))
            words = pc.if_else(pa.array((used & 1).astype(bool)), words, spaced)
        rest = np.flatnonzero(whole)
        return self._gathered(words, keys, first, rest, texts.take(pa.array(rest)).to_pylist())

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are not cut, 32 bits each."""
        if self.leading:
            texts = [" " + text for text in texts]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _gathered(
        self, words: pa.Array, keys: np.ndarray, first: np.ndarray, rest: np.ndarray, alone: list[str]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has, from the words that ``keys`` name.

        The texts numbered ``rest`` are encoded whole; such a text has one empty piece, whose
        place its ids take.
        """
        whole = pa.array(self._whole(alone), pa.large_binary())
        known = pa.concat_arrays([self._look_up(words), whole])
        keys = np.array(keys)
        keys[first[:-1][rest]] = len(words) + np.arange(len(rest))
        taken = known.take(pa.array(keys))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4
        flat = np.frombuffer(taken.buffers()[2] or b"", np.uint32)[: ends[-1]]
        return flat, np.diff(ends[first])


#: White space beside white space, or at either end of a text, in RE2's words.
_RUNS = r"[\s\pZ\x0b\x1c-\x1f\x{85}]{2}|^[\s\pZ\x0b\x1c-\x1f\x{85}]|[\s\pZ\x0b\x1c-\x1f\x{85}]$"


class PieceEncoder(Encoder):
    """Encodes columns of texts as ``sentencepiece`` does, which puts a blank before each text.

    No piece of the vocabulary has a blank behind another character (this is checked), so a text
    may be cut before its blanks. A text in which blanks meet, or stand at an end, is encoded
    whole.
    """

    leading = True

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = (self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size()))
        if any(_BLANK in name.lstrip(_BLANK) for name in names):
            raise ValueError("Pieces of this vocabulary go on behind a blank.")
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x).tobytes() for x in self.pieces.encode(texts, num_threads=1)]

    _new = _whole

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, f"^ | $|  |{_BLANK}").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(odd.astype(bool))
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        pieces = lists.flatten().dictionary_encode()
        first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        alone = texts.take(pa.array(rest)).to_pylist()
        return self._gathered(pieces.dictionary, pieces.indices.to_numpy(), first, rest, alone)


#: Stands for a blank in the pieces of ``sentencepiece``.
_BLANK = "\u2581"


def piece_encoder(path: str) -> PieceEncoder:
    """The task's encoder for a ``sentencepiece`` file; later tasks of the worker reuse it."""
    if (path,) not in _OPEN:
        _OPEN[(path,)] = PieceEncoder(path)
    return _OPEN[(path,)]


def encoder(path: str, keeps_space: bool, leading: bool = False) -> Encoder:
    """The task's encoder for a tokenizer file; later tasks of the same worker reuse it."""
    key = (path, keeps_space, leading)
    if key not in _OPEN:
        _OPEN[key] = Encoder(*key)
    return _OPEN[key]


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens stand for their strings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    byte_of = {sign: b for b, sign in _SIGNS.items()}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        name = tokenizer.id_to_token(i) or ""
        plain = all(sign in byte_of for sign in name)
        out.append(bytes(byte_of[sign] for sign in name) if plain else name.encode())
    return out


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a ``sentencepiece`` vocabulary, blanks as blanks."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return [
        bytes([int(pieces.id_to_piece(i)[3:5], 16)])
        if pieces.is_byte(i)
        else pieces.id_to_piece(i).replace(_BLANK, " ").encode()
        for i in range(pieces.get_piece_size())
    ]
