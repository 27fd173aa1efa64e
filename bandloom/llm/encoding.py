"""Encoders that remember the ids of the pieces a text falls into.

A tokenizer's merges never cross certain boundaries, so a text's ids are its pieces' ids in a row. Natural text repeats
its pieces: those of many texts are made distinct together, and the library is asked for the new ones, many in a call.
Texts for which the boundaries can't be trusted are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that an encoder remembers before it starts anew (some 60 MB in all): those met again, and those met once.
OFTEN, ONCE = 250_000, 125_000

WHOLE, PIECES, WORDS = range(3)

#: Stands where words are cut; a text that has it itself is cut otherwise.
CUT = "\x04"


def tokenizer_path(name: str) -> str:
    """``name`` itself if it is a path, else the place of the public tokenizer file of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Token ids of texts; subclasses say how a text is cut and how pieces are encoded."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.often: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def way(self, text: str) -> int:
        """WORDS if cut() finds a text's pieces, PIECES if pieces() does, else WHOLE."""
        raise NotImplementedError

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def cut(self, texts: pa.Array) -> pa.Array:
        """The texts with CUT wherever a piece ends within them."""
        raise NotImplementedError

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, as bytes; new ones are encoded and remembered."""
        often, once = self.often, self.once
        if len(often) > OFTEN:
            often.clear()
        if len(once) > ONCE:
            once.clear()
        missing = [x for x in pieces if x not in often]
        often.update((x, once.pop(x)) for x in missing if x in once)
        new = [x for x in missing if x not in often]
        once.update(zip(new, self.encode_pieces(new), strict=True))
        return [often[x] if x in often else once[x] for x in pieces]

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        lists = pc.split_pattern(self.cut(pa.array(texts, pa.large_string())), CUT)
        words = lists.values.dictionary_encode()
        return _gather(self._ids(_strings(words.dictionary)), words.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy())

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.pieces(x) for x in texts]
        pieces = pa.array([x for one in lists for x in one], pa.large_string()).dictionary_encode()
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        return _gather(self._ids(_strings(pieces.dictionary)), pieces.indices.to_numpy().astype(np.int64), at)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        ways = np.array([self.way(x) for x in texts], np.int8)
        out: list = [None] * len(texts)
        for way, encode in ((WORDS, self._by_words), (PIECES, self._by_pieces)):
            rows = np.flatnonzero(ways == way).tolist()
            for i, ids in zip(rows, encode([texts[i] for i in rows]) if rows else (), strict=True):
                out[i] = ids
        return [np.array(self.encode_whole(text), "<u4") if ids is None else ids for text, ids in zip(texts, out, strict=True)]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _gather(found: list[bytes], codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text, whose pieces have the ``codes`` from one bound in ``at`` to the next, their ids in a row."""
    ids = np.frombuffer(b"".join(found), "<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    every = ids[np.repeat(starts[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
    return np.split(every, ends[at[1:-1]])


class ByteLevelEncoder(Encoder):
    """A ``tokenizers`` file. Byte-level ones whose pre-tokenizer splits at spaces are encoded by pieces, others whole."""

    #: A run of letters with a space before it, up to white space, comma or full stop; a run of anything else without
    #: white space; white space as the pre-tokenizer splits it.
    PIECES = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\\s,.])|[ ]?\\S+|\\s+(?!\\S)|\\s+")
    #: White space that isn't a word's own space or the end of a line.
    LOOSE = re.compile("[^\\S \n]")
    #: Python takes these for white space and the pre-tokenizer doesn't.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    #: A piece that the pre-tokenizer leaves whole.
    LETTERS = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        super().__init__(path)
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [*self.ODD, *(x["content"] for x in described.get("added_tokens") or [])]
        before = described.get("pre_tokenizer") or {}
        self.by_pieces = described.get("normalizer") is None and described.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        # The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [c for c in range(256) if c not in shown]
        self.alphabet = {c: 256 + k for k, c in enumerate(hidden)}
        self.space = chr(self.alphabet[32])

    def way(self, text: str) -> int:
        if not self.by_pieces or any(x in text for x in self.special):
            return WHOLE
        loose = "  " in text or "\n\n" in text or " \n" in text or text[-1:] == " " or CUT in text or self.LOOSE.search(text)
        return PIECES if loose else WORDS

    def pieces(self, text: str) -> list[str]:
        return self.PIECES.findall(text)

    def cut(self, texts: pa.Array) -> pa.Array:
        """Before each space, around ends of lines, and between a letter and a comma or full stop."""
        cut = pc.replace_substring(pc.replace_substring(texts, " ", f"{CUT} "), "\n", f"{CUT}\n{CUT}")
        return pc.replace_substring_regex(cut, r"(\p{L})([.,])", rf"\1{CUT}\2")

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Words of letters go straight to the tokenizer's model, other pieces through all its steps."""
        whole, tokenize = self.LETTERS.fullmatch, self.tokenizer.model.tokenize
        rest = [x for x in pieces if not whole(x)]
        found = dict(zip(rest, map(as_bytes, self._batch(rest)), strict=True))
        return [found[x] if x in found else array("I", [t.id for t in tokenize(self._letters(x))]).tobytes() for x in pieces]

    def _letters(self, piece: str) -> str:
        """A piece's bytes in the byte-level alphabet."""
        return piece.replace(" ", self.space) if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class SentencePieceEncoder(Encoder):
    """A ``sentencepiece`` model. Those whose pieces hold the space mark at their start alone are encoded by words."""

    MARK = "▁"
    PIECES = re.compile(" +[^ ]+| +")

    def __init__(self, path: str) -> None:
        super().__init__(path)
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = re.compile(f"[^{self.MARK}]{self.MARK}")
        words = self.model.encode(["a b", "a  b "], out_type=str)
        plain = ["".join(x) for x in words] == [f"{self.MARK}a{self.MARK}b", f"{self.MARK}a{self.MARK * 2}b{self.MARK}"]
        self.by_pieces = plain and not any(inner.search(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))

    def way(self, text: str) -> int:
        if not self.by_pieces or not text or self.MARK in text or "\0" in text:
            return WHOLE
        return PIECES if "  " in text or text[0] == " " or text[-1] == " " or CUT in text else WORDS

    def pieces(self, text: str) -> list[str]:
        return self.PIECES.findall(f" {text}")

    def cut(self, texts: pa.Array) -> pa.Array:
        """Before each space; the model takes a text as if one stood before it."""
        return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pc.replace_substring(texts, " ", f"{CUT} "), pa.scalar(" ", pa.large_string()))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        # The model puts one space mark before what it is given.
        found = self.model.encode([x[1:] or "x" for x in pieces], num_threads=1)
        return [as_bytes(ids if len(x) > 1 else [self.model.piece_to_id(self.MARK)]) for x, ids in zip(pieces, found, strict=True)]

    def encode_whole(self, text: str) -> list[int]:
        return self.model.encode(text)


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """The encoder of a tokenizer file, one for each Python process."""
    path = tokenizer_path(name)
    return SentencePieceEncoder(path) if path.endswith(".model") else ByteLevelEncoder(path)
