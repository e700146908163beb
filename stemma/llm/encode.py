"""Whole-text encoding with the tokenizers library, each distinct word encoded once per worker.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the joined ids of the pieces are the ids
of the whole text. Two layouts are known; for any other the whole text is encoded at once:

- lead: byte-level pre-tokenizer with its standard pattern and no normalizer. A piece starts at each space and each
  newline and holds it. Where three white-space characters follow each other, or two end the text, the pattern takes
  them together: such a text is encoded whole.
- drop: a normalizer that folds white space and a pre-tokenizer that drops it. Pieces lie between spaces and newlines.

Both patterns also cut between a letter and a mark such as a comma, so a piece starts there too, and "word," and "word."
share "word". The pieces of many texts are found by array operations and grouped by their bytes; only distinct ones are
looked up and, where new, encoded. A piece of Latin letters is one pre-token, so the tokenizer's model takes it as it is.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytescan import lowered, texts_of

_RUN = re.compile(r"\s\s\s|\s\s\Z")
_CUT = np.isin(np.arange(256), [32, 10])
#: Bytes that are white space other than space and newline, or the first of such a character's.
_RARE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3])
_RARE_TAILS = {0xC2: (b"\x85", b"\xa0"), 0xE1: (b"\x9a\x80",), 0xE2: (b"\x80", b"\x81\x9f"), 0xE3: (b"\x80\x80",)}
#: Bytes that are ASCII letters; letters of two bytes from 0xC3; ASCII marks but the apostrophe, which contractions hold.
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_LATIN = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
_PLAIN = re.compile(rb"[ \n]?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+")
#: The character that the byte-level step makes of each byte; a line feed stays, as a separator.
_ALPHABET = np.arange(256, dtype="<u2")
_HIDDEN = np.r_[0:33, 127:161, 173]
_ALPHABET[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
_ALPHABET[10] = 10
#: Pieces kept encoded per worker process: when there are more they become the old ones, which stay as long as the next
#: are gathered (together some 100 MB). The longest piece, in bytes, that is kept; longer ones are encoded each time.
CACHE_WORDS, CACHE_BYTES = 250_000, 48
#: Words that are encoded in one call, a special token between them.
TOGETHER = 50


def layout(spec: dict) -> str:
    """lead, drop or whole, from a tokenizer's JSON."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "lead"
    steps = [x["type"] for x in norm.get("normalizers", [])]
    split = (pre.get("pretokenizers") or [{}])[0]
    folds = any(x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in norm.get("normalizers", []))
    drops = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
    return "drop" if folds and drops and set(steps) <= {"NFC", "Replace", "Lowercase"} else "whole"


def takes_words(spec: dict) -> bool:
    """Whether a piece of letters alone reaches the model as one pre-token, its bytes spelled in the byte-level alphabet."""
    if layout(spec) == "whole" or spec.get("truncation") or spec.get("padding"):
        return False
    if any(_PLAIN.fullmatch(t["content"].encode()) for t in spec["added_tokens"]):
        return False
    pre = spec["pre_tokenizer"]
    if pre["type"] == "ByteLevel":
        return True
    split, *rest = pre["pretokenizers"]
    bare = [(x["type"], x.get("use_regex"), x.get("add_prefix_space")) for x in rest] == [("ByteLevel", False, False)]
    return bare and "[\\p{L}]+" in split["pattern"].get("Regex", "").split("|")


class Encoder:
    """ids of whole texts as little-endian unsigned integers of the given width (2 or 4 bytes)."""

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.layout, self.dtype = layout(spec), np.dtype(f"<u{width}")
        # texts can be lower-cased first where the tokenizer does so, unless that makes a special token
        self.lowers = self.layout == "drop" and any(x["type"] == "Lowercase" for x in spec["normalizer"]["normalizers"])
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self.between = next((t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]), None)
        #: what stands between the pieces has no ids in the layout that drops it
        self.blank = {b" ": b"", b"\n": b""} if self.layout == "drop" else {}
        self.words: dict[bytes, bytes] = dict(self.blank)
        self.old: dict[bytes, bytes] = {}
        #: marks that no special token holds
        self.marks = np.isin(np.arange(256), list(set(_MARKS).difference(*self.specials)))
        self.direct = takes_words(spec)
        self.newline = self._each(["\n"])[0] if self.layout == "lead" else b""

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, texts: list[str]) -> list[bytes]:
        """As _each, with many short texts in one call: the ids are cut at a special token's."""
        if self.between is None:
            return self._each(texts)
        out, mark, size = [], self.tok.token_to_id(self.between), self.dtype.itemsize
        for lo in range(0, len(texts), TOGETHER):
            part = texts[lo : lo + TOGETHER]
            ids = np.array(self.tok.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == mark)
            if len(cuts) != len(part) - 1:  # a text holds the special token itself
                out += self._each(part)
                continue
            data, at = ids.tobytes(), 0
            for end in [*(cuts * size).tolist(), len(data)]:
                out.append(data[at:end])
                at = end + size
        return out

    def _words(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of letters, each behind a space or newline or none."""
        lead = [b""] * len(pieces)
        if self.layout == "lead":
            lead = [self.newline if w[:1] == b"\n" else b"" for w in pieces]
            text = b"\n".join(w[1:] if w[:1] == b"\n" else w for w in pieces)
        else:
            text = b"\n".join(pieces).decode().lower().encode()
        spelled = _ALPHABET[np.frombuffer(text, np.uint8)].tobytes().decode("utf-16-le").split("\n")
        tokens = list(map(self.tok.model.tokenize, spelled))
        size = self.dtype.itemsize
        ids = np.array([t.id for word in tokens for t in word], self.dtype).tobytes()
        ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) * size).tolist()
        return [first + ids[at:end] for first, at, end in zip(lead, [0, *ends[:-1]], ends, strict=True)]

    def _bounds(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start, in order, and the end; in layout drop a separator is a piece of its own."""
        cut = _CUT[buf]
        begins = np.zeros(len(buf) + 1, bool)
        begins[:-1] = cut
        begins[off] = True
        letter = _LETTER[buf]
        letter[1:] |= _LATIN[buf[1:]] & (buf[:-1] == 0xC3)
        begins[1:-1] |= letter[:-1] & self.marks[buf[1:]]
        if self.layout == "drop":
            begins[1:] |= cut
        return np.flatnonzero(begins)

    def _whole(self, buf: np.ndarray, off: np.ndarray) -> list[int]:
        """The texts that pieces can't serve. Two white-space characters side by side, and any but space and newline,
        make a text one to look at."""
        if self.layout != "lead":
            return []
        cut = _CUT[buf]
        odd = [np.flatnonzero(cut[1:] & cut[:-1])]
        rare = np.flatnonzero(_RARE[buf])
        first = buf[rare]
        odd.append(rare[first < 32])
        for lead, tails in _RARE_TAILS.items():
            at = rare[first == lead]
            for tail in tails:
                hit = np.ones(len(at), bool)
                for k, b in enumerate(tail, 1):
                    hit &= buf[np.minimum(at + k, len(buf) - 1)] == b
                odd.append(at[hit])
        docs = np.unique(np.searchsorted(off, np.concatenate(odd), "right") - 1)
        return [d for d in docs.tolist() if _RUN.search(buf[off[d] : off[d + 1]].tobytes().decode())]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of these pieces, from the old ones or encoded; all but the long ones are kept."""
        out = {w: ids for w, ids in zip(new, map(self.old.get, new), strict=True) if ids is not None}
        rest = [w for w in new if w not in out]
        if self.direct:
            plain = [w for w in rest if _PLAIN.fullmatch(w)]
            if plain:
                out.update(zip(plain, self._words(plain), strict=True))
                rest = [w for w in rest if w not in out]
        out.update(zip(rest, self._many([w.decode() for w in rest]), strict=True))
        self.words.update((w, ids) for w, ids in out.items() if len(w) <= CACHE_BYTES)
        return out

    def batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text; a null text counts as an empty one."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.layout == "whole":
            return self._each([t or "" for t in texts.to_pylist()])
        if len(self.words) > CACHE_WORDS:
            self.old, self.words = self.words, dict(self.blank)
        buf, off = texts_of(texts)
        if not len(buf):
            return [b""] * len(texts)
        if self.lowers:
            low = lowered(buf)
            buf = buf if any(t in low.tobytes() for t in self.specials) else low
        bounds = self._bounds(buf, off)
        # a dictionary of the pieces themselves: two pieces are one only where their bytes are
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(buf)])
        coded = pieces.dictionary_encode()
        start, which, keys = bounds[:-1], coded.indices.to_numpy(), coded.dictionary.to_pylist()
        got = list(map(self.words.get, keys))
        new = [w for w, ids in zip(keys, got, strict=True) if ids is None]
        if new:
            fresh = self._learn(new)
            got = [fresh[w] if ids is None else ids for w, ids in zip(keys, got, strict=True)]
        # lay out the ids of all pieces, in order, from those of the distinct ones
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        flat, first = np.frombuffer(b"".join(got), self.dtype), np.cumsum(size) - size
        n = size[which]
        upto = np.cumsum(n)
        ids = flat[np.repeat(first[which] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        bound = np.r_[0, upto][np.searchsorted(start, off)] * self.dtype.itemsize
        out = [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        data, whole = buf.tobytes(), self._whole(buf, off)
        for d, x in zip(whole, self._each([data[off[d] : off[d + 1]].decode() for d in whole]), strict=True):
            out[d] = x
        return out


@lru_cache(maxsize=4)
def encoder(name: str, width: int = 4) -> Encoder:
    """The worker's encoder for a tokenizer file: a path, or the name of a file of public_tokenizers."""
    return Encoder(locate(name), width)


def locate(name: str) -> str:
    """The path of a tokenizer on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def width_of(name: str, *extra: int) -> int:
    """Bytes of an unsigned integer that holds every id of the tokenizer and the extra ids."""
    from tokenizers import Tokenizer

    top = max([Tokenizer.from_file(locate(name)).get_vocab_size() - 1, *extra])
    return 2 if top < 1 << 16 else 4
