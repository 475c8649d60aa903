"""Token ids through the tokenizers library, with each distinct part of text encoded once by a process.

The library cuts text into parts (words, numbers, marks, white space) before it looks for tokens, and a part's ids depend
on the part alone. So a group of texts is cut by array operations, its distinct parts are looked up or encoded, and their
ids are put in order.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, MARK, SPACE, OTHER = range(5)
#: Unicode white space, as the tokenizers' patterns see it.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Up to here, but for U+0130, normal form C and lower case need no context. What has other letters in it, up to the white
#: space around, is one part, which the library cuts further.
_PLAIN = 0x250

_encoders: dict[tuple[str, str, bool, int], PartEncoder] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each code point, and its lower case."""
    kinds, lower = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(_PLAIN):
        if c != 0x130:
            kinds[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], MARK)
            lower[c] = ord(chr(c).lower())
    kinds[_SPACES] = SPACE
    return kinds, lower


_KINDS, _LOWER = _tables()


def cut(c: np.ndarray, first: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where parts start in them) of code points c; first: where texts start. "words" are in lower case.

    kind "bytes": runs of letters, numbers or marks, each with the blank before it; other white space by itself. "words":
    the same without blanks, and each number is a part. An apostrophe that starts a part takes s, t, m, d, re, ve or ll.
    """
    n, own, given = len(c), _KINDS[c], c
    if kind == "words":
        c = _LOWER[c]
    starts = np.ones(n, bool)
    starts[1:] = own[1:] != own[:-1]
    if kind == "words":
        starts |= own == NUMBER
    else:
        last = np.flatnonzero((own[:-1] == SPACE) & (own[1:] != SPACE) & ~first[1:])  # white space that something follows
        starts[last] = True
        starts[last + 1] = c[last] != 32
    starts |= first
    quotes = np.flatnonzero((c == 39) & starts)
    ahead = np.concatenate([c, np.zeros(3, c.dtype)])
    new = np.concatenate([first, np.ones(3, bool)])
    a, b = ahead[quotes + 1], ahead[quotes + 2]
    one = np.isin(a, [ord(x) for x in "stmd"]) & ~new[quotes + 1]
    two = (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))) & ~new[quotes + 1] & ~new[quotes + 2]
    starts[quotes[one | two] + 1] = False
    after = np.concatenate([quotes[one] + 2, quotes[two] + 3])
    starts[after[after < n]] = True
    if (own == OTHER).any():
        word = own != SPACE
        opens = word & np.concatenate([[True], ~word[:-1]]) | word & first
        which = np.cumsum(opens)
        odd = np.zeros(which[-1] + 1, bool)
        odd[which[own == OTHER]] = True
        inside = odd[which] & word
        starts[inside & ~opens] = False
        c = np.where(inside, given, c)
    return c, starts


def _letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_WRITTEN = _letters()


class PartEncoder:
    """texts -> ids as little-endian unsigned 32-bit bytes, the same as the library gives for whole texts.

    kind "bytes" is for byte-level BPE in which a blank belongs to the word after it, "words" for BPE with word ends that
    lower-cases and drops white space. A text that contains one of the tokenizer's added tokens goes to the library whole;
    there it gives that token's id, or, with special_as_text, those of ordinary text.
    """

    def __init__(self, tokenizer_json: str, kind: str, special_as_text: bool = False, keep: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        self.kind, self.keep = kind, keep
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.model = self.tokenizer.model

    def _new(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that aren't remembered. Words of letters go to the model, written in its letters, as the library would
        hand them to it: they are their own lower case, and it cuts none of them further."""
        flat, ends, blank = [], [0], self.kind == "bytes"
        model, whole = self.model.tokenize, self.tokenizer.encode
        for p in parts:
            word = p[1:] if blank and p[0] == " " else p
            if not word.isalpha():
                flat += whole(p, add_special_tokens=False).ids
            elif word.isascii():
                flat += [t.id for t in model(word if word is p else _WRITTEN[32] + word)]
            elif max(word) < chr(_PLAIN) and "İ" not in word:
                flat += [t.id for t in model(p.encode().decode("latin-1").translate(_WRITTEN))]
            else:
                flat += whole(p, add_special_tokens=False).ids
            ends.append(len(flat))
        raw = np.array(flat, "<u4").tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip(ends, ends[1:])]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts. Of two generations of parts the older is dropped, so those in use stay."""
        if len(self.recent) + len(parts) > self.keep:
            self.older, self.recent = self.recent, {}
        recent, older, fresh = self.recent, self.older.get, []
        found = list(map(recent.get, parts))
        for k, ids in enumerate(found):
            if ids is None:
                ids = older(parts[k])
                if ids is None:
                    fresh.append(k)
                else:
                    found[k] = recent[parts[k]] = ids
        for k, ids in zip(fresh, self._new([parts[k] for k in fresh]), strict=True):
            found[k] = ids
            if len(parts[k]) <= 48:
                recent[parts[k]] = ids
        return found

    def encode(self, texts: list[str], width: str = "<u4") -> list[bytes]:
        """The ids of each text as numbers of this width; what is held meanwhile is some dozens of bytes for each character of
        all texts."""
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        if self.added.search(joined):
            if len(texts) == 1:
                return [np.asarray(self.tokenizer.encode(joined, add_special_tokens=False).ids, width).tobytes()]
            return [x for t in texts for x in self.encode([t], width)]
        c = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        places = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(c) + 1, bool)
        first[places] = True
        own, starts = cut(c, first[:-1], self.kind)
        starts = np.flatnonzero(starts)
        raw = joined.encode() if own is c else own.astype("<u4").tobytes().decode("utf-32-le").encode()
        edges = np.append(starts, len(c))
        if len(raw) > len(c):
            edges = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))[edges]
        parts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)).dictionary_encode()
        which, ids = parts.indices.to_numpy(), self._ids(parts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        flat, begin = np.frombuffer(b"".join(ids), "<u4").astype(width), np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[which]
        ends = np.cumsum(each, dtype=np.int32 if 4 * len(raw) < 1 << 31 else np.int64)  # a byte has few tokens
        out = flat[np.repeat(begin[which] - (ends - each), each) + np.arange(ends[-1], dtype=ends.dtype)].tobytes()
        cuts = flat.itemsize * np.append(0, ends.astype(np.int64))[np.searchsorted(starts, places)]
        return [out[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def encoder(tokenizer_json: str, kind: str, special_as_text: bool = False, keep: int = 150_000) -> PartEncoder:
    """This process's encoder, which remembers two generations of `keep` parts; Python workers live for many tasks."""
    key = (hashlib.sha256(tokenizer_json.encode()).hexdigest(), kind, special_as_text, keep)
    if key not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        _encoders[key] = PartEncoder(tokenizer_json, kind, special_as_text, keep)
    return _encoders[key]
