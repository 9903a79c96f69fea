"""Byte-level BPE ids through the ``tokenizers`` library, memoised by word.

Byte-level BPE first cuts a text into pre-tokens, none of which crosses the start of a run of white space that follows other text.
So a text can be cut before each such run and the parts encoded alone, with the same ids.
Most parts recur; each is given to the library once and then found in a dictionary.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import cpu_threads_off

#: The pre-token pattern of byte-level BPE (a fixed value of that published tokenizer).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LED = re.compile(r"\s ")
_PARTS = re.compile(r"\s*\S+|\s+")
_PLAIN = re.compile("[\x20-\x7e\n\xa1-ɏ]*")
#: Byte-level BPE writes each byte as a printable character: bytes that are printable in Latin-1 as themselves, the others from U+0100 on (a fixed rule of that tokenizer).
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_STAND_IN = {b: b if b in _SHOWN else 0x100 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}
#: Letters of the Latin blocks; a pre-token of letters ends before any other character but a letter.
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: What is put before a stop or comma that stands between a letter or digit and a space: a character that texts with it do without.
_MARK, _ENDS = "\x02", (".", ",")
_CUT = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text that holds the string of a special token goes to the library whole, as do parts with characters outside the Latin blocks.
    ``limit`` bounds the entries of each dictionary; a full one makes way, and its words are taken over or found anew when they come again.
    """

    def __init__(self, path: str, limit: int = 220_000):
        cpu_threads_off()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        conf = json.loads(self.tok.to_str())
        pre = conf.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or conf.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        self.model = self.tok.model
        self.special = [t["content"] for t in conf["added_tokens"]]
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        self.limit = limit
        self.after_space: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, p: str) -> bytes:
        """The ids of one pre-token, by the library's BPE model over its bytes' stand-in characters."""
        raw = p if p.isascii() else p.encode("utf-8", "surrogatepass").decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(raw.translate(_STAND_IN))]).tobytes()

    def _part(self, part: str) -> bytes:
        """The ids of a text that no pre-token overruns on either side."""
        if not _PLAIN.fullmatch(part):
            return self._library(part)
        known, out = self.pieces, []
        for x in PRETOKEN.findall(part):
            got = known.get(x)
            if got is None:
                got = known[x] = self._piece(x)
            out.append(got)
        return b"".join(out)

    def _chunk(self, c: str) -> bytes:
        """The ids of a space and then ``c``."""
        return b"".join(map(self._part, _PARTS.findall(" " + c)))

    def _slow(self, text: str) -> bytes:
        """The ids of a text that holds a special token, or white space before a space."""
        if any(s in text for s in self.special):
            return self._library(text)
        first, *rest = _CUT.split(text)
        return b"".join([*map(self._part, _PARTS.findall(first)), *(self._chunk(x[1:]) for x in rest)])

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of a space and then each of ``words``."""
        if len(self.after_space) > self.limit:
            self.older, self.after_space = self.after_space, {}
        if len(self.pieces) > self.limit:
            self.pieces.clear()
        tail, older, pieces, tokenize = self.after_space, self.older, self.pieces, self.model.tokenize
        out = list(map(tail.get, words))
        if None not in out:
            return out
        for i in [i for i, got in enumerate(out) if got is None]:
            c = words[i]
            got = older.get(c)
            if got is not None:
                out[i] = tail[c] = got
                continue
            m = _LETTERS.match(c)
            n = m.end() if m else 0
            if not n or n < len(c) and c[n].isalpha():  # none, or letters beyond the Latin blocks
                out[i] = self._chunk(c)
                continue
            # a pre-token ends where its letters end
            core = c if n == len(c) else c[:n]
            got = tail.get(core)
            if got is None:
                got = older.get(core)
                if got is None:
                    got = array("I", [t.id for t in tokenize("Ġ" + core)]).tobytes() if core.isascii() else self._piece(" " + core)
                tail[core] = got
            if n < len(c):
                end = c[n:]
                more = pieces.get(end)
                got += more if more is not None else self._part(end)
            out[i] = got
        return out

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, where each text's begin, with the end of the last).

        A text is cut at its spaces, and before a stop or comma that a letter or digit and a space enclose. The chunks of all texts are numbered,
        each distinct one is looked up once, and the ids are gathered by numbers.
        """
        slow = {i: self._slow(t) for i, t in enumerate(texts) if _LED.search(t) or _MARK in t or any(s in t for s in self.special)}
        while True:
            plain = pa.array(["" if i in slow else t for i, t in enumerate(texts)] if slow else texts, pa.large_string())
            for end in _ENDS:
                plain = pc.replace_substring(plain, f"{end} ", f" {_MARK}{end} ")
            cut = pc.split_pattern(plain, " ")
            of = cut.flatten().dictionary_encode()
            codes, ends = of.indices.to_numpy().copy(), cut.offsets.to_numpy()
            words = of.dictionary.to_pylist()
            marks = [words.index(_MARK + end) for end in _ENDS if _MARK + end in words]
            at = np.flatnonzero(np.isin(codes, marks)) if marks else np.zeros(0, np.int64)
            # behind other characters than letters and digits a stop is part of what they make
            fine = pc.match_substring_regex(of.dictionary, r"[\pL\pN]$").to_numpy(zero_copy_only=False)
            odd = at[~fine[codes[at - 1]]] if len(at) else at
            first = odd[np.isin(odd - 1, ends[:-1])] if len(odd) else odd  # a stop that begins a text has nothing before it
            odd = odd[~(np.isin(odd, first) & np.array([words[c] == "" for c in codes[odd - 1]], bool))] if len(odd) else odd
            if not len(odd):
                break
            slow |= {i: self._slow(texts[i]) for i in np.unique(np.searchsorted(ends, odd, "right") - 1).tolist()}
        ids = self._known(words)
        for k in marks:
            ids[k] = self._part(words[k][1:])
        # what begins a text has no space before it
        n = len(ids)
        ids += [slow[i] if i in slow else b"".join(map(self._part, _PARTS.findall(words[c]))) for i, c in enumerate(codes[ends[:-1]].tolist())]
        codes[ends[:-1]] = np.arange(n, n + len(texts))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[codes]
        stops = np.cumsum(each)
        # places in the table, by steps of 32 bits while they fit
        kind = np.int32 if max(len(table), int(stops[-1]) if len(stops) else 0) < 2**31 else np.int64
        at = np.repeat((starts[codes] - (stops - each)).astype(kind), each)
        at += np.arange(len(at), dtype=kind)
        return table[at], np.concatenate(([0], stops))[ends]

    def encode_ended(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode_flat`` with the id ``end`` behind every text."""
        flat, ends = self.encode_flat(texts)
        return np.insert(flat, ends[1:], np.uint32(end)), ends + np.arange(len(ends))

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, ends = self.encode_flat(texts)
        raw = memoryview(flat).cast("B") if len(flat) else b""
        return [bytes(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
