"""Byte-level BPE encoding by the tokenizers library, each distinct word once.

With the published byte-level pattern no piece holds white space but at its start, so a text can be cut before a single space, and around a single
line feed, between two characters that are no white space, and the parts' ids joined are the text's. Punctuation after a letter at a word's end is a part of its own as well. Arrow cuts texts and finds the distinct parts of a batch; each of these
is encoded by the library once, new ones together as a text of their own, whose ids come apart where a word begins. Words of letters are one piece each, so they meet the library's model without its pattern. A worker's table of parts is of bounded size. Runs of white space stay inside a part,
and texts with a special token's string or a mark of ours, and all texts of tokenizers of another kind, go to the library whole.

Defined results: null and empty texts have no ids.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space beside white space or at an end, or other than these two characters; where there is none, a text is split at spaces and line feeds.
_ODD = r"[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_WHITE = regex.compile(r"\s")
#: Letters and punctuation between which every piece of the published pattern ends, and words of one piece.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_STOP, _WORD = rf"([{_LETTER}])([.,;:!?]+)( |$)", re.compile(rf"[{_LETTER}]+")
#: The byte-level letter of a space, the mark of a part with no space before it, words that are encoded together, and bytes of texts that are split together.
SPACE, GLUED, RUN, SLICE = "Ġ", "\x01", 20_000, 1 << 21


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def cuts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file is a byte-level BPE with the published pattern and nothing that looks beyond a piece."""
    pre = spec.get("pre_tokenizer") or {}
    return spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")


class Encoder:
    """Encodes texts to ids; equal to the library's encode_batch(..., add_special_tokens=False)."""

    def __init__(self, path: str, limit: int = 10 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"] for x in spec.get("added_tokens", []))
        self.whole = not cuts_at_spaces(spec) or any(_WHITE.search(x) for x in self.special)
        # ids that begin the words of a text of words, and those that begin its lines
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] == SPACE]] = True
        self.newline = self._library("\n")
        # the same model for words whose bytes are letters already, with a mark between
        self.bare = Tokenizer.from_file(path)
        self.bare.no_padding()
        self.bare.no_truncation()
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = np.array([ord(x) for x in byte_letters()], np.uint32)
        self.letters[ord("\n")] = ord(" ")
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.places, self.held = {}, 0  # number of each part, in order of coming
        self.starts, self.sizes, self.before, self.flat = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _words(self, words: list[str]) -> list[int]:
        """What _library gives for words of letters, each with a space before it: each is one piece, so no pattern is asked for."""
        letters = self.letters[np.frombuffer((" " + "\n ".join(words)).encode(), np.uint8)]
        return self.bare.encode_batch_fast([letters.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids

    def _learn(self, new: list[str], odd: set[str]) -> None:
        """Encodes new parts: those without white space (which only parts in `odd` may have) together, as one text of words and one of lines, the others one by one."""
        rows, words, others, alone = [], [], [], []
        for part in new:
            if part.isalpha() and (part.isascii() or _WORD.fullmatch(part)):
                words.append(part)
            else:
                (alone if part == "\n" or part[0] == GLUED or part in odd and _WHITE.search(part, 1) else rows if part[0] == "\n" else others).append(part)
        newline = np.zeros(len(self.opens), bool)
        newline[self.newline] = True
        at = len(self.flat)
        flat, starts, sizes, before_line = [self.flat], [self.starts], [self.sizes], [self.before]
        # a line's first id is its line feed, which does not count
        for parts, encode, opens, skip in ((words, self._words, self.opens, 0), (others, lambda x: self._library(" " + " ".join(x)), self.opens, 0), (rows, lambda x: self._library("".join(x)), newline, 1)):
            for some in (parts[k : k + RUN] for k in range(0, len(parts), RUN)):
                ids = np.array(encode(some), np.uint32)
                firsts = np.flatnonzero(opens[ids])
                if len(firsts) != len(some) or firsts[0]:
                    raise ValueError("the tokenizer's pieces are not what its file says")
                flat.append(ids)
                starts.append(at + firsts + skip)
                sizes.append(np.diff(firsts, append=len(ids)) - skip)
                before_line.append(np.full(len(some), skip))
                at += len(ids)
        for part in alone:
            ids = np.array(self._library(part if part == "\n" else part[1:] if part[0] in ("\n", GLUED) else " " + part), np.uint32)
            flat.append(ids)
            starts.append([at])
            sizes.append([len(ids)])
            before_line.append([0])
            at += len(ids)
        self.places.update(zip((*words, *others, *rows, *alone), range(len(self.places), len(self.places) + len(new)), strict=True))
        self.held += sum(map(len, new)) + 20 * len(new)
        self.flat = np.concatenate(flat)
        self.starts, self.sizes, self.before = (np.concatenate(x).astype(np.int32) for x in (starts, sizes, before_line))

    def _numbers(self, parts: list[str], odd: set[str]) -> np.ndarray:
        """The number in the table of each part; new ones are learned."""
        if self.held > self.limit:
            self._forget()
        new = set(parts) - self.places.keys()
        if new:
            self._learn(list(new), odd)
        return np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts whose white space is single spaces and line feeds between other characters: Arrow splits them, punctuation after a word as well, and finds the distinct parts, so Python sees each of a batch once."""
        lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(pc.replace_substring_regex(lines, _STOP, rf"\1 {GLUED}\2\3"), " ")
        coded = words.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary.to_pylist(), set())[coded.indices.to_numpy()]
        begins = words.offsets.to_numpy().astype(np.int64)
        begins -= begins[0]
        sizes = self.sizes[at]
        before = self.before[at]  # ids of the line feed before a line's first word, which the first of a text has not
        before[begins[:-1]] = 0
        sizes += before
        ends = np.cumsum(sizes, dtype=np.int32)
        ids = self.flat[np.repeat(self.starts[at] - before - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)]
        return np.split(ids, ends[begins[1:-1] - 1]) if len(texts) > 1 else [ids]

    def _odd(self, text: str) -> np.ndarray:
        """The ids of a text with other white space."""
        if self.whole or GLUED in text or any(map(text.__contains__, self.special)):
            return np.array(self._library(text), np.uint32)
        found = _CUT.split(text)
        found[0] = "\n" + found[0]
        at = self._numbers(found, set(found))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)]

    def many(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(column):
            return []
        empty = pc.equal(pc.binary_length(column), 0)
        plain = pc.invert(pc.or_(empty, pc.match_substring_regex(column, _ODD)))
        for x in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(column, x)))
        plain = np.zeros(len(column), bool) if self.whole else plain.to_numpy(zero_copy_only=False)
        out = [np.empty(0, np.uint32)] * len(column)
        if plain.any():
            for i, ids in zip(np.flatnonzero(plain).tolist(), self._plain(column.filter(pa.array(plain))), strict=True):
                out[i] = ids
        for i in np.flatnonzero(~plain & ~empty.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._odd(column[i].as_py())
        return out

    def each(self, keys: list, texts):
        """(key, ids) of an Arrow column of texts, some texts at a time."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield from zip(keys[at:stop], self.many(texts.slice(at, stop - at)), strict=True)
            at = stop


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file in a Python worker, kept from task to task."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
