"""BPE encoding and decoding for word-end vocabularies.

A piece is a list of symbols' ids. A priority queue holds the merges of the adjacent pairs by (rank, position): for pieces of at most SHORT symbols a
list by position whose least entry is taken, beyond that a heap over a doubly linked list; there a popped entry is stale, and skipped, when its symbols have changed since.
Merging takes the right neighbour out and offers the two pairs that arise. Decoding concatenates the vocabulary strings.

Each distinct chunk between white space is normalised, split and merged once in a worker's tables, which hold at most `limit` characters
together; a chunk or piece of more than LONG characters is never held. Normalising and splitting are done here for letters and signs whose classes all Unicode versions share,
and by the tokenizer's own normaliser and pre-tokenizer for other chunks.

Defined results: null and empty texts have no ids (n_tokens 0, the digests of the empty string).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents
from .tokens import byte_letters

#: Latin letters with their case pairs, digits, common punctuation: no normalisation changes them but lower-casing.
PLAIN = regex.compile(r"[!-~¡-§©«¬®¶·»¿À-ÖØ-ķŁ-ňŊ-ž–—‘’“”„…]*")
#: The tokenizer's published splitting pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: str.split cuts at these, the tokenizer's white space does not hold them.
SEPARATORS = "\x1c\x1d\x1e\x1f"
LONG = 200
#: Pieces of more symbols are merged with a heap, whose work does not grow with the square.
SHORT = 48
#: No merge: above all others.
NEVER = 1 << 62


class Table(dict):
    """make(key) by string, made when it is first asked for; emptied before the strings pass `limit` characters (20 more are counted for each). Long strings are left out."""

    def __init__(self, make, limit: int, longest: int):
        self.make, self.limit, self.longest, self.held = make, limit, longest, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= self.longest:
            self.held += len(key) + 20
            if self.held > self.limit:
                self.clear()
                self.held = len(key) + 20
            self[key] = value
        return value


class WordBpe:
    """The model of a tokenizer file: text -> (number of ids, ids in decimal, decoded text)."""

    def __init__(self, path: str, limit: int = 16 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.strings = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        # by both ids in one number: rank and id of what arises in another, so that the least is the first to merge
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: r << 32 | self.vocab[a + b] for r, (a, b) in enumerate(merges)}
        self.first = {c: i for c, i in self.vocab.items() if len(c) == 1}
        self.last = {c: self.vocab[c + self.end] for c in self.first if c + self.end in self.vocab}
        self.letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.chunks, self.pieces = Table(self._chunk, limit, LONG), Table(self._piece, limit // 2, LONG)

    def merge(self, piece: str) -> list[int]:
        """The ids of a byte-lettered piece after all merges."""
        first, merges = self.first, self.merges
        ids = [first[c] for c in piece[:-1]]
        ids.append(self.last[piece[-1]])
        return self._merge_long(ids) if len(ids) > SHORT else self._merge_short(ids, merges.get)

    @staticmethod
    def _merge_short(ids: list[int], get) -> list[int]:
        """The queue is the list of the pairs' merges in order of place: its least entry, the first of equal ones, is next."""
        queue = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while queue and (least := min(queue)) != NEVER:
            i = queue.index(least)
            merged = ids[i] = least & 0xFFFFFFFF
            del ids[i + 1], queue[i]
            if i:
                queue[i - 1] = get(ids[i - 1] << 32 | merged, NEVER)
            if i < len(queue):
                queue[i] = get(merged << 32 | ids[i + 1], NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The queue is a heap of (merge, place, pair); symbols are linked both ways."""
        n, get = len(ids), self.merges.get
        symbols = [*ids, -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m, i, pair) for i in range(n - 1) if (m := get(pair := ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            m, i, pair = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] << 32 | symbols[j] != pair:
                continue  # stale
            merged = symbols[i] = m & 0xFFFFFFFF
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := get(pair := merged << 32 | symbols[k])) is not None:
                    heapq.heappush(queue, (m, i, pair))
            h = before[i]
            if h >= 0 and (m := get(pair := symbols[h] << 32 | merged)) is not None:
                heapq.heappush(queue, (m, h, pair))
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> tuple[str, str]:
        ids = self.merge(piece)
        return " ".join(map(str, ids)), self.decode(ids)

    def split(self, chunk: str) -> list[str]:
        """Byte-lettered pieces of a chunk."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and not chunk[-1].isalnum() and chunk.isprintable():
                return [chunk[:-1].lower(), chunk[-1]]
        if PLAIN.fullmatch(chunk):
            found = PIECES.findall(chunk.lower())
            if chunk.isascii():
                return found
            return ["".join([self.letters[b] for b in p.encode()]) for p in found]
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        found = [self.pieces[p] for p in self.split(chunk)]
        if len(found) == 1:
            return found[0]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings joined by a space, as a tokenizer without decoder does."""
        return " ".join([self.strings[i] for i in ids])

    def _plain(self, text: str) -> list[tuple[str, str]]:
        chunks = [text] if any(c in text for c in SEPARATORS) else text.split()
        return list(map(self.chunks.__getitem__, chunks))

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        if self.cut and any(s in text for s in self.special):
            found = []
            for k, part in enumerate(self.cut.split(text)):
                if k % 2:
                    i = self.special[part]
                    found.append((str(i), self.strings[i]))
                elif part:
                    found += self._plain(part)
        else:
            found = self._plain(text)
        if not found:
            return 0, "", ""
        ids, strings = zip(*found, strict=True)
        joined = " ".join(ids)
        if "  " in joined or joined[:1] in ("", " ") or joined[-1] == " ":  # a chunk without ids
            found = [x for x in found if x[0]]
            if not found:
                return 0, "", ""
            ids, strings = zip(*found, strict=True)
            joined = " ".join(ids)
        return joined.count(" ") + 1, joined, " ".join(strings)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_decode(text)[1].split()]


_OPEN: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
        gc.freeze()  # collections would go through its large tables again and again
    return _OPEN[path]


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256(, ids, decoded) of each document."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_texts

    def run(batches):
        bpe, sha = model(tokenizer), hashlib.sha256
        for b in batches:
            out = []
            for text in b.column(1):
                n, ids, decoded = bpe.encode_decode(text.as_py())
                out.append((n, sha(ids.encode()).hexdigest(), sha(decoded.encode()).hexdigest()) + (([int(i) for i in ids.split()], decoded) if with_texts else ()))
            columns = zip(*out, strict=True) if out else [[] for _ in fields[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields[1:], strict=True))], schema=pa.schema(fields))

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_texts
    return documents(docs, id_col, text_col).mapInArrow(run, ddl)
