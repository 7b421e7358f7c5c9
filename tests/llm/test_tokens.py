import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphlode.llm.bpe import WordBpe, bpe_round_trip
from graphlode.llm.packing import fullest, pack_documents, plan
from graphlode.llm.sstable import Bloom, key_of, lookup, read_shards, write_shards
from graphlode.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    letters = list("abAB'sT1. \n\t \xa0　éÉ!ßΣ日́½\x1c<|>")
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's we'll\nI'd", "x  y", " x", "x ", "\n"]


def test_encoder_equals_library():
    e, library = Encoder(BYTE, limit=20_000), Tokenizer.from_file(BYTE)
    assert not e.whole
    texts = random_texts(20_000)
    texts += [" ".join(texts[i : i + 30]) for i in range(0, 3000, 30)] + ["x" * 5000, "a\n" * 3000]
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        for t, ids in zip(some, e.many(some), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert e.held <= 20_000 + sum(len(t) + 20 * len(t.split()) + 100 for t in some)
    assert not e.many([]) and [x.tolist() for x in e.many(["", ""])] == [[], []]


def test_other_tokenizers_get_whole_texts():
    e, library = Encoder(WORD), Tokenizer.from_file(WORD)
    assert e.whole and e.many(["It's one  two"])[0].tolist() == library.encode("It's one  two", add_special_tokens=False).ids


def test_word_bpe_equals_library():
    m, library = WordBpe(WORD), Tokenizer.from_file(WORD)
    for t in random_texts(3000):
        ids = library.encode(t, add_special_tokens=False).ids
        assert m.encode_decode(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)), repr(t)


def test_merge_queues_agree_and_tables_make_a_piece_once():
    m = WordBpe(WORD)
    rng = random.Random(11)
    for n in (1, 2, 3, 9, 40, 48, 49, 300):
        for _ in range(40):
            piece = "".join(rng.choice("theraninoust") for _ in range(n))
            first = [*(m.first[c] for c in piece[:-1]), m.last[piece[-1]]]
            assert m._merge_short([*first], m.merges.get) == m._merge_long(first) == m.merge(piece)
    made = []
    merge, m.merge = m.merge, lambda piece: made.append(piece) or merge(piece)
    words = ["".join(rng.choice("theraninoust") for _ in range(12)) for _ in range(400_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    first, again = [m.encode_decode(t) for t in texts], [m.encode_decode(t) for t in texts]
    assert first == again and len(made) == len(set(words))  # tables of 8 Mi characters were emptied in between
    library = Tokenizer.from_file(WORD)
    for t, (n, ids, decoded) in list(zip(texts, first, strict=True))[::100]:
        found = library.encode(t, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(found), " ".join(map(str, found)), library.decode(found, skip_special_tokens=False))


def test_bpe_query(docs, corpus, no_docs, odd_docs):
    library = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe_round_trip(docs, WORD, with_texts=True).collect()}
    for doc_id, text, *_ in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[doc_id].ids, got[doc_id].decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe_round_trip(no_docs, WORD).count() == 0
    assert bpe_round_trip(odd_docs, WORD).count() == odd_docs.count()


def test_shards_round_trip(spark, docs, corpus, tmp_path):
    library = Tokenizer.from_file(BYTE)
    manifest = write_shards(docs, BYTE, 0, block_bytes=2000, path=str(tmp_path / "shards"))
    rows = read_shards(spark, str(tmp_path / "shards"), manifest, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for r, (doc_id, text, *_) in zip(rows, corpus, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (doc_id, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = [str(tmp_path / "shards" / r.name) for r in manifest.collect()]
    for doc_id in (0, 5, len(corpus) - 1):
        found = [x for f in files for x in lookup(f, doc_id)]
        assert found == [[*library.encode(corpus[doc_id][1] or "", add_special_tokens=False).ids, 0]]
    assert [x for f in files for x in lookup(f, 10**9)] == []


def test_shards_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    manifest = write_shards(odd_docs, BYTE, 0, path=str(tmp_path / "odd"))
    rows = read_shards(spark, str(tmp_path / "odd"), manifest)
    assert rows.count() == odd_docs.count() and rows.where("doc_id is null").count() == 5
    assert sum(len(lookup(str(tmp_path / "odd" / r.name), None)) for r in manifest.collect()) == 5
    assert write_shards(no_docs, BYTE, 0).count() == 0


def test_keys_ascend_and_bloom_holds():
    ids = [None, -(2**63), -1, 0, 1, 255, 256, 2**63 - 1]
    assert [key_of(i) for i in ids] == sorted(key_of(i) for i in ids)
    bloom = Bloom.of([key_of(i) for i in range(1000)])
    assert all(key_of(i) in bloom for i in range(1000))
    assert sum(key_of(i) in bloom for i in range(10_000, 20_000)) < 300


def test_fullest_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        left = Counter(rng.choices(range(1, 30), k=rng.randint(1, 9)))
        anchor, sums = max(left), {0}
        for length in (left - Counter([anchor])).elements():
            sums |= {s + length for s in sums}
        best = max(s for s in sums if s + anchor <= 40)
        chosen = fullest(anchor, left, 40)
        assert sum(k * n for k, n in chosen.items()) == best + anchor and not chosen - left


def test_plan_uses_each_piece_once():
    histogram = {k: (k * 7919) % 101 for k in range(1, 1025)}
    used = Counter()
    for pattern, times in plan(histogram, 1024):
        assert sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] += n * times
    assert used == Counter({k: v for k, v in histogram.items() if v})


@pytest.mark.parametrize("capacity", [64, 1024])
def test_packing(docs, corpus, capacity):
    library = Tokenizer.from_file(BYTE)
    rows = pack_documents(docs, BYTE, 2, capacity).collect()
    by_doc, by_sequence, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text, *_ in corpus:
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for i, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == capacity or i == 0
            at += r.length
        assert at == len(ids)
        total += at
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= -(-total // capacity) * 1.2 + 1


def test_packing_gives_the_ids(docs, corpus):
    library = Tokenizer.from_file(BYTE)
    pieces = {}
    for r in pack_documents(docs, BYTE, 2, 100, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    for doc_id, text, *_ in corpus:
        assert [i for _, x in sorted(pieces[doc_id]) for i in x] == [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_odd_rows(odd_docs, no_docs):
    assert pack_documents(no_docs, BYTE, 2).count() == 0
    assert pack_documents(odd_docs, BYTE, 2).select("row_no").distinct().count() == odd_docs.count()


def test_shards_are_cut_by_size(spark, docs, tmp_path):
    one, many = (str(tmp_path / x) for x in ("one", "many"))
    whole = write_shards(docs, BYTE, end_id=0, path=one)
    cut = write_shards(docs, BYTE, end_id=0, path=many, block_bytes=256, file_bytes=1500)
    assert cut.count() > 3 * whole.count()
    rows = [sorted(tuple(-1 if x is None else x for x in r) for r in read_shards(spark, f, m).collect()) for f, m in ((one, whole), (many, cut))]
    assert rows[0] == rows[1]
    start = 0
    for r in sorted(rows[1]):
        assert r[1] == start
        start += r[2]


def test_words_are_split_from_punctuation_and_encoded_without_the_pattern():
    """Each word of letters is encoded once, with whatever punctuation it comes; marks of the split in a text change nothing."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    e, texts = Encoder(path), ["One, two. One; two!\nOne two... être,\nêtre.", "it's, don't. x×. ß, ÿ: 1, 2.", "a\x01, b.\x01", "\x01,", "\x01, \n x, y", None, "", ","]
    for t, (_, ids) in zip(texts, e.each(list(range(len(texts))), pa.array(texts)), strict=True):
        assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert {"One", "two", "être", "\x01,", "\x01.", "\x01..."} <= e.places.keys() and not {"One,", "two.", "One;", "être,"} & e.places.keys()
