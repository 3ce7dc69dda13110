import functools
import struct
import zlib

import pytest
from brookspan.llm import packing as P
from brookspan.llm import sstable as S
from brookspan.llm.tokens import Encoder, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
PIECES = st.lists(st.sampled_from(["the", " ", "\n", "  ", ".", ",", "..", "Foo", "<|", "<|startoftext|>", "don't", "é", "á", "\t", " ", "3.14", "ß", "<|endoftext|>", "\x01", "你好", "x,y", "$$$", "Σ"]), max_size=14).map("".join)


@functools.cache
def plain(name):
    """The library's own tokenizer, as anyone loads it."""
    return Tokenizer.from_file(tokenizer_path(name))


@functools.cache
def _made(name, keeps):
    return Encoder(tokenizer_path(name), keeps)


def plain_ids(name, text):
    ids = plain(name).encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize(("name", "keeps"), KINDS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(PIECES, st.text(max_size=20)), max_size=4))
def test_memoised_ids_are_the_librarys(name, keeps, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids = _made(name, keeps)
    assert ids.encode(texts) == [plain_ids(name, t) for t in texts]


def test_memo_is_bounded_and_still_right(monkeypatch):
    monkeypatch.setattr("brookspan.llm.tokens.MEMO_PIECES", 3)
    ids = Encoder(tokenizer_path(KINDS[0][0]), True)
    texts = ["one two three, four five. six", "seven one\neight nine"]
    for _ in range(3):
        for n in range(20):
            assert ids.encode([*texts, f"one w{n}"]) == [plain_ids(KINDS[0][0], t) for t in [*texts, f"one w{n}"]]
            assert max(map(len, ids.fine + ids.coarse)) <= 3 + 20  # one call's pieces beyond the bound


def truth(docs, name, keeps, end):
    return sorted(((r.doc_id, plain_ids(name, r.text or "") + struct.pack("<I", end)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))


def test_shards_round_trip(odd_documents, no_documents, monkeypatch):
    folder = S.shard_folder(odd_documents)
    found = S.read_shards(S.write_shards(odd_documents, folder), folder).collect()
    want, start = truth(odd_documents, *KINDS[0], 0), 0
    got = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in found), key=lambda x: x[1])
    for (doc_id, ids), have in zip(want, got, strict=True):
        assert have == (doc_id, start, ids)
        start += len(ids) // 4
    empty = S.shard_folder(no_documents)
    assert S.read_shards(S.write_shards(no_documents, empty), empty).count() == 0


@given(st.lists(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), max_size=60), st.integers(40, 4000))
@settings(deadline=None, max_examples=40)
def test_lookup_by_filter_index_and_block(ids, size):
    ids.sort(key=lambda i: (i is not None, i or 0))
    writer = S.ShardWriter()
    for n, i in enumerate(ids):
        writer.add(i, struct.pack("<I", n) * (n % 5))
        if len(writer.block) >= size:
            writer._close()
    shard = S.Shard(writer.finish())
    assert [i for i, _ in shard] == ids
    for i in set(ids):
        assert shard.get(i) == [struct.pack("<I", n) * (n % 5) for n, j in enumerate(ids) if j == i]
    assert shard.get(12345) == [] or 12345 in ids


def test_damaged_shard():
    data = bytearray(S.ShardWriter().finish())
    data[-1] ^= 1
    with pytest.raises(ValueError):
        S.Shard(bytes(data))


@given(st.lists(st.integers(1, 64), max_size=200))
def test_first_fit_decreasing_is_first_fit(lengths):
    got = P.first_fit_decreasing(lengths, 64)
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        place = next((b for b, used in enumerate(bins) if used + lengths[i] <= 64), None)
        if place is None:
            place = len(bins)
            bins.append(0)
        assert got[i] == (place, bins[place])
        bins[place] += lengths[i]


def test_packed_pieces_are_whole_and_gapless(odd_documents, no_documents):
    rows = P.pack(odd_documents, length=64, group_bytes=20_000).collect()
    whole = {}
    for doc_id, ids in truth(odd_documents, *KINDS[1], 2):
        for start in range(0, len(ids) // 4, 64):
            key = doc_id, start, zlib.crc32(ids[4 * start : 4 * start + 256]), len(ids) // 4
            whole[key] = whole.get(key, 0) + 1
    sequences = {}
    for r in rows:
        key = r.doc_id, r.start, zlib.crc32(bytes(r.ids)), r.doc_tokens
        whole[key] -= 1
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert not any(whole.values())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert P.pack(no_documents).count() == 0


def test_rows_of_one_identifier_are_spread_over_groups(spark, monkeypatch):
    """Empty texts without identifiers fill no group beyond its bound, and every piece keeps its place."""
    monkeypatch.setattr(P, "GROUP_ROWS", 50)
    rows = P.pack(spark.createDataFrame([(None, None)] * 400, "doc_id long, text string"), length=8).collect()
    assert len(rows) == 400 and {(r.start, r.length, bytes(r.ids)) for r in rows} == {(0, 1, struct.pack("<I", 2))}
    assert len({(r.sequence_id, r.offset) for r in rows}) == 400 and len({r.sequence_id >> 31 for r in rows}) == 8


def test_a_word_is_encoded_once_and_as_the_library_does():
    """A word after a line feed or in a text cut at blanks only is not handed to the library again; odd words keep their ids."""
    name = "word_bpe_49k.json"
    made, handed = Encoder(tokenizer_path(name), False), []
    words = made._words
    made._words = lambda some, lead: handed.extend(some) or words(some, lead)
    texts = ["first alpha beta\nalpha gamma", "other .. alpha\nbeta gamma", "odd İx ² Ⅷ straße ﬁn Ǆx naïve 你好 xⅧy"]
    for text in texts:
        assert made.encode([text])[0] == plain_ids(name, text)
    assert len(handed) == len(set(handed)) and {"alpha", "beta"} <= set(handed)


@pytest.mark.parametrize(("name", "keeps"), KINDS)
def test_texts_with_marks_are_cut_as_finely(name, keeps):
    """Words before and after marks are known pieces, and no text goes to the coarser cut; where marks forbid that, ids are right too."""
    made = Encoder(tokenizer_path(name), keeps)
    texts = ["alpha the!!. beta*** gamma, .delta&&&, a_. b", "alpha of%%%\nbeta.*** x!!.y gamma,&&&", "a b!.c\n.d e", "a b! .c d", "a b!  c", "a b!\n\nc", "a é_,ß² it's.'s b$"]
    assert made.encode(texts) == [plain_ids(name, t) for t in texts]
    made.coarse[:] = {}, {}
    assert made.encode(texts[1:2]) == [plain_ids(name, texts[1])]
    assert not any(made.coarse)
