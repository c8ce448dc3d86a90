import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from changelens.llm import packing, texts, token_store, vocabulary

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def whole_ids(name, some, end):
    encode = Tokenizer.from_file(public_tokenizers.path(name)).encode
    return [encode(t or "", add_special_tokens=False).ids + [end] for t in some]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_those_of_whole_texts(name, odd_documents):
    some = [r.text for r in odd_documents.collect()]
    some += ["a b 　c  d\x85 e", "x≮ y", " <|endoftext|>", "tab\t\ttab \r\n end ", "¿qué?¡sí!", "1,5.7:8"]
    text, bounds = texts.utf8(pa.array(some, pa.string()))
    ids, at = vocabulary.with_end(*vocabulary.Encoder(public_tokenizers.path(name)).encode(text, bounds), 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole_ids(name, some, 2)


def test_ids_are_the_same_when_the_encoder_forgets(monkeypatch, prose):
    monkeypatch.setattr(vocabulary, "REMEMBERED", 50)
    monkeypatch.setattr(vocabulary, "ENCODED_AT_ONCE", 7)
    some = [prose(seed, 80) for seed in range(4)]
    encoder = vocabulary.Encoder(public_tokenizers.path(FILES[1]))
    for text in some:
        ids, _ = encoder.encode(*texts.utf8(pa.array([text], pa.string())))
        assert ids.tolist() + [0] == whole_ids(FILES[1], [text], 0)[0]


@pytest.mark.parametrize("name", FILES)
def test_symbols_after_letters_are_pieces_of_their_own(name):
    symbols = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~|'"
    words = ["wort", "é", "señorñ", "MAß", "x×", "y÷", "don't", "l'été", "a<\u0338b", "e\u0301", "<|endoftext|>", "n2"]
    some = [f" {w}{s}{t}" for w in words for s in symbols for t in ("", "***", "s", " x")]
    some += [f"{w}{a}{b}{w}" for w in words for a in symbols for b in symbols]
    text, bounds = texts.utf8(pa.array(some, pa.string()))
    ids, at = vocabulary.with_end(*vocabulary.Encoder(public_tokenizers.path(name)).encode(text, bounds), 2)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == whole_ids(name, some, 2)
    text, bounds = texts.utf8(pa.array([f" {w}{s}" for w in ("wort", "señorñ") for s in ("***", "###", "%%%", "?")]))
    assert len(vocabulary.tiled(text, vocabulary._cuts(text, bounds)).dictionary) == 2 + 4


def test_pieces_met_again_are_not_forgotten():
    handed = defaultdict(int)

    def encode(pieces):
        found = pieces.to_pylist()
        for p in found:
            handed[p] += 1
        return np.concatenate([np.frombuffer(p.encode(), np.uint8) for p in found]).astype(np.int32), np.array([len(p) for p in found])

    remembered = vocabulary.Remembered(encode, 40)
    for n in range(50):
        words = [" the", " of", *(f" w{n}x{i}" for i in range(10))]
        text, bounds = texts.utf8(pa.array(words))
        ids, at = remembered.ids_of(vocabulary.tiled(text, bounds))
        assert bytes(ids.astype(np.uint8)) == "".join(words).encode() and at.tolist() == bounds.tolist()
        assert len(remembered.keys) <= 40
    assert handed[" the"] == handed[" of"] == 1
    text, bounds = texts.utf8(pa.array([f" v{i}" for i in range(100)]))  # more than are remembered, twice
    for _ in range(2):
        assert bytes(remembered.ids_of(vocabulary.tiled(text, bounds))[0].astype(np.uint8)) == text.tobytes()


def test_open_windows_hold_only_their_own_ids():
    packer, ids = packing.Packer(64, 32), np.arange(1000, dtype=np.int32)
    assert not list(packer.place(1, 0, ids[:40], 40))
    assert all(x.base is None for window in packer.rest() for _, _, x, _ in window)


@pytest.mark.parametrize("name", FILES)
def test_distinct_pieces_are_encoded_many_to_a_string(name):
    handed = []
    encode = vocabulary.tokenizer(public_tokenizers.path(name)).encode_batch_fast

    def counted(some):
        handed.append(len(some))
        return [e.ids for e in encode(some, add_special_tokens=False)]

    odd = [" ", "\x01", " a\x01b", ",", "...", " it's", "'s", "\u0301a", " e\u0301", "  two", "\n\nñ", " ¿qué", "É", " x!", " <|endoftext|>", "<|endoftext|>a"]
    pieces = pa.array([f" w{i}" for i in range(2000)] + odd, pa.large_string())
    run = vocabulary.joined(counted)
    handed.clear()
    ids, lengths = run(pieces)
    assert sum(handed) < 50
    alone = [e.ids for e in encode(pieces.to_pylist(), add_special_tokens=False)]
    assert lengths.tolist() == [len(some) for some in alone] and ids.tolist() == [i for some in alone for i in some]


def test_pieces_are_encoded_alone_where_strings_would_differ():
    pieces = pa.array(["ab", " c"], pa.large_string())
    ids, lengths = vocabulary.joined(lambda some: [[*s.encode(), 0] for s in some])(pieces)
    assert ids.tolist() == [97, 98, 0, 32, 99, 0] and lengths.tolist() == [3, 3]


def test_store_holds_all_documents_in_order(spark, odd_documents):
    store = token_store.write_tokens(odd_documents, public_tokenizers.path(FILES[0]), end_id=2)
    found = sorted(store.documents().collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, -2, 3, 4, 5, 7, 7, 7, 9, 10, 11, 12]
    start = 0
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
    expected = defaultdict(list)
    source = odd_documents.collect()
    for r, ids in zip(source, whole_ids(FILES[0], [r.text for r in source], 2), strict=True):
        expected[r.doc_id].append(ids)
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    sums = {(r.start, r.n_tokens): r.ids_crc32 for r in token_store.checksums(store.documents()).collect()}
    assert sums == {(r.start, r.n_tokens): crc(r.ids) for r in found}


def test_store_of_an_empty_table(spark, odd_documents):
    store = token_store.write_tokens(odd_documents.filter("false"), public_tokenizers.path(FILES[0]), end_id=2)
    assert store.documents().count() == 0
    assert token_store.checksums(store.documents()).count() == 0


def test_store_format(spark, odd_documents, tmp_path):
    import pyarrow.parquet as pq

    token_store.write_tokens(odd_documents, public_tokenizers.path(FILES[0]), end_id=2, path=str(tmp_path / "store"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "store").glob("*.parquet")]
    columns = [g.column(i) for g in groups for i in range(g.num_columns)]
    assert all(c.has_offset_index and c.has_column_index for c in columns)
    assert all("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.path_in_schema == "n_tokens")
    assert any("RLE_DICTIONARY" in c.encodings for c in columns if c.path_in_schema.startswith("ids"))


def pieces_of(docs, length=64):
    sequences = packing.pack(docs, public_tokenizers.path(FILES[1]), end_id=0, length=length)
    return sequences.collect(), packing.placements(sequences).collect()


def test_every_id_lies_in_one_piece(odd_documents, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 2)
    sequences, pieces = pieces_of(odd_documents.repartition(7))
    source = odd_documents.collect()
    expected = sorted(map(tuple, whole_ids(FILES[1], [r.text for r in source], 0)))
    by_sequence = {s.sequence_id: s for s in sequences}
    assert len(by_sequence) == len(sequences)
    assert all(1 <= len(s.ids) <= 64 for s in sequences)
    offsets = defaultdict(list)
    for p in pieces:
        offsets[p.sequence_id].append((p.offset, p.length))
        ids = by_sequence[p.sequence_id].ids[p.offset : p.offset + p.length]
        assert crc(ids) == p.ids_crc32
    for number, places in offsets.items():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == len(by_sequence[number].ids)
    # documents that are alone with their id are put together again
    alone = {i for i in {r.doc_id for r in source} if i is not None and sum(r.doc_id == i for r in source) == 1}
    for doc_id in alone:
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        ids = [i for p in own for i in by_sequence[p.sequence_id].ids[p.offset : p.offset + p.length]]
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert tuple(ids) in expected and {p.doc_tokens for p in own} == {len(ids)}
    assert sum(p.length for p in pieces) == sum(map(len, expected))


def test_little_padding(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 20 + i * 7 % 150)) for i in range(400)], "doc_id LONG, text STRING")
    sequences, _ = pieces_of(docs, 256)
    used = sum(len(s.ids) for s in sequences)
    assert used / (256 * len(sequences)) > 0.97


def test_packing_an_empty_table(odd_documents):
    assert pieces_of(odd_documents.filter("false")) == ([], [])


def test_best_fit_and_fullest():
    packer = packing.Packer(100, 2)
    put = lambda name, n: [[(d, len(x)) for d, _, x, _ in w] for w in packer.place(name, 0, np.zeros(n, np.int32), n)]
    assert put("a", 60) == [] and put("b", 70) == []
    assert put("c", 30) == [[("b", 70), ("c", 30)]]  # the fuller of the two that it fits
    assert put("d", 90) == []
    assert put("e", 45) == [[("d", 90), ("e", 10)]]  # the fullest is filled and emitted, the rest placed again
    assert [[(d, len(x)) for d, _, x, _ in w] for w in packer.rest()] == [[("a", 60), ("e", 35)]]
