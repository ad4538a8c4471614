import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from sentrylake.llm import wavelet
from sentrylake.llm.queries import op11_wavelet_ids

from . import cases
from .test_tokens import noise

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, texts):
    return [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]


def expected(library, rows):
    """Of rows in order."""
    out, at = [], 0
    for (i, _), ids in zip(rows, encoded(library, [t or "" for _, t in rows]), strict=True):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_ids_are_the_librarys(library, monkeypatch):
    texts = [*noise(3000, 5), "a b\nc  d\n\ne", " x\ny z ", "\n", " ", "", "one", "don't\nwe'll go", "a" * 1000 + " b\n" * 50, "<|endoftext|> a<|endoftext|>\nb", "x\x1cy z", "é　中 文 a b", "tab\tb c"]
    encode = wavelet.LibraryIds(PATH)
    want = [ids[:-1] for ids in encoded(library, texts)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == want
    monkeypatch.setattr(wavelet, "KEPT", 10)
    for at in range(0, len(texts), 40):
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts[at : at + 40])] == want[at : at + 40]


def test_words_are_asked_of_the_model_by_matches_once(library, monkeypatch):
    """Every character up to U+0180 beside letters, numbers and marks; the library encodes no such text whole."""
    chars = [chr(i) for i in range(1, 0x180) if not chr(i).isspace()]
    texts = [f"a{c}b {c}{c}1 x{c} {c} it{c}s '{c} {c}\n{c}, we've{c}" for c in chars] + ["it's he'll, I'd; we'S 'tis\n'twas ... don't", "word word, word. word", "one"]
    want = [ids[:-1] for ids in encoded(library, texts)]
    encode = wavelet.LibraryIds(PATH)
    matches, ask = [], encode.asked
    monkeypatch.setattr(encode, "asked", lambda m: [matches.extend(m), ask(m)][1])
    monkeypatch.setattr(encode, "encoded", lambda _: pytest.fail("a text was encoded whole"))
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == want
    assert len(matches) == len(set(matches)) and " word" in matches
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts[::-1])] == want[::-1] and len(matches) == len(set(matches))
    monkeypatch.setattr(wavelet, "KEPT", 0)
    for t in ("some other words", "word, word", "some words, it's"):  # from the older words, and others again
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == encoded(library, [t])[0][:-1]


def test_slices_of_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(wavelet, "TEXTS", 10)
    texts = ["", "abc", "é" * 20, "x", "y" * 9, "z", "", "w"]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    got = list(wavelet.short([batch.slice(0, 0), batch, batch.slice(3)]))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts + texts[3:] and len(got) > 4


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_parted_and_mixed(monkeypatch, n):
    monkeypatch.setattr(wavelet, "NEAR", 8)
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 16, n).astype(np.uint16)
    for share in (0, 0.3, 1):
        bits = rng.random(n) < share
        parted = wavelet.parted(a, bits)
        assert parted.tolist() == [*a[~bits], *a[bits]] and wavelet.mixed(parted, bits).tolist() == a.tolist()


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="spaces"):
        wavelet.LibraryIds(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1023, 1024, 1025, 5000])
def test_planes(n):
    rng = np.random.default_rng(n)
    for share in (0, 0.03, 0.5, 1):
        bits = rng.random(n) < share
        plane = wavelet.Plane.of(bits)
        assert (plane.all() == bits).all()
        if n:
            ones, at = plane.rank(np.arange(n + 1))
            assert (ones == np.concatenate([[0], np.cumsum(bits)])).all() and (at[:-1] == bits).all()
        for value in (0, 1):
            where = np.flatnonzero(bits == value)
            if len(where):
                assert (plane.select(value, np.arange(len(where))) == where).all()


@pytest.mark.parametrize("kinds,n", [(1, 50), (2, 3000), (700, 20_000), (70_000, 200_000)])
def test_shards_answer_as_the_plain_array(kinds, n):
    rng = np.random.default_rng(kinds)
    ids = (rng.zipf(1.3, n) % kinds).astype("<u4") if kinds < 5000 else rng.permutation(np.arange(n) % kinds).astype("<u4")
    cuts = np.sort(rng.integers(0, n, 20))
    docs = [b.tobytes() for b in np.split(ids, cuts)]
    shard = wavelet.Shard(wavelet.shard_bytes([None, *range(20)], docs))
    assert shard.doc_ids == [None, *range(20)] and shard.starts.tolist() == [0, *cuts, n]
    assert (shard.ids() == ids).all()
    at = rng.integers(0, n, 200)
    assert (shard.access(at) == ids[at]).all()
    for token in [*np.unique(ids)[:30].tolist(), kinds + 5]:
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        where = np.flatnonzero(ids == token)
        assert shard.count(token) == len(where) and (shard.positions(token) == where).all()
        inside = where[(where >= low) & (where < high)]
        assert shard.count(token, low, high) == len(inside) and (shard.positions(token, low, high) == inside).all()


def test_files_are_smaller_than_the_ids_and_damage_is_seen(library):
    rng = random.Random(1)
    docs = [np.array(ids, "<u4").tobytes() for ids in encoded(library, [cases.words(400, rng.random()) for _ in range(100)])]
    data = wavelet.shard_bytes(list(range(100)), docs)
    assert len(data) < sum(map(len, docs)) / 3
    for at in (0, 9, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            wavelet.Shard(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        wavelet.Shard(data[:-9])


def test_query(spark, sf, library):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: r[0])
    assert sorted(map(tuple, op11_wavelet_ids(spark, sf).collect())) == expected(library, rows)


def test_awkward_rows(spark, library):
    """Nulls, repeats and ties of doc_id, a text of 1 MB, many shards a task; then look-ups in the files."""
    rows = [r for r in cases.rows() if r[0] is not None] + [(None, "no id", *[None] * 3, *cases.CLASH), (500, "ab " * 350_000, *[None] * 3, *cases.CLASH)]
    frame = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    path = wavelet.scratch(spark, "shards-test")
    files = wavelet.stored(wavelet.with_starts(wavelet.stored(wavelet.write_shards(frame, path, PATH, shard=3000), "written")), "files")
    got = sorted(map(tuple, wavelet.read_shards(files, path).collect()), key=lambda r: r[1])
    plain = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = expected(library, plain)
    assert len(plain) == len(set(r[0] for r in plain)) + 2 and got == want and files.count() > 5
    assert sum(f.tokens for f in files.collect()) == want[-1][1] + want[-1][2]
    assert all(fs.FileSystem.from_uri(path)[0].get_file_info(f.path).size == f.bytes for f in files.collect())
    all_ids = {i: ids for (i, _), ids in zip(plain, encoded(library, [t or "" for _, t in plain]), strict=True)}
    tokens = [0, all_ids[5][3], 397, 60_000]
    where = [(t, i, k) for i, ids in all_ids.items() for k, x in enumerate(ids) for t in tokens if x == t and i != 49]
    found = wavelet.occurrences(files, path, tokens, most=100)
    assert sorted(map(tuple, found.where("doc_id is null or doc_id <> 49").collect()), key=str) == sorted(where, key=str)
    flat = [x for _, t in plain for x in encoded(library, [t or ""])[0]]
    assert {r.token: r.n for r in wavelet.token_counts(files, path, tokens).collect()} == {t: flat.count(t) for t in tokens}
    assert wavelet.round_trip(spark, cases.empty(spark), PATH).count() == 0
