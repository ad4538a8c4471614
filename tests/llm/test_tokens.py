import array
import json
import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sentrylake.llm import byte_bpe, packing, token_counts
from sentrylake.llm.queries import op3_packing, op6_token_counts, op7_byte_bpe

from . import cases

PARTS = [*"abcdefgThéßÉÇ 'stmdreveLL\n\t0123½Ⅷ!?.,#’“—中文字日本かİΣςé  \U0001f600Жж", "\x85", "\xa0", "é", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", "don't", " '", "''s", "  ", " x", "y "]


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(P.path("word_bpe_49k.json"))


def test_transducer_counts_as_the_library(counter):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*noise(3000, 1), "a" * 5000, "ab" * 3000 + " x", "", " ", "\n", "'", "th" * 9000, "!" * 2000, "<|startoftext|>" * 3]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts).tolist() == want


def test_chunks_compose_whatever_their_number(counter):
    symbols, _ = counter.symbols(" ".join(["abcabc" * 50, "the quick", "x" * 700, "éa'll"]) + "\n")
    whole = counter.machine.gains(symbols, lanes=1)
    for lanes in (2, 3, 7, 50, 400):
        assert (counter.machine.gains(symbols, lanes) == whole).all()


@pytest.mark.parametrize("guesses", [24, 1])
def test_state_maps_of_words_over_many_chunks(counter, monkeypatch, guesses):
    """Words of many chunks: the scan finds each chunk's entry state, also where the guesses miss it."""
    monkeypatch.setattr(token_counts, "GUESSES", guesses)
    rng = random.Random(11)
    words = ["".join(rng.choice(kinds) for _ in range(n)) for kinds, n in (("z", 9001), ("ab", 8000), ("abcdefghijklmnopqrstuvwxyz", 12_000), ("ha", 70), ("the", 3001), ("é中a", 2000))]
    text = " ".join(words) + "\n"
    symbols, _ = counter.symbols(text)
    whole = counter.machine.gains(symbols, lanes=1)
    for lanes in (8, 100, 500):
        assert (counter.machine.gains(symbols, lanes) == whole).all()
    n = len(Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert whole.sum(dtype=int) == n


def test_other_files_are_refused(tmp_path):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="normalizer"):
        token_counts.TokenCounter(str(tmp_path / "other.json"))


def test_long_texts_are_counted_in_pieces(counter, monkeypatch):
    text = " ".join(noise(200, 5))
    want = counter.counts([text]).tolist()
    monkeypatch.setattr(token_counts, "PIECE", 50)
    assert len(counter.pieces(text)) > 20 and counter.counts([text]).tolist() == want


def test_states_can_be_forgotten(counter, monkeypatch):
    texts = noise(50, 9)
    want = counter.counts(texts).tolist()
    monkeypatch.setattr(token_counts, "MOST_STATES", 1)
    assert counter.counts(texts).tolist() == want


def test_count_query(spark, sf):
    got = {r.doc_id: r for r in op6_token_counts(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode_batch([d.text for d in docs], add_special_tokens=False)
    assert all((got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (len(e.ids), len(d.text.encode()), len(e.ids) > 2048) for d, e in zip(docs, want, strict=True))
    rows = token_counts.token_counts(cases.frame(spark), P.path("word_bpe_49k.json")).collect()
    assert len(rows) == len(cases.rows()) and {r.n_tokens for r in rows if r.doc_id in (40, 41, 42)} == {0}
    assert token_counts.token_counts(cases.empty(spark), P.path("word_bpe_49k.json")).count() == 0


RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_round_trip_query(spark, sf):
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    got = {r.doc_id: r for r in op7_byte_bpe(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, r = bpe.library.encode_ordinary(d.text), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    rows = byte_bpe.round_trip(cases.frame(spark), RANKS, P.PATTERN).collect()
    assert len(rows) == len(cases.rows()) and {r.n_tokens for r in rows if r.doc_id in (40, 41)} == {0}
    assert byte_bpe.round_trip(cases.empty(spark), RANKS, P.PATTERN).count() == 0


def test_long_texts_split_only_where_it_is_safe(monkeypatch):
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    texts = [*noise(300, 3), "word " * 300, "a" * 900, " " * 900, "x \n  y" * 100, "ab cd" * 200]
    want = [bpe.library.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "LONG", 40)
    assert [bpe.encode(t) for t in texts] == want
    assert all(bpe.decode(w) == t.encode() for w, t in zip(want, texts, strict=True))


def test_columns_round_trip(spark):
    docs = cases.frame(spark).select("text")
    ids = byte_bpe.encode_column(docs.text, RANKS, P.PATTERN)
    rows = docs.select("text", byte_bpe.decode_column(ids, RANKS, P.PATTERN).alias("back")).collect()
    assert all(bytes(r.back) == (r.text or "").encode() for r in rows)


def test_one_long_match():
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    rng = random.Random(4)
    text = "".join(rng.choice("abcdeé") for _ in range(200_000))  # a single match, far over LONG
    assert bpe.decode(bpe.encode(text)) == text.encode() and len(bpe.encode(text[:70_000])) == len(bpe.library.encode_ordinary(text[:70_000]))


def test_kept_words_give_the_library_ids():
    ids = packing.TokenIds(P.path("byte_bpe_50k.json"), P.PATTERN)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in [*noise(2000, 8), " lead", "trail ", "a  b", "\n a", "x\n"]:
        assert list(array.array("I", ids(t))) == library.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, docs, capacity=2048):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // capacity) and all(r.length == capacity for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(array.array("I", ids[r.start : r.start + r.length]).tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, sf):
    rows = op3_packing(spark, sf).collect()
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n = check_packing(rows, docs)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_awkward_rows_and_several_rounds(spark, monkeypatch):
    unique = cases.frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    docs = [(d.doc_id, d.text) for d in unique.collect()]
    args = P.path("byte_bpe_50k.json"), P.PATTERN
    one = check_packing(packing.pack(unique, *args).collect(), docs)
    monkeypatch.setattr(packing, "SHARD", 10)
    assert check_packing(packing.pack(unique, *args).collect(), docs) <= one + 3
    assert packing.pack(cases.frame(spark), *args).select("doc_id", "piece").count() >= len(cases.rows())
    assert packing.pack(cases.empty(spark), *args).count() == 0


def test_local_search_never_loses_and_often_gains():
    rng = random.Random(6)
    gained = 0
    for case in range(60):
        lengths = [rng.choice((rng.randint(500, 1100), rng.randint(200, 700), rng.randint(600, 760))) for _ in range(rng.randint(0, 120))]
        plain, found = packing.best_fit([(n, i) for i, n in enumerate(lengths)], 2048), packing.packed(lengths)
        assert sorted(i for b in found for _, i in b) == list(range(len(lengths)))
        assert all(sum(n for n, _ in b) <= 2048 and all(lengths[i] == n for n, i in b) for b in found)
        assert len(found) <= len(plain)
        gained += len(found) < len(plain)
    assert gained


def test_search_closes_the_gap_where_best_fit_misses_the_bound():
    """Lengths of 500 to 1000: best fit is over a tenth above the least number of sequences; the search gains a third of that."""
    rng = random.Random(2)
    lengths = [rng.randint(500, 1000) for _ in range(3000)]
    bound, plain, found = -(-sum(lengths) // 2048), len(packing.best_fit([(n, i) for i, n in enumerate(lengths)], 2048)), len(packing.packed(lengths))
    assert plain - found >= (plain - bound) / 4


def test_two_for_one_finds_the_best_pair():
    rng = random.Random(8)
    for _ in range(200):
        pool = [(rng.randint(1, 60), i) for i in range(rng.randint(0, 9))]
        low, high = sorted((rng.randint(0, 70), rng.randint(0, 70)))
        sums = [a[0] + b[0] for i, a in enumerate(pool) for b in pool[:i] if low < a[0] + b[0] <= high]
        got = packing.Search(pool, 64).two(low, min(high, 64))
        best = max((x for x in sums if x <= 64), default=None)
        assert (sum(got) if got else None) == best


def test_every_code_point_counts_as_in_the_library(counter):
    """Alone, in a word, before marks of other classes and after one: letters, numbers, lower case and composition are
    those of the library's version of Unicode."""
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for low in range(0, 0x110000, 8192):
        points = [chr(c) for c in range(low, low + 8192) if not 0xD800 <= c < 0xE000]
        for form in ("{}", "ab{}c1 x") if 0x40000 <= low < 0xE0000 or low > 0xE1000 else ("{}", "ab{}c1 x", "{}̣̇", "A̴{}é"):
            texts = [form.format(c) for c in points]
            want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)] if texts else []
            assert counter.counts(texts).tolist() == want, (hex(low), form)


def test_long_words_in_bounded_memory(counter, monkeypatch):
    """Words of a megabyte, and many that make more states than are kept: the counts are right, the states few."""
    library, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    monkeypatch.setattr(token_counts, "MOST_STATES", 3000)
    monkeypatch.setattr(token_counts, "MOST_PAIRS", 5000)
    texts = ["z" * 1_000_000, "ab" * 600_000 + " the end", word(60_000) + " x " + word(30_000), " ".join(word(500) for _ in range(60)), "the quick brown fox", word(17_000), ""]
    assert counter.counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(counter.machine.states) <= 3001 and len(counter.machine.valid) <= 5000 and len(counter.machine.next) <= 4096
    counter.machine.clear()
