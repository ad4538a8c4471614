"""Token ids in files that are wavelet matrices.

Documents are sorted by id over ranges; a task encodes its range and writes shards, one file for about SHARD ids of
whole documents. A shard's ids are numbered by how often they occur in it (the alphabet), and the numbers are stored
bit by bit, from the highest: plane k holds bit k of all numbers, in the order in which those before it have put them
(zeros first, then ones, each as they were). A plane is cut into blocks of 16 bits; of a block, its number of ones (the
class, five bits) and its place among the patterns of that class (as many bits as the class needs) are stored, and for
each 64 blocks how many ones and bits come before. So a rank reads 64 classes and one block, a select searches the
counts first, and frequent or clustered bits take little room. From one compressed file,

* `access` gives the id at any position, by a rank a plane;
* `count` how often an id occurs between two positions, likewise;
* `positions` where it occurs, by a select a plane, from the lowest;
* `ids` all of them, plane by plane without a rank.

A file: MAGIC, the size of a JSON header and that header (numbers of documents and ids, sizes of the sections), the
sections, a check sum of all before it.

Ids come from the tokenizers library. Texts are cut where no match of the pattern can span, between a character that
isn't white space and a space that is followed by another; a worker keeps the words with their ids, looks up a batch's
distinct words once, and puts the ids of all its words together by their numbers. Words that it hasn't seen are cut
into the pattern's matches and those asked of the library's model, each once; words with characters whose class could
differ, or with an added token, go through the library whole, many at once, on lines of their own.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._shared import prepare, scratch, stored, text_bytes
from .token_counts import byte_letters

MAGIC = b"WAVELET1"
#: Ids of a shard, bytes of text of a task that writes; files up to which each has a task that reads, and of a task beyond.
SHARD, TASK_BYTES, ALONE, FILES = 1 << 21, 16 << 20, 4096, 16
#: Words kept with their ids by a worker (as many older ones beside them), new words that the library gets at once, and bytes of texts whose words are told apart at once.
KEPT, ASKED, TEXTS = 600_000, 5_000, 8 << 20
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Of words between NULs: other white space than single line feeds inside and a space at the end, and no word at all.
ODD = re.compile(r"[^\S\n ]|\n[\n \0]|\0[\n \0]| [^\0]")
#: Matches of the pattern in words whose characters are before U+0180, letters and numbers of every Unicode version alike.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
MATCH = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
BEYOND = re.compile(r"[^\x01-ſ]")
#: None of these is white space, a letter or a number.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
WRITTEN = "path string, task int, place int, docs long, tokens long, bytes long"


class LibraryIds:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers, as the library's encode gives them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        file = json.loads(self.library.to_str())
        pre = file["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or file["normalizer"] is not None:
            raise ValueError(f"{path}: words can't be told apart at spaces")
        if any(" " in a["content"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in file["added_tokens"]):
            raise ValueError(f"{path}: an added token spans words")
        if (line := self.library.token_to_id("Ċ")) is None:
            raise ValueError(f"{path}: it has no line feed")
        if file["model"]["type"] != "BPE" or file["model"]["dropout"]:
            raise ValueError(f"{path}: its model isn't byte-pair merges alone")
        self.line, self.model = line, self.library.model
        self.added = re.compile("|".join(re.escape(a["content"]) for a in file["added_tokens"]) or r"(?!)")
        self.shown = np.zeros(256, "<u4")  # of each byte the letter that the model knows it by; NULs part matches
        for letter, byte in byte_letters().items():
            self.shown[byte] = ord(letter)
        self.shown[0] = ord(" ")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def asked(self, matches: list[str]) -> list[bytes]:
        """The ids of matches of the pattern, by the library's model."""
        raw = np.frombuffer("\0".join(matches).encode(), np.uint8)
        shown = self.shown[raw].tobytes().decode("utf-32-le").split(" ") if matches else []
        return [array("I", [t.id for t in self.model.tokenize(x)]).tobytes() for x in shown]

    def learn(self, words: list[str]) -> None:
        """Keep the ids of words; a first word ends with a space and has none before it. What isn't a word between single
        spaces is kept as None. Matches after a space are kept as the words they are, others (`tails`) apart."""
        joined = "\0".join(["", *words, ""])
        if ODD.search(joined):
            bad = [w for w in words if ODD.search(f"\0{w}\0")]
            self.kept.update(dict.fromkeys(bad))
            words = list(set(words).difference(bad))
        if BEYOND.search(joined.replace("\0", "")) or self.added.search(joined):
            whole = [w for w in words if BEYOND.search(w) or self.added.search(w)]
            self.learn_whole(whole)
            words = list(set(words).difference(whole))
        alone, ended, stems, ends, other = set(), [], [], [], []
        for w in words:
            if w.isalpha():
                alone.add(w)
            elif (stem := w.rstrip(MARKS)).isalpha():
                ended.append(w)
                stems.append(stem)
                ends.append(w[len(stem) :])
            else:
                other.append(w)
        cut = [MATCH.findall(w[:-1] if w[-1] == " " else f" {w}") for w in other]
        alone.update([w for w in stems if w not in self.kept], [m[1:] for ms in cut for m in ms if m[0] == " " and m[1:] not in self.kept])
        self.kept.update(zip(alone, self.asked([f" {w}" for w in alone]), strict=True))
        tails = {m for ms in (ends, *cut) for m in ms if m[0] != " " and m not in self.tails}
        self.tails.update(zip(tails, self.asked(list(tails)), strict=True))
        for w, stem, end in zip(ended, stems, ends, strict=True):
            self.kept[w] = self.kept[stem] + self.tails[end]
        for w, ms in zip(other, cut, strict=True):
            self.kept[w] = b"".join([self.kept[m[1:]] if m[0] == " " else self.tails[m] for m in ms])

    def learn_whole(self, words: list[str]) -> None:
        """Keep the ids of words, each a line of a text that the library gets."""
        for at in range(0, len(words), ASKED):
            chunk = words[at : at + ASKED]
            lines = [w[:-1] if w[-1] == " " else f" {w}" for w in chunk]
            text = "\n".join(lines)
            ids = self.encoded([text + "\n"])[0]
            ends = 4 * np.flatnonzero(ids == self.line)
            if len(ends) > len(chunk):  # line feeds inside words
                ends = ends[np.cumsum([x.count("\n") + 1 for x in lines]) - 1]
            raw, begin = ids.tobytes(), 0
            for w, end in zip(chunk, ends.tolist(), strict=True):
                self.kept[w] = raw[begin:end]
                begin = end + 4

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        words = cut.flatten().dictionary_encode()
        starts = np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])
        names, place = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().copy()
        firsts = [names[i] + " " for i in place[starts[:-1]].tolist()]
        place[starts[:-1]] = len(names) + np.arange(len(texts))
        names += firsts
        known, odd = list(map(self.kept.get, names)), []
        if None in known:
            if len(self.kept) > KEPT:  # the words so far are the older ones, until as many are kept again
                self.older, self.kept, self.tails = self.kept, {w: b for w, b in zip(names, known, strict=True) if b is not None}, {}
            new = [k for k, b in enumerate(known) if b is None]
            again = [(names[k], b) for k in new if (b := self.older.get(names[k])) is not None]
            self.kept.update(again)
            self.learn(list({names[k] for k in new}.difference([w for w, _ in again])))
            for k in new:
                known[k] = self.kept[names[k]]
        if None in known:
            lacks = np.array([b is None for b in known])
            odd = np.flatnonzero(np.logical_or.reduceat(lacks[place], starts[:-1])).tolist()
            known = [b or b"" for b in known]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin, n = np.cumsum(size) - size, size[place]
        end = np.cumsum(n)
        at = np.repeat(begin[place] - (end - n), n)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(known), "<u4")[at].tobytes()
        out, at = [], 0
        for hi in (4 * end[starts[1:] - 1]).tolist():
            out.append(ids[at:hi])
            at = hi
        for k in odd:
            text = texts[k].as_py()
            out[k] = b"".join(x.tobytes() for x in self.encoded(SAFE.split(text))) if text else b""
        return out


@lru_cache(maxsize=2)
def load(path: str) -> LibraryIds:
    return LibraryIds(path)


#: Of all patterns of 16 bits: ones, place among those with as many ones; by class: first pattern in ORDER, bits of a place.
ONES = np.array([p.bit_count() for p in range(1 << 16)], np.uint8)
ORDER = np.argsort(ONES, kind="stable").astype(np.uint16)
FIRST = np.searchsorted(ONES[ORDER], np.arange(18))
PLACE = np.empty(1 << 16, np.uint16)
PLACE[ORDER] = np.arange(1 << 16) - FIRST[ONES[ORDER]]
BITS = np.array([int(n - 1).bit_length() for n in np.diff(FIRST)], np.int64)
BLOCK, SUPER = 16, 64
FIVE = np.arange(0, 40, 5, dtype=np.uint64)
U = np.uint64


class Plane:
    """A succinct sequence of bits: classes (five bits each), places (bit string in 32-bit words), and how many ones and
    bits of places come before each 64 blocks."""

    def __init__(self, n: int, classes: np.ndarray, words: np.ndarray, ones: np.ndarray, bits: np.ndarray):
        self.n, self.classes, self.words, self.ones, self.bits = n, classes, words, ones, bits

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        """Of an array of booleans; it is filled up with zeros to whole superblocks."""
        raw = np.packbits(bits)
        blocks = np.zeros(-(-len(bits) // (BLOCK * SUPER)) * SUPER, ">u2")
        blocks.view(np.uint8)[: len(raw)] = raw
        blocks = blocks.astype(np.uint16)
        c = ONES[blocks]
        width = BITS[c]
        end = np.cumsum(width)
        at = end - width
        value = PLACE[blocks].astype(U) << (at & 31).astype(U)
        word = at >> 5
        total = int(end[-1]) if len(end) else 0
        words = np.zeros(total // 32 + 2, U)
        if len(word):
            cut = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[cut]] = np.add.reduceat(value, cut)
        carried = words & U(0xFFFFFFFF)
        carried[1:] += words[:-1] >> U(32)
        packed = (c.reshape(-1, 8).astype(U) << FIVE).sum(1, dtype=U).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        counts = np.cumsum(c, dtype=np.int64)[SUPER - 1 :: SUPER]
        before = lambda x: np.concatenate([[0], x[:-1]]).astype("<u4") if len(x) else np.zeros(0, "<u4")
        return cls(len(bits), np.ascontiguousarray(packed).ravel(), carried.astype("<u4"), before(counts), before(end[SUPER - 1 :: SUPER]))

    @staticmethod
    def unpacked(classes: np.ndarray) -> np.ndarray:
        eight = np.zeros((classes.size // 5, 8), np.uint8)
        eight[:, :5] = classes.reshape(-1, 5)
        return ((eight.view("<u8") >> FIVE) & U(31)).astype(np.uint8).reshape(classes.shape[:-1] + (-1,))

    def patterns(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The blocks of classes c whose places begin at bits `at`."""
        word, width = at >> 5, BITS[c]
        two = self.words[word].astype(U) | (self.words[word + 1].astype(U) << U(32))
        place = (two >> (at & 31).astype(U)) & ((U(1) << width.astype(U)) - U(1))
        return ORDER[FIRST[c] + place.astype(np.int64)]

    def all(self) -> np.ndarray:
        """Every bit."""
        c = self.unpacked(self.classes)
        width = BITS[c]
        return np.unpackbits(self.patterns(c, np.cumsum(width) - width).astype(">u2").view(np.uint8), count=self.n).view(bool)

    def superblock(self, s: np.ndarray) -> np.ndarray:
        return self.unpacked(self.classes.reshape(-1, 40)[s])

    def block(self, s: np.ndarray, c: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """The bit pattern of block `inner` of each superblock s of classes c."""
        ahead = np.arange(SUPER) < inner[:, None]
        return self.patterns(c[np.arange(len(s)), inner], self.bits[s].astype(np.int64) + (BITS[c] * ahead).sum(1))

    def rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ones come before each position, and the bit there (0 at the end)."""
        i = np.asarray(i, np.int64)
        inside = i < len(self.ones) * BLOCK * SUPER
        j = np.where(inside, i, max(self.n - 1, 0))
        s, inner = j // (BLOCK * SUPER), j // BLOCK % SUPER
        c = self.superblock(s)
        pattern = self.block(s, c, inner).astype(np.int64)
        ahead = (c * (np.arange(SUPER) < inner[:, None])).sum(1, dtype=np.int64)
        upto = self.ones[s].astype(np.int64) + ahead + ONES[pattern >> (BLOCK - j % BLOCK) & 0xFFFF]
        bit = (pattern >> (BLOCK - 1 - j % BLOCK)) & 1
        return np.where(inside, upto, upto + bit), np.where(inside, bit, 0)

    def select(self, value: int, j: np.ndarray) -> np.ndarray:
        """The position of the j-th bit (from 0) that is `value`; there must be one."""
        j = np.asarray(j, np.int64)
        starts = np.arange(len(self.ones)) * (BLOCK * SUPER)
        before = self.ones.astype(np.int64) if value else starts - self.ones
        s = np.searchsorted(before, j, side="right") - 1
        c = self.superblock(s)
        count = c.astype(np.int64) if value else BLOCK - c.astype(np.int64)
        left = j - before[s]
        upto = np.cumsum(count, 1)
        inner = (upto <= left[:, None]).sum(1)
        left = left - np.where(inner > 0, upto[np.arange(len(s)), inner - 1], 0)
        pattern = self.block(s, c, inner)
        bits = np.unpackbits(pattern.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1) == value
        return s * (BLOCK * SUPER) + inner * BLOCK + (np.cumsum(bits, 1) <= left[:, None]).sum(1)


#: Numbers that are dealt out, or put back, at once: they stay in a processor's cache.
NEAR = 1 << 16


def parted(a: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The numbers whose bit is unset, then the others, each as they were."""
    out = np.empty_like(a)
    zero, one = 0, len(a) - np.count_nonzero(bits)
    for at in range(0, len(a), NEAR):
        some, b = a[at : at + NEAR], bits[at : at + NEAR]
        ones, zeros = np.flatnonzero(b), np.flatnonzero(~b)
        out[zero : zero + len(zeros)], out[one : one + len(ones)] = some[zeros], some[ones]
        zero, one = zero + len(zeros), one + len(ones)
    return out


def mixed(a: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """What `parted` made into `a`."""
    out = np.empty_like(a)
    zero, one = 0, len(a) - np.count_nonzero(bits)
    for at in range(0, len(a), NEAR):
        some, b = out[at : at + NEAR], bits[at : at + NEAR]
        ones, zeros = np.flatnonzero(b), np.flatnonzero(~b)
        some[zeros], some[ones] = a[zero : zero + len(zeros)], a[one : one + len(ones)]
        zero, one = zero + len(zeros), one + len(ones)
    return out


def matrix(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The alphabet, most frequent first, and the planes' bits."""
    count = np.bincount(ids)
    found = np.flatnonzero(count)
    alphabet = found[np.argsort(-count[found], kind="stable")].astype("<u4")
    number = np.zeros(len(count), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    a, planes = number[ids], []
    for k in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
        bits = (a & (1 << k)).astype(bool)
        planes.append(bits)
        a = parted(a, bits)
    return alphabet, planes


def shard_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The file of documents in order: their ids and token ids."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    alphabet, planes = matrix(flat)
    sections = [
        zlib.compress(np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()),
        zlib.compress(np.packbits([i is None for i in doc_ids]).tobytes()),
        zlib.compress(np.array([len(b) // 4 for b in ids], "<i8").tobytes()),
        alphabet.tobytes(),
    ]
    for p in map(Plane.of, planes):
        sections += [p.classes.tobytes(), p.words.tobytes(), p.ones.tobytes(), p.bits.tobytes()]
    header = json.dumps({"docs": len(doc_ids), "tokens": len(flat), "planes": len(planes), "sections": [len(s) for s in sections]}).encode()
    body = b"".join((MAGIC, len(header).to_bytes(4, "little"), header, *sections))
    return body + zlib.crc32(body).to_bytes(4, "little")


class Shard:
    """A shard's file: `doc_ids`, `starts` (of the documents, and the end), and its ids."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a whole shard")
        size = int.from_bytes(data[8:12], "little")
        header, at, sections = json.loads(bytes(data[12 : 12 + size])), 12 + size, []
        for n in header["sections"]:
            sections.append(data[at : at + n])
            at += n
        ids, none, lengths = (zlib.decompress(s) for s in sections[:3])
        nulls = np.unpackbits(np.frombuffer(none, np.uint8), count=header["docs"])
        self.doc_ids = [None if n else i for i, n in zip(np.frombuffer(ids, "<i8").tolist(), nulls.tolist(), strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<i8"))])
        self.n, self.alphabet = header["tokens"], np.frombuffer(sections[3], "<u4")
        self.planes = [Plane(self.n, np.frombuffer(sections[k], np.uint8), *(np.frombuffer(s, "<u4") for s in sections[k + 1 : k + 4])) for k in range(4, len(sections), 4)]
        self.zeros = [int(self.n - p.rank(np.array([self.n]))[0][0]) for p in self.planes]

    def ids(self) -> np.ndarray:
        """All ids: every plane puts the numbers that it has dealt back in their order."""
        number = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            number[zeros:] |= number.dtype.type(1 << k)
            number = mixed(number, plane.all())
        return self.alphabet[number]

    def access(self, positions: np.ndarray) -> np.ndarray:
        at, number = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            ones, bit = plane.rank(at)
            at, number = np.where(bit == 1, zeros + ones, at - ones), number * 2 + bit
        return self.alphabet[number]

    def interval(self, token: int, low: int, high: int) -> tuple[int, int, int]:
        """Where the occurrences of a token between two positions are in the order below the last plane; its number."""
        found = np.flatnonzero(self.alphabet == token)
        if not len(found):
            return 0, 0, -1
        ends, number = np.array([low, high]), int(found[0])
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank(ends)[0]
            ends = zeros + ones if number >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1]), number

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        low, high, _ = self.interval(token, low, self.n if high is None else high)
        return high - low

    def positions(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Where the token occurs, in order."""
        low, high, number = self.interval(token, low, self.n if high is None else high)
        at = np.arange(low, high)
        for k, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            if len(at):
                at = plane.select(1, at - zeros) if number >> k & 1 else plane.select(0, at)
        return at


def short(batches):
    """Arrow batches in slices of at most TEXTS bytes of text (the second column), or of one row."""
    for batch in batches:
        place = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()) // TEXTS
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def tasks_of(docs: DataFrame) -> int:
    """How many ranges of ids the texts are sorted into: as many as their bytes ask for."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(size // TASK_BYTES, 7) + 1


def write_shards(docs: DataFrame, folder: str, path: str, separator: int = 0, shard: int = SHARD) -> DataFrame:
    """Write the shards into `folder`; a row for each file that counts. A task that is run again writes files of its
    own, and only those of the attempt that Spark commits are listed; tasks, and the places of their files, are in the
    order of doc_id (null first, equal ids by a hash of the text)."""
    prepare(docs.sparkSession)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        encode, end, task = load(path), np.array([separator], "<u4").tobytes(), TaskContext.get().partitionId()
        done, doc_ids, held, size = [], [], [], 0

        def write():
            nonlocal doc_ids, held, size
            data, name = shard_bytes(doc_ids, held), f"{base}/{uuid.uuid4().hex}.wavelet"
            with store.open_output_stream(name, compression=None) as out:
                out.write(data)
            done.append((name, task, len(done), len(doc_ids), size, len(data)))
            doc_ids, held, size = [], [], 0

        for batch in short(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard:
                    write()
        if doc_ids:
            write()
        if done:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["path", "task", "place", "docs", "tokens", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(tasks_of(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return rows.select("doc_id", "text").mapInArrow(run, WRITTEN)


def with_starts(files: DataFrame) -> DataFrame:
    """Adds `start`, the ids in all files before; a row a task is summed in one place, files by task."""
    tasks = files.groupBy("task").agg(F.sum("tokens").alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("ahead"))
    inside = F.sum("tokens").over(Window.partitionBy("task").orderBy("place")) - F.col("tokens")
    return files.withColumn("inside", inside).join(tasks, "task").select(*files.columns, (F.col("ahead") + F.col("inside")).alias("start"))


def opened(files: DataFrame, folder: str, rows, schema: str, columns: tuple[str, ...] = ("path", "start")) -> DataFrame:
    """What `rows(shard, start)` gives of every file, in batches of columns, as many files at once as there are tasks."""
    prepare(files.sparkSession)
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    n = files.count()

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(path) as source:
                    shard = Shard(source.read())
                for out in rows(shard, start):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    tasks = max(1, min(n, ALONE) + max(n - ALONE, 0) // FILES)
    return files.select(*columns).repartition(tasks).mapInArrow(run, schema)


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files (path, start)."""

    def rows(shard: Shard, start: int):
        raw, cuts = memoryview(shard.ids().astype("<u4").tobytes()), shard.starts
        crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield shard.doc_ids, start + cuts[:-1], np.diff(cuts), crc

    return opened(files, folder, rows, DOCS)


def occurrences(files: DataFrame, folder: str, tokens: list[int], most: int = 1 << 16) -> DataFrame:
    """token, doc_id, offset (from the document's start) of every occurrence, looked up in the files without reading
    their other ids; `most` of them make a batch."""

    def rows(shard: Shard, start: int):
        ids = np.array([i if i is not None else 0 for i in shard.doc_ids], np.int64)
        none = np.array([i is None for i in shard.doc_ids], bool)
        for token in tokens:
            at = shard.positions(token)
            for low in range(0, len(at), most):
                some_ = at[low : low + most]
                doc = np.searchsorted(shard.starts, some_, side="right") - 1
                yield np.full(len(some_), token), pa.array(ids[doc], mask=none[doc]), some_ - shard.starts[doc]

    return opened(files, folder, rows, "token long, doc_id long, offset long")


def token_counts(files: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each occurs in all files, by ranks."""

    def rows(shard: Shard, start: int):
        yield tokens, [shard.count(t) for t in tokens]

    return opened(files, folder, rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def shards(docs: DataFrame, path: str, folder: str | None = None) -> tuple[DataFrame, str]:
    """The listed files of `docs` (path, task, place, docs, tokens, bytes, start), and their folder."""
    folder = folder or scratch(docs.sparkSession, "shards")
    return stored(with_starts(stored(write_shards(docs, folder, path), "written")), "files"), folder


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, as read back from the shards of `docs`.

    Null and empty texts have the end id alone; null ids come first; rows of one id follow each other by a hash of the
    text, repeats included; other columns are not read; an empty table writes no file and gives no rows."""
    files, folder = shards(docs, path)
    return read_shards(files, folder)
