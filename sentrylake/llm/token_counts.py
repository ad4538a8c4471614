"""Token counts by a compiled finite-state transducer.

A BPE vocabulary with word ends is compiled into a deterministic transducer over 512 symbols: each byte, and each
byte that ends a word. A state is what the tokens of the word so far can still influence: for each suffix of the word
that begins some token, the token before it and how many fewer tokens stand before it. The last token of a prefix is
the one token that ends there and forms a valid pair with the token before it, so a transition is annotated with the
change of the token count (it may be negative: merging takes counts back) and a word-ending symbol returns to the
start state. States are determinised on demand and kept until there are MOST_STATES: then the worker starts afresh,
with half of the words if there were too many for one run, and a word of over LONG symbols runs by itself, so that memory
is bounded whatever the texts are.

A batch's symbols are cut into chunks that run in step. A chunk first runs from an unknown state, which the first
word end turns into the start state: its state map is constant. A chunk inside a longer word has a map of entry to
exit states, made for the states that its last few symbols can lead to. The maps compose in a parallel prefix scan:
at each of its steps the map of every block of chunks is joined to that of the block before it, and what has met a
constant map is known. An entry state that a map lacks is run and added to it. With all entry states known, the open
beginnings of all chunks run once more, in step, for the counts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from ._shared import prepare, text_bytes

END = 256
LANES = 4096
#: Characters counted in one go; longer texts are cut before a space, where no word or special token can span.
PIECE = 2_000_000
UNKNOWN, START, NONE = 0, 1, -1
#: Symbols before a chunk, each of which is tried as the beginning of the word.
GUESSES = 24
#: States that a worker keeps at most, pairs of tokens whose validity it keeps, and symbols of a word that runs by itself.
MOST_STATES, MOST_PAIRS, LONG = 131_072, 300_000, 16_384
#: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_letters() -> dict[str, int]:
    """The usual stand-in letter of each byte in byte-level vocabularies -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Full(Exception):
    """There are MOST_STATES states."""


class Transducer:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            out = [letters[c] for c in (token[: -len(suffix)] if ends else token)]
            return (*out[:-1], out[-1] + END) if ends else tuple(out)

        self.spelled = {i: symbols(t) for t, i in vocab.items()}
        self.rank = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(merges)}
        self.single = {s[0]: i for i, s in self.spelled.items() if len(s) == 1}
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.inner = {0}
        count = 1
        for i, s in self.spelled.items():
            node = 0
            for x in s:
                self.inner.add(node)
                if (nxt := self.child.get(node * 512 + x)) is None:
                    nxt = self.child[node * 512 + x] = count
                    count += 1
                node = nxt
            self.token[node] = i
        self.valid: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.column = np.full(512, -1, np.int32)
        self.n_columns = 0
        self.states = [(), ((0, NONE, 0),)]
        self.number = {self.states[START]: START}
        self.next = np.full((1024, 64), -1, np.int32)
        self.delta = np.zeros((1024, 64), np.int8)

    def bpe(self, word: tuple[int, ...]) -> list[int]:
        """The merges, one by one: used for single tokens and pairs only."""
        ids = [self.single[x] for x in word]
        while len(ids) > 1:
            best = min(((r[0], k, r[1]) for k in range(len(ids) - 1) if (r := self.rank.get((ids[k], ids[k + 1])))), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [best[2]]
        return ids

    def fits(self, before: int, token: int) -> bool:
        """Whether the merges leave these two tokens, side by side, as they are."""
        key = (before, token)
        if (v := self.valid.get(key)) is None:
            if len(self.valid) >= MOST_PAIRS:
                self.valid.clear()
            word = self.spelled[token] if before == NONE else self.spelled[before] + self.spelled[token]
            v = self.valid[key] = self.bpe(word) == ([token] if before == NONE else [before, token])
        return v

    def step(self, state: int, x: int) -> tuple[int, int]:
        if state == UNKNOWN:
            return (START if x >= END else UNKNOWN), 0
        found, reached = None, []
        for node, before, fewer in self.states[state]:
            if (c := self.child.get(node * 512 + x)) is None:
                continue
            if found is None and (t := self.token.get(c)) is not None and self.fits(NONE, t) and self.fits(before, t):
                found = (t, fewer + 1)
            if c in self.inner:
                reached.append((c, before, fewer))
        token, gain = found
        if x >= END:
            return START, gain
        made = (*((c, b, f - gain) for c, b, f in reached), (0, token, 0))
        if (n := self.number.get(made)) is None:
            if len(self.states) >= max(MOST_STATES, 4):  # the first two, one to go on from and one to go to
                raise Full
            n = self.number[made] = len(self.states)
            self.states.append(made)
        return n, gain

    def fill(self, keys: np.ndarray, xs: np.ndarray) -> None:
        """Make the transitions that are missing at keys (state * columns + column), given their symbols."""
        width = self.next.shape[1]
        for key, x in dict(zip(keys.tolist(), xs.tolist(), strict=True)).items():
            state, col = divmod(key, width)
            to, gain = self.step(state, x)
            if to >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
            self.next[state, col], self.delta[state, col] = to, gain

    def columns(self, symbols: np.ndarray) -> None:
        """Give each symbol that occurs a column of the table."""
        for x in np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0)):
            if self.n_columns == self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], 1)
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)], 1)
            self.column[x] = self.n_columns
            self.n_columns += 1

    def advance(self, state: np.ndarray, xs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.next.shape[1]
        key = state.astype(np.int64) * width + self.column[xs]
        to = self.next.ravel()[key]
        if (to < 0).any():
            miss = to < 0
            self.fill(key[miss], xs[miss])
            to = self.next.ravel()[key]
        return to, self.delta.ravel()[key]

    def gains(self, symbols: np.ndarray, lanes: int = LANES) -> np.ndarray:
        """The change of the token count at each symbol; the last symbol must end a word. A word that runs by itself has
        all of it at its last symbol."""
        out = np.zeros(len(symbols), np.int64)
        stops = np.flatnonzero(symbols >= END) + 1
        starts = np.concatenate([[0], stops[:-1]])
        long = stops - starts > LONG
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            out[b - 1] = self.alone(symbols[a:b].tolist())
        rest = symbols if not long.any() else symbols[~np.repeat(long, stops - starts)]
        got, at, size = [], 0, len(rest)
        stops = np.flatnonzero(rest >= END) + 1
        while at < len(rest):
            k = np.searchsorted(stops, at + size, side="right")
            end = int(stops[max(k - 1, np.searchsorted(stops, at, side="right"))])  # one word at least
            if len(self.states) > MOST_STATES * 3 // 4:
                self.clear()
            try:
                got.append(self.together(rest[at:end], lanes))
                at, size = end, 2 * size
            except Full:
                self.clear()
                if np.count_nonzero(rest[at:end] >= END) == 1:
                    one = np.zeros(end - at, np.int64)
                    one[-1] = self.alone(rest[at:end].tolist())
                    got.append(one)
                    at = end
                size = max((end - at) // 2, 1)
        if got:
            out[slice(None) if rest is symbols else ~np.repeat(long, np.diff(np.concatenate([[0], np.flatnonzero(symbols >= END) + 1])))] = np.concatenate(got)
        return out

    def alone(self, word: list[int]) -> int:
        """The tokens of one word, symbol by symbol; its states go when there are too many."""
        state, total, moves = START, 0, {}
        for x in word:
            if (move := moves.get((state, x))) is None:
                try:
                    move = self.step(state, x)
                except Full:
                    here = self.states[state]
                    self.clear()
                    moves.clear()
                    if (state := self.number.get(here, NONE)) == NONE:
                        state = self.number[here] = len(self.states)
                        self.states.append(here)
                    move = self.step(state, x)
                moves[state, x] = move
            state, gain = move
            total += gain
        self.clear()  # the table has no rows of what this made
        return total

    def together(self, symbols: np.ndarray, lanes: int) -> np.ndarray:
        """The gains of words that run in step."""
        n = len(symbols)
        self.columns(symbols)
        width = -(-n // max(1, min(lanes, n // 64 + 1)))
        rows = -(-n // width)
        grid = np.full(rows * width, END, np.int16)  # what fills the last chunk up is not counted
        self.columns(np.array([END]))
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        out = np.zeros((width, rows), np.int8)
        state = np.full(rows, UNKNOWN, np.int32)
        state[0] = START
        for k in range(width):
            state, out[k] = self.advance(state, grid[k])
        heads = np.where((grid >= END).any(0), (grid >= END).argmax(0) + 1, width)
        heads[0] = 0
        at = np.append(START, self.exits(grid, state)[:-1])
        for k in range(int(heads.max())):
            run = np.flatnonzero(heads > k)
            at[run], out[k, run] = self.advance(at[run], grid[k, run])
        return out.T.ravel()[:n]

    def run(self, grid: np.ndarray, chunks: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The exit states of chunks (columns of `grid`) from entry states."""
        for row in grid:
            state = self.advance(state, row[chunks])[0]
        return state

    def chunk_maps(self, grid: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of chunks without a known exit state, as sorted (chunk << 32 | entry state) and exit states: for the
        exit state of the chunk before, or where that isn't known for each that a word begun in its last GUESSES
        symbols has at its end."""
        width = len(grid)
        chunks = np.flatnonzero(known == UNKNOWN)
        guesses = min(GUESSES, width)
        begin, lane = np.divmod(np.arange(guesses * len(chunks)), len(chunks))
        lane = chunks[lane]
        state = np.full(len(lane), UNKNOWN, np.int32)
        for k in range(guesses):
            state[begin == k] = START
            state = self.advance(state, grid[width - guesses + k, lane - 1])[0]
        before = known[lane - 1]
        key = np.unique(lane << 32 | np.where(before == UNKNOWN, state, before))
        return key, self.run(grid, key >> 32, (key & 0xFFFFFFFF).astype(np.int32))

    def exits(self, grid: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The exit states of all chunks, by a prefix scan of their state maps; `known` has those of constant maps."""
        known = known.copy()
        if (known != UNKNOWN).all():
            return known
        key, to = self.chunk_maps(grid, known)
        while (known == UNKNOWN).any():
            step, k, t = 1, key, to  # the maps of blocks of `step` chunks, by their last chunk
            while step < len(known) and len(k):
                rest = np.flatnonzero(known[step:] == UNKNOWN) + step
                rest = rest[known[rest - step] != UNKNOWN]
                has, value = looked_up(k, t, rest << 32 | known[rest - step])
                known[rest[has]] = value
                longer = (k >> 32) + step
                has, value = looked_up(k, t, longer << 32 | t)
                k, t = longer[has] << 32 | k[has] & 0xFFFFFFFF, value
                step *= 2
            rest = np.flatnonzero(known[1:] == UNKNOWN) + 1
            rest = rest[known[rest - 1] != UNKNOWN]  # their maps lack the entry state
            if len(rest):
                more = rest << 32 | known[rest - 1]
                known[rest] = self.run(grid, rest, known[rest - 1])
                key, at = np.unique(np.concatenate([key, more]), return_index=True)
                to = np.concatenate([to, known[rest]])[at]
        return known


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of `wanted` are among the sorted keys, and the values of those."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    has = keys[at] == wanted
    return has, values[at[has]]


# The normalizer, pre-tokenizer and kind of model that the counter's own passes are made for.
FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    ("BPE", None, None, False),
)


NFC, NFD, LOWER = normalizers.NFC(), normalizers.NFD(), normalizers.Lowercase()
#: All code points that have letters, marks or numbers in any version of Unicode so far, but surrogates.
POINTS = [c for c in (*range(0x40000), *range(0xE0000, 0xE1000)) if not 0xD800 <= c < 0xE000]


def kinds() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other, as the library's own tables have them."""
    out, text = np.full(0x110000, 3, np.uint8), "".join(map(chr, POINTS))
    points = np.array(POINTS)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for at in range(0, len(text), 1 << 16):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text[at : at + (1 << 16)]):
                out[points[at + a : at + b]] = kind
    out[WHITE] = 0
    return out


def odd_letters() -> re.Pattern:
    """What this Python's Unicode tables lower, compose or order otherwise than the library's: texts with one of these,
    or with a letter that only the library composes, are normalised by the library."""
    odd: set[str] = set()
    for at in range(0, len(POINTS), 1 << 13):
        letters = [chr(c) for c in POINTS[at : at + (1 << 13)] if chr(c) not in "\nΣ"]
        for theirs, ours, around in ((LOWER.normalize_str, str.lower, "{}"), (NFC.normalize_str, partial(unicodedata.normalize, "NFC"), "{}"), (NFD.normalize_str, partial(unicodedata.normalize, "NFD"), "a{}\u0334")):
            text = "\n".join(around.format(c) for c in letters)
            a, b = theirs(text), ours(text)
            if a != b:
                for c, x, y in zip(letters, a.split("\n"), b.split("\n"), strict=True):
                    if x != y:
                        odd |= {c, x[around.index("{")]} if theirs != LOWER.normalize_str else {c}
    return re.compile(f"[{''.join(map(re.escape, sorted(odd)))}]" if odd else r"(?!)")


class TokenCounter:
    """counts(texts) for a `tokenizers` file: NFC, lower case, white space dropped, words by class and contraction."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        kind = (model.get("type"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("byte_fallback", False))
        if (file.get("normalizer"), file.get("pre_tokenizer"), kind) != FORM:
            raise ValueError(f"{path}: its normalizer, pre-tokenizer or model is not the one that this counter is made for")
        names = sorted((a["content"] for a in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.marks = {n[0] for n in names}
        self.kind = kinds()
        self.odd = odd_letters()

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.odd.search(text):
            return LOWER.normalize_str(NFC.normalize_str(text))
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # each letter is lowered for itself
            text = text.replace("Σ", "σ")
        return text.lower()

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, and for each code point of the text how many symbols stand before it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        cp = raw if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[cp]
        first = np.ones(len(cp) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        mark = np.flatnonzero(cp == 39)
        mark = mark[(mark == 0) | (kind[mark - 1] != 3)]
        after = np.zeros((2, len(mark)), np.uint32)
        for j in (0, 1):
            ok = mark + j + 1 < len(cp)
            after[j, ok] = cp[mark[ok] + j + 1]
        short = np.isin(after[0], [ord(c) for c in "stmd"])
        a, b = after
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, length in ((mark[short], 2), (mark[long & ~short], 3)):
            first[which + 1] = False
            first[which + length] = True
        size = np.ones(len(cp), np.int64) if cp is raw else 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        stop = np.cumsum(size)
        words = kind != 0
        out = raw.astype(np.int16)
        out[stop[words & (first[1:] | np.append(~words[1:], True))] - 1] += END
        kept = words if cp is raw else np.repeat(words, size)
        before = np.concatenate([[0], np.cumsum(np.where(words, size, 0))])
        return out[kept], before

    def pieces(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > PIECE and (cut := text.find(" ", at + PIECE)) >= 0:
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The token count of each text."""
        done, rows, owner, size = np.zeros(len(texts), np.int64), [], [], 0
        for k, t in enumerate(texts):
            for p in self.pieces(t):
                rows.append(p)
                owner.append(k)
                size += len(p)
                if size >= PIECE:
                    np.add.at(done, owner, self.batch(rows))
                    rows, owner, size = [], [], 0
        if rows:
            np.add.at(done, owner, self.batch(rows))
        return done

    def batch(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        parts = []
        for k, t in enumerate(texts):
            if any(m in t for m in self.marks):
                t, extra[k] = self.special.subn("\n", t)
            parts.append(self.normal(t))
        ends = np.cumsum([len(p) + 1 for p in parts])
        symbols, before = self.symbols("\n".join(parts) + "\n")
        if not len(symbols):
            return extra
        total = np.concatenate([[0], np.cumsum(self.machine.gains(symbols), dtype=np.int64)])
        at = total[before[np.concatenate([[0], ends])]]
        return np.diff(at) + extra


@lru_cache(maxsize=2)
def load(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text (null: empty, no tokens), as the tokenizer file counts them.

    One narrow pass; a special token's string inside a text counts as that one token, the library's default. Rows that
    repeat an id or a text are counted each for itself, null ids too; other columns are not read; an empty table gives no
    rows. A text of one long word is counted in bounded memory, symbol by symbol."""
    prepare(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(load(path).counts(list(texts)))

    t = text_bytes(text)
    out = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), count(t).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
