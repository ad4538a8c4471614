import random
import re
import zlib
from collections import Counter

from sentrylake.llm import spelling
from sentrylake.llm.queries import op13_spelling_variants

from . import cases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_spelling_variants(spark, sf)) == expected(rows)


def test_chains_of_forms_and_many_near_words(spark):
    """Words of a small alphabet, of counts that grow tenfold along chains; ties; runs of one letter; × and ÷."""
    rng = random.Random(4)
    words = []
    for base in ("aaaaaaa", "abababab", "éàüßaéàü", "zzzzzzzzzz", "letters×÷"):
        for step, n in enumerate((6000, 480, 40, 3, 2)):
            words += [base + "q" * step] * n
    for _ in range(300):
        words += ["".join(rng.choice("ab") for _ in range(rng.choice((7, 8, 9))))] * rng.randint(1, 4)
    words += ["Abcdefg"] * 20 + ["abcdefh", "abcdefh", "abcdefi", "abcdefi"] + ["xbcdefg"] * 20 + ["ybcdefg"] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[at : at + 40])) for i, at in enumerate(range(0, len(words), 40))]
    want = expected(rows)
    roots = {w: r for w, _, r, *_ in want}
    assert any(form is not None and root != form and roots[form] != form for _, form, root, *_ in want) and max(x[4] for x in want) > 5
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_awkward_rows(spark):
    rows = [*cases.rows(), (7, "Größere größere GRÖSSERE größerE " * 9, None, None, 0, *cases.CLASH), (None, "missing missing, missin'g missings " * 40, None, None, 0, *cases.CLASH), (8, "m" * 1_000_000 + " " + "missin " * 200_000, None, None, 0, *cases.CLASH)]
    docs = spark.createDataFrame(rows * 2, cases.SCHEMA).repartition(5)
    assert got(spelling.spelling_variants(docs)) == expected([r[:2] for r in rows * 2])
    assert spelling.spelling_variants(cases.empty(spark)).count() == 0


def test_names_are_those_of_equal_strings_only():
    """Two words share a group exactly if they are equal but for that place, a deletion's name is that word's own."""
    words = ["aaaaaaa", "aaaaaab", "aaaaaba", "abaaaaa", "aaaaaaaa", "ababababab", "ababababb", "bababababa", "éàüßaéàü", "zéàüßaéàü"]
    owners, kinds, (a, b) = spelling.name_words(words)
    want = [(0, w) for w in words] + [(1, f"{i} {w[:i]}*{w[i + 1 :]}") for w in words for i in range(len(w))]
    want += [(0, w[:i] + w[i + 1 :]) for w in words for i in range(len(w)) if i == 0 or w[i] != w[i - 1]]
    assert kinds.tolist() == [0] * 10 + [1] * sum(map(len, words)) + [2] * (len(want) - 10 - sum(map(len, words)))
    seen = {}
    for x, name in zip(want, zip(a.tolist(), b.tolist(), strict=True), strict=True):
        assert seen.setdefault(x, name) == name
    assert len(set(seen.values())) == len(seen) and len({x for x, _ in seen.values()}) == len(seen) == len({x for _, x in seen.values()})


def test_a_group_is_not_paired(spark):
    """60 words that differ in one place: one row a word and name, and from the group one row a word."""
    vocab = spelling.numbered(spark.createDataFrame([(f"abc{chr(0xC0 + i)}defg", 2 + i) for i in range(60)], "word string, n long"))
    assert spelling.names(vocab).count() == 60 * (1 + 8 + 8)
    rows = {r.id: r for r in spelling.forms(vocab).collect()}
    ids = [r.id for r in vocab.orderBy("id").collect()]
    assert {r.n_near for r in rows.values()} == {59} and [rows[i].best.id for i in ids] == [ids[1]] + ids[:1] * 59
