"""Operator 13 against a plain version and its own SQL."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, spelling

random.seed(13)
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    holes, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    for (head, tail), group in holes.items():
        group = group | ({head + tail} & n.keys())
        for w in group:
            near[w] |= {v for v in group - {w} if len(v) == len(w) or head + tail in (v, w)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def edited(word):
    i, c = random.randrange(len(word) + 1), random.choice("abÉé÷")
    return random.choice([word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :]])


BASE = ["".join(random.choice("abé") for _ in range(random.randint(7, 10))) for _ in range(60)]
FAMILY = [edited(w) for w in BASE for _ in range(6)]
TEXTS = [
    (1, None), (2, ""), (2, ""), (None, "letters lettersx lettérs"), (None, "letters lettersx lettérs"), (3, "ABCDEFGH abcdefgh ÀBCDEFGH àbcdefgh"), (3, "ABCDEFGH abcdefgh ÀBCDEFGH àbcdefgh"),
    *((10 + k, " ".join(random.choices(BASE + FAMILY, k=60))) for k in range(40)),
    # Chains of forms: each word ten times as frequent as the one that differs from it by a letter.
    (100, "chaining " * 2 + "chainings " * 20 + "chainingsx " * 200 + "chainingsxy " * 2000), (101, "tiedwordaa " * 2 + "tiedwordab " * 20 + "tiedwordac " * 20),
    # Runs of one letter in all lengths, and words of equal counts beside each other.
    (102, " ".join("a" * k for k in range(1, 60)) * 2), (103, "x×x÷xxxx x×x÷xxxy ʼabcdefg1abcdefg_abcdefg"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "id", "node", "doc", "run", "h")}).repartition(3)


@pytest.mark.parametrize("salt", [20_000, 3])
def test_against_plain(docs, monkeypatch, salt):
    """With 3 words a salt nearly every node is split."""
    monkeypatch.setattr(spelling, "WORDS_A_SALT", salt)
    expected = plain(TEXTS)
    assert rows(spelling.spellings(docs)) == expected
    assert any(r[1] for r in expected) and any(r[1] and r[1] != r[2] for r in expected) and any(r[4] > 5 for r in expected)


def test_no_rows(docs):
    assert spelling.spellings(docs.limit(0)).collect() == []
    assert spelling.spellings(docs.filter("doc_id = 2")).collect() == []


def test_long_words(spark):
    """Words of 30,000 characters, edited at the start, in the middle and at the end, and one text that is one word."""
    word = "".join(random.choice("abcd") for _ in range(30_000))
    others = ["q" + word, word[:15_000] + "q" + word[15_000:], word[:14_999] + "é" + word[15_000:], word[:-1], word + "qq", word[1:]]
    table = [(1, " ".join([w] * 2)) for w in [word, *others]] + [(2, "ab" * 40_000)]
    got = rows(spelling.spellings(spark.createDataFrame(table, "doc_id long, text string")))
    assert got == plain(table)
    assert sorted(r[4] for r in got)[-1] >= 4


def test_prefix_nodes():
    """Shared prefixes have one name; each word has those that hold its untouched half."""
    words = ["abcdefg", "abcdxyz", "abcdefg"]
    for back in (False, True):
        row, depth, node, after = spelling.prefix_nodes(words, back)
        names = defaultdict(set)
        for r, d, v, a in zip(row, depth, node, after):
            way = words[r][::-1] if back else words[r]
            names[v].add(way[:d])
            assert a == (ord(way[d]) if d < len(way) else spelling.END)
        assert all(len(x) == 1 for x in names.values())
        assert Counter(row.tolist()) == {0: 7 - (4 if back else 3) + 1, 1: 7 - (4 if back else 3) + 1, 2: 7 - (4 if back else 3) + 1}


def test_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    expected = sorted(con.sql(spelling.ORACLE_SQL["op13_spelling"]).fetchall(), key=str)
    assert rows(spelling.op13_spelling(spark, folder)) == expected == plain([(r.doc_id, r.text) for r in common.read(spark, folder, "documents").collect()])
