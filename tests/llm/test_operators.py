"""Each operator against a plain version, on small tables with nulls, empties, repeats and clashing columns."""

import random
import time

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm import bpe, common, decontaminate, html_text, langid, licenses, line_dedup, quality, simhash, suffix_dedup, token_counts

from . import brute

random.seed(5)
VOCAB = ["the", "of", "Ring", "ring", "zinc", "café", "ÉTÉ", "x1", "naïve", "and", "to", "straße", "日本", "it's"]
words = lambda n: " ".join(random.choice(VOCAB) for _ in range(n))
LONG = words(3000)
BASE = [words(80) for _ in range(6)]
LICENSE = "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.\nMIT license apache License"
TEXTS = [
    (1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x", None), (3, LONG, "a"), (4, LONG, "c"), (5, LONG[:900] + " tail " + LONG[400:1500], "d"), (6, "   \n\t ", "a"),
    *[(10 + k, t, f"s{k}") for k, t in enumerate(BASE)], (20, BASE[0] + " more", "z"), (21, BASE[1].upper(), "z"), (22, "a" * 1500, "z"), (23, "shared line\nown\nshared line ", "q"),
    (24, LICENSE, "q"), (24, LICENSE, "q"), (25, "a b a b a b a b " * 20, "q"), (26, "one two three\none two three\n\n##", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The rows with extra columns that clash with the operators' own."""
    return spark.createDataFrame(TEXTS, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("k1", "k2", "words", "n_words", "fp", "ids", "lang_pred", "score", "items", "n_lines", "site", "host", "root", "component_id", "goes", "row", "pos", "line")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *columns):
    key = lambda r: [(x is not None, str(x)) for x in r]
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=key)


def same(got, expected):
    key = lambda r: [(x is not None, str(x)) for x in r]
    assert got == sorted(expected, key=key)


PAIRS = [(i, t) for i, t, _ in TEXTS]


@pytest.mark.parametrize("block,bucket", [(4 << 20, 24 << 20), (2000, 24 << 20), (4 << 20, 1000), (2000, 3000)])
def test_suffix_dedup(docs, block, bucket):
    got = suffix_dedup.digests(suffix_dedup.with_runs(docs.select("doc_id", "text"), block_bytes=block, bucket_bytes=bucket))
    same(rows(got), brute.suffix_dedup(PAIRS))


def test_repeated_words(spark):
    """Passages of 51 words and more that stand elsewhere, in few bytes or many; 50 words are none."""
    table = [(i, t) for i, t in PAIRS if t and "\ud800" not in t] + [(200 + k, f"{words(9)} q{k} " + " ".join(LONG.split()[2000 : 2000 + n]) + f" r{k}") for k, n in enumerate((49, 50, 51, 52, 90))]
    own = suffix_dedup.keyed(spark.createDataFrame(table, "doc_id long, text string"))
    got = {(r["k1"], r["k2"]): r["n_repeated_words"] for r in suffix_dedup.repeated_words(own).collect()}
    found = [(r["text"], got.get((r["k1"], r["k2"]), 0)) for r in own.collect()]
    split = {t: t.split() for t, _ in found}
    seen = brute.Counter(tuple(ws[i : i + 51]) for t, _ in found for ws in [split[t]] for i in range(len(ws) - 50))
    for t, n in found:
        ws = split[t]
        assert n == len({j for i in range(len(ws) - 50) if seen[tuple(ws[i : i + 51])] > 1 for j in range(i, i + 51)})


def test_suffix_dedup_spans(docs, empty):
    for r in suffix_dedup.dedup_suffixes(docs.select("doc_id", "text")).filter("doc_id = 3").collect():
        assert r["spans"][0]["begin"] == 0 and bytes(r["kept"]) == b"" or r["spans"]
    assert suffix_dedup.dedup_suffixes(empty.select("doc_id", "text")).count() == 0


def test_suffix_blocks_random():
    """Repeats at any offset within and between pieces."""
    for _ in range(20):
        alphabet = random.choice([b"ab", b"abcdefgh"])
        core = bytes(random.choice(alphabet) for _ in range(700))
        pieces = [core[: random.randint(400, 700)] + bytes(random.choice(alphabet) for _ in range(random.randint(0, 300))) for _ in range(5)]
        pieces += [bytes(random.choice(b"xy") for _ in range(random.randint(0, 50))) + p for p in pieces[:3]]
        counts = [len(p) - 399 for p in pieces]
        all_ = [p[i : i + 400] for p, n in zip(pieces, counts) for i in range(n)]
        same = suffix_dedup.equal_starts(pieces, counts).tolist()
        assert all(all_[i] == all_[k] and same[k] == k for i, k in enumerate(same)) and len(set(same)) == len(set(all_))


PAGES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b  c<br>d": "a\n\nb c d",
    "<html><body><nav><a href=x>Menu</a></nav><div class='post-7'><h1>T&eacute;</h1><p>Some text that is long.<p>More <b>bo</b>ld</div><div class='comments'><p>reader says a lot of things here, much more than the article does, truly</div><footer>f</footer>": "Té\n\nSome text that is long.\n\nMore bold",
    "<body><script>var a = '<p>no</p>'</script><article><p>yes</p><form><p>send</p></form></article><!-- <p>gone</p> -->": "yes",
    "<title>t</title><style>p{}</style>": "",
}


def test_html(spark):
    table = [(i, "http://h.example/x", h) for i, h in enumerate(PAGES)] + [(98, None, None), (99, "nonsense", "<p>z</p>"), (99, "nonsense", "<p>z</p>")]
    got = html_text.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string").withColumn("path", F.lit("clash")))
    found = rows(got.select("page_id", "text", "n_chars"))
    alone = {h: html_text.extract(h) for h in PAGES}
    assert alone == PAGES
    assert (98, "", 0) in found and found.count((99, "z", 1)) == 2 and len(found) == len(table)
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_consensus(spark):
    """A page whose own best container is another follows its host."""
    usual = "<body><div class=main><p>{}</p></div><div class=extra><p>{}</p></div>"
    table = [(i, "https://a.example/1", usual.format("article " * 40, "more")) for i in range(5)] + [(9, "https://a.example/2", usual.format("short one", "extra " * 60))]
    got = dict(rows(html_text.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string")).select("page_id", "text")))
    assert got[9] == "short one" and got[0] == ("article " * 40).strip()


def test_bpe(docs, empty):
    reference = Tokenizer.from_file(bpe.vocabulary_path())
    expected = []
    for i, t in PAIRS:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(reference.decode(ids, skip_special_tokens=False))))
    same(rows(bpe.digests(docs)), expected)
    whole = bpe.encode_decode(docs)
    assert whole.filter("n_tokens <> size(ids)").count() == 0 and "source" in whole.columns and bpe.digests(empty).count() == 0


def test_bpe_fuzz():
    reference, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.word_bpe(bpe.vocabulary_path())
    letters = "ab'sStTΣςİéß \t\n\x1c\x85\xa0 日本123٣½<|endoftext|>._-'ll'D\U0001f600ﬁ"
    for _ in range(2000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        ids = reference.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.pieces(text)[1] == reference.decode(ids, skip_special_tokens=False)
    assert own.encode("a<|endoftext|>b") == reference.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_token_counts(docs, empty):
    first, later = token_counts.load_pieces(token_counts.vocabulary_path())
    vocabulary = {"[UNK]": 0}
    for piece in [*sorted(first), *("##" + p for p in sorted(later))]:
        vocabulary.setdefault(piece, len(vocabulary))
    reference = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6))
    reference.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    expected = []
    for i, t in PAIRS:
        tokens = reference.encode(t or "").tokens
        expected.append((i, len(brute.white_words(t)), len(tokens), tokens.count("[UNK]")))
    same(rows(token_counts.count_tokens(docs), "doc_id", "n_words", "n_tokens", "n_unknown"), expected)
    assert token_counts.count_tokens(empty).count() == 0


ITEMS = [(1, " ".join(BASE[2].split()[5:30])), (2, "Zinc RING"), (3, None), (4, "..."), (None, " ".join(BASE[3].split()[:10])), (2, "zinc ring"), (10, "never seen anywhere")]


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    got = decontaminate.mark(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), "contaminated")
    same(rows(got), brute.contamination(PAIRS, [("" if i is None else i, t) for i, t in ITEMS]))
    assert decontaminate.mark(empty, items).count() == 0
    assert decontaminate.mark(docs, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    """The lists meet by start: the same start is a phrase to verify, up to two words off a proximity match."""
    item = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    table = [(1, "alpha x beta gamma delta epsilon zeta eta theta iota kappa"), (2, "kappa " + "x " * 60 + "alpha"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, "alpha x x x beta"), (5, "alpha beta x gamma")]
    near = spark.createDataFrame(table, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.mark(near, item).collect()}
    windows = decontaminate.test_windows(item)
    terms = [r["term"] for r in decontaminate.lookups(near, windows).orderBy("rank").collect()]
    at = {w: i for i, w in enumerate(item.first()["text"].split())}
    for i, text in table:
        places = {t: [k - at[t] for k, w in enumerate(text.split()) if w == t] for t in terms}
        n = sum(any(abs(a - b) <= 2 for a in places[terms[0]]) for b in places[terms[1]])
        assert got[i] == (10 if i == 3 else 0, n)
    assert got[3][1] == got[1][1] == 1 and got[2][1] == 0


def test_simhash(docs, empty):
    prints = [brute.fingerprint(t) for _, t in PAIRS]
    group = brute.components(prints)
    least = {}
    for (i, _), g in zip(PAIRS, group):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(i, least[g])
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), "component_id")
    same(rows(got), [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(PAIRS, prints, group)])
    kept = simhash.keep_first(docs)
    assert kept.count() == len(set(group)) and kept.columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links(spark):
    """Planted distances 0 to 6: exactly those up to 4 are linked."""
    base = random.getrandbits(64)
    prints = [base] + [base ^ sum(1 << (9 * d + k) for k in range(d)) for d in range(1, 7)]
    signed = [(p if p < 1 << 63 else p - (1 << 64),) for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), rounds=2))
    linked = {r["node"] for r in found.collect()} | {r["root"] for r in found.collect()}
    assert {signed[k][0] for k in range(5)} <= linked and not {signed[5][0], signed[6][0]} & linked


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots_of(df):
    return {r["node"]: r["root"] for r in simhash.components(df).collect()}


@pytest.mark.parametrize("hot_rows", [simhash.HOT_ROWS, 0, 50])
def test_simhash_large_group(spark, hot_rows):
    """2,000 near copies and some chains: the components are those of all pairs, the links fewer than rows."""
    base = random.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in random.sample(range(64), n))
    prints = {flip(base, random.randint(0, 4)) for _ in range(2000)} | {random.getrandbits(64) for _ in range(200)}
    for _ in range(30):
        x = random.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            x = flip(x, random.randint(3, 5))
    prints = sorted(prints)
    table = [(signed(p),) for p in prints]
    found = simhash.links(spark.createDataFrame(table, "fp long"), hot_rows=hot_rows)
    assert found.count() < 60 * len(prints)
    root, group = roots_of(found), brute.components(prints)
    mine = {}
    for p, g in zip(prints, group):
        mine.setdefault(g, set()).add(root.get(signed(p), signed(p)))
    assert all(len(x) == 1 for x in mine.values()) and len(set().union(*mine.values())) == len(mine)


def test_simhash_dealt_further():
    """Groups too large to be expanded at once are dealt by further bits, with the same links."""
    import numpy as np

    base = random.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for _ in range(300)})
    half = np.array(simhash.masks(2, range(32, 64)), np.int64).view(np.uint64)
    own = np.repeat(np.array(prints, np.uint64), len(half))
    m = np.tile(half, len(prints))
    spare = 2 - np.bitwise_count(m).astype(np.int64)
    group = brute.components(prints)
    expected = {prints[k]: prints[g] for k, g in enumerate(group) if g != k}
    before = simhash.EXPANDED
    try:
        for simhash.EXPANDED in (before, 3000):
            assert dict(zip(*(x.tolist() for x in simhash.met(own ^ m, own, spare, 32)))) == expected
    finally:
        simhash.EXPANDED = before


def test_keep_first_ties(spark):
    """Repeated ids, null ids and equal rows: one row of each component, always the same."""
    table = [(1, "one two three four five", "b"), (1, "one two three four five", "a"), (1, "One two three four five", "c"), (None, "one two three four five", "d"), (None, "alone and other words", "e"), (None, "alone and other words", "e")]
    picks = [rows(simhash.keep_first(spark.createDataFrame(table[::step], "doc_id long, text string, source string"))) for step in (1, -1)]
    assert picks[0] == picks[1] and len(picks[0]) == 2


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = dict(rows(simhash.components(edges)))
    assert all(got[k] == 0 for k in range(1, 41)) and got[101] == got[102] == 100


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(docs, empty, least):
    got = rows(line_dedup.dedup_lines(docs, least_sites=least).select("doc_id", "text"))
    same(got, [(i, t) for (i, _, _), t in zip(TEXTS, brute.line_dedup(TEXTS, least))])
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_threshold(spark):
    """Lines on 8 to 13 sites, repeated within sites: 10 and more go."""
    table = [(n * 100 + k, f"line {n}\nown {n} {k}", f"site{k}") for n in range(8, 14) for k in range(n) for _ in range(2)]
    got = line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string, source string"))
    assert {r["doc_id"] // 100 for r in got.filter("n_removed > 0").collect()} == {10, 11, 12, 13}


def test_language(spark, empty):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs, per_language=150)
    held = docs.filter(langid.held_out(F.col("doc_id")))
    right = langid.predict(held, model).filter("lang = lang_pred").count()
    assert right >= 0.95 * held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "12 !?"), (3, "the of and " * 5000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[None] == ("und", 0.0) and got[3][0] == "en" and 0 <= got[3][1] <= 1
    assert langid.train(empty.withColumn("lang", F.lit("en"))) is None and langid.predict(empty, None).count() == 0


def test_quality(docs, empty):
    got = quality.judge(docs)
    expected = [(i, *brute.quality(t)) for i, t in PAIRS]
    same(rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), expected)
    assert got.filter("base_failed AND kept").count() == 0 and quality.judge(empty).count() == 0


def test_host_verdicts(spark):
    """A host with many failures goes with all its documents; a host with one failing document does not."""
    good, bad = " ".join(f"w{k}" for k in range(60)), "few words"
    table = [(k, good, "good") for k in range(40)] + [(100 + k, bad if k < 38 else good, "bad") for k in range(40)] + [(200, bad, "tiny")]
    got = quality.judge(spark.createDataFrame(table, "doc_id long, text string, source string"))
    kept = {r["doc_id"] for r in got.filter("kept").collect()}
    assert kept == set(range(40))


def test_licenses(docs, empty):
    same(rows(licenses.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), [(i, *brute.licenses(t)) for i, t in PAIRS])
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[24]["labels"] == "apache,cc-by,cc-by-nc,gpl,mit" and found[24]["score"] == 1.0 and found[3]["labels"] == "" and found[3]["score"] == 0.0
    assert licenses.scan(empty).count() == 0


def test_licenses_many_notices(spark):
    """Every template of a text that holds all of them is found, as each is alone."""
    notices = [text for _, _, text in licenses.TEMPLATES]
    table = [(k, t) for k, t in enumerate(notices)] + [(100, "\n".join(notices))] + [(1000 + k, f"plain text {k}") for k in range(400)]
    found = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert all(label in found[k] for k, (label, _, _) in enumerate(licenses.TEMPLATES))
    assert {label for label, _, _ in licenses.TEMPLATES} <= found[100] and found[1000] == {""}


def test_licenses_random_mixes(spark):
    """Labels and scores of texts of whole, cut and altered notices against a plain scan."""
    templates = [(label, licenses.words_of(key), licenses.words_of(text)) for label, key, text in licenses.TEMPLATES]
    table = []
    for k in range(150):
        parts = []
        for _ in range(random.randint(0, 4)):
            ws = random.choice(licenses.TEMPLATES)[2].split()
            cut = random.choice([len(ws), random.randint(1, len(ws))])
            parts.append(" ".join(w if random.random() > 0.15 else "other" for w in ws[:cut]).upper())
            parts.append(words(random.randint(0, 6)))
        table.append((k, " ".join(parts)))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for k, text in table:
        ws, base, best = brute.contract_words(text), set(brute.licenses(text)[4].split(",")) - {""}, 0.0
        labels = set(base)
        for label, key, body in templates:
            at = next(i for i in range(len(body)) if body[i : i + len(key)] == key)
            for p in (p for p in range(len(ws)) if ws[p : p + len(key)] == key):
                share = max(sum(0 <= p - at + s + i < len(ws) and ws[p - at + s + i] == w for i, w in enumerate(body)) for s in range(-licenses.AROUND, licenses.AROUND + 1)) / len(body)
                if share >= licenses.LEAST_SHARE:
                    labels.add(label)
                    best = max(best, share)
        assert got[k]["labels"] == ",".join(sorted(labels)) and got[k]["base_labels"] == ",".join(sorted(base))
        assert abs(got[k]["score"] - (1.0 if base else best)) < 1e-9


def test_licenses_frequent_notice(spark):
    """A notice that most texts carry keeps its label in all of them."""
    table = [(k, "some text\nAll rights reserved.") for k in range(60)] + [(100 + k, f"text {k}\nLicensed under CC BY-NC 4.0.") for k in range(40)]
    found = licenses.scan(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert all(r["labels"] == ("all-rights-reserved" if r["doc_id"] < 100 else "cc-by,cc-by-nc") for r in found)


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){f()}</script>", "<SCRIPT>a='<!--'</SCRIPT >", "<style>/* <b */</style>", "<svg><style>a<b</style></svg>"])
def test_html_raw_text(raw):
    """No '<' in a script or style takes the article after it away."""
    assert html_text.extract(f"{raw}<article><p>Text<p>more</article>{raw}") == "Text\n\nmore"


HARD = {
    '<article><p>Main text.</p><ol class="commentlist"><li>A reader says so.</li></ol></article>': "Main text.",
    '<article><p>Main text.</p><div class="reader-responses"><p>I say</p></div></article>': "Main text.",
    '<body><p>Main text without an article, some more words.</p><div class="legal">Small print.</div></body>': "Main text without an article, some more words.",
    '<article><div class="share-count-free notice-board"><p>The whole article.</p><p>And more.</p></div></article>': "The whole article.\n\nAnd more.",
    "<article><p>Area <math><mi>x</mi></math> and <object>fallback</object>.</p><fieldset>In a set</fieldset></article>": "Area x and fallback.\n\nIn a set",
    "<article><p>A &lt; B and 3 < 4 &amp; so on</p></article>": "A < B and 3 < 4 & so on",
    "<article><p title='a > b'>ok</p><p>two": "ok\n\ntwo",
    "<main><section><p>one</p></section><section><p>two</p></section></main><aside><p>not this one</p></aside>": "one\n\ntwo",
}


@pytest.mark.parametrize("source", list(HARD))
def test_html_hard(source):
    assert html_text.extract(source) == HARD[source]


def test_html_hosts_decide(spark):
    """A marked path on which a host's pages disagree follows the majority; text repeated on its pages is no content."""
    banner = "<div class=promo><p>Buy this now, it is cheap and good and new.</p></div>"
    story = "<article><div class=promo-story><p>{}</p></div><p>{}</p></article>"
    table = [(k, "https://a.example/", f"{banner}<article><p>{'story ' * (2 if k == 0 else 40)}{k}</p></article>") for k in range(6)]
    table += [(10 + k, "https://b.example/", story.format(f"tale {k} " * 30, "end" if k else "a long end " * 40)) for k in range(5)]
    got = dict(rows(html_text.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string")).select("page_id", "text")))
    assert all("Buy" not in got[k] and "story" in got[k] for k in range(6))
    assert all(f"tale {k}" in got[10 + k] and "end" in got[10 + k] for k in range(5))


def test_html_whole_pages(spark):
    """All pages of the table against a plain reading of their article elements."""
    pages = common.read(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages.select("page_id", "url", "html")).collect()}
    whole = {r["page_id"]: r["html"] for r in pages.collect()}
    assert got == {k: brute.article_text(h) for k, h in whole.items()}


@pytest.mark.parametrize("source", ["<article>" + "<div>" * 20_000 + "text", "<div>t " * 20_000, "<a " * 350_000, '<a x="' * 50_000, "<p>t</p><a x='" * 20_000, "<b>" * 10_000 + "<p>x" * 10_000, "<ul><li>" * 10_000, "<" * 100_000, "<i>" * 5_000 + "</b>" * 20_000])
def test_html_linear(source):
    """Deep nesting and tags left open take time in proportion."""
    began = time.perf_counter()
    html_text.extract(source)
    assert time.perf_counter() - began < 4


def test_html_caption():
    assert html_text.extract("<article><p>Text<figure><img src=x><figcaption>Caption</figcaption></figure></article>") == "Text\n\nCaption"


def test_line_dedup_short_sketch(spark):
    """A line on exactly 10 sites goes though they share registers and its sketch says 7."""
    groups = spark.range(2_000_000).select(F.floor(F.col("id") / 10).alias("g"), F.concat(F.lit("s"), "id").alias("site"))
    g, n = groups.groupBy("g").agg(F.approx_count_distinct("site", line_dedup.RSD).alias("n")).orderBy("n", "g").first()
    assert n < 7.5
    table = [(k, f"line\nown {k}", f"s{10 * g + k}") for k in range(10)]
    got = line_dedup.dedup_lines(spark.createDataFrame(table, "doc_id long, text string, source string"))
    assert got.filter("n_removed = 1").count() == 10


def test_verdicts_grow_with_pages(spark):
    """Two pages a path that disagree about it, all of one host: what pages carry grows with the pages, not with their square."""
    carried = []
    for n in (100, 200, 400):
        make = lambda k: f"<div class='share x{chr(97 + k // 2 % 26)}{chr(97 + k // 52)}'><p>{'Some words of this page number %d. ' % k * (20 if k % 2 else 1)}</p></div><article><p>{'Article. ' * (1 if k % 2 else 30)}</p></article>"
        table = [(k, "http://one.example/x", make(k)) for k in range(n)]
        votes = html_text.page_votes(spark.createDataFrame(table, "page_id long, url string, html string")).cache()
        carried.append(sum(len(r["content"]) + len(r["apart"]) for r in html_text.page_verdicts(votes).collect()))
    assert carried[0] > 0 and carried[1] <= 2.2 * carried[0] and carried[2] <= 2.2 * carried[1]


def test_pages_of_a_host_beyond_broadcast(spark, monkeypatch):
    """Joined with salts, pages get the same texts."""
    pages = common.read(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url", "html").limit(60)
    few = sorted(map(tuple, html_text.extract_pages(pages).collect()))
    monkeypatch.setattr(html_text.common, "broadcast_if_small", lambda df, **_: df)
    assert sorted(map(tuple, html_text.extract_pages(pages, salts=3).collect())) == few
