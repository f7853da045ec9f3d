"""Texts: golden cases of repair, gates and markup, against rules restated in plain Python."""

import hashlib
import random
import re
import unicodedata
import zlib

from pyspark.sql import functions as F

from corpuslab.functions import scores as S
from corpuslab.functions import text as T
from corpuslab.functions.minhash import parameters, signature
from corpuslab.operators import dedup, quality
from corpuslab.profiles import ASSAMESE, HINDI, LATIN
from corpuslab.session import ship


def values(spark, rows, expr, schema="t string"):
    ship(spark)
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(expr).collect()]


def test_repair(spark):
    cases = {"क े": "के", "म ें": "में", "बच ्चे": "बच्चे", "शिक्षणसंक े त": "शिक्षणसंकेत", "कैै": "कै", "": "", "  a\tb ": "a b"}
    assert values(spark, list(cases), T.repair(F.col("t"), HINDI)) == list(cases.values())
    cases = {"অসম ৰ": "অসমৰ", "হৈ ছে": "হৈছে", "অসম ৰ।": "অসমৰ"}
    assert values(spark, list(cases), T.repair(F.col("t"), ASSAMESE)) == list(cases.values())


def test_repair_is_idempotent(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("कखगमतनरािीुेै्ं  ।") for _ in range(rng.randrange(80))) for _ in range(100)]
    once = values(spark, texts, T.repair(F.col("t"), HINDI))
    twice = values(spark, once, T.repair(F.col("t"), HINDI))
    assert sum(a != b for a, b in zip(once, twice, strict=True)) <= 5  # healing one sign can bring another beside a space


def test_quality_reasons(spark):
    cases = {"एक दो तीन चार": "too_short", "क ख ग घ राम श्याम": "excessive_single_char_fragments", "राम श्याम मोहन सीता गीता": None}
    assert values(spark, list(cases), T.quality_reason(F.col("t"), HINDI)) == list(cases.values())


def test_cleaned_gates(spark):
    docs = spark.createDataFrame([(1, "राम ने श्याम से कहा कि मोहन आज घर पर है और खाना खा रहा है।"), (2, "short"), (3, None), (4, "this text is wholly in another script than the one asked for")], "doc_id long, text string")
    got = {r["doc_id"]: r["dropped"] for r in quality.cleaned(docs, HINDI).collect()}
    assert got[1] is None and got[2] == "too_short" and got[4] == "too_short"


def test_whitespace_is_pythons(spark):
    every = "".join(c for c in map(chr, range(1, 0x3100)) if c.isspace())
    text = "a" + every + "b" + every
    assert values(spark, [text], T.collapse(F.col("t"))) == ["a b"]
    assert values(spark, [text, "", "  "], T.word_count(F.col("t"))) == [2, 0, 0]


def test_wiki_and_html(spark):
    raw = "== Head ==\n'''Bold''' text with a [[Target|link]] and {{box|{{in}}}} more words here<ref>x</ref>\nshort\n[[Category:Gone]]"
    assert values(spark, [raw], T.wikitext(F.col("t"))) == ["Bold text with a link and more words here"]
    page = "<nav>menu menu menu</nav><p>A paragraph of text &amp; more.</p><div>Subscribe to our letter</div><script>x()</script><p>tiny</p>"
    assert values(spark, [page], T.html_text(F.col("t"))) == ["A paragraph of text & more."]


def test_small_functions(spark):
    assert values(spark, ["https://a.b/c/d/", "x"], T.last_segment(F.col("t"))) == ["d", "x"]
    assert values(spark, ["▁ab", "<0x41>"], T.shown_piece(F.col("t"))) == [" ab", "A"]
    assert values(spark, ["कर।"], T.to_assamese(F.col("t"))) == ["কৰ।"]
    assert values(spark, ["[कारण: a > b] हाँ"], T.answer(F.col("t"))) == ["हाँ"]
    assert values(spark, ["[कारण: a > b और b > c इसलिए a > c] हाँ।"], T.rationale_parts(F.col("t")))[0].asDict()["steps"] == ["a > b", "b > c"]
    apart = lambda x: tuple(values(spark, [x], T.rationale_parts(F.col("t")))[0])
    assert apart("হয়। [কারণ: a > b আৰু b > c সেয়ে a > c") == (["a > b", "b > c"], "a > c", "হয়।", False)
    assert apart("x [कारण: ] y [कारण: a] z") == ([], None, "x  y [कारण: a] z", True)
    assert apart(" plain ") == ([], None, "plain", True) and apart("[note: a] b")[2:] == ("[note: a] b", True)
    assert apart("[कारण: a इसलिए b इसलिए c]") == (["a"], "b", "", True)
    assert values(spark, [None, "a"], T.rationale_parts(F.col("t")))[0] is None
    assert values(spark, ["aXbX"], T.count_of(F.col("t"), "X")) == [2]


def test_signatures(spark):
    a, b = parameters()
    rng = random.Random(1337)
    assert a[0] == rng.getrandbits(63) | 1

    def restated(t):
        t = " ".join(t.split())
        sh = [t[i : i + 8] for i in range(max(1, len(t) - 7))]
        return [f"{min((x * zlib.crc32(s.encode()) + y) % 2**64 for s in sh):016x}" for x, y in zip(a[:16], b[:16], strict=True)]

    texts = ["", "short", "é" * 30, "the quick brown fox jumps over the lazy dog " * 5]
    assert values(spark, texts, signature(F.col("t"))) == [restated(t) for t in texts]


def test_near_pairs_small_and_banded(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(130)]
    docs += [(200 + i, docs[i][1] + " tail") for i in range(10)]
    few = spark.createDataFrame(docs[:20] + docs[-10:], "doc_id long, text string")
    many = spark.createDataFrame(docs, "doc_id long, text string")
    want = {(i, 200 + i) for i in range(10)}
    for df in (few, many):
        pairs = {(r["id_a"], r["id_b"]) for r in dedup.near_pairs(df).collect()}
        assert pairs == want
    left = {r["doc_id"] for r in dedup.drop_later(many, dedup.near_pairs(many)).collect()}
    assert left == {i for i, _ in docs if i < 200}


def test_chain_of_near_copies_drops_pairwise(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2, 0.7), (2, 3, 0.7)], "id_a long, id_b long, similarity double")
    assert [r["doc_id"] for r in dedup.drop_later(docs, pairs).collect()] == [1]


def test_scores(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    pairs = [(" ".join(rng.choice("abcd") for _ in range(rng.randrange(9))), " ".join(rng.choice("abcd") for _ in range(rng.randrange(9)))) for _ in range(60)]
    got = values(spark, pairs, S.rouge_l(F.col("a"), F.col("b")), "a string, b string")
    for (a, b), g in zip(pairs, got, strict=True):
        x, y = a.split(), b.split()
        n = lcs(x, y) if x and y else 0
        want = 2 * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y)) if n else 0.0
        assert abs(g - want) < 1e-12
    f1 = values(spark, [("a a b", "a b b"), ("", ""), ("a", "")], S.token_f1(F.col("a"), F.col("b")), "a string, b string")
    assert [round(x, 6) for x in f1] == [0.666667, 1.0, 0.0]
    assert values(spark, [("यह है।और", "यह है।"), ("x", "y")], S.strict_match(F.col("a"), F.col("b")), "a string, b string") == [True, False]
    assert values(spark, [("है", "वह है"), ("", "x")], S.exact_match(F.col("a"), F.col("b")), "a string, b string") == [True, False]


def test_script_counts(spark):
    text = "राम a।"
    assert values(spark, [text], T.in_script(F.col("t"), HINDI)) == [4]
    assert values(spark, [text, ""], T.script_fraction(F.col("t"), HINDI)) == [4 / 5, 0.0]
    assert values(spark, ["añb 1!"], T.in_script(F.col("t"), LATIN)) == [4]
    assert unicodedata.normalize("NFC", "é") == values(spark, ["é"], T.nfc(F.col("t")))[0]
    assert hashlib.sha256(b"x").hexdigest() == values(spark, ["x"], S.doc_hash(F.col("t")))[0]
    assert re.fullmatch(r"[0-9a-f]{8}", values(spark, ["http://a/b?x"], T.cache_name(F.col("t")))[0].split("-")[-1])
