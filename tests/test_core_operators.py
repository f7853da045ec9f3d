"""Operators on small tables: selection, reasoning, tokens, training, sources, sinks, streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import transliteration
from corpuslab.operators import evaluation, leakage, ngrams, quality, reasoning, select, stats, tokens, training
from corpuslab.sources import registry, scan, sinks
from corpuslab.streaming.incremental import ingest, windowed_counts


def test_quota_keeps_the_row_that_goes_beyond(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "i long, tok long")
    assert sorted(r["i"] for r in quality.quota(df, [F.col("i")], {"tok": 25}).collect()) == [0, 1, 2]
    assert quality.quota(df, [F.col("i")], {"tok": 10**6, "*": 4}).count() == 4
    assert quality.quota(df.limit(0), [F.col("i")], {"tok": 25}).count() == 0


def test_splits(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = select.exact_split(df, "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": 980, "val": 10, "test": 10}
    assert all(r["rank"] == r["k"] for r in select.ranked(df, [F.col("k")]).collect())
    assert select.sample(df, "k", 7, 3).count() == 7


def solve(premises, query):
    """Plain closure over at most a few names."""
    names = {n for s, _, o in premises for n in (s, o)}
    reach = {}
    for s, r, o in premises:
        if r == "=":
            reach[s, o] = max(reach.get((s, o), 0), 0)
            reach[o, s] = max(reach.get((o, s), 0), 0)
    equal = set(reach) | {(n, n) for n in names}
    for k in names:
        for i in names:
            for j in names:
                if (i, k) in equal and (k, j) in equal:
                    equal.add((i, j))
    for s, r, o in premises:
        if r != "=":
            a, b = (s, o) if r == ">" else (o, s)
            reach[a, b] = 1
    for k in names:
        for i in names:
            for j in names:
                if (i, k) in reach and (k, j) in reach:
                    reach[i, j] = max(reach.get((i, j), 0), reach[i, k], reach[k, j])
    x, y = query
    if x == y:
        return "=", None
    if x not in names or y not in names:
        return None, "unknown entity"
    f, b = (x, y) in reach, (y, x) in reach
    if (x, y) in equal:  # whatever else is said of them
        return "=", None
    if f and b:
        return None, "cycle"
    return (">", None) if f else ("<", None) if b else (None, "underdetermined")


def test_solver(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        names = "abcde"[: rng.randint(2, 5)]
        premises = [(rng.choice(names), rng.choice("<>="), rng.choice(names)) for _ in range(rng.randint(1, 5))]
        premises = [p for p in premises if p[0] != p[2]] or [("a", ">", "b")]
        rows.append((i, premises, (rng.choice("abcdef"), rng.choice(names))))
    df = spark.createDataFrame(rows, "id long, premises array<struct<s: string, rel: string, o: string>>, query struct<x: string, y: string>")
    got = {r["id"]: (r["relation"], r["error"]) for r in reasoning.solved(df).collect()}
    assert got == {i: solve(p, q) for i, p, q in rows}


def test_generated_examples_hold(spark):
    rows = reasoning.generate(spark, 90, [f"नाम{i}" for i in range(40)], 3, sizes=(3, 4), least_hops=2)
    rows = rows.cache()
    found = rows.collect()
    assert len(found) == 90 == len({r["text"] for r in found})
    counts = {r["relation"]: r["count"] for r in rows.groupBy("relation").count().collect()}
    assert max(counts.values()) <= 30
    assert all(solve([tuple(p) for p in r["premises"]], tuple(r["query"]))[0] == r["relation"] for r in found)
    hops = {r["id"]: r["hops"] for r in reasoning.hops(rows).collect()}
    assert all(hops[r["id"]] == r["hops"] >= 2 for r in found)
    back = rows.where("paradigm <> 'conversational'").select("premises", reasoning.parsed(F.col("text")).alias("p")).collect()
    assert all(sorted(map(tuple, r["p"])) == sorted(map(tuple, r["premises"])) for r in back)
    again = {r["id"] for r in reasoning.generate(spark, 90, [f"नाम{i}" for i in range(40)], 3, sizes=(3, 4), least_hops=2, partitions=7).collect()}
    assert again == {r["id"] for r in found}


def test_asserted_relation_tolerates_misspelt_names(spark):
    rows = [(1, "राम की उम्र श्याम की उम्र से अधिक है।"), (2, "रामा की उम्र श्याम की उम्र से कम है। और"), (3, "कुछ और")]
    df = spark.createDataFrame(rows, "id long, pred string").withColumn("query", F.struct(F.lit("राम").alias("x"), F.lit("श्याम").alias("y"))).withColumn("attribute", F.lit("उम्र"))
    assert [r["asserted"] for r in reasoning.asserted(df).orderBy("id").collect()] == [">", "<", None]


def test_relation_metrics(spark):
    df = spark.createDataFrame([("<", "<"), ("<", ">"), (">", ">"), ("=", None)], "gold string, pred string")
    r = leakage.relation_metrics(df).first()
    assert (r["accuracy"], r["recall_lt"], r["recall_eq"], r["recall_gt"]) == (0.5, 0.5, 0.0, 1.0)


def test_structure_is_canonical(spark):
    rows = [([("a", ">", "b")], ("a", "b"), "t"), ([("x", ">", "y")], ("x", "y"), "t"), ([("x", ">", "y")], ("y", "x"), "t")]
    df = spark.createDataFrame(rows, "p array<struct<s: string, rel: string, o: string>>, q struct<x: string, y: string>, a string")
    a, b, c = (r[0] for r in df.select(leakage.structure(F.col("p"), F.col("q"), F.col("a"))).collect())
    assert a == b != c


def test_bleu_and_chrf_of_equal_texts(spark):
    df = spark.createDataFrame([("1", "a b c d e", "a b c d e"), ("2", "f g h i", "f g h i")], "id string, hypothesis string, reference string")
    assert abs(ngrams.bleu(df).first()[0] - 100) < 1e-9
    assert abs(ngrams.chrf(df).first()[0] - 100) < 1e-9
    none = spark.createDataFrame([("1", "xx", "yy")], "id string, hypothesis string, reference string")
    assert ngrams.chrf(none).first()[0] == 0


def test_chrf_with_words(spark):
    """By hand: characters ab,cd against ab,ce with orders up to 2, and words up to 2 with marks split off."""
    df = spark.createDataFrame([("1", "ab, cd", "ab, ce")], "id string, hypothesis string, reference string")
    assert [r[0] for r in df.select(ngrams.marked_words(F.col("hypothesis"))).collect()] == [["ab", ",", "cd"]]
    want = 100 * (4 / 5 + 3 / 4 + 2 / 3 + 1 / 2) / 4  # precision is recall
    assert abs(ngrams.chrf(df, order=2, word_order=2).first()[0] - want) < 1e-9


@pytest.mark.parametrize("n,block,wanted", [(0, 8, 4), (7, 8, 4), (8, 8, 4), (100, 8, 4), (100, 8, 40), (513, 16, 7)])
def test_block_starts(spark, n, block, wanted):
    got = spark.range(1).select(tokens.block_starts(F.lit(n), block, wanted)).first()[0]
    fit = n // block
    k = min(fit, wanted)
    want = [] if fit < 1 else [int(x) * block for x in np.linspace(0, fit - 1, k).astype(int)]
    assert got == want


def test_masking(spark):
    df = spark.createDataFrame([(1, [5, 6, 7], [8, 9]), (2, list(range(10, 30)), [8]), (3, [5], [])], "id long, p array<int>, a array<int>")
    rows = {r["id"]: r for r in tokens.masked(df, "p", "a", 8).collect()}
    assert rows[1]["x"] == [5, 6, 7, 8, 9, 3, 0, 0] and rows[1]["y"] == [-100, -100, 8, 9, 3, -100, -100, -100] and rows[1]["n_real"] == 5
    assert rows[2]["x"] == [10, 11, 12, 13, 14, 15, 8, 3] and rows[2]["y"] == [-100] * 5 + [8, 3, -100] and 3 not in rows


def test_ranked_bpe_is_the_librarys(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    n = library.get_piece_size()
    rows = [(library.id_to_piece(i), i, float(library.get_score(i)), 6 if library.is_byte(i) else 3 if library.is_control(i) else 2 if library.is_unknown(i) else 1) for i in range(n)]
    vocabulary = spark.createDataFrame(rows, "piece string, id int, score double, type int")
    first = next(i for i, r in enumerate(rows) if r[3] == 6)
    places = {"first_byte": first, "first_merge": first + 256}
    rng = random.Random(3)
    alphabet = "abcdefghijklmnop  ,.éßकখ’—"
    texts = ["The cat sat on the mat.", "ab é 🙂 x", *(" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))).split()) for _ in range(60))]
    df = spark.createDataFrame([(t,) for t in texts if t], "text string")
    got = tokens.with_pieces(tokens.decoded(tokens.encoded(df, vocabulary, **places), vocabulary, **places), vocabulary, **places).collect()
    for r in got:
        assert r["ids"] == library.encode(r["text"]) and r["decoded"] == library.decode(r["ids"]) and r["pieces"] == library.encode(r["text"], out_type=str)
        assert [i for g in r["segments"] for i in g["ids"]] == r["ids"]
    special = tokens.special_ids(n)
    one = tokens.decoded(tokens.encoded(spark.createDataFrame([("a <COT_START>b<REL_GT>",)], "text string"), vocabulary, special=special, **places), vocabulary, special=special, **places).first()
    assert one["ids"] == [*library.encode("a"), n, *library.encode("b"), n + 2] and one["decoded"] == "a<COT_START>b<REL_GT>"
    exported = json.loads(tokens.vocabulary_json(vocabulary, 0, 2).first()["json"])
    assert [p[0] for p in exported["pieces"]] == [r[0] for r in rows] and exported["eos_id"] == 2 and exported["pieces"][first][2] == 6


def test_unigram_is_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    table = tokens.model_vocabulary(spark, pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))
    rows = table.orderBy("id").collect()
    first = min(r["id"] for r in rows if r["type"] == 6)
    least = min(r["score"] for r in rows if r["type"] == 1)
    # the library would also use pieces that are not plain, so they get a score that no path takes
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([(r["piece"], r["score"] if r["type"] == 1 else least) for r in rows], 0, True))
    model = tokens.unigram_of(table, first_byte=first, unknown=0)
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choice("abcdefghijklmnoprstuvwéßকখ’—🙂") for _ in range(rng.randint(1, 25))) for _ in range(400)] + ["▁The", "▁international", "▁"]
    for w in words:
        assert model.word(w) == library.encode(w, add_special_tokens=False).ids, w


@pytest.mark.parametrize("first_byte", [None, 50])
def test_unigram_best_path_against_all_segmentations(first_byte):
    import itertools

    rng = random.Random(5)
    for _ in range(150):
        pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 9))})
        scores = {p: -rng.uniform(0.5, 9) for p in pieces}
        model = tokens.Unigram({p: i + 2 for i, p in enumerate(pieces)}, scores, first_byte=first_byte)
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        best = float("-inf")
        for cuts in itertools.product((False, True), repeat=len(word) - 1):
            ends = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
            parts = [word[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            if all(p in scores or len(p) == 1 for p in parts):
                best = max(best, sum(scores.get(p, model.least) for p in parts))
        found = model.best(word)
        assert "".join(found) == word and abs(sum(scores.get(p, model.least) for p in found) - best) < 1e-9
        ids = model.word(word)
        assert first_byte or (model.unknown, model.unknown) not in zip(ids, ids[1:], strict=False)


def test_unigram_over_texts(spark):
    pieces = ["<unk>", "▁", "▁ab", "a", "b", "ab", "▁a"]
    table = spark.createDataFrame([(p, i, -float(i), 2 if i == 0 else 1) for i, p in enumerate(pieces)], "piece string, id int, score double, type int")
    model = tokens.unigram_of(table, first_byte=None, unknown=0)
    df = spark.createDataFrame([("ab  xyab a", 1), ("", 2), (None, 3)], "text string, _coded int")
    rows = tokens.measured(df, model).collect()
    assert rows[0]["ids"] == [2, 1, 0, 5, 1, 3] and rows[0]["n_unknown"] == 1 and rows[0]["n_tokens"] == 6 and rows[0]["_coded"] == 1
    assert rows[1]["ids"] == [] and rows[1]["decoded"] == "" and rows[2]["ids"] is None
    small = tokens.unigram_of(table, first_byte=None, unknown=0, size=3)
    assert small.encode("ab") == [2] and small.encode("b") == [1, 0]


def test_window_starts_are_a_uniform_sample(spark):
    from collections import Counter

    df = spark.range(6000).select(tokens.random_starts(F.lit(7), F.lit(3), 2, F.col("id"), 9).alias("s"))
    counts = Counter(tuple(r["s"]) for r in df.collect())
    assert len(counts) == 10 and all(a < b for a, b in counts) and all(480 < n < 720 for n in counts.values())


def test_generation_raises_when_names_run_out(spark):
    with pytest.raises(ValueError, match="different texts"):
        reasoning.generate(spark, 1500, ["a", "b"], 1, {"transitive": 1.0}, (2,))


def test_transliteration(spark):
    scored = {"भारत": (1, -5.0), "राम": (1, -3.0), "अच्छा": (1, -4.0)}
    pieces = lambda t: [(False, scored[t][1])] if t in scored else [(False, -9.0)] * len(t)
    spell = transliteration.Speller("hindi", pieces)
    assert [spell.suggest(w)[0] for w in ("bharat", "RAM", "achchha")] == ["भारत", "राम", "अच्छा"] and spell.suggest("") == [] and sorted(spell.suggest("ram")) == sorted(["राम", "रम", "रां", "रं"]) and len(spell.suggest("karana")) == 5
    assert transliteration.Speller("assamese", lambda t: [(False, 0.0)] * len(t)).suggest("ram", 200).count("ৰাম") == 1
    df = spark.createDataFrame([("main ram hun, 5",), (None,)], "text string")
    out = transliteration.transliterated(df, spell).collect()
    assert "राम" in out[0]["native"] and out[0]["native"].endswith(", 5") and out[1]["native"] is None


def test_sources_as_plugs(spark, tmp_path):
    (tmp_path / "crawler_x.jsonl").write_text('{"doc_id": "1", "url": "u", "text": "a"}\n{"doc_id": "2", "url": "u", "text": " "}\n', encoding="utf-8")
    (tmp_path / "y.txt").write_text("b\n", encoding="utf-8")
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}', encoding="utf-8")
    sources = [registry.Source("y", "other", 2, lambda s: scan.texts(s, str(tmp_path / "y.txt"))), registry.Source("x", "manual", 1, lambda s: scan.crawled(s, str(tmp_path), "x"))]
    assert [tuple(r) for r in registry.table(spark, sources).collect()] == [("x", "manual", 1), ("y", "other", 2)]
    assert sorted((r["source"], r["text"], r["source_type"]) for r in registry.documents(spark, sources).collect()) == [("x", "a", "manual"), ("y", "b", "other")]
    assert registry.documents(spark, sources, {"x", "y"}).count() == 0 and registry.config(spark, str(tmp_path / "c.json")) == {"a": {"b": 1}}
    sinks.write_sources(stats.registry(registry.table(spark, sources), spark.createDataFrame([("x",)], "source string"), spark.createDataFrame([], "source string")), str(tmp_path / "s"))
    assert [r["completed"] for r in spark.read.json(str(tmp_path / "s")).orderBy("priority").collect()] == [True, False]
    by = stats.source_stats(registry.documents(spark, sources))
    data = json.loads(stats.report_json(by, 3, 4, ["z"]).first()["json"])
    assert data["total_tokens_estimate"] == 2 and data["failed_sources"] == ["z"] and [x["name"] for x in data["sources"]] == ["x", "y"]
    assert [tuple(r) for r in stats.crawl_stats(registry.documents(spark, sources)).orderBy("source").collect()] == [("x", 1, 1, 1), ("y", 1, 1, 1)]


def test_evaluation(spark):
    names = [f"नाम{i}" for i in range(20)]
    made = reasoning.with_rationale(reasoning.generate(spark, 30, names, 5)).drop("relation")
    perfect = evaluation.judged(made, made.select("id", F.col("cot_text").alias("prediction")))
    one = evaluation.summary(perfect).first()
    assert one["n_examples"] == 30 and one["accuracy_answer_strict"] == one["cot_decomposed_score"] == one["accuracy_name_copy"] == 1.0
    assert perfect.where("gold <> pred_rel").count() == 0
    assert evaluation.summary(evaluation.judged(made, made.select("id", F.lit(None).cast("string").alias("prediction")))).first()["accuracy_answer_only"] == 0.0
    rows = spark.createDataFrame([("1", "greedy", "a b c d e", "a b c d e"), ("1", "top", "x y", "a b c d e")], "id string, label string, hypothesis string, reference string")
    scores = {r["label"]: r for r in evaluation.generation_scores(rows, ["greedy", "top"]).collect()}
    assert abs(scores["greedy"]["bleu"] - 100) < 1e-9 and scores["greedy"]["rouge_l"] == 1.0 and scores["top"]["rouge_l"] == 0.0 and scores["top"]["distinct_1"] == 1.0
    assert evaluation.accuracy(rows, "hypothesis", "reference").first()["accuracy"] == 0.5


def test_random_windows(spark):
    df = spark.createDataFrame([(1, list(range(100))), (2, [1, 2]), (3, list(range(9)))], "doc_id long, ids array<int>")
    rows = tokens.random_windows(df, 8, 5, 3).collect()
    assert {d: sum(r["doc_id"] == d for r in rows) for d in (1, 2, 3)} == {1: 5, 2: 0, 3: 1}
    assert all(r["x"] == list(range(r["start"], r["start"] + 8)) and r["y"] == list(range(r["start"] + 1, r["start"] + 9)) for r in rows if r["doc_id"] == 1)
    assert tokens.joined_ids(df, "doc_id").first()["ids"][-10:] == [*range(9), 3]


def test_ranked_bpe_round_trip(spark, tmp_path):
    pieces = ["<pad>", "<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "▁a", "ab", "▁ab"]
    (tmp_path / "v.vocab").write_text("".join(f"{p}\t{i}\n" for i, p in enumerate(pieces)), encoding="utf-8")
    vocabulary = tokens.read_vocabulary(spark, str(tmp_path / "v.vocab"))
    assert {r["type"]: r["count"] for r in vocabulary.groupBy("type").count().collect()} == {1: 6, 2: 1, 3: 3, 6: 256}
    df = spark.createDataFrame([("ab aé",), ("",), (None,)], "text string")
    rows = tokens.decoded(tokens.encoded(df, vocabulary), vocabulary).collect()
    assert rows[0]["ids"][0] == 265 and rows[0]["decoded"] == "ab aé"
    assert rows[1]["ids"] == [] and rows[2]["ids"] is None


def test_early_stop_and_log(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0.1, 0.6, 0.5, 0.55, 0.7, 0.1, 0.2, 0.3])], "step long, acc double")
    rows = training.early_stop(df, "step", "acc", 0.5, 2).orderBy("step").collect()
    assert [r["stop"] for r in rows] == [False, False, False, True, False, False, True, True]
    old = spark.createDataFrame([(1, "o"), (2, "o"), (3, "o")], "step long, w string")
    new = spark.createDataFrame([(3, "n"), (4, "n")], "step long, w string")
    assert sorted(map(tuple, training.merged_log(old, new).collect())) == [(1, "o"), (2, "o"), (3, "n"), (4, "n")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n two\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"text": "x"}\nnot json\n{"text": " ", "sentence": "s"}\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text('id,content\n1,"a\nb"\n2,\n', encoding="utf-8")
    assert sorted(map(tuple, scan.lines(spark, str(tmp_path / "a.txt")).collect())) == [("a.txt#0", "one"), ("a.txt#2", "two")]
    assert sorted(map(tuple, scan.json_lines(spark, str(tmp_path / "b.jsonl")).collect())) == [("b.jsonl#0", "x"), ("b.jsonl#2", "s")]
    assert [tuple(r) for r in scan.csv(spark, str(tmp_path / "c.csv")).collect()] == [("c.csv#0", "a\nb")]
    got = scan.mixed(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.jsonl"), str(tmp_path / "c.csv"), "d/", 3).collect()
    assert [r["doc_id"] for r in got] == ["d/a.txt#0", "d/a.txt#2", "d/b.jsonl#0"]
    (tmp_path / "cc.txt").write_text("y" * 130 + "\n\nshort\n\n" + "z" * 121, encoding="utf-8")
    assert [r["doc_id"] for r in scan.blank_line_documents(spark, str(tmp_path / "cc.txt"), "cc").orderBy("doc_id").collect()] == ["cc/doc_0", "cc/doc_1"]
    maps = spark.createDataFrame([("top", "<loc> http://a/sitemap1.xml </loc><loc>http://a/p</loc>"), ("http://a/sitemap1.xml", "<loc>http://a/q</loc>")], "url string, xml string")
    assert [r["url"] for r in scan.sitemap_pages(maps, "top", 10).collect()] == ["http://a/p", "http://a/q"]


def test_wiki_dump(spark, tmp_path):
    page = "<page><title>{t}</title><ns>{n}</ns><id>{i}</id>{r}<revision><text>{x}</text></revision></page>"
    pages = [page.format(t="a", n=0, i=1, r="", x="राम [[श्याम|मोहन]] घर"), page.format(t="b", n=1, i=2, r="", x="राम"), page.format(t="c", n=0, i=3, r='<redirect title="a" />', x="राम"), page.format(t="d", n=0, i=4, r="", x="latin only")]
    (tmp_path / "d.xml").write_text("<mediawiki>" + "\n".join(pages) + "</mediawiki>", encoding="utf-8")
    from corpuslab.profiles import HINDI

    assert [tuple(r) for r in scan.wiki_dump(spark, str(tmp_path / "d.xml"), HINDI).collect()] == [("wiki/1", "राम मोहन घर")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(i, [i, i + 1]) for i in range(50)], "doc_id long, ids array<int>").repartition(3)
    for wide, kind in ((False, "<u2"), (True, "<u4")):
        index = sinks.write_tokens(docs, str(tmp_path / f"t{wide}"), "doc_id", wide=wide)
        parts = sorted(map(tuple, index.select("start", "path", "tokens", "docs").collect()))
        raw = np.concatenate([np.fromfile(p.removeprefix("file://"), kind) for _, p, _, _ in parts])
        assert len(parts) > 1 and raw.tolist() == [x for i in range(50) for x in (i, i + 1, 3)]
        assert [s for s, *_ in parts] == np.cumsum([0, *(t for *_, t, _ in parts)])[:-1].tolist()
        counts = scan.token_counts(spark, f"file://{tmp_path}/t{wide}/*.bin", wide=wide).collect()
        assert sum(r["tokens"] for r in counts) == 150 and sum(r["docs"] for r in counts) == int((raw == 3).sum())
        assert sinks.join_parts(index, str(tmp_path / f"one{wide}.bin")) == 150 and np.fromfile(tmp_path / f"one{wide}.bin", kind).tolist() == raw.tolist()
    with pytest.raises(ValueError):
        sinks.write_tokens(docs.limit(0), str(tmp_path / "none"), "doc_id")
    with pytest.raises(Exception, match="does not fit"):
        sinks.write_tokens(docs.withColumn("ids", F.array(F.lit(70000))), str(tmp_path / "large"), "doc_id")
    rows = spark.createDataFrame([("d1", "s", "x\ny", "manual", "h")], "doc_id string, source string, text string, source_type string, hash string")
    sinks.write_clean(rows, str(tmp_path / "clean"))
    sinks.append_manifest(rows, str(tmp_path / "m"), "s")
    assert {r["kind"] for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"doc", "source_done"}
    out = sinks.write_splits(rows.withColumn("split", F.lit("train")), str(tmp_path / "sp")).collect()
    assert [tuple(r) for r in out] == [("train", 1)]
    assert spark.read.text(str(tmp_path / "sp/txt")).first()["value"] == "x y"


def test_token_ranges(spark, tmp_path, monkeypatch):
    ids = np.arange(5000, dtype="<u2") % 7
    ids.tofile(tmp_path / "a.bin")
    monkeypatch.setattr(scan, "RANGE", 1024)
    assert [tuple(r) for r in scan.token_counts(spark, f"file://{tmp_path}/a.bin", end=3).collect()] == [("a.bin", 5000, int((ids == 3).sum()))]


def test_corpus_to_tokens(spark, tmp_path):
    pieces = ["<pad>", "<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "▁a"]
    (tmp_path / "v.vocab").write_text("".join(f"{p}\t{i}\n" for i, p in enumerate(pieces)), encoding="utf-8")
    (tmp_path / "clean").mkdir()
    for name in ("one", "two", "train", "reasoning_x"):
        (tmp_path / "clean" / f"{name}.txt").write_text("".join(f"a{'b' * (i % 5)}\n" for i in range(150)), encoding="utf-8")
    vocabulary = tokens.read_vocabulary(spark, str(tmp_path / "v.vocab"))
    rows = sinks.corpus_to_tokens(spark, str(tmp_path / "clean"), vocabulary, str(tmp_path / "bins")).collect()
    assert sum(r["docs"] for r in rows) == 300 and sum(r["tokens"] for r in rows) == 2 * sum(2 + i % 5 for i in range(150))
    line = spark.createDataFrame([("1", "a", "b", None), ("2", "a", None, "a a")], "id string, text string, answer_text string, cot_text string")
    assert {r["id"]: r["ids"] for r in tokens.sft_ids(line, vocabulary).collect()} == {"1": [263, 260, 262], "2": [263, 263, 263]}


def stream_of(spark, source):
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).json(str(source))


def put(spark, source, n, rows, out, check, **more):
    source.mkdir(exist_ok=True)
    (source / f"{n}.json").write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in rows))
    ingest(spark, stream_of(spark, source), str(out), str(check), **more).awaitTermination(120)


def test_incremental_ingestion(spark, tmp_path):
    places = (tmp_path / "out", tmp_path / "check")
    put(spark, tmp_path / "in", 1, [(1, "a"), (2, "a"), (3, "b")], *places)
    put(spark, tmp_path / "in", 2, [(4, "b"), (5, "c")], *places)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out/docs")).collect()) == [1, 3, 5]


def test_ingestion_up_to_a_quota(spark, tmp_path):
    places = (tmp_path / "out", tmp_path / "check")
    put(spark, tmp_path / "in", 1, [(i, f"t{i}") for i in range(3)], *places, limits={"*": 5})
    put(spark, tmp_path / "in", 2, [(i, f"t{i}") for i in range(10, 14)], *places, limits={"*": 5})
    put(spark, tmp_path / "in", 3, [(20, "t20")], *places, limits={"*": 5})
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out/docs")).collect()) == [0, 1, 2, 10, 11]


def test_windowed_counts_plan(spark):
    df = spark.readStream.format("rate").load().withColumn("event_type", F.lit("a"))
    assert windowed_counts(df, "timestamp").isStreaming


def test_rationales(spark):
    rows = [(1, [("a", ">", "b"), ("c", "<", "b"), ("c", "=", "d")], ("d", "a")), (2, [("a", "=", "b")], ("a", "b")), (3, [("a", ">", "b"), ("c", ">", "d")], ("a", "d"))]
    df = spark.createDataFrame(rows, "id long, premises array<struct<s: string, rel: string, o: string>>, query struct<x: string, y: string>")
    got = {r["id"]: r["rationale"] for r in reasoning.rationales(df).collect()}
    assert got == {1: "[कारण: d = c और c < b और b < a इसलिए d < a]", 2: "[कारण: a = b इसलिए a = b]"}
    assert {r["id"]: r["rationale"] for r in reasoning.rationales(df, "assamese").collect()}[2] == "[কাৰণ: a = b সেয়ে a = b]"
    # the walk in depth goes on from the last neighbour
    branched = spark.createDataFrame([(1, [("a", ">", "b"), ("b", ">", "c"), ("a", ">", "c")], ("a", "c")), (2, [("a", ">", "b"), ("a", ">", "c"), ("b", ">", "c")], ("a", "b"))], df.schema)
    assert [r["p"] for r in branched.select(reasoning.path_of(F.col("premises"), F.col("query.x"), F.col("query.y")).alias("p")).collect()] == [["a", "c"], ["a", "b"]]


def test_asserted_by_pattern(spark):
    rows = [("राम की उम्र श्याम की उम्र से अधिक है।",), ("श्याम की उम्र राम की उम्र से अधिक है।",), ("श्याम की उम्र राम की उम्र के बराबर है।",), ("और",), ("राम की उम्र श्याम की उम्र से अधिक नहीं है।",), ("राम की उम्र श्याम की उम्र के बराबर नहीं है।",)]
    df = spark.createDataFrame(rows, "pred string").withColumn("query", F.struct(F.lit("राम").alias("x"), F.lit("श्याम").alias("y")))
    assert [r["asserted"] for r in reasoning.asserted_by_pattern(df).collect()] == [">", "<", "=", None, "<", None]
    rows = [("ৰামৰ বয়স শ্যামৰ বয়সতকৈ বেছি।",), ("শ্যামৰ বয়স ৰামৰ বয়সতকৈ কম নহয়।",), ("শ্যামৰ বয়স ৰামৰ বয়সৰ সমান।",)]
    df = spark.createDataFrame(rows, "pred string").withColumn("query", F.struct(F.lit("ৰাম").alias("x"), F.lit("শ্যাম").alias("y")))
    assert [r["asserted"] for r in reasoning.asserted_by_pattern(df, "assamese").collect()] == [">", "<", "="]


def test_a_denied_equality_is_refused(spark):
    rows = [("a की उम्र b की उम्र के बराबर नहीं है। क्या x?",), ("a की उम्र b की उम्र से कम नहीं है। a की उम्र c की उम्र के बराबर है। क्या a की उम्र c की उम्र से कम है?",)]
    got = spark.createDataFrame(rows, "t string").select(reasoning.parsed(F.col("t")).alias("p")).collect()
    assert got[0]["p"] is None and [tuple(x) for x in got[1]["p"]] == [("a", ">", "b"), ("a", "=", "c")]


def test_dataset(spark, tmp_path):
    names = {s: [f"{s}{i}" for i in range(25)] for s in ("train", "val", "test")}
    splits = reasoning.dataset(spark, {"train": 120, "val": 30, "test": 30}, names, fresh=True, real_share=0.5, extra=9, hard=6)
    assert len(splits) == 15
    counts = {r["split"]: r["n"] for r in sinks.write_examples(splits, names, str(tmp_path / "d")).collect()}
    assert counts["train"] == 120 and counts["test_depth3"] == 9 and counts["test_depth10"] == 6
    back = {s: scan.examples(spark, str(tmp_path / f"d/split={s}")).collect() for s in ("train", "val", "test_branch", "test_distractor_attr")}
    assert {r["paradigm"] for r in back["train"]} <= {*reasoning.TRAINED, "negation"}
    real = sum(n in names["train"] for r in back["train"] for n in r["entities"]) / sum(len(r["entities"]) for r in back["train"])
    assert 0.35 < real < 0.65
    held = {*names["val"], *names["test"]}
    assert not held & {n for r in back["train"] for n in r["entities"]}
    for rows in back.values():
        for r in rows:
            rel = r["answer_rel"].split()[1]
            assert solve([tuple(p) for p in r["premises"]], tuple(r["query"]))[0] == rel and len(set(r["entities"])) == len(r["entities"])
            assert r["cot_text"].endswith(r["answer_text"]) and f"{r['query'][0]} {rel} {r['query'][1]}]" in r["cot_text"]
    assert all(len(r["premises"]) == 6 for r in back["test_branch"]) and all(len(r["distractors"]) == 3 and len(r["premises"]) == 3 for r in back["test_distractor_attr"])
    assert json.loads(spark.read.text(str(tmp_path / "d/manifest.json")).first()[0])["counts"] == counts
    with pytest.raises(ValueError):
        reasoning.dataset(spark, {"train": 1, "val": 1, "test": 1}, dict.fromkeys(("train", "val", "test"), ["a", "b"]))
    bank = reasoning.question_bank(spark, names["test"], depths=(2, 4), each=5)
    assert {r["hops"]: r["count"] for r in bank.groupBy("hops").count().collect()} == {2: 5, 4: 5}


@pytest.mark.parametrize("language", ["hindi", "assamese"])
def test_fresh_names(language):
    maker, rng = reasoning.FreshNames(language, frozenset(["x"])), random.Random(4)
    names = maker.some(rng, 500)
    spec = reasoning.LANGUAGES[language]
    assert len(set(names)) == 500 and all(3 <= len(n) <= 14 and n not in spec.words for n in names)
    assert all(spec.profile.first <= ord(c) <= spec.profile.last for n in names for c in n)


def test_curriculum(spark):
    rows = [(1, [("a", ">", "b")], ("a", "b")), (2, [("a", ">", "b"), ("b", ">", "c")], ("a", "c"))]
    df = spark.createDataFrame(rows, "id long, premises array<struct<s: string, rel: string, o: string>>, query struct<x: string, y: string>")
    assert [r["id"] for r in reasoning.up_to_hops(df, 1).collect()] == [1] and reasoning.up_to_hops(df, None).count() == 2
    with pytest.raises(ValueError):
        reasoning.up_to_hops(df, 0)


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_orders_hold_for_rows_with_further_columns(spark, no_reuse):
    n = 30_000
    rows = spark.range(n).select(F.expr("id * 7919 % 30011").alias("key"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 9).alias("tok"), (F.col("id") % 3).alias("g")).repartition(8)
    local = sorted(map(tuple, rows.collect()))

    def first(costs, limit):
        total, out = 0, []
        for row, c in costs:
            if total >= limit:
                break
            out.append(row)
            total += c
        return out

    for _ in range(2):
        assert sorted(map(tuple, quality.quota(rows, [F.col("key")], {"tok": 50_000}).collect())) == first([(r, r[2]) for r in local], 50_000)
        want = [x for g in range(3) for x in first([(r, r[2]) for r in local if r[3] == g], 9_000)]
        assert sorted(map(tuple, quality.quota(rows, [F.col("key")], {"tok": 9_000}, ["g"]).collect())) == sorted(want)
        counts = {r["split"]: r["count"] for r in select.exact_split(rows, "key").groupBy("split").count().collect()}
        assert counts == {"train": 29_400, "val": 300, "test": 300}
        assert [r["rank"] for r in select.ranked(rows, [F.col("key"), F.col("text")]).orderBy("key").collect()] == list(range(n))
    assert "Exchange" not in quality.quota(rows.repartition(1).cache(), [F.col("key")], {"tok": 50_000}).select("key")._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]


def test_orders_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([(None, 5), (1, 5), (1, 5), (2, None), (3, 5)] + [(7, 1)] * 50, "k long, tok long")
    assert sorted((r["k"] or 0, r["tok"] or 0) for r in quality.quota(rows, [F.col("k")], {"tok": 6}).collect()) == [(0, 5), (1, 5), (1, 5)]
    assert quality.quota(rows, [F.col("k")], {"tok": 0}).count() == 0 and quality.quota(rows, [F.col("k")], {"tok": 10**6}).count() == 55
    split = select.exact_split(rows, "k", train=0.5, val=0.2)
    assert split.count() == 55 and split.groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert select.exact_split(rows.limit(0), "k").count() == 0 and select.ranked(rows.limit(0), [F.col("k")]).count() == 0
    assert sorted(r["rank"] for r in select.ranked(rows, [F.col("k")]).collect()) == list(range(55))


def test_contamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))).replace(" a", rng.choice([" a", "\na", "  a"]))) for i in range(60)] + [(99, None), (98, "")]
    items = []
    for k in range(80):
        text = rng.choice(docs[:60])[1]
        a = rng.randrange(len(text))
        items.append((k, text[a : a + rng.randint(1, 60)]))
    items += [(200, "not in any of them"), (201, None), (202, "")]
    got = {tuple(r) for r in leakage.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, d) for i, t in items if t for d, x in docs if x and t in x}
    assert leakage.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("ramu ramuji rams other", ["ram", "ramu"])], "t string, n array<string>")
    assert df.select(tokens.name_split(F.col("t"), F.col("n"))).first()[0] == ["ramu", "ramu", "ji", "ram", "s", "other"]
    df = spark.createDataFrame([(["x ", "ra", "mu", " y"], "ramu"), (["x"], "ramu")], "p array<string>, n string")
    assert [r[0] for r in df.select(tokens.positions_of(F.col("p"), F.col("n"))).collect()] == [[1, 2], []]


def test_scratch_tables_go(spark):
    import os

    from corpuslab.tables import scratch, written

    with scratch(spark) as made:
        a, at = written(spark.range(3).toDF("x"), "a")
        b, kept = written(a, "b")
        made.discard(kept)
    assert not os.path.exists(at.removeprefix("file://")) and b.count() == 3


def test_extra_columns_with_names_of_the_operators_own(spark):
    from corpuslab.profiles import LATIN

    rows = [(i, "ab"[i % 2], 10, "A text of some twenty letters, or more of them.", "x", "y", "z", "u", "v", "w") for i in range(12)]
    df = spark.createDataFrame(rows, "k long, g string, tok long, text string, _T0 string, _stretch string, _before string, _nfc string, _filtered string, _at_g string")
    kept = quality.quota(df, [F.col("k")], {"tok": 25}, ["g"])
    assert kept.columns == df.columns and sorted(r["k"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    ranks = select.ranked(df, [F.col("k")], "rank", ["g"])
    assert ranks.columns == [*df.columns, "rank"] and all(r["rank"] == r["k"] // 2 and r["_before"] == "z" for r in ranks.collect())
    clean = quality.cleaned(df, LATIN)
    assert clean.columns[: len(df.columns)] == df.columns and {(r["_nfc"], r["_filtered"], r["dropped"]) for r in clean.collect()} == {("u", "v", None)}
    named = df.withColumnRenamed("_nfc", "_rn")
    assert select.first_in_groups(named, ["g"], [F.col("k")], 2).select("k", "_rn").count() == 4


def test_contamination_of_any_length(spark):
    rng = random.Random(8)
    some = lambda a, b: "".join(rng.choice("ab é🙂") for _ in range(rng.randint(a, b)))
    docs = [(i, some(0, 150)) for i in range(60)] + [(60, None), (None, "ab")]
    items = [(f"i{k}", some(1, 4) if k % 3 else docs[k % 60][1][rng.randint(0, 9) :][: rng.randint(1, 140)]) for k in range(80)] + [("none", None), ("empty", "")]
    got = leakage.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    want = {(k, i) for k, x in items if x for i, t in docs if i is not None and t is not None and x in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)
