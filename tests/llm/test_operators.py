"""Each operator against brute force, a round trip or held-out accuracy, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from corpuslab.llm import bpe, html_cut, media, minhash, mixing, paragraphs, substring, token_orc, toxicity, warc  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, cluster long"


def words_of(text):
    return (text or "").encode().split()


def made(rng, n=160):
    """Documents with copies, near copies, shared passages, hot groups, and odd ones."""
    vocabulary = ["".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(k))
    rows = [text(rng.choice((3, 20, 60, 120, 300))) for _ in range(n)]
    passage = text(70)
    for i in range(0, n, 5):
        kind = rng.randrange(5)
        if kind == 0:
            rows.append(rows[i])
        elif kind == 1:
            w = rows[i].split(" ")
            for _ in range(max(1, len(w) // rng.choice((40, 25, 12)))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
        elif kind == 2:
            rows.append(text(15) + " " + passage + " " + text(15))
        elif kind == 3:
            rows.append((rows[i] + " ") * 3)
    base = text(150).split(" ")
    for _ in range(40):
        w = list(base)
        for _ in range(8):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append(" ".join(w))
    rows += [None, "", " \n\t ", "one", "one", "two words", "Two WORDS", "x" * 30000, " ".join(["long"] * 4000), "a b " * 60]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def rows():
    return made(random.Random(12))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, 2) for i, t in rows], DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("size,block", [(2, minhash.BLOCK_SHINGLES), (5, minhash.BLOCK_SHINGLES), (2, 900)])
def test_near_duplicates(docs, rows, size, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, size, 80, block).collect()}
    assert got == brute_components(rows, size, 80)


def test_near_duplicates_odd_tables(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (3, "z y x"), (5, "z y x"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 3, False), (5, 3, False), (3, 3, True), (5, 3, False), (9, 9, True)], key=str)
    kept = minhash.drop_near_duplicates(df.withColumn("rep", F.lit(1)), 2)
    assert kept.columns == ["doc_id", "text", "rep"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, 3, 9], key=str)


def test_blocks_of_a_cluster_lose_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**60, 100)
    sets = [np.unique(np.concatenate([base[rng.permutation(100)[:90]], rng.integers(0, 2**60, 5)])) for _ in range(60)]

    def components(edges):
        f = minhash.Forest()
        for a, b in edges:
            f.union(a, b)
        return {i: f.find(i) for i in range(60)}

    whole = components(minhash.linked_forest(list(range(60)), [0] * 60, sets, 80))
    side = [i % 3 for i in range(60)]
    edges = []
    for a in range(3):
        for b in range(a, 3):
            at = [i for i in range(60) if side[i] in (a, b)]
            edges += minhash.linked_forest(at, [side[i] for i in at], [sets[i] for i in at], 80)
    assert components(edges) == whole


def test_near_duplicates_in_more_partitions_than_rows(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:40], f"x{i}", *words[41:]])) for i in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == dict.fromkeys(range(6), 0)


@pytest.mark.parametrize("others,values", [(20, 256), (400, 256), (400, 3)])
def test_neighbours_meet_in_crowded_regions(others, values):
    rng = np.random.default_rng(others + values)
    rest = rng.integers(0, values, (3 * others, 8), dtype=np.uint8)
    for i in range(0, 3 * others, 7):
        rest[i] = rest[(i * 11) % others]
        rest[i, rng.permutation(8)[:3]] += 1
    region, rest = np.repeat(np.array([-5, 2, 9]), others), rest.view(np.int64)[:, 0]
    order = np.lexsort((rest, region))
    region, rest, rep = region[order], rest[order], rng.permutation(3 * others)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 130]) for x in (region, rest, rep)], ["region", "rest", "rep"]) for i in range(0, len(rep), 130)]
    forest = minhash.Forest()
    for batch in minhash._neighbours(iter(batches)):
        for a, b in zip(*(batch.column(c).to_pylist() for c in "ab"), strict=True):
            forest.union(a, b)
    equal = (rest.view(np.uint8).reshape(-1, 1, 8) == rest.view(np.uint8).reshape(1, -1, 8)).sum(2)
    pairs = np.argwhere((region[:, None] == region) & (equal >= minhash.AGREE))
    assert len(pairs) > len(rep) and all(forest.find(rep[a]) == forest.find(rep[b]) for a, b in pairs.tolist())
    where = dict(zip(rep.tolist(), region.tolist(), strict=True))
    assert all(where[forest.find(x)] == where[x] for x in where)


# ---------------------------------------------------------------- repeated passages


def brute_removed(rows, window):
    first = {}
    ws = {i: words_of(t) for i, t in rows}
    for i in sorted(ws):
        for k in range(len(ws[i]) - window + 1):
            first.setdefault(tuple(ws[i][k : k + window]), i)
    out = {}
    for i, w in ws.items():
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                cover[k : k + window] = [True] * window
        kept = [x for x, c in zip(w, cover, strict=True) if not c]
        out[i] = (len(w), sum(cover), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 5, 51, 104])
def test_repeated_spans(docs, rows, window):
    result, _ = substring.repeated_spans(docs, window)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result.collect()}
    assert got == brute_removed(rows, window)


def test_remove_repeats(docs, rows, empty, spark):
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns
    want = brute_removed(rows, 50)
    texts = dict(rows)
    for r in out.collect():
        n, removed, sha = want[r["doc_id"]]
        if removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == texts[r["doc_id"]]
    assert substring.remove_repeats(empty).count() == 0
    long = " ".join(map(str, range(60)))
    odd = spark.createDataFrame([(None, long), (4, long), (4, long), (2, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in substring.remove_repeats(odd).na.fill("").collect()) == sorted([("None", long), ("4", long), ("4", long), ("2", "")])


def test_levels():
    assert substring.levels(50) == [13, 25, 50] and substring.levels(104) == [13, 26, 52, 104] and substring.levels(51) == [13, 26, 51] and substring.levels(7) == [7]
    w = np.random.default_rng(1).integers(0, 3, 200).astype(np.uint64)
    for length in (1, 2, 3, 7, 25, 51):
        h, runs = substring.window_hashes(w, length), [tuple(w[i : i + length]) for i in range(len(w) - length + 1)]
        assert len(h) == len(runs) and len(set(h.tolist())) == len(set(runs)) == len(set(zip(h.tolist(), runs, strict=True)))


def test_windows_with_equal_first_hashes_are_told_apart():
    """Words by their length alone: passages of other words have equal first hashes, and other second ones."""
    a, b = ([f"{c}{'x' * (i % 7)}".encode() for i in range(60)] for c in "ab")
    first = [substring.window_hashes(np.array(list(map(len, t)), np.uint64), 50).tolist() for t in (a, b)]
    second = [set(substring.window_hashes(substring.SecondHashes().array(t), 50).tolist()) for t in (a, b)]
    assert first[0] == first[1] and not second[0] & second[1]
    # both passages of one document are looked up under one first hash; only the one whose second hash is gone is cut
    text = b" ".join([*a, *b]).decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"k"]), pa.array([text]), pa.array([substring.window_hashes(substring.WordHashes().array([*a, *b]), 50).view(np.int64).tolist()]), pa.array([np.array(sorted(second[0]), np.uint64).view(np.int64).tolist()])], ["doc_id", "key", "text", "gone", "gone_too"])
    assert next(substring._spans(50)(iter([batch]))).column("spans").to_pylist() == [[0, 60]]


# ---------------------------------------------------------------- tokens


def odd_texts(rng):
    letters = [chr(c) for c in [*range(1, 700), *range(0x300, 0x340), *range(0x900, 0x980), *range(0x2000, 0x2070), 0x1F600, 0x3000, 0x85]]
    out = ["".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice("abc 'std\n.,") for _ in range(rng.randrange(60))) for _ in range(500)]
    return [*out, "x<|endoftext|>a <|startoftext|> b", "<|ENDOFTEXT|>", "a" * 3000, "!?" * 2000, "ΣΑΣ's", "", "  ", "IT'S don't' ''", "\x1ca\x1db", "Á x\xa0y"]


def test_trie_encodes_as_the_library(spark, rows):
    texts = [t for _, t in rows] + odd_texts(random.Random(4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    coded = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert all(r["ids"] == want[r["doc_id"]] and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in coded)
    for r in bpe.digests(df, PATH).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_odd_tables(empty):
    assert bpe.encode(empty, PATH).count() == 0 and bpe.digests(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(empty.withColumn("ids", F.lit(1)), PATH)


def test_orc_round_trip(spark, docs, rows, empty, tmp_path):
    library = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_orc.round_trip(docs, PATH).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_orc.round_trip(empty, PATH).count() == 0
    token_orc.write_orc(docs, PATH, f"file://{tmp_path}/orc")
    plan = token_orc.read_orc(spark, f"file://{tmp_path}/orc").where("doc_id = 7")
    assert plan.count() == 1 and "PushedFilters" in plan._jdf.queryExecution().toString()


def scanned(df):
    """Rows that the scan of an executed plan has given."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_orc_passes_over_what_is_not_wanted(spark, tmp_path):
    docs = spark.range(0, 60_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    at = f"file://{tmp_path}/orc"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        token_orc.write_orc(docs, PATH, at)
        rows = token_orc.read_orc(spark, at)
        assert rows.where("doc_id = 31000").count() == 1
        assert scanned(rows.select("doc_id")) == 30_000
        # an index entry for each 1,000 rows; ids between two that are there are told by the Bloom filter
        assert scanned(rows.where("doc_id = 31000").select("doc_id")) <= 1000
        assert scanned(rows.where("doc_id between 100 and 300").select("doc_id")) <= 1000
        assert scanned(rows.where("doc_id = 31001").select("doc_id")) == 0 and scanned(rows.where("doc_id > 70000").select("doc_id")) == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    orc = pytest.importorskip("pyarrow.orc")
    files = sorted((tmp_path / "orc").glob("part-*.orc"))
    assert len(files) == 2 and sum(orc.ORCFile(f).nrows for f in files) == 30_000


# ---------------------------------------------------------------- archives


def test_warc_round_trip(spark):
    rng = random.Random(6)
    pages = [(i, f"http://a/{i} x", rng.choice(["<p>" + "y" * 1200, "<p>é" * 600, "small", None, "<p>" + str(i) * 700])) for i in range(80)]
    pages += [(81, None, "<p>" + "y" * 1200), (81, None, "<p>" + "y" * 1200), (None, "u", "<p>" + "y" * 1200)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    keeper = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            keeper[h] = max(i, keeper.get(h, -1))
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        first = len(b) < 1000 or i == keeper[h]
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else keeper[h])] += 1
    assert Counter(map(tuple, warc.round_trip(df).collect())) == want
    bundles, _ = warc.write_bundles(df)
    held = {r["bundle"]: r["content"] for r in bundles.collect()}
    texts = Counter((h or "").encode() for _, _, h in pages)
    index = warc.record_index(bundles).collect()
    assert len({r["record_id"] for r in index}) == len(index) == len(pages)
    for r in index:
        head, body = warc.fetch(held[r["bundle"]], r["frame"], r["offset"], r["length"])
        assert head[b"WARC-Record-ID"].decode() == r["record_id"]
        assert body in texts if head[b"WARC-Type"] == b"response" else body == b""
    wanted = spark.createDataFrame([(r["record_id"],) for r in index[::7]] + [("<none>",)], "record_id string")
    some = warc.fetch_records(bundles, wanted).collect()
    assert {r["record_id"] for r in some} == {r["record_id"] for r in index[::7]}
    by_id = {r["record_id"]: r for r in warc.read_bundles(bundles).collect()}
    assert all(r["payload"] == by_id[r["record_id"]]["payload"] and r["page_id"] == by_id[r["record_id"]]["page_id"] for r in some)
    assert warc.round_trip(df.limit(0)).count() == 0 and warc.write_bundles(df.limit(0))[0].count() == 0


def test_archives_as_files(spark, tmp_path):
    pages = [(i, f"http://a/{i}", f"<p>{i}</p>" * 300) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    index = warc.write_files(warc.write_bundles(df)[0], f"file://{tmp_path}/a")
    rows = {r["record_id"]: r for r in index.collect()}
    assert len(rows) == 300 and all(p.suffix == ".zst" for p in (tmp_path / "a").glob("*.warc.*"))
    for i in (0, 7, 299):
        r = rows[warc.record_id(i)]
        head, body = warc.fetch_from(r["path"], r["frame"], r["offset"], r["length"])
        assert body.decode() == pages[i][2]
    # any reader of Zstandard reads a whole archive: frames one after another, the seek table skipped
    content = next((tmp_path / "a").glob("*.warc.zst")).read_bytes()
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert sum(1 for _ in warc.parse_records(whole)) == sum(r["path"].endswith(next((tmp_path / "a").glob("*.warc.zst")).name) for r in rows.values())


def test_frames_are_independent():
    bundle = warc._Bundle()
    for i in range(40):
        bundle.add(str(i), warc.warc_record(i, None, bytes([65 + i % 20]) * 20_000, "d", 20_000, None, "response"))
    content = bundle.row()["content"]
    table = warc.read_seek_table(content)
    assert len(table) > 1
    records = [h[b"X-Page-ID"] for k in range(len(table)) for h, _ in warc.parse_records(warc.frame_of(content, table, k))]
    assert records == [str(i).encode() for i in range(40)]


# ---------------------------------------------------------------- pages


def test_minimum_cut_is_least():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 8)
        gain = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(label, gain=gain, edges=edges):
            return sum((max(0, g) if not c else max(0, -g)) for g, c in zip(gain, label, strict=True)) + sum(c for i, j, c in edges if label[i] != label[j])

        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_cut.content_side(gain, edges)) == least


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy this thing now, it is good.</div>"
    "<article><h1>A &amp; title</h1><p>First   paragraph of the text, with <b>bold</b> words\nand more of them.</p><script>var t='</p>'</script><p>Second one. It goes on for a while, and then ends.</p></article>"
    "<div id='comments'><div class='comment'><p>I did not like this text at all, said a reader.</p></div></div><form><label>Your name</label><p>Sign up for our letter today.</p></form><footer>&copy; 2024 somebody</footer></body></html>"
)


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, PAGE[: PAGE.index('<form')]), (5, "u", "<!-- never ends " + PAGE), (1, "u", PAGE), (6, "u", "<p>" * 3000), (7, "u", '<a "' * 2000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_cut.extract(df).collect()
    want = "A & title First paragraph of the text, with bold words and more of them. Second one. It goes on for a while, and then ends."
    texts = defaultdict(list)
    for r in got:
        texts[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert texts[1] == [want, want] and texts[2] == texts[3] == texts[5] == [""] and texts[4] == [want]
    assert html_cut.extract(df.limit(0)).count() == 0


def test_blocks_take_time_by_length_alone():
    import time

    for page in ("<b>" * 20000 + "</i>" * 40000, "<b>" * 20000 + "x<hr>" * 20000, "<p><div>" + "<b>" * 20000 + "x<hr>" * 20000, "<li><div>" + "<i>" * 20000 + "x</p>" * 20000):
        start = time.process_time()
        html_cut.blocks(page)
        assert time.process_time() - start < 3


def test_blocks_of_four_times_the_length_take_four_times_the_time():
    import time

    shapes = ["<a ", "<a '", "<a \"'", "<!", "</", "<a", "</script ", "&amp", "<p ' \"", "<a \">'", "<i x='>\"'", "<li><b>"]
    for shape in (*((lambda n, s=s: s * n) for s in shapes), lambda n: "<b>" * n + "</b>" * n, lambda n: "<script>" + "</script " * n, lambda n: "<p><div>" + "<b>" * n + "<div></div>" * n, lambda n: "<a '>x" * n + "'" + "<a \">y" * n):
        times = []
        for n in (20_000, 80_000):
            page = shape(n)
            start = time.process_time()
            html_cut.blocks(page)
            times.append(time.process_time() - start)
        assert times[1] < 8 * max(times[0], 0.05), (page[:20], times)


def test_tags_that_end_nowhere():
    texts = lambda page: [b.text for b in html_cut.blocks(page)]
    assert texts("<p>a <b") == ["a <b"] and texts("a < b <3 c") == ["a < b <3 c"]
    assert texts("<p title='>'>a</p><p title=\">b</p>c <!-- d") == ["a", "b", "c"]
    assert texts("a<!-- b") == ["a"] and texts("a <b <!-- c") == ["a <b"]
    assert texts("<script>a</script >b") == ["b"] and texts("<script>a</script b") == []


def test_features_read_whole_blocks():
    at = lambda t: html_cut.features(html_cut.blocks(f"<p>{t}</p>"))[0]
    words = "word " * 120
    assert at(f"x {words} One. Two. Three. y")[4] == at(f"x One. Two. Three. {words} y")[4] == 1
    assert at(words + " all rights reserved").tolist() == at("all rights reserved " + words).tolist()
    assert [b.text for b in html_cut.blocks("<p>a <math><mi>x</mi></math> <span aria-hidden=true>b</span> <span hidden>c</span></p>")] == ["a x b"]


def test_classifier_on_unseen_layouts():
    rng, wrong = random.Random(77), 0
    for _ in range(150):
        found = html_cut.blocks(html_cut.generated_page(rng))
        want = [b.text[0] == "" for b in found]
        for b in found:
            b.text = b.text[1:] or "."
        gain = np.rint(np.clip(html_cut.features(found) @ html_cut.trained(), -12, 12) * html_cut.SCALE).astype(int).tolist()
        wrong += html_cut.content_side(gain, html_cut.smoothness(found)) != want
    assert wrong <= 15


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(docs, rows, empty, spark):
    order = [(i, t or "") for i, t in sorted(rows)]
    following = {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    got = {r["doc_id"]: r for r in paragraphs.fingerprints(docs).collect()}
    pieces = lambda t: {r[0] for r in spark.createDataFrame([(t,)], "t string").select(F.explode(F.expr(paragraphs.digests_sql("t")))).collect()}
    by_text = defaultdict(set)
    for n, (i, t) in enumerate(order):
        k = len(t) // 4
        edited = t[: len(t) - k] + following[i][:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(r["fingerprint"])
        if n % 16 == 0:
            a, b, c = pieces(t), pieces(edited), pieces(following[i])
            for mine, other in ((r["near_edited"], b), (r["near_next"], c)):
                assert abs(mine - (len(a & other) / len(a | other) if a | other else 1.0)) < 1e-12
    assert all(len(v) == 1 for v in by_text.values())
    assert paragraphs.fingerprints(empty).count() == 0
    lone = paragraphs.fingerprints(spark.createDataFrame([(None, "One. Two. Three.")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(2)
    for n in (0, 1, 5, 40, 300):
        shared = [rng.getrandbits(63) - 2**62 for _ in range(200)]
        a, b = shared + [rng.getrandbits(63) for _ in range(n)], shared + [-rng.getrandbits(62) for _ in range(n)]
        df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").withColumns({"x": F.expr(paragraphs.sketch_sql("a", paragraphs.BASE)), "y": F.expr(paragraphs.sketch_sql("b", paragraphs.BASE))})
        assert set(df.select(F.expr(paragraphs.difference_sql("a", "b", "x", "y"))).first()[0]) == set(a) ^ set(b)


def test_marks_and_what_follows_them_are_fingerprinted(spark):
    for a, b in (("Price is 3.50 euros", "Price is 3.75 euros"), ("see a.com now", "see a.org now"), ("v1.2 ", "v1.9 "), ("One. Two.", "One! Two."), ("Is it? Yes", "Is it. Yes"), ("Said.[12] So", "Said.[13] So")):
        differ = spark.createDataFrame([(a, b)], "a string, b string").select(F.expr(paragraphs.digests_sql("a")).alias("a"), F.expr(paragraphs.digests_sql("b")).alias("b")).first()
        assert differ["a"] and set(differ["a"]) != set(differ["b"]), (a, b)
    kept = spark.createDataFrame([("One.  Two!) 3.50 x\n\nlast",)], "t string").select(F.expr(f"split(t, '{paragraphs.ENDS}')")).first()[0]
    assert kept == ["One.", "Two!)", "3.50", "x", "last"]
    rows = paragraphs.fingerprints(spark.createDataFrame([(1, "Price is now 3.50 "), (2, ".75 it is. What else")], "doc_id long, text string")).collect()
    assert all(r["changed"] > 0 for r in rows)


def test_fingerprints_run_no_python(docs):
    rows, _ = paragraphs.with_next(docs)
    assert "Python" not in rows._jdf.queryExecution().toString()


# ---------------------------------------------------------------- toxicity and mixing


def toxic_table(spark, n=900):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["vile", "rotten", "wretch"]
    docs, labels = [], []
    for i in range(n):
        sentences = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 30))]
        toxic = rng.random() < 0.25
        if toxic:
            s = rng.choice(sentences)
            s[rng.randrange(len(s))] = rng.choice(bad)
        docs.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(docs), dict(labels)


def test_toxicity_held_out_accuracy(spark):
    docs, labels, texts, truth = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    found = toxicity.offending(docs, model).collect()
    assert sorted((r["doc_id"], k) for r in rows for k in r["offending"]) == sorted((r["doc_id"], r["sentence"]) for r in found)
    assert found and np.mean([any(b in r["words"].split() or f"{b}." in r["words"].split() for b in ("vile", "rotten", "wretch")) for r in found]) > 0.95
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}


def test_toxicity_odd_tables(spark, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (3, "x" * 50000)], "doc_id long, text string")
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.scored(odd, toxicity.fit(odd, labels.limit(0))).count() == 4
    assert toxicity.scored(odd, toxicity.fit(odd, labels)).where("score between 0 and 1").count() == 4


def test_toxicity_with_repeats_and_clashing_columns(spark):
    docs, labels, texts, truth = toxic_table(spark, 400)
    model = toxicity.fit(docs, labels)
    more = docs.union(docs).unionByName(docs.withColumn("text", F.concat(F.lit("zz "), F.col("text")))).withColumns({"toxic": F.lit(1), "feature": F.lit("x"), "held": F.lit(2), "_id": F.lit(3)})
    again = toxicity.fit(more, labels.union(labels))
    assert model.weights and again.weights.keys() == model.weights.keys() and all(abs(again.weights[k] - v) < 1e-9 for k, v in model.weights.items()) is True
    kept = toxicity.drop_toxic(more, model)
    assert kept.columns == more.columns and 0 < kept.count() < more.count()
    assert toxicity.scored(more, model).count() == 1200
    assert toxicity.Model({"=bad": 9.0}, -3.0).score("fine\x00bad") < 0.5


def test_scores_of_a_table_by_hand(spark, docs, rows):
    """The query's rows against noisy-or restated word by word."""
    rng = random.Random(6)
    vocabulary = sorted({w for _, t in rows for w in (t or "").split()})
    weights = {f: rng.uniform(0.1, 3) for w in rng.sample(vocabulary, 120) for f in toxicity.word_features(w) if rng.random() < 0.4}
    model = toxicity.Model(weights, -4.0)

    def score(text):
        clean = 1.0
        for line in (text or "").split("\n"):
            logit, words = model.bias, 0
            for w in [*line.split(), None]:
                if w is not None:
                    word, words = w.lower().strip(toxicity._PUNCT), words + 1
                    logit += sum(weights.get(f, 0.0) for f in ({f"={word}", *(word[:n] for n in (3, 4, 5, 6, 7) if len(word) >= n)} if word else ()))
                if words and (w is None or w[-1] in ".!?…"):
                    clean *= 1 - 1 / (1 + np.exp(-logit))
                    logit, words = model.bias, 0
        return 1 - clean

    texts = dict(rows)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = score(texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_training_counts_sentences_without_features():
    """The least loss of three documents of one, two and three sentences, found by trying weights and biases on a grid."""
    bags = toxicity.Bags(np.array([1, 0, 1]), np.array([0, 2, 2]), np.array([0, 2]), np.array([0, 1]), np.array([0, 0]))
    model = toxicity.train(bags, ["=bad"], steps=3000)

    def loss(w, b):
        p, p0 = 1 / (1 + np.exp(-(w + b))), 1 / (1 + np.exp(-b))
        return -(np.log(p) + 2 * np.log(1 - p0) + np.log(1 - (1 - p) * (1 - p0) ** 2)) / 3 + toxicity.PENALTY * w

    best = min(loss(w, b) for w in np.linspace(0, 20, 81) for b in np.linspace(-20, 0, 81))
    assert loss(model.weights["=bad"], model.bias) < best + 0.01


def test_noisy_or_by_hand():
    model = toxicity.Model({"=bad": 5.0}, -3.0)
    p0, p1 = 1 / (1 + np.exp(3.0)), 1 / (1 + np.exp(-2.0))
    assert abs(model.score("fine day. bad day.\nfine") - (1 - (1 - p0) ** 2 * (1 - p1))) < 1e-12
    assert model.score(None) == model.score("") == model.score(" \n ") == 0.0


def mixing_table(spark):
    rng = random.Random(10)
    kinds = {k: ["".join(rng.choice(s) for _ in range(5)) for _ in range(60)] for k, s in (("x", "abcd"), ("y", "efgh"), ("z", "ijkl"))}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(5, 60))), k) for i, k in enumerate(rng.choices("xyz", (6, 3, 1), k=500))]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_rates_meet_targets(spark, empty):
    docs = mixing_table(spark)
    model = mixing.fit_classifier(docs, docs.where("doc_id % 2 = 0").select("doc_id", "domain"))
    truth = {r["doc_id"]: r["domain"] for r in docs.collect()}
    weights = {"x": 1, "y": 1, "z": 2}
    scored, _ = mixing.with_posteriors(docs, model)
    rates = mixing.fit_rates(scored, model, weights)
    rows = mixing.rated(scored, rates).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixing_rates(docs, model, weights).collect()))
    assert np.mean([r["domain"] == truth[r["doc_id"]] for r in rows]) > 0.97
    tokens = Counter()
    for r in rows:
        tokens[truth[r["doc_id"]]] += r["rate"] * r["n_tokens"]
    total = sum(r["n_tokens"] for r in rows)
    assert all(abs(tokens[k] / total - w / 4) < 0.03 for k, w in weights.items())
    assert np.allclose(rates.reached, rates.targets, rtol=1e-4) and min(r["rate"] for r in rows) >= 0
    more = mixing.mix(docs, model, keep_all=True)
    out = Counter(r["doc_id"] for r in more.collect())
    assert set(out) == set(truth) and sum(out.values()) > len(truth)
    assert more.columns == docs.columns
    none = empty.select("doc_id", "text")
    assert mixing.mix(none, mixing.fit_classifier(none, docs.select("doc_id", "domain").limit(0))).count() == 0


def test_mixing_odd_tables(spark):
    docs = mixing_table(spark)
    model = mixing.fit_classifier(docs, docs.select("doc_id", "domain"))
    odd = spark.createDataFrame([(None, "abcda " * 5, "en", 9), (1, None, "en", 1), (1, "", "de", 1), (7, "efghe " * 30000, None, 2), (7, "efghe " * 30000, None, 2)], "doc_id long, text string, domain string, t long")
    out = mixing.mix(odd, model, {"x": 1, "y": 1}, keep_all=True)
    assert out.columns == odd.columns and {(r["doc_id"], (r["text"] or "")[:5]) for r in out.collect()} == {(None, "abcda"), (1, ""), (7, "efghe")}
    rows = mixing.mixing_rates(odd, model).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 5, 30000, 30000] and len({(r["rate"], r["copies"]) for r in rows if r["doc_id"] == 7}) == 1
    with pytest.raises(ValueError):
        mixing.with_posteriors(odd.withColumn("_tokens", F.lit(1)), model)
    # one text of an id that stands on many rows, and the least of its domains, come to the fit
    twice = docs.union(docs.select("doc_id", F.lit("zzzzz"), "domain"))
    assert mixing.fit_classifier(twice, docs.select("doc_id", "domain")).matrix.tolist() == model.matrix.tolist()


def least_squares_above(a, b, floor):
    """min |a r - b| over r >= floor by an active set (Lawson and Hanson 1974), for r = floor + x, x >= 0."""
    b = b - a @ np.full(a.shape[1], floor)
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(500):
        slope = a.T @ (b - a @ x)
        if free.all() or slope[~free].max() < 1e-10:
            break
        free[np.flatnonzero(~free)[np.argmax(slope[~free])]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                break
            down = free & (z <= 0)
            step = np.min(x[down] / np.maximum(x[down] - z[down], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
        x = z
    return floor + x


@pytest.mark.parametrize("floor,targets", [(0.0, (0.1, 0.3, 0.6)), (0.0, (0.0, 0.0, 1.0)), (1.0, (0.02, 0.03, 0.95)), (0.5, (0.9, 0.1, 0.0))])
def test_descent_against_an_active_set_solver(floor, targets):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet((0.5, 0.5, 0.5), 40), rng.integers(1, 50, 40).astype(float)
    a, wanted = (p * t[:, None]).T, np.array(targets) * t.sum()
    root = np.linalg.cholesky(np.linalg.inv(a @ p))  # the residual is measured by the inverse of P'diag(t)P
    best = least_squares_above(root.T @ a, root.T @ wanted, floor)
    steps, reached, _ = mixing.descent(a @ p, wanted, floor, lambda some: mixing.sums_of(t, p, some, floor), 400)
    mine = mixing.rates_of(p, steps, floor)[1]
    value = lambda r: np.linalg.norm(root.T @ (a @ r - wanted))
    assert mine.min() >= floor and value(mine) <= value(best) + 2e-3 * (1 + value(best)) and np.allclose(reached, a @ mine)


def test_rates_of_a_table_against_an_active_set_solver(spark):
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet((0.5, 0.5, 0.5), 60), rng.integers(0, 50, 60)
    table = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p, strict=True))], "doc_id long, _tokens long, _posterior array<double>").repartition(3)
    rates = mixing.fit_rates(table, mixing.Classifier(list("xyz"), np.zeros((0, 3))), {"x": 1, "y": 3, "z": 6})
    a = (p * t[:, None]).T
    best = least_squares_above(a, rates.targets, 0.0)
    assert np.allclose(a @ rates.of(p), a @ best, rtol=1e-5) and np.allclose(rates.targets, np.array([0.1, 0.3, 0.6]) * t.sum())
    assert len(rates.steps) < 30 and rates.of(p).min() >= 0


# ---------------------------------------------------------------- media


def pixels_of(r):
    return np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"])


def test_copies_are_found_as_by_brute_force(spark):
    rng = random.Random(3)
    table = [(i, [rng.random() for _ in range(8)] if i != 33 else [0.5] * 8, 0) for i in range(80)] + [(100, [0.5] * 8, 0), (120, None, 0), (None, [0.1] * 8, 0)]
    table += [(40, [rng.random() for _ in range(8)], 0), (40, table[40][1], 0)]  # a vec_id with two vectors, one of them twice
    vectors = spark.createDataFrame(table, "vec_id long, embedding array<double>, row int").withColumns({"query": F.lit(1), "number": F.lit(2), "class_id": F.lit(3)})
    every = media.copies_of_vectors(vectors).collect()
    rows = [r for r in every if r["row"] == "match"]
    smallest = {}
    for i, v, _ in table:
        if i is not None and v is not None:
            smallest[tuple(v)] = min(i, smallest.get(tuple(v), i))
    assert Counter((r["vec_id"], r["class_id"]) for r in every if r["row"] == "member") == Counter((i, smallest[tuple(v)]) for i, v, _ in table if i is not None and v is not None)
    asked = {(i, tuple(v)) for i, v, _ in table if i is not None and v is not None and i % 20 == 0}
    assert {(r["query_id"], r["class_id"]) for r in rows} == {(i, smallest[v]) for i, v in asked} and len(asked) == 6
    found = {(r["query_id"], r["class_id"], r["found_class"]) for r in rows if r["found_class"] is not None}
    described = {v: media.describe_image(np.frombuffer(media.picture(list(v)), np.uint8).reshape(media.SIDE, media.SIDE)) for v in smallest}
    brute = set()
    for q, v in asked:
        w, h, p = media.edited(media.picture(list(v)), q // 20 % 5)
        places, bits = media.describe_image(np.frombuffer(p, np.uint8).reshape(h, w))
        for u, (other, theirs) in described.items():
            apart = np.unpackbits(bits[:, None] ^ theirs[None], axis=2).sum(2)
            a, b = np.nonzero(apart <= media.DISTANCE)
            if len(a) >= media.AGREEING and media.consensus(places[a], other[b]) >= media.AGREEING:
                brute.add((q, smallest[v], smallest[u]))
    assert len(found & brute) >= 0.9 * len(brute) and not found - brute
    assert {(q, smallest[v], smallest[v]) for q, v in asked} <= found
    assert media.copies_of_vectors(vectors.limit(0)).count() == 0


def scene(rng, h, w):
    """A picture of many boxes and grain."""
    image = np.full((h, w), 110.0)
    for _ in range(h * w // 200):
        y, x, a, b = rng.integers(0, h), rng.integers(0, w), *rng.integers(3, 14, 2)
        image[y : y + a, x : x + b] = 0.25 * image[y : y + a, x : x + b] + 0.75 * rng.integers(0, 256)
    return np.clip(image + 10 * media._box(rng.normal(0, 1, (h, w)), 1) / 3, 0, 255).astype(np.uint8)


def test_small_crops_of_large_pictures(spark):
    """By the edits that were made: crops of a fiftieth to a tenth of the area, some with less contrast, some half as large, some turned."""
    rng = np.random.default_rng(8)
    pictures = {i: scene(rng, 480, 640) for i in range(6)}
    assert len(media.describe_image(pictures[0])[0]) > 800
    queries, truth = [], {}
    for k in range(24):
        i = k % 6
        h, w = (70, 90) if k < 12 else (150, 200)
        y, x = rng.integers(0, 480 - h), rng.integers(0, 640 - w)
        crop = pictures[i][y : y + h, x : x + w].astype(float)
        crop = crop * 0.7 + 30 if k % 4 == 1 else np.rot90(crop) if k % 4 == 2 else crop
        if k >= 18:
            crop = crop[: crop.shape[0] // 2 * 2, : crop.shape[1] // 2 * 2].reshape(crop.shape[0] // 2, 2, crop.shape[1] // 2, 2).mean((1, 3))
        crop = np.clip(np.rint(crop), 0, 255).astype(np.uint8)
        queries.append((k, crop.shape[1], crop.shape[0], crop.tobytes()))
        truth[k] = i
    schema = "id long, width int, height int, pixels binary"
    images = spark.createDataFrame([(i, 640, 480, bytearray(p.tobytes())) for i, p in pictures.items()] * 2, schema)
    found = {(r["query"], r["class_id"]) for r in media.find_copies(spark.createDataFrame([(*q[:3], bytearray(q[3])) for q in queries], schema), images).collect()}
    assert {c for q, c in found if truth[q] != c} == set() and len(found) >= 0.9 * len(truth)
    clash = images.union(spark.createDataFrame([(0, 64, 64, bytearray(64 * 64))], schema))
    with pytest.raises(ValueError):
        media.find_copies(images.limit(1), clash)


def test_many_matches_take_bounded_time_and_memory():
    import time
    import tracemalloc

    board = ((np.indices((200, 200)) // 8).sum(0) % 2 * 200 + 20).astype(np.uint8)
    places, bits = media.describe_image(board)
    a, b = media.matches(bits, bits)
    assert len(a) > 5000
    start = time.process_time()
    tracemalloc.start()
    assert media.consensus(places[a], places[b]) >= media.AGREEING
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and time.process_time() - start < 60
    tracemalloc.stop()
    # a true transform among many chance matches is among those tried
    rng = np.random.default_rng(2)
    q = np.stack([*rng.uniform(0, 300, (2, 6000)), np.ones(6000), rng.uniform(0, 6.28, 6000)], 1)
    t = np.stack([*rng.uniform(0, 300, (2, 6000)), np.ones(6000), rng.uniform(0, 6.28, 6000)], 1)
    t[:14, :2], t[:14, 3] = q[:14, :2] + [40, -25], q[:14, 3]
    assert media.consensus(q, t) >= 14


def test_copies_meet_whatever_the_number_of_descriptors(spark, monkeypatch):
    for n in (5_000, 2_000_000, 10**7, 10**9):
        width = media.table_bits(n)
        assert 1 - (1 - media.meeting(width)) ** media.table_count(width) >= media.MET
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(8)], 0) for i in range(0, 400, 5)], "vec_id long, embedding array<double>, label int")
    named = vectors.select(F.col("vec_id").alias("id"), "embedding", (F.floor(F.col("vec_id") / 20) % 5).alias("kind"))
    images, queries = media.pictures(named), media.pictures(named.where("id % 20 = 0"), copies=True)
    described = {n: {r["id"]: media.describe_image(pixels_of(r)) for r in df.collect()} for n, df in (("q", queries), ("t", images))}
    brute = {}
    for q, (places, bits) in described["q"].items():
        for i, (other, theirs) in described["t"].items():
            a, b = np.nonzero(np.unpackbits(bits[:, None] ^ theirs[None], axis=2).sum(2) <= media.DISTANCE)
            if len(a) >= media.AGREEING and (n := media.consensus(places[a], other[b])) >= media.AGREEING:
                brute[q, i] = (n, len(a))
    # keys as wide as for twenty million descriptors
    monkeypatch.setattr(media, "table_bits", lambda n: 27)
    monkeypatch.setattr(media, "ROUND", 50)
    assert {(r["query"], r["class_id"]): (r["agreeing"], r["matches"]) for r in media.find_copies(queries, images).collect()} == brute
