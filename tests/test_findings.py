"""Cases of the findings of reviews."""

import random
import time

import duckdb

from corpuslab.operators import tokens
from corpuslab.plans.queries import ORACLES, QUERIES


def against_sql(spark, name, folder):
    """Rows of a query and of its SQL over documents dealt over several files, both sorted."""
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    return sorted((tuple(r[c] for c in names) for r in QUERIES[name](spark, folder).collect()), key=repr), sorted(got.fetchall(), key=repr)


def test_parquet_scan_numbers_rows_over_all_files(spark, tmp_path):
    duck = duckdb.connect()
    (tmp_path / "documents.parquet").mkdir()
    for i, texts in enumerate((["a", " b \n", None], [], ["", "  \n", "\tc\t"], ["d"] * 5, [])):
        rows = "SELECT unnest($1::VARCHAR[]) AS text, 1 AS doc_id"
        duck.execute(f"COPY ({rows}) TO '{tmp_path}/documents.parquet/part-{i:04d}.parquet'", [texts])
    ours, theirs = against_sql(spark, "parquet_scan", str(tmp_path))
    assert len(theirs) == 11 and ours == theirs


def small_table(spark):
    pieces = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "bca", "▁ab", "aa", "cab"]
    return spark.createDataFrame([(p, i, -1.5 - i % 7, 2 if i == 0 else 3 if i < 3 else 6 if i < 259 else 1) for i, p in enumerate(pieces)], "piece string, id int, score double, type int")


def plainly_merged(bpe, word):
    """The definition: of all pairs that are a piece the one of the least id, the leftmost first, until there is none."""
    parts = list(word)
    while found := [(bpe.ids[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in bpe.ids and bpe.ids[m] >= bpe.first_merge]:
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def words_of(rng, most, n):
    return ["▁" + "".join(rng.choice("aabbccdé\n") for _ in range(rng.randint(1, most))) for _ in range(n)]


def test_merges_of_long_words_take_no_square_of_time(spark):
    bpe = tokens.bpe_of(small_table(spark), first_byte=3, first_merge=259)
    rng = random.Random(1)
    for word in [*words_of(rng, 20, 300), *words_of(rng, 300, 60), "▁" + "a" * 131, "▁" + "abc" * 40]:
        assert bpe.parts(word) == bpe._parts_of_long(word) == plainly_merged(bpe, word)
    began = time.process_time()
    assert len(bpe.parts("▁" + "abcabd" * 8000)) > 8000
    assert time.process_time() - began < 10


def same_as_segments(spark, model, table, **places):
    rng = random.Random(2)
    texts = [None, "", " ", " a  ab ", "�é�", "▁ a▁b", "x\ny", *(" ".join(w[1:] for w in words_of(rng, 9, 30)) for _ in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    coded = tokens.with_pieces(tokens.measured(df, model), table, **places)
    seen = {r["doc_id"]: r for r in tokens.shown(df, model).collect()}
    assert [seen[0][c] for c in ("text", "decoded", "shown", "begins", "unknown")] == [None] * 5
    for r in coded.where("text is not null").collect():
        s = seen[r["doc_id"]]
        assert (s["decoded"], s["begins"], s["unknown"]) == (r["decoded"], sum(p.startswith("▁") for p in r["pieces"]), any(g["kind"] == "unknown" for g in r["segments"]))
        assert s["shown"] == "".join(" " * (g["starts"] and g["text"] != " ") + g["text"] for g in r["segments"] if g["kind"] != "unknown")


def test_bpe_is_shown_as_its_segments(spark):
    table, places = small_table(spark), {"first_byte": 3, "first_merge": 259}
    same_as_segments(spark, tokens.bpe_of(table, **places), table, **places)


def documents(tmp_path):
    duck = duckdb.connect()
    (tmp_path / "documents.parquet").mkdir()
    rows = "SELECT unnest($1::BIGINT[]) AS doc_id, unnest($2::VARCHAR[]) AS text"
    duck.execute(f"COPY ({rows}) TO '{tmp_path}/documents.parquet/part-0000.parquet'", [[1, 2, 3], ["The cat  sat.\nOn é ঘ 🙂", None, ""]])
    duck.execute(f"COPY ({rows}) TO '{tmp_path}/documents.parquet/part-0001.parquet'", [[4, 5], ["  ", "ab" * 30_000 + " c"]])
    return str(tmp_path)


def test_bpe_tokens_of_odd_texts(spark, tmp_path):
    ours, theirs = against_sql(spark, "bpe_tokens", documents(tmp_path))
    assert len(theirs) == 5 and ours == theirs


def test_unigram_paths_of_many_words_are_those_of_each(spark):
    model = tokens.unigram_of(small_table(spark), first_byte=3, unknown=0)

    def plainly(word):
        total, start = [0.0] + [float("-inf")] * len(word), [0] * (len(word) + 1)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                score = model.scores.get(word[i:j], model.least if j == i + 1 else None)
                if score is not None and total[i] + score > total[j]:
                    total[j], start[j] = total[i] + score, i
        out, n = [], len(word)
        while n:
            out.append(word[start[n] : n])
            n = start[n]
        return out[::-1]

    words = {*words_of(random.Random(3), 12, 500), "▁", "▁ab", "▁abc", "▁abcab"}
    assert dict(model.paths(words)) == {w: plainly(w) for w in words}


def test_unigram_is_shown_as_its_segments(spark):
    table = small_table(spark)
    same_as_segments(spark, tokens.unigram_of(table, first_byte=3, unknown=0), table, first_byte=3, first_merge=259)


def test_unigram_tokens_of_odd_texts(spark, tmp_path):
    ours, theirs = against_sql(spark, "unigram_tokens", documents(tmp_path))
    assert len(theirs) == 5 and ours == theirs


def test_lists_of_ids_and_segments_go_in_slices(spark, monkeypatch):
    """However many rows an Arrow batch has, no more than some are held as Python's lists at a time; a row larger than that goes alone."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 3] * 4 + [None, "y" * 50, "", "z", "z"]), pa.array([[1] * 6] * 4 + [None, [2] * 90, [], [3], [3]])], ["k", "text", "ids"])
    monkeypatch.setattr(tokens, "TEXT_BYTES", 7)
    monkeypatch.setattr(tokens, "IDS", 13)
    for column in (1, 2):
        parts = list(tokens._slices(batch, column))
        assert [p.num_rows for p in parts] == [2, 3, 1, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
