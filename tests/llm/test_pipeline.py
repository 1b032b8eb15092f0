"""Every stage of the corpus pipeline against a brute-force version, and columns and ids of any kind."""

import binascii
import math
import random

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import decontamination, language_ppm, near_duplicates
from plumbline.llm.queries import _SIZE, MIX_SQL

from .test_joins import brute_near
from .test_text_and_models import brute_code


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("pipeline")
    letters = {"aa": "abcdefgh", "ii": "ijklmnop", "qq": "qrstuvwx"}
    vocabulary = {x: ["".join(rng.choice(c) for _ in range(rng.randint(3, 8))) for _ in range(400)] for x, c in letters.items()}
    line = lambda x, n: " ".join(rng.choice(vocabulary[x]) for _ in range(n))
    items = [f"{line('aa', 14)}? {line('aa', 7)}." for _ in range(5)]
    rows = []
    for i in range(60):
        x = ("aa", "ii", "qq")[i % 3]
        rows.append([x, "\n".join(line(x, rng.randint(8, 20)) for _ in range(rng.randint(1, 4)))])
    for i in range(60, 72):  # near copies of whole documents, at another place in another line each
        words = rows[i - 60][1].split(" ")
        words[rng.randrange(len(words))] += "a"
        rows.append([rows[i - 60][0], " ".join(words)])
    rows += [["aa", f"{line('aa', 30)} {items[i % 5]} {line('aa', 30)}"] for i in range(6)]
    rows += [["aa", rows[0][1]], ["ii", "Menu\n" + line("ii", 9)], ["ii", "menu \n" + line("ii", 9)], [None, line("qq", 12)], ["aa", None], ["aa", ""], ["ii", "12 34 !?"], [None, "é " * 40]]
    data = [(i, t, x, ("s1", "s2", "s3", None)[i % 4], None if t is None else len(t)) for i, (x, t) in enumerate(rows)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 80, 3)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def brute_language(rows):
    learn = {}
    for r in rows:
        if r.text is not None and r.lang is not None and binascii.crc32(str(r.doc_id).encode()) % 5:
            learn.setdefault(r.lang, []).append(r.text.encode())
    out = set()
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            bits = [brute_code(t, r.text.encode()) for t in learn.values()]
            if 1 / sum(2.0 ** -min(1000, b - min(bits)) for b in bits) >= 0.5:
                out.add(r.doc_id)
    return out


def brute_lines(rows):
    """doc_id -> the text that stays, None where every line goes."""
    places = [(r.doc_id, n, " ".join(x.lower().split())) for r in sorted(rows, key=lambda r: r.doc_id) for n, x in enumerate(r.text.split("\n"))]
    places = [p for p in places if p[2]]
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    con = duckdb.connect()
    for i, (_, _, a) in enumerate(places):
        for j, (_, _, b) in enumerate(places[:i]):
            if find(i) == find(j) or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
                continue
            if a == b or (min(len(a.split()), len(b.split())) >= 5 and con.execute("SELECT levenshtein(?, ?)", [a, b]).fetchone()[0] <= math.floor(0.2 * max(len(a), len(b)) + 1e-9)):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    gone = {places[i][:2] for i in range(len(places)) if find(i) != i}
    out = {}
    for r in rows:
        lines = r.text.split("\n")
        kept = [x for n, x in enumerate(lines) if (r.doc_id, n) not in gone]
        out[r.doc_id] = "\n".join(kept) if kept else None
    return out


def test_stages(spark, folder):
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = frame.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "copies", "leaks", "mix"]
    before = frame.collect()
    step = lambda name: spark.createDataFrame(stages[name](spark, frame, folder).collect(), frame.schema)

    frame = step("language")
    after = frame.collect()
    assert frame.columns == columns and {r.doc_id for r in after} == brute_language(before) and len(after) < len(before)

    want, frame = brute_lines(after), step("lines")
    got = {r.doc_id: r for r in frame.collect()}
    assert frame.columns == columns and {i: r.text for i, r in got.items()} == {i: t for i, t in want.items() if t is not None} and len(got) < len(after)
    assert all(r.n_chars == len(r.text) for r in got.values())

    rows = sorted(frame.collect(), key=lambda r: r.doc_id)
    kept = {rows[i].doc_id for i, _, _, stays in brute_near([r.text for r in rows], 80) if stays}
    frame = step("copies")
    assert frame.columns == columns and {r.doc_id for r in frame.collect()} == kept

    items = [r.text.lower().replace("?", "").replace(".", "") for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in frame.collect() if not any(x in r.text.lower().replace("?", "").replace(".", "") for x in items)}
    frame = step("leaks")
    assert frame.columns == columns and {r.doc_id for r in frame.collect()} == clean and clean < kept

    con = duckdb.connect()
    con.register("docs", frame.toPandas())
    con.sql(f"CREATE VIEW labels AS SELECT * FROM '{folder}/labels.parquet/*.parquet'")
    sql = MIX_SQL.format(size=_SIZE, docs="docs") + "SELECT doc_id, (size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"
    want = {i: n for i, n in con.sql(sql).fetchall() if n}
    assert {r.doc_id: r.taken for r in stages["mix"](spark, frame, folder).collect()} == want
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, folder).collect()} == want


CLASH = "doc_id {kind}, text string, lang string, source string, n_chars long, gone int, found int, ppm_id int, ppm_lang string, __id int, __gone int, __held int, lines_of int, sieve_at int, w double, `a.b` int, size int"


@pytest.mark.parametrize("kind", ["long", "string", "smallint"])
def test_any_columns_and_ids(spark, folder, kind):
    """Clashing names, ids of other types, null ids, repeated rows and empty tables pass every stage."""
    make = {"long": int, "smallint": int, "string": str}[kind]
    texts = ["abc def gha bcd efg hab cde fgh"] * 3 + ["ijk lmn opi jkl mno pij klm nop " * 30, None, "", "bad cab dab fab gab hab jab kab\nbad cab dab fab gab hab jab kab"]
    rows = [(make(i // 2), t, "aa" if i != 3 else "ii", "s", 1, *[i] * 3, "l", *[i] * 5, 0.5, i, i) for i, t in enumerate(texts)]
    rows.append((None, "abc bcd cde def", None, None, None, *[None] * 12))
    frame = spark.createDataFrame(rows, CLASH.format(kind=kind))
    for some in (frame, frame.filter("doc_id is null and text = 'no'")):
        out = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, folder)
            assert name == "mix" or out.columns == frame.columns
            out = spark.createDataFrame(out.collect(), out.schema)
        assert {"doc_id", "text", "taken", "a.b"} <= set(out.columns) and (out.count() > 0) == (some is frame)


def test_items_of_any_type(spark):
    texts = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "doc_id long, text string")
    item = "one two three four five six seven eight nine ten eleven twelve"
    for kind, ids in (("string", ["x", "", None]), ("smallint", [3, 4, None]), ("decimal(10,2)", [None, None, None])):
        bench = spark.createDataFrame([(i, item) for i in ids], f"item_id {kind}, text string")
        got = decontamination.contaminated(texts, bench).collect()
        assert sorted(map(str, (r.item_id for r in got))) == sorted(map(str, ids))


def test_long_text_with_short_items():
    """Bounds are made some half windows at a time, whatever the length of a text."""
    index = decontamination.Index([("a b c d e", "f g h i j")] * 3)
    words = " ".join(["x y z a b"] * 20_000 + ["a b c d e f g h i j"] + ["q"] * 50_000)
    import pyarrow as pa

    found = index.search(decontamination.textbytes.Words(pa.array([words]), decontamination.textbytes.ALNUM_WORDS), 0.6, 0.8, 0.8)
    assert [f[:2] for f in found] == [(0, 0), (0, 1), (0, 2)]


def test_sample_is_bounded_in_bytes(spark):
    long = [(i, "abc " * 50_000, "aa") for i in range(40)] + [(i, "xyz " * 100, "zz") for i in range(40, 60)]
    frame = spark.createDataFrame(long, "doc_id long, text string, lang string")
    model = language_ppm.train(frame.union(frame), bytes_per_lang=300_000)
    assert model.langs == ["aa", "zz"]
    got = {r.lang_pred for r in language_ppm.identify(frame.filter("doc_id < 40"), model).collect()}
    assert got == {"aa"} and near_duplicates.near_duplicates(frame).filter("kept").count() == 2
