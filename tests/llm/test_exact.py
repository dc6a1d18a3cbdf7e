"""The operators with one right result, against brute force: on a small table, and on rows made to be awkward."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, lines, neardup, packing, shards, substring, suffix, vptree
from quern.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, k long, th string, spans int"


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white, very long and repeated texts, ties, near copies, columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(90)
    base = text(120).split(" ")
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (3, 50, 100)]
    lines_ = "\n".join(text(12) for _ in range(20))
    texts = [
        None, "", " \t\n ", "one", "two words", shared, shared, f"{text(30)}\n{shared} {text(5)}", " ".join(base), *near, lines_, lines_.replace("a", "b", 2), f"{lines_}\n\n{lines_}",
        "x" * 1500, "x" * 900, "ab" * 700, "é" * 500 + " ü ñ", text(8000), "".join(rng.choice("qwrt ") for _ in range(3000)), "a  b\t c\x0bd", "UPPER lower Éé", shared + " " + shared,
    ]
    data = [(i, t) for i, t in enumerate(texts)]
    return data, spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in data], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], df


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


def test_substrings(table):
    data, df = table
    found = rows_of(substring.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(brute.op1(data))


def test_bytes(table):
    data, df = table
    found = rows_of(suffix.dedup_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == sorted(brute.op9(data))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(table, width):
    data, df = table
    found = rows_of(neardup.near_duplicates(df, width=width), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(brute.op4(data, width))


def test_lines(table):
    data, df = table
    found = rows_of(lines.dedup_lines(df), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert found == sorted(brute.op10(data))


def test_lines_whose_shingles_repeat(spark):
    """Equal or nearly equal sets of shingles in lines of other lengths, on either side of the border of the two kinds of bands."""
    rng = random.Random(6)
    sentence = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = ["=" * 100, "=" * 300, *(x for n in (90, 120, 128, 150, 200) for s in [sentence(n)] for x in (s, s + s, s * 3))]
    data = list(enumerate(texts))
    found = rows_of(lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert found == sorted(brute.op10(data))
    assert sum(r[2] for r in found) == 11


def test_bands_of_lines_that_are_signed_together():
    """A line's bands are those it has alone, of whatever lengths and kinds the lines around it are."""
    import pyarrow as pa

    def signed(texts):
        columns = [pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.string())]
        return {k: b for x in lines._sign(iter([pa.RecordBatch.from_arrays(columns, names=["k", "th", "text"])])) for k, b in zip(*x.to_pydict().values())}

    rng = random.Random(9)
    lengths = [*range(1, 9), *range(120, 180, 3), *[132] * 20, 300, 900]
    some = ["".join(rng.choice(s) for _ in range(n)) for n in lengths for s in ("ab", "abcdefghij klmnop", "éü漢字😀 abc")]
    alone = {k: b for x in some for k, b in signed([x]).items()}
    assert signed(["\n".join(some)]) == signed([None, "", *some, " \t\n"]) == alone
    assert {len(b) for b in alone.values()} == {128, 256}


def test_lines_without_their_text(table):
    """The query's digests need no text back from the workers."""
    data, df = table
    out = lines.dedup_lines(df.select("doc_id", "text"), keep_text=False)
    assert out.columns == ["doc_id", "kept_sha256", "n_lines", "n_removed"]
    assert rows_of(out, "doc_id", "n_lines", "n_removed", "kept_sha256") == sorted(brute.op10(data))


def test_lines_keep_other_columns(odd):
    out = lines.dedup_lines(odd[1])
    assert set(DOCS.replace(",", "").split()[::2]) - {"k", "th", "gone"} <= set(out.columns) | {"k", "th"}


@pytest.mark.parametrize("bound", [2_000_000, 30])
def test_contamination(spark, table, bound):
    data, df = table
    items = [(1, " ".join((data[5][1] or "a b c d").split()[3:18])), (2, "two, WORDS"), (3, None), (4, "..."), (10, "one"), (10, (data[-1][1] or "")[:80])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(df.select("doc_id", "text"), bench, bound=bound)
    found = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n"), decontaminate.sha256_of_items(F.col("items")).alias("sha"), (F.col("n_hit") > 0).alias("hit"))
    assert sorted(map(tuple, found.collect())) == sorted(brute.op2(data, items))


def test_contaminated_spans_are_cut(spark):
    df = spark.createDataFrame([(1, "Keep. a b c d e f g h i J, keep", "en"), (2, "clean", "en"), (3, None, "en")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "A b c d e f g h i j")], "item_id long, text string")
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, remove="spans").collect()}
    assert cut == {1: "Keep. , keep", 2: "clean", 3: None}
    assert rows_of(decontaminate.decontaminate(df, bench), "doc_id", "items") == [(2, "en"), (3, "en")]


def test_a_group_of_copies_and_its_neighbours(spark):
    """A third of all rows under one text: components and kept rows as by brute force."""
    rng = random.Random(1)
    words = [str(i) for i in range(60)]
    base = [rng.choice(words) for _ in range(50)]
    data = [(i, " ".join(base)) for i in range(100)]
    data += [(100 + i, " ".join(base[:i] + [f"n{i}"] + base[i + 1 :])) for i in range(40)]
    data += [(200 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(160)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert rows_of(neardup.near_duplicates(df, width=2), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.op4(data))
    assert rows_of(substring.dedup_substrings(df), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op1(data))


def test_rows_repeated_with_one_doc_id(spark):
    data = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (1, "other words here now"), (None, "a b c d")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = sorted(neardup.near_duplicates(df, width=2).select("doc_id", "component_id", "kept").collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (1, 1, True), (None, None, True)], key=str)
    assert substring.dedup_substrings(df).count() == suffix.dedup_bytes(df).count() == lines.dedup_lines(df).count() == 5


def test_near_copies_of_both_texts_of_a_repeated_doc_id(spark):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(4)]
    data = [(1, " ".join(t)) for t in texts] + [(2 + i, " ".join([*t[:-1], "changed"])) for i, t in enumerate(texts)] + [(9, "nothing like the others")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = rows_of(neardup.near_duplicates(df, width=2), "doc_id", "component_id", "kept")
    assert found == [(1, 1, True)] * 4 + [(i, 1, False) for i in (2, 3, 4, 5)] + [(9, 9, True)]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_shards(request, which):
    data, df = request.getfixturevalue(which)
    n = 40 if which == "docs" else 5
    found = shards.assign(df, n).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in data)
    counts = {s: [r["slot"] for r in found if r["shard"] == s] for s in range(n)}
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(c) == list(range(len(c))) for c in counts.values())
    import zlib

    by = dict(data)
    assert all(r["size"] == len((by[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((by[r["doc_id"]] or "").encode()) and r["law"] == "rows" for r in found)


def test_shards_keep_groups_together(spark):
    data = [(i, f"text {i % 100}") for i in range(1000)]
    found = shards.assign(spark.createDataFrame(data, "doc_id long, text string"), 10)
    apart = found.groupBy(F.col("text_crc32")).agg(F.count_distinct("shard").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    assert apart < 550 / 4, apart  # hashing would cut each group of ten 10 * (1 - 0.9**10) - 1 = 5.5 times


def test_packing(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    data, df = table
    found = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    import zlib

    import numpy as np

    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in data}
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        ps = sorted(pieces[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and sum(p["length"] for p in ps) == len(ids)
        assert len(ps) == -(-len(ids) // 1024) and all(p["length"] == 1024 for p in ps[1:])
        for p in ps:
            assert zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(len(x) for x in want.values()) // 1024)
    assert len(bins) <= 1.15 * least + 2


def test_bins_of_many_lengths():
    rng = random.Random(2)
    counts = {}
    for _ in range(3000):
        n = rng.randint(1, 1024)
        counts[n] = counts.get(n, 0) + 1
    made = packing.bins(counts, 1024)
    got = {}
    for kind, n in made:
        assert sum(kind) <= 1024
        for x in kind:
            got[x] = got.get(x, 0) + n
    assert got == counts
    assert sum(n for _, n in made) <= 1.05 * sum(n * c for n, c in counts.items()) / 1024 + 1
    assert packing.bins({}, 1024) == []


def test_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    data = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    found = sorted(tuple(r) for r in QUERIES["op8_nearest_neighbours"](spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    want = sorted(brute.op8(data))
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(found, want))


def test_neighbours_of_awkward_vectors(spark):
    nan = float("nan")
    rng = random.Random(3)
    data = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)]
    data += [(1000 + i, [2.0, 2.0, 2.0, 2.0]) for i in range(60)]  # copies: ties by id
    bad = [(500, None), (520, [0.0] * 4), (540, [nan, 1.0, 1.0, 1.0]), (560, [None, 1.0, 1.0, 1.0]), (580, [float("inf"), 0.0, 0.0, 0.0]), (600, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>")
    clean = [(i, v) for i, v in data if any(v)]
    for n, leaf in ((1, 8), (5, 4)):
        found = sorted(tuple(r) for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), shards=n, leaf=leaf).collect())
        assert [x[:3] for x in found] == [x[:3] for x in sorted(brute.op8(clean))]
    some = vptree.nearest(df, df.where("vec_id % 20 = 0"), factor=2.0, leaf=8, shards=1)
    assert some.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 20


@pytest.mark.parametrize("kind", ["binary", "sparse", "outlier"])
def test_neighbours_with_many_ties_or_an_outlier(spark, kind):
    """More distinct vectors tie than are returned; one norm dwarfs all products but its own."""
    rng = random.Random(9)
    n = 600
    if kind == "outlier":
        data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(n)] + [(n + 1, [1e9] + [0.0] * 5)]
    else:
        data = [(i, [float(rng.random() < (0.5 if kind == "binary" else 0.1)) for _ in range(14)]) for i in rng.sample(range(n), n)]
        data = [(i, v) for i, v in data if any(v)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    for shards, leaf in ((1, 64), (3, 16)):
        found = sorted(tuple(r) for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), shards=shards, leaf=leaf).collect())
        assert found == sorted(brute.op8(data))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "embeddings", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pieces_are_ranked_by_the_tasks_that_make_them(spark):
    """Copies of a text in several tasks each get places of their own, and no sort of all pieces ranks them."""
    import public_tokenizers

    df = spark.createDataFrame([(i, "some words " * (i % 3 * 300)) for i in range(300)], "doc_id long, text string").repartition(7)
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert "row_number" not in out._jdf.queryExecution().toString()
    sequences: dict = {}
    for r in out.collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"], r["piece"]))
    for rows in sequences.values():
        rows.sort()
        assert [o for o, *_ in rows] == [sum(n for _, n, *_ in rows[:i]) for i in range(len(rows))] and sum(n for _, n, *_ in rows) <= 1024
    assert len({x[2:] for rows in sequences.values() for x in rows}) == sum(map(len, sequences.values())) == out.count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, sf)
    assert set(names) <= set(df.columns)
    assert rows_of(df, *names) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_have_the_columns_of_their_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert QUERIES[name](spark, sf).columns == [d[0] for d in c.execute(f"SELECT * FROM ({ORACLE_SQL[name]}) LIMIT 0").description]


def test_neighbours_among_vectors_of_several_lengths(spark):
    rng = random.Random(5)
    data = [(i, [rng.gauss(0, 1) for _ in range((3, 5)[i % 40 < 20])]) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    found = sorted(tuple(r) for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), leaf=8).collect())
    assert found == sorted(x for n in (3, 5) for x in brute.op8([(i, v) for i, v in data if len(v) == n]))


def test_balls_out_of_reach_are_not_searched():
    """Far clusters: most blocks of queries go to the balls that can hold a neighbour, and to no others."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    centres = np.eye(8) * 100
    top = 110.0
    pivots = vptree._lifted(centres, top)
    low, high = np.zeros(8), np.full(8, 5.0)

    class Shared:
        value = {8: (top, pivots, low, high, np.ones(8, np.int64))}

    q = centres[rng.integers(0, 8, 50)] + rng.normal(size=(50, 8)) * 0.1
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(q.tolist(), pa.list_(pa.float64())), pa.array([9_000.0] * 50)], names=["vec_id", "v", "floor"])
    (first,), (rest,) = (list(vptree._route(Shared, 1.0, x)([batch])) for x in (True, False))
    assert sum(len(x.as_py()) for x in first.column("ids")) == 50 * 8 and len(rest) == 0
    none = batch.set_column(2, "floor", pa.array([float("-inf")] * 50))
    (rest,) = vptree._route(Shared, 1.0, False)([none])
    assert sum(len(x.as_py()) for x in rest.column("ids")) == 50 * 7 * 8


@pytest.fixture(scope="module")
def clashing(spark, sf, tmp_path_factory):
    """A very long text among short ones, in a table whose other columns have names that the operators use themselves."""
    rng = random.Random(11)
    long = " ".join(rng.choice(["red", "blue", "ßharp", "seven"]) + str(rng.randrange(5000)) for _ in range(30_000)) + "\n" + "y" * 150_000
    data = [(1, long), (2, long[:50_000]), (3, "short"), (4, None), (5, long[60_000:61_000] + "\nshort")]
    names = ("k", "th", "gone", "size", "spans", "bands", "id", "id2", "n_words", "n_hit", "items", "kept", "kept_sha256", "component_id", "shard", "score", "lang_pred", "piece", "row", "key", "first", "stay", "_own0", "source")
    folder = tmp_path_factory.mktemp("clashing")
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("mine") for c in names}).withColumn("lang", F.lit("en"))
    df.write.parquet(f"{folder}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return data, str(folder)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[:4] != "op8_"])
def test_long_texts_and_clashing_names(spark, clashing, name):
    data, folder = clashing
    found = QUERIES[name](spark, folder)
    if name[:4] in ("op1_", "op4_", "op9_"):
        columns = {"op1_": ("doc_id", "n_words", "n_removed", "kept_sha256"), "op4_": ("doc_id", "n_shingles", "component_id", "kept"), "op9_": ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}[name[:4]]
        assert rows_of(found, *columns) == sorted({"op1_": brute.op1, "op4_": brute.op4, "op9_": brute.op9}[name[:4]](data))
    elif name[:4] == "op10":
        by = {r["doc_id"]: r for r in found.collect()}
        assert by[1]["n_removed"] == 0 and by[5]["n_removed"] == 1 and by[1]["n_lines"] == 2 and len(by) == 5
    else:
        assert {r["doc_id"] for r in found.select("doc_id").collect()} == {1, 2, 3, 4, 5}
