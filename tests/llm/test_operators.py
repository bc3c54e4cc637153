"""The operators on hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluicework.llm import components, language, line_dedup, ngram_join, packing, pieces, quality, sharding, toxicity, warc
from sluicework.llm.common import tables
from sluicework.llm.exact_dedup import exact_dedup
from sluicework.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, ids int, shard int, _w string, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed=0, size=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(size)}" for _ in range(n)]


def texts():
    base = words(200)
    one = " ".join(base)
    near = " ".join([*base[:100], "changed", *base[101:]])
    return [
        one, one.replace(" ", "\n"), near, one + " ", None, "", " \t\n ", "a b", "a b", "é ü 漢字 ok", "x" * 20_000,
        "\n".join([" ".join(words(12, 7)), " ".join(words(12, 8)), " ".join([*words(12, 7)[:-1], "end"])]),
        " ".join(words(12, 8)), "a a a a " * 30, one, "word " * 5000,
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of every odd kind, one of them twice, and a null id; other columns have names that the operators use."""
    rows = [(i, t, "en" if i % 3 else None, ["h1", "h2", None][i % 3], None, i, "k", 1, 2, "w", 3) for i, t in enumerate(texts())]
    rows += [rows[1], (None, texts()[0], "en", "h1", 5, 1, "k", 1, 2, "w", 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, odd, none):
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i is None, i or 0))
    rows = exact_dedup(odd).collect()
    assert sum(r.kept for r in rows) == len(groups) and len(rows) == len(docs)
    for r in rows:
        text = next(t for i, t in docs if i == r.doc_id)
        norm = re.sub(r"[\x20\x09-\x0D]", "", text)
        first = min(groups[norm])
        assert (r.group_size, r.text_sha256) == (len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest())
        assert r.keep_id == (None if first[1] else first[2]) and (not r.kept or (-len(text), r.doc_id is None, r.doc_id or 0) == first)
    assert exact_dedup(none).count() == 0
    same = spark.createDataFrame([(1, "a b"), (1, "a\tb"), (1, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted((r.text_sha256, r.group_size, r.kept) for r in exact_dedup(same).collect()) == sorted(
        (hashlib.sha256(t).hexdigest(), n, k == 0) for t, n in ((b"ab", 3), (b"c", 2)) for k in range(n))


def test_heavy_digests(spark):
    """A third of the rows equal: they are settled by the broadcast winners, with the same result."""
    rows = [(i, "same text" if i % 3 == 0 else f"t {i % 500}") for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), support=0.01).collect()
    sizes = Counter(t for _, t in rows)
    assert all(r.group_size == sizes[rows[r.doc_id][1]] for r in found) and sum(r.kept for r in found) == len(sizes)


def test_quality(spark, odd, none):
    found = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        wins = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if wins[x] > 1 for k in range(3)}
        assert (found[i].n_words, found[i].word_chars, found[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).columns == none.columns
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
        map(str, (r.doc_id for r in quality.quality_rules(odd).collect() if r.kept)))


@pytest.mark.parametrize("limit", [quality.BROADCAST_BYTES, 0])
def test_bad_hosts(spark, monkeypatch, limit):
    """A host of nearly only bad documents is rejected, a small one with the same rate isn't."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
    good, bad = " ".join(words(80)), "spam " * 60
    rows = [(i, good if i % 50 == 0 else bad, "spam.example") for i in range(400)]
    rows += [(1000 + i, bad if i % 20 == 0 else good, f"host{i % 9}") for i in range(900)] + [(5000, good, None), (5001, bad, "tiny")]
    kept = {r.doc_id for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.kept}
    assert kept == {i for i, t, h in rows if t == good and h != "spam.example"}


def test_line_dedup(spark, odd, none):
    rows = sorted({(r.doc_id if r.doc_id is not None else -(1 << 63), r.text) for r in odd.collect() if r.text is not None})
    seen, gone = [], Counter()
    left = {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            w = set(WORD.findall(line))
            same = w and any(9 * len(w & o) >= 4 * (len(w) + len(o)) for o in seen)
            if w:
                seen.append(w)
            gone[i] += bool(same)
            kept += [] if same else [line]
        left[i] = "\n".join(kept)
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_removed"]
    for r in out.collect():
        i = r.doc_id if r.doc_id is not None else -(1 << 63)
        assert (r.text, r.n_removed) == ((None, 0) if r.doc_id == 4 else (left[i], gone[i]))
    assert out.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0


def test_near_lines(spark):
    """Random near copies of some lines against all pairs."""
    draw, rows = random.Random(3), []
    stems = [words(n, n, 300) for n in (5, 9, 10, 14, 20, 31)]
    for i in range(240):
        w = [*draw.choice(stems)]
        for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
            w[draw.randrange(len(w))] = f"n{draw.randrange(60)}"
        rows.append((i, " ".join(w)))
    sets, expected = [], {}
    for i, t in rows:
        w = set(t.split())
        expected[i] = any(9 * len(w & o) >= 4 * (len(w) + len(o)) for o in sets)
        sets.append(w)
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed == 1 for r in found} == expected and 40 < sum(expected.values()) < 240


def test_near_long_lines(spark, monkeypatch):
    """Near copies of long lines against all pairs; of unlike lines, however long, no pair is left to verify."""
    draw, rows, made = random.Random(11), [], []
    pool = sorted({*words(900, 12, 9000)})
    stems = [draw.sample(pool, n) for n in (40, 58, 63, 64, 70, 150, 290) for _ in range(5)]
    for i in range(160):
        w = [*draw.choice(stems)]
        for _ in range(draw.choice([0, 1, len(w) // 20, len(w) // 12, len(w) // 9, len(w) // 6])):
            w[draw.randrange(len(w))] = draw.choice(pool)
        rows.append((i // 2, " ".join(w[:draw.choice([len(w), len(w) - len(w) // 8])]) + "  \n\n"))
    rows = [(i, "".join(t for j, t in rows if j == i)) for i in range(80)] + [(i, " ".join(draw.sample(pool, 290))) for i in range(80, 140)]
    sets, gone = [], Counter()
    for i, t in rows:
        for w in filter(None, (frozenset(line.split()) for line in t.split("\n"))):
            gone[i] += any(9 * len(w & o) >= 4 * (len(w) + len(o)) for o in sets)
            sets.append(w)
    similar = sum(9 * len(a & b) >= 4 * (len(a) + len(b)) for k, a in enumerate(sets) for b in sets[:k])

    @contextmanager
    def counted(spark):
        with tables(spark) as table:
            def write(df):
                back = table(df)
                made.extend([back.count()] if "differ" in back.columns else [])
                return back

            write.drop = table.drop
            yield write

    monkeypatch.setattr(line_dedup, "tables", counted)
    twice = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")  # equal rows are one document
    found = line_dedup.dedup_lines(twice).collect()
    assert len(found) == 149 and all(r.n_removed == gone[r.doc_id] for r in found) and 20 < sum(gone.values()) < 160
    assert len(made) == 1 and made[0] <= 1.5 * similar


def test_lines_split_once(spark):
    """No filter that splits the texts once more stands below the rows of words and lines."""
    docs = spark.createDataFrame([(1, "a b\nc"), (2, None)], "doc_id long, text string")
    with tables(spark) as table:
        order = table(line_dedup.rarity(docs))
        told = line_dedup.described(docs, order, table(line_dedup.numbered(docs)))
        for df in (line_dedup.rarity(docs), told):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert not any("Filter" in x and "split(" in x for x in plan.split("\n"))
        assert sorted(r.n for r in told.collect()) == [1, 2]


def test_words_hashed_once(spark):
    """Each word of a line is hashed once, and the prefixes have the rarest ones."""
    rows = [(i, f"often a{i} b{i} c{i} d{i}\n\toften  often\r") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with tables(spark) as table:
        order = table(line_dedup.rarity(docs))
        told = line_dedup.described(docs, order, table(line_dedup.numbered(docs)))
        plan = told._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"xxhash64\(lambda", plan)) == 1
        found = told.collect()
    often = spark.range(1).select(F.xxhash64(F.lit("often"))).first()[0] & (1 << 56) - 1
    assert Counter((r.n, len(r.prefix)) for r in found) == {(5, 2): 300, (1, 1): 300}
    assert all((often in {c & (1 << 56) - 1 for c in r.prefix}) == (r.n == 1) for r in found)
    assert {r.prefix[0] >> 56 for r in found if r.n == 1} == {39}  # 4 * log2(901), rounded down


def test_texts_shuffled_seldom(spark):
    """Documents get their numbers with their texts, in one shuffle, and of fetched lines only the texts wanted are shuffled."""
    rows = [(i % 50, f"a{i}\nb{i}\n\nc") for i in range(300)] + [(None, "x y"), (7, None), (None, "x y"), (3, "a3\nb3\n\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbers = line_dedup.numbered(docs)
    plan = numbers._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    of = {t: -1 if i is None else i for i, t in rows}
    found = [r.text for r in sorted(numbers.collect(), key=lambda r: r.ord)]
    assert len(found) == 302 and [of[t] for t in found] == sorted(of[t] for t in found)
    with tables(spark) as table:
        named = table(numbers.select("ord", "row"))
        wanted = numbers.where("text like 'a%7\n%'").select((F.shiftleft("ord", line_dedup.LINE_BITS) + 1).alias("id"))
        lines = line_dedup.texts(docs, named, wanted, table)
        plan = lines._jdf.queryExecution().optimizedPlan().toString()
        assert Counter(r.line for r in lines.collect()) == {f"b{i}": 1 for i in range(7, 300, 10)}
        assert "getbit" in plan
        cells = table(line_dedup.sieve(numbers.where("text like 'a%7\n%'")))
        bits = F.getbit(F.get(cells.scalar(), line_dedup.cell(F.col("row"))), line_dedup.bit(F.col("row")))
        assert numbers.where(bits == 1).count() == 30


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    with tables(spark) as table:
        found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long"), table).collect()}
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert found == {i: top(i) for i in linked}


def brute_classes(rows):
    """Class, copies and links of documents by all pairs."""
    def grams(t):
        w = WORD.findall(t or "")
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t in rows]
    links = {j: {k for k, (_, b) in enumerate(sets) if k != j and a and 9 * len(a & b) >= 4 * (len(a) + len(b))}
             for j, (_, a) in enumerate(sets)}
    label = [*range(len(sets))]
    for _ in sets:
        label = [min([label[j], *(label[k] for k in links[j])]) for j in range(len(sets))]
    least = {c: min(i for (i, _), x in zip(sets, label, strict=True) if x == c) for c in set(label)}
    return sorted((i, least[label[j]], len(links[j])) for j, (i, _) in enumerate(sets))


@pytest.mark.parametrize("blocks", [(2000, 1000), (5, 7)])
def test_ngram_join(spark, monkeypatch, blocks):
    """Families of near copies, some over the block sizes, against all pairs."""
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(ngram_join, "BLOCK", blocks[1])
    draw, rows = random.Random(9), [(900, None), (901, ""), (902, "a b"), (903, "a b"), (904, "one two three four five")]
    for family in range(4):
        base = words(150, family)
        for i in range([40, 6, 3, 1][family]):
            w = [*base]
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                w[draw.randrange(len(w))] = f"n{draw.randrange(1000)}"
            rows.append((family * 100 + i, " ".join(w)))
    found = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == brute_classes(rows)


def test_keep_one(odd, none):
    kept = ngram_join.keep_one(odd)
    ids = Counter(r.doc_id for r in kept.collect())
    # 0, 1, 2, 3, 14 and the null id are near copies; the row that is there twice goes twice
    assert kept.columns == odd.columns and ids[0] == 1 and not {1, 2, 3, 14, None, 8} & set(ids) and {4, 5, 6, 7} <= set(ids)
    assert ngram_join.keep_one(none).count() == 0


def test_keep_one_of_each_class(spark):
    """Repeated rows of the least doc_id, near texts under one doc_id, and classes without any doc_id: one row stays of each."""
    def family(seed, changes):
        base = words(200, seed)
        return [" ".join([*base[:k], "changed", *base[k + 1:]]) if k else " ".join(base) for k in changes]

    a, b, c, d = family(11, [0, 100]), family(12, [0, 90, 110]), family(13, [0, 0, 100]), family(14, [0, 100])
    rows = [(1, a[0], "a"), (1, a[0], "a"), (1, a[0], "a"), (2, a[1], "a"), (3, a[0], "a")]
    rows += [(5, b[0], "b"), (5, b[1], "b"), (9, b[2], "b")]
    rows += [(None, t, "c") for t in c] + [(None, d[0], "d"), (None, d[1], "d"), (7, d[1], "d")]
    rows += [(None, None, "none"), (None, None, "none"), (20, "", "none"), (20, "", "none"), (1, "one of its own", "own")]
    draw = random.Random(1)
    for _ in range(2):
        draw.shuffle(rows)
        kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, family string").repartition(3)).collect()
        found = Counter(r.family for r in kept)
        assert found == {"a": 1, "b": 1, "c": 1, "d": 1, "none": 4, "own": 1}
        assert {r.family: r.doc_id for r in kept if r.family in "abcd"} == {"a": 1, "b": 5, "c": None, "d": 7}


def test_pruning():
    needed = ngram_join.needed_matches()
    assert [n for n, _ in needed] == [16, 32, 48, 64] and all(m < 0.8 * n for n, m in needed)
    draw = np.random.default_rng(1)
    one = draw.integers(0, 1 << 16, 64, dtype="uint16")
    like = np.where(draw.random((500, 64)) < 0.8, one, draw.integers(0, 1 << 16, (500, 64), dtype="uint16"))
    other = np.where(draw.random((500, 64)) < 0.2, one, draw.integers(0, 1 << 16, (500, 64), dtype="uint16"))
    assert len(ngram_join.survivors(one, like, needed)) == 500 and len(ngram_join.survivors(one, other, needed)) < 10


def test_pieces(spark, odd, none):
    """Ids as the library gives them, and back."""
    from sentencepiece import SentencePieceProcessor

    path = vocabulary("piece_bpe_32k.model")
    library, model = SentencePieceProcessor(model_file=path), pieces.Model(path)
    draw = random.Random(2)
    parts = ["a", "b", "  ", " ", "\n", "é", "the", " ing", "漢", "\U00010348", "|", "0", "tion", "▁"]
    samples = [t for t in texts() if t] + ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(2000)] + [" " * 300 + "a"]
    for t, ids in zip(samples, model.encode(samples), strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids)
    rows = pieces.decode(pieces.encode(odd, path), path)
    assert {c: t for c, t in rows.dtypes if c in ("ids", "decoded")} == {"ids": "array<int>", "decoded": "string"}
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in rows.collect())
    assert pieces.decode(pieces.encode(none, path), path).count() == 0


def test_pieces_in_little_memory():
    """What a worker remembers and works on at a time doesn't grow with the distinct words or the batch."""
    model = pieces.Model(vocabulary("piece_bpe_32k.model"))
    for at in range(0, 250_000, 10_000):
        model.encode([" ".join(f"q{i}" for i in range(at, at + 10_000))])
        assert len(model.words) + len(model.older) <= 150_000
    batch = pa.RecordBatch.from_pydict({"text": [None, *map(str, range(1200))]})
    parts = [*pieces._slices([batch, batch.slice(0, 0)])]
    assert max(p.num_rows for p in parts) <= 500 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


def test_sharding(spark, odd, none):
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 1009)
    assert set(Counter(table).values()) <= {100, 101}
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.1 * 1009  # beside those of the shard that went
    rows = sharding.assign_shards(odd, "doc_id", names, 1009).collect()
    assert len(rows) == odd.count()
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.assign_shards(none, "doc_id", names, 1009).count() == 0
    with pytest.raises(ValueError, match="prime"):
        sharding.fill(names, 1000)


def test_write_shards(spark, tmp_path):
    """Whole rows come back from the shard of their key; a hot key and rows equal in all columns are written by several tasks."""
    names = [f"s{i}" for i in range(10)]
    rows = [("hot", f"text {i} " * 9) for i in range(4000)] + [("same", "one text " * 9)] * 40_000 + [(f"k{i}", "x") for i in range(500)] + [(None, "y")] * 3
    random.Random(3).shuffle(rows)
    assigned = sharding.assign_shards(spark.createDataFrame(rows, "k string, text string").repartition(8), "k", names, 1009)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1k")
    try:
        sharding.write_shards(assigned, str(tmp_path / "shards"))
    finally:
        spark.conf.set(size, before)
    found = spark.read.parquet(str(tmp_path / "shards")).select("*", F.input_file_name().alias("file")).collect()
    assert Counter((r.k, r.text) for r in found) == Counter(rows)
    table = sharding.fill(names, 1009)
    for r in found:
        slot = int(hashlib.md5((r.k or "").encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert all(len({r.file for r in found if r.k == k}) > 1 for k in ("hot", "same"))


def test_warc(spark, tmp_path):
    """Round trip of payloads over many chunks, with repetitions, line feeds, odd characters and nulls."""
    long = "".join(random.Random(4).choices("ab\r\n é漢\U00010348", k=30_000))
    pages = [(5, "http://a/b c", long), (3, "http://a/2", long), (9, None, None), (1, "u", ""), (2, "u\r\nx", "x" * 99),
             (4, "u", "x" * 99), (7, "u", "y" * 100), (6, "u", "y" * 100), (None, "u", "z" * 200), (8, "u", "0\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, kind string").repartition(2)
    warc.write_archives(warc.records(df), str(tmp_path / "w"), chunk_bytes=1000)
    found = {r.page_id: r for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    assert len(found) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if h == html and j is not None]
        first = min(same) if len(data) >= 100 and same and i is not None and min(same) != i else None
        assert found[i][1:] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first, True)
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).where("record_id = '3' and not last").orderBy("chunk_no").collect()
    assert len(chunks) > 50 and b"".join(bytes(c.chunk) for c in chunks).decode() == long
    assert all(len(c.chunk) <= 1000 for c in chunks)
    for k in (0, 7):
        data = b"".join(bytes(c.chunk) for c in chunks[:k + 1])
        assert (chunks[k].bytes_so_far, chunks[k].digest_so_far) == (len(data), hashlib.sha256(data).hexdigest())
    warc.write_archives(warc.records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


def toxic_table(spark, n=600):
    draw, rows, labels = random.Random(6), [], []
    for i in range(n):
        sentences = [" ".join(words(8, i * 50 + k, 500)) for k in range(draw.randrange(2, 12))]
        toxic = draw.random() < 0.25
        if toxic:
            at = draw.randrange(len(sentences))
            sentences[at] += " " + draw.choice(["scum", "idiot", "trash"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity(spark, odd, none):
    docs, labels, truth = toxic_table(spark)
    found = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()} == {r.doc_id for r in found if r.score < 0.7}
    model = toxicity.fit(docs, labels)
    spots = toxicity.offending(docs, model, 0.5).collect()
    assert len(spots) >= 0.9 * sum(truth.values()) and all(re.search("scum|idiot|trash", s.sentence) for s in spots)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[s.doc_id][s.start:s.start + s.length] == s.sentence for s in spots)
    assert len(toxicity.toxicity(odd, labels).collect()) == odd.count() and toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_language(spark, odd, none):
    draw = random.Random(8)
    vocabulary_ = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schon", "nicht"], "fr": ["les", "est", "pour", "dans"]}
    rows = [(i, " ".join(draw.choices(vocabulary_[lang], k=30)), lang) for i in range(300) for lang in [draw.choice([*vocabulary_])]]
    rows += [(1000, None, "en"), (1001, "12 34 !", "en"), (1002, "der und schon", None), (1003, "½ ② Ⅷ ²", "en")]
    found = {r.doc_id: r for r in language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:300]) and found[1002].lang_pred == "de"
    assert [found[i][2:] for i in (1000, 1001, 1003)] == [("und", 0.0)] * 3
    assert found[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert language.language_id(odd).count() == odd.count() and language.language_id(none).count() == 0
    counted = dict(zip(*language.grams({"ab": 2, "b": 1}), strict=True))
    number = lambda g: int("".join(f"{ord(c):021b}" for c in g), 2)
    assert counted == {number(g): n for g, n in {"a": 2, "b": 3, "_a": 2, "ab": 2, "b_": 3, "_b": 1, "_ab": 2, "ab_": 2, "_b_": 1}.items()}


def test_words_of():
    """Words are runs of letters, and are found about as fast as by a plain pattern."""
    signs = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    draw = random.Random(5)
    for _ in range(20):
        text = "".join(draw.choices([*signs, *"aBéΣİ_1 漢\u0301"], k=300)) + "".join(draw.choices([*"aBéΣİ_1 ½②\U00010107"], k=300))
        runs = "".join(c if c.isalpha() else " " for c in text.lower())
        assert language.words_of(text) == runs.split()
    text = " ".join([*words(50_000), "é"])

    def seconds(call):
        start = time.perf_counter()
        call()
        return time.perf_counter() - start

    plain = re.compile(r"\w+")
    assert min(seconds(lambda: language.words_of(text)) for _ in range(3)) < 8 * min(seconds(lambda: plain.findall(text)) for _ in range(3))


def check_packing(rows, docs, tokenizer, size=1024):
    """Pieces hold the documents' ids, and sequences are gapless and not too long."""
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in own] == [*range(len(own))] and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == size for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in own)
    assert not by_doc
    for s in sequences.values():
        s.sort()
        assert all(a == sum(n for _, n in s[:k]) for k, (a, _) in enumerate(s)) and sum(n for _, n in s) <= size
    return len(sequences), sum(r.length for r in rows)


def test_packing(spark, none):
    from tokenizers import Tokenizer

    paths = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    docs = [(i, t) for i, t in enumerate(texts())] + [(100 + i, " ".join(words(n, i))) for i, n in enumerate([1, 1, 1, 30, 30, 99, 400] * 30)]
    docs += [(500, "a <|endoftext|> b"), (501, "x" * 600 + "  y"), (502, " " * 700 + "\n\n z's")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, piece int, length int")
    n, total = check_packing(packing.best_fit_packing(df, *paths).collect(), docs, Tokenizer.from_file(paths[0]))
    assert n <= 1.03 * -(-total // 1024) + 1
    assert packing.best_fit_packing(none, *paths).count() == 0
    assert packing.best_fit_packing(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string"), *paths).count() == 2


def test_packing_plan():
    draw = random.Random(1)
    for _ in range(30):
        counts = Counter(draw.randrange(1, 65) for _ in range(draw.randrange(1, 300)))
        made, used = packing.plan(counts, 64), Counter()
        for pattern, times in made:
            assert sum(pattern) <= 64 and times > 0
            for n in pattern:
                used[n] += times
        assert used == counts
        assert sum(times for _, times in made) <= sum(times for _, times in packing.best_fit(counts, 64))
    assert packing.plan({40: 3, 24: 2, 12: 2}, 64) == [((40, 24), 2), ((40, 12, 12), 1)]
    assert packing.plan({30: 1, 20: 1, 10: 1, 4: 1}, 64) == [((30, 20, 10, 4), 1)]


def test_pipeline(spark, sf_dir):
    """Each stage against what its operator says of the stage's own input."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert out.columns == docs.columns
        kept[name] = docs, out
        docs = out
    ids = {n: ({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for n, (a, b) in kept.items()}
    for name, verdicts in (
            ("quality_rules", quality.quality_rules(kept["quality_rules"][0]).where("kept")),
            ("toxicity", toxicity.toxicity(kept["toxicity"][0], spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0")),
            ("ngram_join", ngram_join.ngram_join(kept["ngram_join"][0]).where("doc_id = class_id"))):
        assert ids[name][1] == {r.doc_id for r in verdicts.collect()} and ids[name][1] <= ids[name][0]
    assert len(ids["quality_rules"][1]) < len(ids["quality_rules"][0])  # the smallest tables needn't have what later stages reject
    assert ids["line_dedup"][0] == ids["line_dedup"][1]
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"][1].collect())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))
