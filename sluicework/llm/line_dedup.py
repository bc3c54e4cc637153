"""Line dedup by an exact set-similarity join (native).

Every line of every document is a set of words.  A line goes if an earlier line, in
its own or another document, has a Jaccard similarity of at least 4/5 with it.  Lines are
ordered by ``doc_id``, then by their place in the text; an earlier line counts whether it
stays itself or not, so that the result doesn't depend on how the work is split.

1. Words are counted over all documents, in a table of hash slots; a word is as
   rare as its slot.  Any order would give the same result, this one gives it soonest.
2. Documents are numbered in the order of ``doc_id`` and text, so that a number names a line and its place.
   Lines with the same set form a class, which its first line stands for.
3. Classes that share a MinHash value are compared with the first of them.  What is
   similar to it is settled, which is nearly all of a large group of near copies.
4. The prefix join: a class has a row for each of its rarest words, as many as any
   similar class must share one of.  Classes that aren't settled meet the earlier ones on
   equal words; length, position and signatures of the sets rule most pairs out.  A signature has 64 bits, and
   256 for sets of ``LONG`` words, since in 64 bits large sets would look alike.  Of the rest each class is
   verified, on the lines' words, with the likeliest earlier one first, and with the others if that one isn't
   similar.  No pair is lost.
5. All lines of a class go but the first, and that one too if its class was matched.

Lines without a word stay and are never compared.  Null text has no lines and stays null.
A null ``doc_id`` comes first.  Rows that agree in ``doc_id`` and text are one document: a
line of the one isn't later than the same line of the other.  An empty table gives an
empty result.  Further columns pass through ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import SPACE, let, row_key, tables, with_group, written

#: Similarity from which a line is a repetition, as a fraction.
SIMILARITY = (4, 5)
#: Counters for the rarity of words are as many as numbers of this many bits, the first ones of a word's hash.
SLOT_BITS = 18
#: Words from which a set's signature has 256 bits.
LONG = 64
#: Bits of a line's number for its place in the text, and of a document's number for its place in a partition.
LINE_BITS, DOC_BITS = 24, 25
#: The sieve of the rows whose texts are fetched has as many bits as numbers of this many bits.
SIEVE_BITS = 22

SIGNATURE = ["sig", "sig1", "sig2", "sig3"]


def placed(docs: DataFrame) -> DataFrame:
    """The texts with what orders them: doc, and row, which is ``row_key`` of doc_id and text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), row_key("doc_id", "text").alias("row"), "text")


def numbered(docs: DataFrame) -> DataFrame:
    """One row per different document: its row and text, and its number (ord) in the order of doc and row."""
    # Texts are shuffled once: equal documents end up in one range, so that what drops the copies has its rows as it needs them.
    ordered = placed(docs).repartitionByRange("doc", "row").groupBy("doc", "row").agg(F.first("text").alias("text")).sortWithinPartitions("doc", "row")
    n = F.monotonically_increasing_id()  # the partition above 33 bits
    part, at = F.shiftright(n, 33), n.bitwiseAND(F.lit((1 << 33) - 1))
    fits = (at < 1 << DOC_BITS) & (part < 1 << (63 - DOC_BITS - LINE_BITS))
    return ordered.select("row", "text", F.when(fits, F.shiftleft(part, DOC_BITS).bitwiseOR(at)).otherwise(
        F.raise_error(F.lit("more documents than line_dedup can number; use more partitions")).cast("long")).alias("ord"))


def plain(text: Column) -> Column:
    """The text with spaces for other white space between words; a split at a single character is far cheaper than one at a pattern."""
    others = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.when(others, F.translate(text, "\t\x0b\x0c\r", " " * 4)).otherwise(text)


def words_of(line: Column) -> Column:
    """The words of a line, and empty ones."""
    return F.split(plain(line), " ")


def rarity(docs: DataFrame) -> DataFrame:
    """One row with a mask for each slot: it puts how often the slot's words occur, in quarters of a power of two, in place of a hash's first 8 bits."""
    # Outer generators, here and below: for others Spark adds a filter that evaluates what they split once more.
    words = docs.select(F.explode_outer(F.split(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.where("word <> ''").groupBy(slot(F.xxhash64("word")).alias("slot")).count()
    every = docs.sparkSession.range(1 << SLOT_BITS).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("count"))
    level = F.least(F.floor(4 * F.log2(F.sum("count") + 1)), F.lit(120)).cast("long")
    whole = counts.unionByName(every).groupBy("slot").agg(level.alias("level")).select("slot", F.shiftleft(
        F.shiftright("slot", SLOT_BITS - 8).cast("long").bitwiseXOR(F.col("level")), 56).alias("mask"))
    return whole.agg(F.array_sort(F.collect_list(F.struct("slot", "mask"))).alias("masks")).select(F.transform("masks", lambda x: x.mask).alias("masks"))


def slot(h: Column) -> Column:
    """The counter of a word with this hash."""
    return F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")


def code(masks: Column, h: Column) -> Column:
    """A word's level of rarity above the last 56 bits of its hash."""
    return h.bitwiseXOR(F.get(masks, slot(h)))


def whole_part(a: Column, b: int) -> Column:
    """a / b without the rest."""
    return F.call_function("div", a, F.lit(b)).cast("int")


def overlap_needed(a: Column, b: Column) -> Column:
    """Words that sets of these sizes must share."""
    num, den = SIMILARITY
    return whole_part(num * (a + b) + num + den - 1, num + den)


def prefix_length(n: Column) -> Column:
    """Of a set's rarest words, how many hold at least one that any similar set has among its own."""
    num, den = SIMILARITY
    return n - whole_part(num * n + den - 1, den) + 1


def parity(hashes: Column) -> Column:
    """64 bits, of which each hash turns one over: what two sets share cancels out, so that they differ in at most as many bits as sets in words."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def described(docs: DataFrame, order: DataFrame, numbers: DataFrame) -> DataFrame:
    """The lines' numbers with the key (a, b) of their set of words, its size, signature, MinHash values and prefix.

    ``numbers`` are the documents as ``numbered`` gives them.  Lines without a word have size 0, null texts none.
    """
    # Functions on arrays with a function of their own cost far more per element than all others, so that words go through
    # three small ones only: hash, mask, signature.
    rows = numbers.select("ord", "row", F.posexplode_outer(F.split(plain(F.col("text")), "\n")).alias("line_no", "line"))
    number = F.when(F.col("line_no") < 1 << LINE_BITS, F.shiftleft("ord", LINE_BITS).bitwiseOR(F.col("line_no").cast("long"))).otherwise(
        F.raise_error(F.lit("a text has more lines than line_dedup can number")).cast("long"))
    hashed = rows.where("line_no is not null").select(
        number.alias("id"), "row", F.array_distinct(F.array_remove(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))).alias("hashes"))
    n = F.size("hashes")
    # For large sets a signature per quarter of the hashes: marks between the quarters tell their places among the sorted ones.
    quarters = [k << 62 for k in (-1, 0, 1)]
    marks = F.sort_array(F.concat("hashes", F.array(*[F.lit(q).cast("long") for q in quarters])))
    told = hashed.select("*", order.scalar().alias("_masks"), F.when(n >= LONG, marks).alias("marks")).select(
        "id", "row", "hashes", "marks", F.sort_array(F.transform("hashes", lambda x: code(F.col("_masks"), x))).alias("coded"))
    ends = [F.array_position("marks", F.lit(q).cast("long")).cast("int") for q in quarters]
    parts = [parity(F.slice("marks", a + 1, b - a - 1)) for a, b in zip([F.lit(0), *ends], [*ends, F.size("marks") + 1], strict=True)]
    signed = told.select(
        "id", "row", "hashes", "coded", *[F.when(n >= LONG, x).alias(f"part{k}") for k, x in enumerate(parts)],
        F.when(n < LONG, parity(F.col("hashes"))).alias("whole"))
    return signed.select(
        "id", "row", n.alias("n"), F.xxhash64("coded").alias("a"), F.xxhash64(F.lit(1), "coded").alias("b"),
        F.array_min("hashes").alias("mh0"), F.array_max("hashes").alias("mh1"),
        F.coalesce("whole", F.col("part0").bitwiseXOR(F.col("part1")).bitwiseXOR(F.col("part2")).bitwiseXOR(F.col("part3"))).alias("sig"),
        *[F.col(f"part{k}").alias(f"sig{k}") for k in (1, 2, 3)], F.slice("coded", F.lit(1), prefix_length(n)).alias("prefix"))


def copies(told: DataFrame, table) -> DataFrame:
    """The numbers of the lines whose set an earlier line has."""
    lines = told.where("n > 0").select("a", "b", "id")
    classes = table(lines.groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1"))
    often = 0.001 * told.count()
    hot = classes.where(F.col("members") >= often).drop("members")  # at most 1000 rows
    cold = classes.where(F.col("members") < often).drop("members")
    named = lines.join(F.broadcast(hot), ["a", "b"]).unionByName(
        lines.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(cold, ["a", "b"]))
    return table(named.where("id <> first").select("id"))


def differing(x: str, y: str) -> Column:
    """Bits in which the signatures of two sets differ, in 256 bits if both have them."""
    whole, *parts = [F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in SIGNATURE]
    first = whole
    for p in parts:
        first = first.bitwiseXOR(p)
    return F.coalesce(F.bit_count(first) + sum([F.bit_count(p) for p in parts[1:]], F.bit_count(parts[0])), F.bit_count(whole))


def possible(n: Column, m: Column, differ: Column) -> Column:
    """Whether sizes and signatures allow two sets to be similar."""
    num, den = SIMILARITY
    return (num * n <= den * m) & (num * m <= den * n) & (differ <= n + m - 2 * overlap_needed(n, m))


def sieve(rows: DataFrame) -> DataFrame:
    """One row with a table of 2^22 bits, those of these rows set: most of what isn't among them is told without a shuffle."""
    every = rows.sparkSession.range(1 << SIEVE_BITS - 6).select("id", F.lit(0).cast("long").alias("bit"))
    own = rows.select(cell(F.col("row")).cast("long").alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("row"))).alias("bit"))
    whole = own.unionByName(every).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    return whole.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("cells")).select(F.transform("cells", lambda x: x.bits).alias("cells"))


def cell(row: Column) -> Column:
    """The number of 64 bits of the sieve among which a row has its bit."""
    return F.shiftrightunsigned(row, 70 - SIEVE_BITS).cast("int")


def bit(row: Column) -> Column:
    """The place of a row's bit among these 64."""
    return row.bitwiseAND(F.lit(63)).cast("int")


def texts(docs: DataFrame, numbers: DataFrame, wanted: DataFrame, table) -> DataFrame:
    """The lines (id, line) with these numbers."""
    per = wanted.select(F.shiftright("id", LINE_BITS).alias("ord"), F.col("id").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("no")).groupBy(
        "ord").agg(F.collect_set("no").alias("nos")).join(numbers, "ord")
    per = table(per)
    cells = table(sieve(per))
    some = placed(docs).select("row", "text").where(F.getbit(F.get(cells.scalar(), cell(F.col("row"))), bit(F.col("row"))) == 1)
    found = let(F.split("text", "\n"), lambda lines: F.transform("nos", lambda i: F.struct(
        F.shiftleft("ord", LINE_BITS).bitwiseOR(i.cast("long")).alias("id"), F.get(lines, i).alias("line"))))
    return some.join(per, "row").select(F.explode_outer(found).alias("t")).select("t.*")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The later numbers (id) of the pairs whose lines are similar, each once."""
    num, den = SIMILARITY
    sides = F.array(*[F.struct(F.lit(s == "x").alias("first"), F.col(s).alias("id")) for s in "xy"])
    wanted = pairs.select("x", "y", F.explode(sides).alias("_s")).select("x", "y", "_s.*")
    both = wanted.join(lines, "id").groupBy("x", "y").agg(
        F.max(F.when(F.col("first"), F.col("line"))).alias("line_x"), F.max(F.when(~F.col("first"), F.col("line"))).alias("line_y"))
    a, b = (F.array_distinct(F.array_remove(words_of(F.col(f"line_{c}")), "")) for c in "xy")
    similar = let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(
        F.size(F.array_intersect(s.a, s.b)), lambda o: (num + den) * o >= num * (F.size(s.a) + F.size(s.b))))
    return both.where(similar).select(F.col("y").alias("id")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    """The numbers (id) that occur in pairs, each once."""
    return pairs.select(F.col("x").alias("id")).distinct().unionByName(pairs.select(F.col("y").alias("id")).distinct()).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """The places (row, line_no) of the lines to remove; ``row`` is ``row_key`` of doc_id and text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with tables(spark) as table:
        order = table(rarity(docs))
        told = table(described(docs, order, numbered(docs)))
        numbers = table(told.where(F.col("id").bitwiseAND(F.lit((1 << LINE_BITS) - 1)) == 0).select(F.shiftright("id", LINE_BITS).alias("ord"), "row"))
        table.drop(order)  # tables go as soon as they can, since each may be as large as the input
        repeated = copies(told, table)
        sets = table(told.where("n > 0").drop("a", "b", "row").join(repeated, "id", "left_anti"))
        table.drop(told)

        # The second MinHash value is the largest hash, turned over to tell the two apart.
        about = ["id", "n", *SIGNATURE]
        minhash = sets.select(F.col("mh0").alias("mh"), *about).unionByName(sets.select(F.bitwise_not("mh1").alias("mh"), *about))
        groups = with_group(minhash, "mh", F.min("id").alias("first"), *[F.min_by(c, "id").alias(f"first_{c}") for c in about[1:]], least=2)
        both = groups.select(F.struct(*about).alias("y"), F.struct(F.col("first").alias("id"), *[F.col(f"first_{c}").alias(c) for c in about[1:]]).alias("x"))
        near = table(both.where((F.col("x.id") < F.col("y.id")) & possible(F.col("x.n"), F.col("y.n"), differing("x", "y"))).select(
            F.col("x.id").alias("x"), F.col("y.id").alias("y")).distinct())
        settled = table(verified(near, texts(docs, numbers, ends(near), table)))

        # Narrow rows, since there are several per line: size and position are one number.  Those of settled classes have a
        # position behind any set's end as later ones, so that both sides of the join are the same rows, shuffled once.
        done = 1 << 30
        flagged = sets.join(settled.withColumn("done", F.lit(done)), "id", "left")
        words = F.arrays_zip(F.col("prefix").alias("word"), F.slice(F.concat(F.array(F.lit(-1).cast("long")), "prefix"), F.lit(1), F.size("prefix")).alias("before"))
        rows = flagged.select("id", "n", *SIGNATURE, "done", F.posexplode_outer(words).alias("at", "t")).select("id", *SIGNATURE, "t.word", "t.before", (
            F.shiftleft(F.col("n").cast("long"), 32) + F.coalesce("done", F.lit(0)) + F.col("at")).alias("n_at"))
        x, y = rows.alias("x"), rows.alias("y")
        num, den = SIMILARITY
        n, m = (F.shiftright(f"{s}.n_at", 32).cast("int") for s in "xy")
        i, j = (F.col(f"{s}.n_at").bitwiseAND(F.lit(bits)).cast("int") for s, bits in (("x", done - 1), ("y", 2 * done - 1)))
        close = F.least(n - i, m - j) >= overlap_needed(n, m)
        # Nearly all pairs end at this test, which is cheap: what similar sets differ in is at most a ninth of their words.
        alike = (num + den) * F.bit_count(F.col("x.sig").bitwiseXOR(F.col("y.sig"))) <= (den - num) * (n + m)
        # Of shared words that follow one another on both sides only the first makes the pair.
        anew = (i == 0) | (F.col("x.before") != F.col("y.before"))
        met = table(x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.id") < F.col("y.id")) & alike & close & anew & possible(n, m, differing("x", "y"))).select(
            F.col("x.id").alias("x"), F.col("y.id").alias("y"), differing("x", "y").alias("differ")).distinct())
        table.drop(sets)

        # A class goes if any earlier one is similar: the likeliest is verified first, the others only for what is left.
        lines = table(texts(docs, numbers, ends(met), table))
        likeliest = table(met.groupBy("y").agg(F.min_by("x", F.struct("differ", "x")).alias("x")))
        found = table(verified(likeliest, lines))
        open_ = likeliest.select("y", F.col("x").alias("likeliest")).join(found.select(F.col("id").alias("y")), "y", "left_anti")
        rest = met.join(open_, "y").where("x <> likeliest").select("x", "y")
        gone = repeated.unionByName(settled).unionByName(found).unionByName(verified(rest, lines))
        named = gone.select(F.shiftright("id", LINE_BITS).alias("ord"), F.col("id").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int").alias("line_no"))
        return written(named.join(numbers, "ord").select("row", "line_no"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")


def dedup_lines(docs: DataFrame, removed: str = "n_removed") -> DataFrame:
    """The rows with the text that stays, and how many lines went."""
    per_row = repeated_lines(docs).groupBy("row").agg(F.collect_set("line_no").alias("_gone"))
    columns = [c for c in docs.columns if c != removed]
    rows = docs.select(F.struct(*columns).alias("_r"), row_key("doc_id", "text").alias("row"))
    joined = rows.join(per_row, "row", "left")
    text = F.when(F.col("_gone").isNull(), F.col("_r.text")).otherwise(without(F.col("_r.text"), F.col("_gone")))
    return joined.select(
        *[(text if c == "text" else F.col("_r").getField(c)).alias(c) for c in columns],
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(removed))
