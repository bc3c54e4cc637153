"""Host-level quality rules (native).

Each document is judged by a few rules over its whole text.  Failures are summed per
host (``source``), the failure rate of each host is shrunk towards all hosts with a beta
prior fitted to the hosts' rates by its moments, and a host whose shrunk rate reaches
``max_host_rate`` in some rule is rejected with all its documents.

Null text counts as empty and fails.  A null host is no host: its documents are judged by
themselves.  Repeated rows count as often as they occur.  One host, or no spread between
hosts, gives the strongest prior.  An empty table gives an empty result.

All work on a text happens inside its row.  Only one partial sum per task and host is
shuffled; a hot host costs no more than another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import SPACE, let, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
MAX_HOST_RATE = 0.8
#: The prior weighs as much as so many documents at least and at most.
PRIOR_WEIGHT = (2.0, 1000.0)
#: Rejected hosts are broadcast up to this number of bytes, else joined by shuffle.
BROADCAST_BYTES = 4_000_000
#: Parts that the documents of a host are dealt to in a shuffled join.
SALTS = 32
RULES = ("base", "symbols", "dup_lines")


def _repeated(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more: windows are sorted by a 64-bit hash inside the row."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - 2),
        lambda i: F.struct(
            F.xxhash64(F.element_at(tokens, i), F.element_at(tokens, i + 1), F.element_at(tokens, i + 2)).alias("h"),
            i.alias("at")))
    twice = let(F.array_sort(windows), lambda w: F.array_sort(F.transform(
        F.filter(w, lambda x, i: (x.h == F.get(w, i - 1).h) | F.coalesce(x.h == F.get(w, i + 1).h, F.lit(False))),
        lambda x: x.at)))
    covered = let(twice, lambda at: F.aggregate(
        F.transform(at, lambda x, i: F.coalesce(F.least(F.get(at, i + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0), lambda a, x: a + x))
    return F.when(F.size(tokens) < 3, F.lit(0)).otherwise(covered)


def measures(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines in a struct ``_m``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def measured(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"),
            )).alias("lines"),
            _repeated(tokens).cast("long").alias("n_repeat_words"))

    return docs.withColumn("_m", let(words(F.col("text")), measured))


def failures(m: str = "_m") -> dict[str, Column]:
    """Per rule whether a document with these measures fails it."""
    n = F.col(f"{m}.n_words")
    return {
        "base": (n < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "symbols": 100 * F.col(f"{m}.n_symbols") > MAX_SYMBOL_PERCENT * F.col(f"{m}.word_chars"),
        "dup_lines": 100 * F.col(f"{m}.lines.dup") > MAX_DUP_LINE_PERCENT * F.col(f"{m}.lines.n"),
    }


def host_rates(judged: DataFrame, prior_weight: tuple[float, float] = PRIOR_WEIGHT) -> DataFrame:
    """Per host (column ``host``) of rows with a boolean per rule: n_docs, failures and shrunk rate per rule."""
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.count_if(F.col(r)).alias(f"failed_{r}") for r in RULES])
    hosts = written(hosts)
    prior = hosts.agg(*[
        x for r in RULES for x in (
            F.avg(F.col(f"failed_{r}") / F.col("n_docs")).alias(f"mean_{r}"),
            F.var_pop(F.col(f"failed_{r}") / F.col("n_docs")).alias(f"var_{r}"))]).first()
    out = hosts
    for r in RULES:
        mean, var = prior[f"mean_{r}"] or 0.0, prior[f"var_{r}"] or 0.0
        weight = mean * (1 - mean) / var - 1 if var > 0 else prior_weight[1]
        weight = min(max(weight, prior_weight[0]), prior_weight[1])
        out = out.withColumn(f"rate_{r}", (F.col(f"failed_{r}") + mean * weight) / (F.col("n_docs") + weight))
    return out


def rejected_hosts(rates: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The hosts whose shrunk failure rate is too high in some rule."""
    return rates.where(F.greatest(*[F.col(f"rate_{r}") for r in RULES]) >= max_host_rate).select("host")


def mark_rejected(rows: DataFrame, host: str, rejected: DataFrame, marker: str) -> DataFrame:
    """The rows with a boolean that says whether their host is rejected.

    A list of known small size is broadcast.  A longer one is joined by shuffle, with
    each host's rows dealt to many parts, so that a hot host isn't one task's work.
    """
    rejected = written(rejected)
    size = rejected.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
    listed = rejected.select(F.col("host").alias("_host"), F.lit(True).alias(marker))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(listed), F.col(host) == F.col("_host"), "left")
    else:
        salted = listed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64("doc_id", host), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("_salt", part).join(
            salted, (F.col(host) == F.col("_host")) & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
    return joined.drop("_host").withColumn(marker, F.coalesce(F.col(marker), F.lit(False)))


def _judged(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, host, the measures and a boolean per rule."""
    rows = measures(docs.select("doc_id", "text", F.col("source").alias("host"))).drop("text")
    return rows.withColumns(failures())


def quality_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: its measures, base_failed, the host's verdict, kept."""
    judged = written(_judged(docs))
    marked = mark_rejected(judged, "host", rejected_hosts(host_rates(judged), max_host_rate), "host_rejected")
    return marked.select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", F.col("_m.lines.dup").alias("n_dup_lines"),
        "_m.n_repeat_words", F.col("base").alias("base_failed"), "host_rejected",
        (~F.col("base") & ~F.col("host_rejected")).alias("kept"))


def keep_good(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with all their columns.

    Measured once: the documents that pass by themselves are written with their measures' verdicts, of the others only
    what their hosts are judged by.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("_row"), "doc_id", "text", F.col("source").alias("host"))
    judged = measures(rows).withColumns(failures()).select("doc_id", "host", *RULES, F.when(~F.col("base"), F.col("_row")).alias("_row"))
    judged = written(judged)
    passed = judged.where(~F.col("base")).select("_row", "doc_id", "host")
    return mark_rejected(passed, "host", rejected_hosts(host_rates(judged), max_host_rate), "_rejected").where(~F.col("_rejected")).select(
        *[F.col("_row").getField(c).alias(c) for c in columns])
