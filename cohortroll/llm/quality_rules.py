"""Quality rules for documents and their hosts, with DataFrame functions only.

Each text is judged by rules of its own. Failures are then added up by host, each host's failure rate is shrunk towards the
rate of all hosts by a beta prior fitted to the hosts' rates, and a host whose shrunk rate is high fails with all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortroll.session import keep

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # percent of words in repeated windows
MAX_HOST_RATE = 0.5  # of a host's documents that fail, after shrinking
FEW_HOSTS = 100_000  # hosts that are sent to every task at most
SALTS = 64
WINDOW = 3
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
NAMES = [*MEASURES, "words", "lines", "windows", "again"]  # of the columns that ``measured`` uses, before the prefix


def measured(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Adds the measures of a text, each under its name with the prefix. A null text counts as one without words."""
    own = {c: f"{prefix}{c}" for c in NAMES}
    col = lambda c: F.col(f"`{own[c]}`")
    whole = F.coalesce(text, F.lit(""))
    df = df.withColumn(own["words"], F.array_remove(F.split(whole, SPACE), ""))
    n = F.size(col("words"))
    # Windows as (hash of three words, place), sorted, so that equal windows are neighbours.
    window = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(F.xxhash64(*[F.element_at(col("words"), i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")))
    empty = F.expr("cast(array() as array<struct<h: bigint, p: int>>)")
    df = df.withColumn(own["windows"], F.when(n >= WINDOW, F.array_sort(window)).otherwise(empty))
    same = lambda x, i: F.get(col("windows"), i).getField("h") == x["h"]
    df = df.withColumn(own["again"], F.filter(
        col("windows"), lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))))
    covered = F.array_distinct(F.flatten(F.transform(col("again"), lambda x: F.sequence(x["p"], x["p"] + (WINDOW - 1)))))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    kept = [c for c in df.columns if c not in (own["words"], own["windows"], own["again"])]
    df = df.withColumn(own["lines"], lines)
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        n.cast("long").alias(own["n_words"]),
        F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias(own["word_chars"]),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias(own["n_symbols"]),
        (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long").alias(own["n_dup_lines"]),
        F.size(covered).cast("long").alias(own["n_repeat_words"]))


def failed(prefix: str = "") -> Column:
    """The base rule: too few words, or most of them in windows that the text repeats."""
    n, again = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < MIN_WORDS) | (100 * again > MAX_REPEAT_SHARE * n)


def host_verdicts(rows: DataFrame, host: str, failed_column: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n, n_failed, rate, host_failed`` for each host; rows without a host form none.

    The prior's mean is the share of all rows that fail; its weight comes from the variance of the hosts' rates beyond
    that of chance (method of moments). Hosts that differ no more than by chance get the mean itself.
    """
    counts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(F.col(failed_column).cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n")
    total = counts.agg(
        (F.sum("n_failed") / F.sum("n")).alias("mean"), F.count("*").alias("hosts"), F.sum("n").alias("rows"),
        F.sum(F.col("n") * share * share).alias("squares"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    mean, hosts, n = F.col("mean"), F.col("hosts"), F.col("rows")
    spread = F.col("squares") - n * mean * mean  # between hosts, weighted by rows
    among = mean * (1 - mean)
    size = n - F.col("n2") / n - (hosts - 1)
    rho = F.when((hosts > 1) & (among > 0) & (size > 0), (spread - (hosts - 1) * among) / (among * size)).otherwise(0.0)
    bounded = F.greatest(F.least(rho, F.lit(0.999)), F.lit(1e-6))
    prior = total.select(mean.alias("mean"), ((1 - bounded) / bounded).alias("weight"))
    # One row: two scalar subqueries, no join.
    scalar = lambda c: prior.select(c).scalar()
    rate = (F.col("n_failed") + scalar("mean") * scalar("weight")) / (F.col("n") + scalar("weight"))
    return counts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") > max_rate)


def join_hosts(rows: DataFrame, host: str, hosts: DataFrame, key: str, how: str, few: int = FEW_HOSTS) -> DataFrame:
    """``rows`` joined ("left" or "left_anti") with host rows that are distinct in ``key``, without dealing rows out by host.

    A host may hold a third of all rows. The host rows are counted: few are sent to every task; more are repeated for each
    of ``SALTS`` salts and rows are dealt out by host and salt. Null hosts match nothing.
    """
    hosts = keep(hosts, "hosts")
    if hosts.count() <= few:
        return rows.join(F.broadcast(hosts), F.col(host) == F.col(key), how)
    salts = hosts.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return salted.join(salts, (F.col(host) == F.col(key)) & (F.col("__salt") == F.col("__of")), how).drop("__salt", "__of")


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``host_failed`` and ``kept``; one row per input row.

    Measures are computed once and written, without texts, to the shared folder; hosts and rows are joined from there. A
    null text has no words and fails; a null host never fails. Other columns aren't read. An empty table gives no rows.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("text"))
    own = keep(measured(rows, F.col("text")).drop("text").withColumn("base_failed", failed()), "quality")
    bad = host_verdicts(own, "host", "base_failed", max_rate).where("host_failed").select(F.col("host").alias("h"), "host_failed")
    return join_hosts(own, "host", bad, "h", "left").select(
        "doc_id", *MEASURES, "base_failed", F.coalesce("host_failed", F.lit(False)).alias("host_failed"),
        (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"))
