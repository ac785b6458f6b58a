"""Quality rules per document, judged again per host (native DataFrame functions only)."""
from pyspark.sql import functions as F

from headwise.llm.common import fields, space_words, write_and_read

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Failures that weigh by the host only: symbols and repeated lines in per cent of words and lines, letters per word.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTHS = (2, 10)
#: Rules of which the failures are summed per host.
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
#: Standard deviations by which a host's posterior rate must be above a limit.
SURE = 3.0
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1000.0)

_SHIFT = 1 << 32


def rule_counts(docs):
    """Count what the rules look at; every document keeps one row.

    Null and empty text have no words, hence zero counts. Repeated three-word
    windows are found by sorting the windows of a document and comparing
    neighbours, so a long text costs n log n and nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "")
    base = docs.select(
        "*", space_words(F.col("text")).alias("_words"), lines.alias("_lines"),
        F.char_length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_m": F.greatest(F.size("_words") - 2, F.lit(0)),
    })
    sorted_windows = base.withColumn("_s", F.sort_array(F.arrays_zip(
        F.slice("_words", 1, F.col("_m")).alias("a"), F.slice("_words", 2, F.col("_m")).alias("b"),
        F.slice("_words", 3, F.col("_m")).alias("c"),
        F.slice(F.sequence(F.lit(1), F.col("_m") + 1), 1, F.col("_m")).alias("i"),
    ))).drop("_words", "_lines")
    # A window equal to its successor gives both starts packed in one number, any other gives 0.
    twins = sorted_windows.withColumn("_p", F.array_remove(F.zip_with(
        "_s", F.slice("_s", 2, F.greatest("_m", F.lit(1))),
        lambda x, y: F.when((x.c == y.c) & (x.b == y.b) & (x.a == y.a), x.i * F.lit(_SHIFT) + y.i).otherwise(F.lit(0)),
    ), F.lit(0).cast("long"))).drop("_s")
    starts = twins.withColumn("_r", F.sort_array(F.array_distinct(F.flatten(F.transform(
        "_p", lambda v: F.array(F.shiftright(v, 32), v % F.lit(_SHIFT)),
    ))))).drop("_p", "_m")
    covered = F.aggregate(
        F.zip_with("_r", F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1))),
                   lambda x, y: F.least(F.lit(3).cast("long"), F.coalesce(y - x, F.lit(3).cast("long")))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    counted = starts.withColumn("n_repeat_words", covered).drop("_r")
    return counted.withColumns(failures()).withColumn("base_failed", F.col("short_failed") | F.col("repeats_failed"))


def failures():
    """Whether a document fails each rule, by its counts; one without words fails no other rule than ``short``."""
    words, (least, most) = F.col("n_words"), WORD_LENGTHS
    return {
        "short_failed": words < MIN_WORDS,
        "repeats_failed": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words,
        "symbols_failed": (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * words) & (words > 0),
        "dup_lines_failed": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length_failed": (F.col("word_chars") < least * words) | (F.col("word_chars") > most * words),
    }


def _prior(total, rule):
    """Mean and weight of a rule's beta prior by the method of moments over all hosts."""
    if not total["n"]:
        return 0.0, PRIOR_WEIGHT[1]
    mean = total[f"{rule}_bad"] / total["n"]
    within = mean * (1 - mean)
    between = total[f"{rule}_square"] - total[f"{rule}_mean"] ** 2 - within * total["noise"]
    weight = within / between - 1 if between > 0 else PRIOR_WEIGHT[1]
    return mean, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def host_verdicts(judged, sure=SURE):
    """One row per host: host_docs, and per rule the shrunken rate and ``<rule>_high``; host_failed.

    Each rule has a beta prior of its own, whose mean is the rate of the corpus and whose weight comes from how
    much more the hosts' rates differ than chance makes them; alike hosts are drawn to the corpus rate. A rule is
    high on a host when its posterior rate less ``sure`` deviations is above the corpus rate, and the host fails
    as a whole when that is above the middle between the corpus rate and all of its documents. A null host is a
    host of its own.
    """
    hosts = write_and_read(judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), *[F.count_if(f"{r}_failed").alias(f"{r}_bad") for r in RULES]), "hosts")
    rates = {r: F.col(f"{r}_bad") / F.col("host_docs") for r in RULES}
    total = hosts.agg(
        F.sum("host_docs").alias("n"), F.avg(1 / F.col("host_docs")).alias("noise"),
        *[F.sum(f"{r}_bad").alias(f"{r}_bad") for r in RULES], *[F.avg(x).alias(f"{r}_mean") for r, x in rates.items()],
        *[F.avg(x * x).alias(f"{r}_square") for r, x in rates.items()]).first()
    columns, whole = {}, F.lit(False)
    for rule in RULES:
        mean, weight = _prior(total, rule)
        rows = F.col("host_docs") + F.lit(weight)
        rate = (F.col(f"{rule}_bad") + F.lit(mean * weight)) / rows
        surely = rate - F.lit(sure) * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (rows + 1))
        columns |= {f"{rule}_rate": rate, f"{rule}_high": surely > F.lit(mean)}
        whole = whole | (surely > F.lit((1 + mean) / 2))
    return hosts.select("host", "host_docs", *[c.alias(n) for n, c in columns.items()], whole.alias("host_failed"))


def host_quality(docs, host="source", sure=SURE):
    """Judge documents by their own counts and by the record of their host.

    A document goes if it fails a base rule (too short, repeated windows), if it fails a rule that its host fails
    more often than the corpus does, or if its host fails as a whole. Returns doc_id, host, the counts and failures,
    base_failed, the host's columns and kept. Repeated rows are judged and returned one by one; null texts have no
    words; an empty table gives an empty result. The counts are written once, so both the sums per host and the
    join back read a slim table.
    """
    slim = fields(docs, "doc_id", "text", host).toDF("doc_id", "text", "host")
    judged = write_and_read(rule_counts(slim).drop("text"), "quality")
    hosts = host_verdicts(judged, sure)
    joined = judged.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left")
    by_host = F.col("host_failed")
    for rule in RULES:
        by_host = by_host | (F.col(f"{rule}_failed") & F.col(f"{rule}_high"))
    return joined.drop("_host").withColumn("kept", ~(F.col("base_failed") | by_host))
