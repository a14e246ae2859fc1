"""Host-level quality rules (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import SPACE, free_names, staged

#: Base rules: fewest words, most repeated words in a hundred.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Further rules, for hosts only: characters a word, symbols and duplicate lines in a hundred words.
WORD_CHARS, MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT = (2, 15), 10, 5
#: A host is rejected when a rule's rate is above this share with so many standard deviations to spare.
MAX_HOST_RATE, DEVIATIONS = 0.5, 2.0
#: Documents that the prior may be worth.
MAX_PRIOR = 1000.0
#: Hosts are broadcast up to this many; a row is a name and a flag.
BROADCAST_HOSTS = 200_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the array holds at least twice; null if there are none."""
    window = lambda i: F.slice(words, i, WINDOW)
    hashes = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(window(i))))

    def places(ordered):
        """Where windows begin of which there are several: a neighbour in order has the same words."""
        same = lambda x, k: F.coalesce((F.get(ordered, k)["h"] == x["h"]) & (F.get(ordered, k)["w"] == x["w"]), F.lit(False))
        found = F.transform(ordered, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.array_sort(F.filter(found, lambda i: i.isNotNull()))

    # each repeated window adds the words up to the next one's start, the window's length at most
    covered = lambda starts: F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + (i + WINDOW) - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    in_order = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), window(i + 1).alias("w"), i.alias("i"))))
    # no repeated hash, no sort
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(_let(in_order(h), places))))


def base_rules(text: Column) -> Column:
    """A struct of ``COUNTS`` and base_failed, in one expression.

    Words are runs of characters other than space and U+0009..U+000D; a null
    text has none.  n_repeat_words counts words inside 8-word windows that the
    text holds at least twice, the first occurrence included.  Windows are
    sorted by a hash and then by their words, which decide, so a long text costs
    n log n; texts in which no hash repeats skip the sort.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def judged(words):
        n = F.size(words).cast("long")
        failed = lambda r: (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
        rest = {
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
        return _let(
            F.coalesce(_repeated_words(words), F.lit(0).cast("long")),
            lambda r: F.struct(n.alias("n_words"), *[c.alias(k) for k, c in rest.items()], r.alias("n_repeat_words"), failed(r).alias("base_failed")),
        )

    return _let(F.filter(F.split(text, SPACE), lambda w: w != ""), judged)


def host_rules(base: Column) -> dict[str, Column]:
    """The rules that a host's documents are held to, as failures of one document; ``base`` is the struct of :func:`base_rules`."""
    n = base["n_words"]
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * n,
        "word_length": (base["word_chars"] < WORD_CHARS[0] * n) | (base["word_chars"] > WORD_CHARS[1] * n),
        "symbols": 100 * base["n_symbols"] > MAX_SYMBOL_PERCENT * n,
        "lines": 100 * base["n_dup_lines"] > MAX_LINE_PERCENT * n,
    }


def host_verdicts(rows: DataFrame, rules: list[str], host_col: str = "host", max_rate: float = MAX_HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per host (null is a host): host, n, rates (rule to shrunken rate), failed_rules, host_rejected.

    ``rows`` has a boolean column for each of the rules.  A rule's failures are
    summed per host; its rate is (failed + a) / (n + a + b), with a beta prior
    a, b fitted by moments to the raw rates of all hosts, of whose variance the
    part that chance explains is taken off.  The prior is worth one document if
    there is one host, and ``MAX_PRIOR`` if hosts differ no more than by chance.
    A host fails a rule if its rate less ``deviations`` standard deviations of
    the posterior is above ``max_rate``: few documents leave a wide margin and
    a strong pull to the mean, so that a small unlucky host stays.
    """
    sums = [F.sum(F.col(r).cast("long")).alias(f"f_{r}") for r in rules]
    hosts = staged(rows.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    # the driver sees three numbers a rule
    raw = [F.col(f"f_{r}") / F.col("n") for r in rules]
    seen = hosts.agg(F.avg(1 / F.col("n")), *[f(x) for x in raw for f in (F.avg, F.var_samp)]).first()
    rates, failed = [], []
    for i, r in enumerate(rules):
        m, v = seen[1 + 2 * i] or 0.0, seen[2 + 2 * i]
        between = None if v is None else v - m * (1 - m) * seen[0]
        # moments of a beta: a + b = m (1 - m) / v - 1
        weight = 1.0 if between is None else min(max(m * (1 - m) / between - 1, 1.0), MAX_PRIOR) if between > 0 else MAX_PRIOR
        rate = (F.col(f"f_{r}") + m * weight) / (F.col("n") + weight)
        rates.append(rate.alias(r))
        margin = deviations * F.sqrt(rate * (1 - rate) / (F.col("n") + weight + 1))
        failed.append(F.when(rate - margin > max_rate, F.lit(r)))
    out = hosts.select("host", "n", F.struct(*rates).alias("rates"), F.array_compact(F.array(*failed)).alias("failed_rules"))
    return out.withColumn("host_rejected", F.size("failed_rules") > 0)


def _few(hosts: DataFrame) -> DataFrame:
    """Broadcast if counted to be few; else Spark shuffles, and splits the skewed host's rows at run time."""
    return F.broadcast(hosts) if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else hosts


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, the base counts, base_failed, host_failed_rules, host_rejected, kept.

    The base counts are made once and staged; only numbers and the host's name
    travel.  Rule failures are summed per host before any shuffle, so a host with
    a third of all rows costs a row per task.  The hosts' verdicts come back by
    broadcast when they are counted to be few.

    A null or empty text has no words and fails; a very long one costs n log n;
    rows that repeat count each; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), base_rules(F.col(text_col)).alias("b"))
    rules = host_rules(F.col("b"))
    base = staged(rows.select("id", "host", "b.*", *[c.alias(f"r_{k}") for k, c in rules.items()]), "quality")
    flags = base.select("host", *[F.col(f"r_{k}").alias(k) for k in rules])
    hosts = host_verdicts(flags, list(rules)).select(F.col("host").alias("_host"), F.array_join("failed_rules", ",").alias("host_failed_rules"), "host_rejected")
    rows = base.join(_few(hosts), F.col("host").eqNullSafe(F.col("_host")), "left")
    return rows.select(F.col("id").alias(id_col), "host", *COUNTS, "base_failed", "host_failed_rules", "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def drop_poor(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs``, all rows and columns, without those that fail the base rules or whose host is rejected.

    Texts are judged once for the hosts' sums and once more for the rows
    themselves, so that no copy of the texts is kept.  Null and empty texts go;
    a null host is a host; rows that repeat are judged alike; the columns keep
    their names and values, whatever they are; an empty table gives no rows.
    """
    host, base = free_names(docs, "host", "base")
    rules = host_rules(F.col("b"))
    flags = docs.select(F.col(host_col).alias("host"), base_rules(F.col(text_col)).alias("b")).select("host", *[c.alias(k) for k, c in rules.items()])
    bad = host_verdicts(flags, list(rules)).where("host_rejected").select(F.col("host").alias(host))
    good = docs.withColumn(base, base_rules(F.col(text_col))["base_failed"]).where(~F.col(base)).drop(base)
    if not bad.isEmpty():
        good = good.join(_few(bad), good[host_col].eqNullSafe(F.col(host)), "left_anti")
    return good
