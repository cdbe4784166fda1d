"""Quality rules for documents, with verdicts on whole hosts.

Each document is measured in one pass inside its row. Failures of each rule are then summed by host,
a host's rate is shrunk towards the corpus's by a beta prior that the hosts themselves give (method of
moments), and the verdicts on the host are joined back to its documents: on the whole host, and on how
strictly each rule is held there. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import join_hubs, let, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A host whose shrunk failure rate of any rule is over this is rejected as a whole.
MAX_RATE = 0.95
#: A host whose shrunk rate of a rule is over so many times the corpus's is strict: its documents that fail the rule go.
STRICT = 1.25
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    n = F.size(words) - 2

    def covered(s: Column) -> Column:
        near = lambda k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
        again = F.filter(s, lambda x, k: near(k - 1, x["h"]) | near(k + 1, x["h"]))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    marks = F.slice(F.transform(words, lambda w, i: F.struct(window(w, i).alias("h"), i.alias("i"))), 1, F.greatest(n, F.lit(0)))
    plain = F.slice(F.transform(words, window), 1, F.greatest(n, F.lit(0)))
    return F.when(n < 2, 0).when(let(plain, lambda t: F.size(F.array_distinct(t)) == F.size(t)), 0).otherwise(let(F.sort_array(marks), covered))


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each whole text (null: empty)."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    bare = _without(text, SPACES)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).cast("long").alias("again")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    got = rows.select(
        "doc_id",
        "host",
        F.char_length(bare).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        counted.alias("w"),
        lined.alias("l"),
    )
    return got.select("doc_id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.again").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE, strict: float = STRICT) -> DataFrame:
    """host, n (documents) and, for each rule, its shrunk failure rate and whether the host is strict on it; rejected if a rate is over ``max_rate``."""
    fails = {f"{name}_n": F.sum(F.expr(rule).cast("long")) for name, rule in RULES.items()}
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(f.alias(k) for k, f in fails.items()))
    total = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"{r}_n").alias(r) for r in RULES), *(F.sum(F.col(f"{r}_n") * F.col(f"{r}_n") / F.col("n")).alias(f"{r}_2") for r in RULES)).first()
    rates, over = {}, {}
    for r in RULES:
        mean = total[r] / total["n"] if total["n"] else 0.0
        spread = total[f"{r}_2"] / total["n"] - mean * mean if total["n"] else 0.0
        weight = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
        rates[r] = (F.col(f"{r}_n") + mean * weight) / (F.col("n") + weight)
        over[r] = rates[r] > strict * mean
    worst = F.greatest(*rates.values(), F.lit(0.0)) > max_rate
    return hosts.select("host", "n", worst.alias("rejected"), *(v.alias(f"{r}_rate") for r, v in rates.items()), *(v.alias(f"{r}_strict") for r, v in over.items()))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the features, base_failed, kept and host_rejected for each document.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail; documents of
    null host share one host. A document that fails the rules short or repeats fails by itself. One that
    fails symbols, dup_lines or word_length goes where the host is strict on that rule, as failures there
    are no accidents; and all of a host go whose shrunk rate of any rule is over ``MAX_RATE``. Repeated
    rows count as often as they are there. Columns other than doc_id, text and the host's are not looked
    at; an empty table gives an empty table.
    """
    measured = materialize(features(docs, host), "quality")
    hosts = materialize(host_verdicts(measured), "hosts")
    failed = F.expr(f"{RULES['short']} or {RULES['repeats']}")
    strict = reduce(lambda a, b: a | b, (F.expr(f"({RULES[r]}) and {r}_strict") for r in RULES if r not in ("short", "repeats")))
    rows = join_hubs(measured, hosts, ["host"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~strict & ~F.col("rejected")).alias("kept"), F.col("rejected").alias("host_rejected"))
