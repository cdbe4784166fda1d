"""Line de-duplication: later copies of repeated runs of lines are deleted.

The corpus is a sequence of line ids for each document (lines without a word are passed over). A
suffix array's equivalence classes are built by prefix doubling: the class of the first 2**(j+1)
lines of a suffix is the pair of the classes of its first 2**j lines and of the 2**j after them, and
is named by the place where it first occurs. Suffixes whose class is unique drop out. Two classes
of a power of two cover a run of any length between, so they decide for each of a line's minimal
runs whether its longest common prefix with an earlier suffix reaches that far; the union of these
runs is that of the maximal repeated runs. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import discard, join_hubs, let, materialize, quoted

SPACES = " \t\n\x0b\f\r"
#: A repeated run counts from so many words on.
MIN_WORDS = 10


def _reach(words: Column, k: Column, step: int, least: int) -> Column:
    """Lines from line k on (backwards for -1) until they have ``least`` words; null if there aren't as many."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))

    def add(a, i):
        more = a["sum"] < least
        at = k + step * i
        value = F.when(at >= 0, F.coalesce(F.get(words, at), F.lit(0))).otherwise(0)
        return F.struct(F.when(more, i + 1).otherwise(a["n"]).alias("n"), F.when(more, a["sum"] + value).otherwise(a["sum"]).alias("sum"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(least - 1)), start, add, lambda a: F.when(a["sum"] >= least, a["n"]))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """doc, k (its place among the document's lines with a word), no, a and b (128 bits of hash), ahead, back."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    kept = F.filter(numbered, lambda x: F.btrim(x["line"], F.lit(SPACES)) != "")
    count = lambda line: F.least(F.lit(least), F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+", least + 2), lambda w: w != "")))

    def rows(lines: Column) -> Column:
        return let(
            F.transform(lines, lambda x: count(x["line"])),
            lambda words: F.transform(
                lines,
                lambda x, k: F.struct(
                    k.alias("k"), x["no"].alias("no"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(7), x["line"]).alias("b"),
                    F.when(F.get(words, k) >= least, 1).otherwise(_reach(words, k, 1, least)).alias("ahead"),
                    F.when(F.get(words, k) >= least, 1).otherwise(_reach(words, k, -1, least)).alias("back"),
                ),
            ),
        )

    return docs.where("doc_id is not null").select(_document(), F.explode(let(kept, rows)).alias("x")).select("doc", "x.*")


def _document() -> Column:
    """What tells documents apart and orders them: the doc_id, then the text (so repeated rows are one document)."""
    return F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at two places or more, with ``first``: the smallest (doc, k) that has them."""
    place = F.struct("doc", "k")
    first = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    return join_hubs(rows, materialize(first.drop("last"), "first"), keys)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, no: the lines that lie in a run of consecutive lines, of ``min_words`` words or more, that also starts earlier."""
    rows = materialize(_lines(docs, min_words), "lines")
    levels = [materialize(_named(rows, ["a", "b"]).select("doc", "k", "no", "ahead", "back", "first").distinct(), "lines")]
    discard(rows)
    while 1 << len(levels) <= min_words:
        beside = Window.partitionBy("doc").orderBy("k").rangeBetween(1 << (len(levels) - 1), 1 << (len(levels) - 1))
        pairs = levels[-1].select("doc", "k", "first", F.first("first").over(beside).alias("second")).where("second is not null")
        pairs = materialize(pairs.withColumnRenamed("first", "one"), "pairs")
        levels.append(materialize(_named(pairs, ["one", "second"]).select("doc", "k", "first"), "lines"))
        discard(pairs)

    later = F.col("first") != F.struct("doc", "k")
    single = levels[0].where((F.col("ahead") == 1) & later).select("doc", "k", F.col("k").alias("last"))
    ahead = levels[0].select("doc", "k", F.col("ahead").alias("n"))
    back = levels[0].select("doc", (F.col("k") - F.col("back") + 1).alias("k"), F.col("back").alias("n"))
    runs = ahead.unionByName(back).where("n > 1").distinct().withColumn("j", F.floor(F.log2("n")).cast("int"))
    ranks = None
    for j, level in enumerate(levels):
        own = level.select("doc", "k", F.col("first").alias("rank"), F.lit(j).alias("j"))
        ranks = own if ranks is None else ranks.unionByName(own)
    tail = (F.col("k") + F.col("n") - F.expr("shiftleft(1, j)")).cast("int")
    runs = runs.join(ranks.withColumnRenamed("rank", "one"), ["doc", "k", "j"])
    runs = runs.withColumn("tail", tail).join(ranks.select("doc", F.col("k").alias("tail"), "j", F.col("rank").alias("two")), ["doc", "tail", "j"])
    runs = materialize(runs.select("doc", "k", F.col("n").alias("size"), "one", "two"), "runs")
    longer = _named(runs, ["size", "one", "two"]).where(later).select("doc", "k", (F.col("k") + F.col("size") - 1).alias("last"))
    covered = single.unionByName(longer).select("doc", F.explode(F.sequence("k", "last")).alias("k")).distinct()
    return covered.join(levels[0].select("doc", "k", "no"), ["doc", "k"]).select("doc", "no")


def _deleted(docs: DataFrame, min_words: int) -> DataFrame:
    """row (all columns as they were), text without later copies, n (lines deleted)."""
    gone = repeated_lines(docs.select("doc_id", "text"), min_words)
    places = gone.groupBy("doc").agg(F.array_sort(F.collect_list("no")).alias("p"))
    marks = F.array_join(F.transform("p", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i == 0, -1).otherwise(F.get("p", i - 1)) - 1), F.lit("1"))), "")
    marks = places.select("doc", marks.cast("binary").alias("marks"), F.size("p").cast("long").alias("n"))
    rows = docs.select(_document(), F.struct(*map(quoted, docs.columns)).alias("row"))
    keep = lambda x, i: F.substring("marks", i + 1, F.lit(1)) != F.lit(b"1")
    text = F.when(F.col("marks").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), keep), "\n"))
    return rows.join(marks, "doc", "left").select("row", text.alias("text"), F.coalesce("n", F.lit(0)).alias("n"))


def delete_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs of lines; all columns, and n_deleted after them.

    Lines are split at \\n and compared whole; order is that of doc_id (integers), then of a hash of the
    text, then of the line. Repeated rows are one document, so they lose the same lines and keep what is
    nowhere else; rows of one doc_id with different texts are documents of their own. A run is of
    consecutive lines, lines without a word not counted (these stay); it counts from ``min_words`` words
    on and may overlap its copy. Null texts stay null, a text that loses all its lines is empty. Rows of
    null doc_id stay as they are. A column n_deleted of the input is replaced; other names don't matter.
    An empty table gives an empty table.
    """
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "n_deleted"]
    return _deleted(docs, min_words).select(*columns, F.col("n").alias("n_deleted"))


def delete_in_place(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same with the columns of ``docs``; n_chars, if there, is that of the new text where lines went."""
    chars = F.when(F.col("n") > 0, F.char_length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": chars}
    return _deleted(docs, min_words).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
