"""Later repeated runs of lines, by winnowing over line hashes.

A line here ends with a newline or with a sentence (".", "!" or "?" and a space), so a passage is
also found where it continues a longer line. A shortest run has min_words or more, and fewer without
its last line (the one that begins at its first line) or without its first (one that ends at its
last line).

1. Winnowing: each shortest run from a line on is a window, and the least line hash in it is its
   fingerprint. Neighbouring windows mostly select the same one, so a text has few; equal runs select
   equal ones, so a repeated run of min_words or more has one that occurs at least twice.
2. Positions are joined by fingerprint: only windows whose fingerprint occurs elsewhere go on, as the
   hashes of whole shortest runs, and of those each occurrence but the first is a match. A window is
   compared by its own lines alone, so the first occurrence of its fingerprint need not be the one
   that holds the run.
3. Matches are extended: shortest runs that touch or overlap make one run. Those that begin at its
   lines, as long as they fit, reach from its first line to near its end, and the one that ends at its
   last line covers the rest. So a line goes if, and only if, a shortest run that holds it has
   occurred before (by doc_id, then the text's hash, then position); the first occurrence stays.

DataFrame functions only. A group of copies costs one row for each copy's run, not for each pair.

Defined results: null, empty and blank texts stay as they are; words are counted by spaces; a shortest
run begins and ends with a line that has words and may hold any number of lines without (they go with
it, those at its edges stay); the order
is by doc_id, nulls first, and of rows that share a doc_id by the text's hash; rows with the same
doc_id and text count as one row (rows without an id too); all other columns are kept, n_chars (if
there) follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgelens.llm.tables import cut

_LEAST, _BLANK = -(1 << 63), (1 << 63) - 1
_LINE_END, _MARK = r"(?<=\n)|(?<=[.!?] )", "\uffff"


def _lines(text: Column) -> Column:
    """Pieces that give the text again when joined. A mark behind each line's end is cheaper than the pattern, which texts get that have the mark already."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, _LINE_END, -1)).otherwise(F.split(marked, _MARK, -1))


def _bare(text: Column) -> Column:
    """Without what ends a line, so that a sentence is the same before a newline and before another."""
    return F.trim(text, F.lit(" \n"))


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _start(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _end(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _slice(lines: str, start: Column, end: Column) -> Column:
    return F.slice(lines, start + 1, end - start + 1)


def _hashed(docs: DataFrame) -> DataFrame:
    """doc, the text's hash h, line hashes hs and words of each line ws."""
    text = F.col("text").cast("string")
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc"), F.xxhash64(text).alias("h"), F.transform(_lines(text), _bare).alias("lines"))
    words = F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1))
    return slim.select("doc", "h", F.transform("lines", lambda x: F.when(x == "", _BLANK).otherwise(F.xxhash64(x))).alias("hs"), words.alias("ws"))


def _winnowed(hashed: DataFrame, min_words: int) -> DataFrame:
    """doc, h, hs, the codes (first and last line) of the shortest run from each line on, and picks: the fingerprints f that runs select, each with the codes (lo to hi) that select it and whether it repeats among their lines.

    Arrays are referred to more than once in each step, so that no step is repeated for each element
    of the next.
    """
    of = hashed.withColumn("of", F.flatten(F.transform("ws", lambda w, i: F.array_repeat(i, w)))).filter(F.size("of") >= min_words)  # each word's line
    first = lambda t: (t == 0) | (F.get("of", t) != F.get("of", t - 1))
    fits = of.withColumn("at", F.filter(_upto(F.size("of") - (min_words - 1)), first))  # first words of lines
    code = lambda t: F.shiftleft(F.get("of", t).cast("long"), 32).bitwiseOR(F.get("of", t + (min_words - 1)).cast("long"))
    runs = fits.select("doc", "h", "hs", F.transform("at", code).alias("codes"))
    least = runs.withColumn("fs", F.transform("codes", lambda c: F.array_min(_slice("hs", _start(c), _end(c)))))
    lows = least.withColumn("lows", F.filter(_upto(F.size("fs")), lambda i: (i == 0) | (F.get("fs", i) != F.get("fs", i - 1))))

    def pick(lo: Column, i: Column) -> Column:
        hi = F.coalesce(F.get("lows", i + 1), F.size("fs")) - 1
        again = F.size(F.filter(_slice("hs", _start(F.get("codes", lo)), _end(F.get("codes", hi))), lambda x: x == F.get("fs", lo))) > 1
        return F.struct(F.get("fs", lo).alias("f"), lo.alias("lo"), hi.alias("hi"), again.alias("again"))

    return lows.select("doc", "h", "hs", "codes", F.transform("lows", pick).alias("picks"))


def _candidates(winnowed: DataFrame) -> DataFrame:
    """doc, h, the hash f and the lines (start, end) of each shortest run whose fingerprint occurs elsewhere too.

    Of the runs from a line on, those are shortest that end before the shortest run from the next
    line does (and the shortest of all).
    """
    picks = winnowed.select("doc", "h", F.inline("picks"))
    shared = cut(picks.groupBy("f").agg(F.count("*").alias("c"), F.max("again").alias("again")).filter("c > 1 or again").select("f"))
    ranges = picks.join(shared, "f").groupBy("doc", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    of = F.flatten(F.transform("ranges", lambda r: F.sequence(r["lo"], r["hi"])))
    found = winnowed.select("doc", "h", "hs", "codes").join(ranges, ["doc", "h"]).withColumn("of", of)

    def runs(i: Column) -> Column:
        start, end = _start(F.get("codes", i)), _end(F.get("codes", i))
        last = F.coalesce(_end(F.get("codes", i + 1)), F.size("hs")) - 1
        ends = F.when(last > end, F.filter(F.sequence(end, last), lambda j: F.get("hs", j) != _BLANK)).otherwise(F.array(end))
        return F.transform(ends, lambda j: F.struct(F.xxhash64(_slice("hs", start, j)).alias("f"), start.alias("start"), j.alias("end")))

    return found.select("doc", "h", F.inline(F.flatten(F.transform("of", runs))))


def _merged(found: DataFrame) -> DataFrame:
    """doc, h and the runs (start, end) that the given ones make together, where they touch or overlap."""
    lines = F.sort_array(F.array_distinct(F.flatten(F.transform("all", lambda r: F.sequence(r["start"], r["end"])))))
    gone = found.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "end")).alias("all")).select("doc", "h", lines.alias("g"))
    edge = lambda step: F.filter("g", lambda x, i: F.coalesce(F.when(i + step >= 0, F.get("g", i + step)) != x + step, F.lit(True)))
    return gone.select("doc", "h", F.arrays_zip(edge(-1).alias("start"), edge(1).alias("end")).alias("runs"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc, h and the runs (start, end) of its lines that repeat earlier ones."""
    windows = cut(_candidates(cut(_winnowed(cut(_hashed(docs)), min_words))))
    known = cut(windows.groupBy("f").agg(F.min("doc").alias("source"), F.count("*").alias("c")).filter("c > 1").select("f", "source"))
    shared = cut(windows.join(known, "f"))
    own = shared.filter("doc = source").select("f", "doc", "h", "start", "end")
    first = cut(own.groupBy("f").agg(F.min(F.struct("h", "start")).alias("first"), F.count("*").alias("c")).filter("c > 1").select("f", "first"))
    own = own.join(first, "f").filter(F.struct("h", "start") > F.col("first"))
    return _merged(shared.filter("doc <> source").select("doc", "h", "start", "end").unionByName(own.select("doc", "h", "start", "end")))


def drop_repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents with their columns, without the lines of later repeated runs; lines_dropped says how many went."""
    found = cut(repeated_runs(docs, min_words)).hint("merge")  # they grow with the documents
    given = docs["text"].cast("string")
    joined = docs.join(found, (F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)) == found["doc"]) & (F.xxhash64(given) == found["h"]), "left")
    runs, lines = found["runs"], _lines(given)
    left = F.filter(lines, lambda x, i: ~F.exists(runs, lambda r: (r["start"] <= i) & (i <= r["end"])))
    text = F.when(runs.isNull(), docs["text"]).otherwise(F.array_join(left, ""))
    dropped = F.when(runs.isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long")
    changed = {"text": text, "n_chars": F.when(runs.isNull(), docs["n_chars"]).otherwise(F.length(text)).cast("long") if "n_chars" in docs.columns else None}
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns if c != "lines_dropped"], dropped.alias("lines_dropped"))


def without_emptied(deduplicated: DataFrame) -> DataFrame:
    """Documents of which something is left, or of which nothing went."""
    return deduplicated.filter((F.col("lines_dropped") == 0) | (_bare(F.col("text")) != "")).drop("lines_dropped")
