"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

A line is the sequence of its words, parted by blanks. It is a duplicate if an earlier line has
the same words or, within the bound of one edit, nearly the same ones. An edit inserts, deletes
or replaces one unit. Units are words where both lines have ``MIN_WORDS`` words at least, and
characters (of the words, joined by single blanks) where both have fewer words and ``MIN_CHARS``
characters at least; still shorter lines are compared as they are. Earlier means a smaller
(doc_id, line number, row), a null doc_id first; the row key, written once with the documents,
tells apart rows that agree in doc_id. A line without words is never a duplicate.

Each line emits the hashes of itself and of itself without each one of its units. Two lines that
differ in one unit share the variant without it, at the same place; of two lines one insertion
apart, one is a variant of the other. So what a line needs is the earliest line behind each of
its variants, which is an aggregate: pairs are never made, and a variant that a third of all
lines share sends one row a task. The edit distance to the witness is verified on the units.

Hashes of variants come from running sums (exclusive or) over a line's units, so a line costs
its length and not the square of it. Two lines one edit apart agree in their first or their last
half, counted by the shorter one; only lines that share such a half with other lines emit
variants, and these halves, too, are met in aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ROW, restored, with_rows
from tessera.session import Tables

#: One edit changes a tenth of the words, or a twentieth of the characters, of a line at most.
MIN_WORDS, MIN_CHARS = 10, 20
#: Most row keys that are broadcast, some 16 MB; beyond, a join shuffles.
BROADCAST = 1 << 20
#: Blanks other than the space; a line ends at a newline.
OTHER_BLANKS = "\t\x0b\x0c\r"

ID = ["h1", "h2"]
HALVES = ["f1", "l1", "f2", "l2"]


def lines_of(docs: DataFrame) -> DataFrame:
    """Row key, doc_id, line_no (from 0) and line (its words joined by single blanks) of each line with words of keyed documents; a null text has no line."""
    text = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), OTHER_BLANKS, F.col("text"))
    lines = docs.select(ROW, F.col("doc_id").cast("long"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    trimmed = lines.select(ROW, "doc_id", "line_no", F.trim("raw").alias("raw")).where("raw != ''")
    return trimmed.select(ROW, "doc_id", "line_no", F.when(F.contains("raw", F.lit("  ")), F.regexp_replace("raw", " +", " ")).otherwise(F.col("raw")).alias("line"))


def _hash(seed: int, *parts: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _counted(lines: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """``lines`` with by_word (whether words are the units) and n (units), null where no edit is allowed."""
    words = lines.withColumn("k", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    sized = words.withColumn("c", F.when(F.col("k") < min_words, F.char_length("line")))
    return sized.withColumns({"by_word": F.col("k") >= min_words, "n": F.when(F.col("k") >= min_words, F.col("k")).when(F.col("c") >= min_chars, F.col("c"))}).drop("k", "c")


def line_keys(docs: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """Lines with words, narrow: row key, doc_id, line_no, h1 and h2 (their identity), and the hashes of their halves, null where there are none."""
    lines = _counted(lines_of(docs), min_words, min_chars)
    lines = lines.withColumns({"short": F.floor(F.col("n") / 2).cast("int"), "long": F.floor((F.col("n") - 1) / 2).cast("int")})

    def half(seed: int, size: str) -> Column:
        words = F.call_function("substring_index", F.col("line"), F.lit(" "), F.col(size) if seed == 0 else -F.col(size))
        chars = F.substring("line", F.lit(1), F.col(size)) if seed == 0 else F.substring("line", F.col("n") - F.col(size) + 1, F.col(size))
        return _hash(seed, "by_word", size, F.when(F.col("by_word"), words).otherwise(chars))

    halves = [F.when(F.col("n").isNotNull(), half(s, "short")) for s in (0, 1)] + [F.when(F.col("long") < F.col("short"), half(s, "long")) for s in (0, 1)]
    return lines.select(ROW, "doc_id", "line_no", _hash(2, "line").alias("h1"), _hash(3, "line").alias("h2"), *(h.alias(k) for h, k in zip(halves, HALVES)))


def marked_lines(t: Tables, docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All lines with words of keyed documents: row key, doc_id, line_no, w: the place (doc_id, line_no, row) of what a duplicate repeats, else null.

    The witness is the earliest equal line or, for the first line of its words, the earliest
    line one edit away. Other columns are ignored.
    """
    keyed = t.write("keys", line_keys(docs, min_words, min_chars))
    place = F.struct("doc_id", "line_no", ROW)
    texts = t.write("texts", keyed.groupBy(*ID).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.any_value(k).alias(k) for k in HALVES)))
    near = t.write("near", _near(t, docs, texts, min_words, min_chars))
    found = t.write("found", texts.where("copies > 1").select(*ID, "first").join(near, ID, "full_outer"))
    t.drop("texts", "near", "words", "variants", "least")
    # AQE splits the side of the lines where one text has very many.
    known = F.when(place > F.col("first"), F.col("first")).otherwise(F.col("near"))
    return keyed.select(ROW, "doc_id", "line_no", *ID).join(found, ID, "left").select(ROW, "doc_id", "line_no", known.alias("w"))


def _near(t: Tables, docs: DataFrame, texts: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """h1, h2 and ``near``, the earliest line one edit away that stands before the text's own first one."""
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST else df
    halves = texts.where("f1 IS NOT NULL").select(*ID, F.explode(F.array(*HALVES)).alias("half")).where("half IS NOT NULL")
    shared, (n, _) = t.measured("halves", halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("half"), "half")
    suspects, (n, _) = t.measured("suspects", halves.join(small(shared, n), "half", "left_semi").select(*ID).distinct(), *ID)
    spots, (n, _) = t.measured("spots", texts.join(small(suspects, n), ID, "left_semi").select(*ID, "first", F.col(f"first.{ROW}").alias(ROW), F.col("first.line_no").alias("line_no")), *ID)
    # Their units, from the place where each stands first. Their documents are few beside all;
    # up to BROADCAST keys they are sent to the documents, which then don't move.
    ids, (n_ids, _) = t.measured("documents", spots.select(ROW).distinct(), ROW)
    lines = _counted(lines_of(docs.join(small(ids, n_ids), ROW, "left_semi")), min_words, min_chars)
    told = lines.drop("doc_id").join(small(spots, n), [ROW, "line_no"]).select(*ID, "first", "by_word", F.when(F.col("by_word"), F.split("line", " ")).otherwise(F.split("line", "")).alias("units"))
    told = t.write("words", told.withColumn("n", F.size("units")))
    t.drop("halves", "suspects", "spots", "documents")

    at = told.select(*ID, "first", "by_word", "n", F.posexplode("units").alias("at", "unit"))
    at = at.withColumns({"here": _hash(4, "by_word", F.col("at"), "unit"), "moved": _hash(4, "by_word", F.col("at") - 1, "unit")})
    line = Window.partitionBy(*ID).orderBy("at")
    whole = Window.partitionBy(*ID)
    before = F.coalesce(F.bit_xor("here").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    after = F.bit_xor("moved").over(whole).bitwiseXOR(F.bit_xor("moved").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    sums = at.select(*ID, "first", "n", "at", before.bitwiseXOR(after).alias("v"), F.bit_xor("here").over(whole).alias("own"))
    variant = F.struct(F.col("v"), (F.col("n") - 1).alias("size"), F.col("at"))
    itself = F.struct(F.col("own").alias("v"), F.col("n").alias("size"), F.lit(-1).alias("at"))
    emitted = F.when(F.col("at") == 0, F.array(variant, itself)).otherwise(F.array(variant))
    rows = t.write("variants", sums.select(F.struct("first", *ID).alias("line"), F.inline(emitted)))

    key = ["v", "size"]
    met = rows.groupBy(*key).agg(F.min("line.h1").alias("a"), F.max("line.h1").alias("b")).where("a != b").select(*key)
    rows = rows.join(met, key)
    least = t.write("least", rows.groupBy(*key, "at").agg(F.min("line").alias("same")))
    cut = F.min(F.when(F.col("at") >= 0, F.col("same"))).alias("cut")
    behind = least.groupBy(*key).agg(cut, F.min(F.when(F.col("at") < 0, F.col("same"))).alias("whole"))
    witness = F.when(F.col("at") < 0, F.col("cut")).otherwise(F.least("whole", "same"))
    best = rows.join(least, [*key, "at"]).join(behind, key).select("line", witness.alias("w")).where("w.first < line.first").groupBy("line").agg(F.min("w").alias("w"))
    mine = told.select(*ID, "by_word", "units", "n")
    theirs = told.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("by_word").alias("other_by_word"), F.col("units").alias("other"), F.col("n").alias("m"))
    pairs = best.select("line.h1", "line.h2", F.col("w.h1").alias("w1"), F.col("w.h2").alias("w2"), F.col("w.first").alias("near"))
    return pairs.join(mine, ID).join(theirs, ["w1", "w2"]).where((F.col("by_word") == F.col("other_by_word")) & one_edit("units", "n", "other", "m")).select(*ID, "near")


def one_edit(a: str, n: str, b: str, m: str) -> Column:
    """Whether two arrays are one edit apart, or equal."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda z: z))
    longer, shorter = F.when(F.col(n) > F.col(m), F.col(a)).otherwise(F.col(b)), F.when(F.col(n) > F.col(m), F.col(b)).otherwise(F.col(a))
    size = F.least(n, m)
    first = F.array_position(F.zip_with(F.slice(longer, F.lit(1), size), shorter, lambda x, y: x == y), False).cast("int")
    gap = F.when(first == 0, size + 1).otherwise(first)
    rest = F.concat(F.slice(longer, F.lit(1), gap - 1), F.slice(longer, gap + 1, F.greatest(size - gap + 1, F.lit(0))))
    return F.when(F.col(n) == F.col(m), differ <= 1).when(F.abs(F.col(n) - F.col(m)) == 1, rest == shorter).otherwise(False)


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no, kept, dup_doc, dup_line of every line with words; the last two are null for a kept line."""
    t = Tables(docs.sparkSession, "line")
    staged = t.write("docs", docs.select("doc_id", "text").withColumn(ROW, F.monotonically_increasing_id()))
    lines = marked_lines(t, staged, min_words, min_chars)
    t.drop("docs")
    return lines.select("doc_id", "line_no", F.col("w").isNull().alias("kept"), F.col("w.doc_id").alias("dup_doc"), F.col("w.line_no").alias("dup_line"))


def drop_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the duplicate lines taken out of ``text``; all columns stay, and ``n_chars``, if there, is counted anew.

    A document that had words and keeps none goes; one without words stays as it is.
    """
    columns, schema = docs.columns, docs.schema
    docs = with_rows(docs, "line-docs")
    gone = marked_lines(Tables(docs.sparkSession, "line"), docs, min_words, min_chars).where("w IS NOT NULL").groupBy(ROW).agg(F.collect_set("line_no").alias("gone"))
    parts = F.split("text", "\n")
    left = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))), lambda i: F.get(parts, i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = docs.join(gone, ROW, "left").withColumn("text", text).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counted = F.char_length("text").cast(schema["n_chars"].dataType).alias("n_chars") if "n_chars" in columns else None
    return out.select(*(counted if c == "n_chars" else restored(c) for c in columns))
