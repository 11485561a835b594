"""Mentions of names with exact line and column positions.

Lines are paired with the next line of their block. A gazetteer of usual size is held by each Python worker, which walks
over the tokens of a pair once (``matching``); rows are sorted as lines, never as tokens. A larger one is a table like any
other, of any size: the joined text is cut into tokens, one row each, whose keys are computed in generated code and meet
the words of the names by equality. Only known words go on: a run of them is told by its consecutive positions, its parts
are built in a bounded window and meet the names by equality. Either way lines are shuffled by document once, into as
many tasks as they fill: a token's row is some fifty times its text, and what a task sorts has to fit its memory.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import core, strip_accents
from .matching import TRIMMED, finder

#: Names (with their codes) that are held in memory; more meet the tokens by joins.
HELD = 100_000
#: Bytes of lines (as the plan estimates them) to a task; what it sorts has to fit its memory or goes to disk.
TASK_BYTES = 1 << 20
#: Names of up to so many words look ahead word by word, which is cheaper than a list for each word.
LEADS = 8


def dealt(lines: DataFrame) -> DataFrame:
    """The lines by document, in a number of tasks that grows with their size and that no later step lowers."""
    size = int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # unknown
        return lines.repartition("doc_id")
    return lines.repartition(max(lines.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "doc_id")


def paired_lines(lines: DataFrame) -> DataFrame:
    """Each line of ``(doc_id, block_id, lineno, text)`` with the next one of its block and their joined text.

    Lines that are broken with a hyphen are put together, others are joined by a space after blanks and hyphens at
    the seam are cut off; the last line of a block stands alone.
    """
    w = Window.partitionBy("doc_id", "block_id").orderBy("lineno")
    own = F.coalesce("text", F.lit(""))
    out = lines.select("doc_id", "block_id", "lineno", own.alias("line1")).withColumns({"line2": F.lead("line1").over(w), "lineno2": F.lead("lineno").over(w)})
    return _joined(out)


def _joined(pairs: DataFrame) -> DataFrame:
    broken = F.endswith("line1", F.lit("-")) | F.startswith("line2", F.lit("-"))
    end1 = F.rtrim("line1", F.lit(TRIMMED))
    joined = F.when(F.col("line2").isNull(), end1).when(broken, F.concat(F.rtrim("line1", F.lit(" ")), F.ltrim("line2", F.lit(" ")))).otherwise(F.concat(end1, F.lit(" "), F.ltrim("line2", F.lit(TRIMMED))))
    added = F.when(F.col("line2").isNull() | broken, 0).otherwise(1)
    return pairs.withColumns({"joined": joined, "added": added})


def token_key(raw: Column, case_sensitive: bool = False) -> Column:
    """What a token is compared by: its core without accents, in lower case unless ``case_sensitive``."""
    folded = strip_accents(raw)
    return F.when(raw.rlike("^[a-z0-9_]+$"), raw).otherwise(core(folded if case_sensitive else F.lower(folded)))


def known_words(lines: DataFrame, gazetteer: DataFrame, longest: int, whole: bool, case_sensitive: bool = False) -> DataFrame:
    """A row for each token of the paired lines that is a word of some name, with its place in the joined text.

    Of the second line only the ``longest`` tokens next to the seam are read, as only names that begin on the first
    line count; all of it if ``whole``. Columns: the pair's (doc_id, block_id, lineno, lineno2 and what is cut off at
    the seam), and the token's pos, piece (with the white space before it), from (where the piece begins), start and
    stop of its core, word.
    """
    pairs = paired_lines(dealt(lines))  # one dealing by document serves all windows
    if not whole:
        near = F.regexp_extract("line2", rf"^[ \-]*(?U)\s*(?:\S+\s+){{0,{longest}}}\S*", 0)
        pairs = _joined(pairs.withColumn("size2", F.length("line2")).withColumn("line2", near))
    else:
        pairs = pairs.withColumn("size2", F.length("line2"))
    seam = F.length(F.rtrim("line1", F.lit(TRIMMED)))
    bare2 = F.length(F.ltrim("line2", F.lit(TRIMMED)))
    pairs = pairs.select(
        "doc_id", "block_id", "lineno", "lineno2", seam.alias("seam"), F.expr("substring(line1, length(rtrim(' -', line1)) + 1)").alias("tail1"),
        F.expr("substring(line2, 1, length(line2) - length(ltrim(' -', line2)))").alias("lead2"), (F.length("joined") - bare2).alias("after"),
        (F.length("line2") - bare2 - F.length("line1") - F.col("added")).alias("shift"), ((F.col("line1") != "") & (F.coalesce("size2", F.lit(0)) > 0)).alias("both"),
        F.regexp_extract_all("joined", F.lit(r"(?U)\s*\S+"), F.lit(0)).alias("pieces"))
    pairs = pairs.select(*pairs.columns[:-1], F.posexplode("pieces").alias("pos", "piece"))
    upto = F.sum(F.length("piece")).over(Window.partitionBy("doc_id", "block_id", "lineno").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a piece that has a printable ASCII character after its blanks needs no search; a column, as its users name it often
    bare = F.ltrim("piece", F.lit(" "))
    pairs = pairs.withColumn("raw", F.when((bare >= "!") & (bare < "\x7f"), bare).otherwise(F.regexp_extract("piece", r"(?U)\S+", 0)))
    tok = pairs.withColumn("key", token_key(F.col("raw"), case_sensitive)).withColumn("upto", upto.cast("int"))
    vocabulary = gazetteer.select(F.explode(F.split("name", " ")).alias("word")).distinct()
    hyphen = F.when(F.col("key").contains("-"), F.replace("key", F.lit("-"), F.lit("")))
    tok = tok.withColumn("bare", hyphen).join(vocabulary.withColumnRenamed("word", "v"), F.col("key") == F.col("v"), "left")
    # the bare form is looked up only where the key is no word itself
    tok = tok.join(vocabulary.withColumnRenamed("word", "u"), F.when(F.col("v").isNull(), F.col("bare")) == F.col("u"), "left")
    tok = tok.withColumn("word", F.coalesce("v", "u")).where("word is not null").drop("v", "u", "bare", "key").withColumn("own", core(F.col("raw")))
    start = F.col("upto") - F.length("raw") + F.position(F.col("own"), F.col("raw")) - 1
    return tok.select("*", (F.col("upto") - F.length("piece")).alias("from"), start.alias("start"), (start + F.length("own")).alias("stop")).drop("upto", "raw", "own")


def named(lines: DataFrame, gazetteer: DataFrame, single: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Mentions with an array of structs ``codes`` in place of a row for each code.

    ``before`` are the document's codes up to here, ``new`` its first mention of the name.
    """
    gazetteer = gazetteer.select("name", "code").where("name <> ''").distinct()
    codes = gazetteer.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("code"))).alias("codes"))
    held = gazetteer.limit(HELD + 1).collect()
    if len(held) > HELD:
        longest = gazetteer.agg(F.max(F.size(F.split("name", " ")))).first()[0]
        found = met(lines, gazetteer.select("name").distinct(), longest, single, case_sensitive).join(codes, "name")
        upto = F.sum(F.size("codes")).over(Window.partitionBy("doc_id").orderBy("startline", "pos", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = Window.partitionBy("doc_id", "name").orderBy("startline", "pos")
        return found.withColumns({"before": (upto - F.size("codes")).cast("int"), "new": F.row_number().over(first) == 1}).drop("pos", "n")
    pairs = paired_lines(dealt(lines)).select("doc_id", "lineno", "lineno2", "line1", "line2").sortWithinPartitions("doc_id", "lineno")
    of = {f.name: f.dataType.simpleString() for f in pairs.schema}
    out = f"doc_id {of['doc_id']}, before int, new boolean, startline {of['lineno']}, startcol int, endline {of['lineno']}, endcol int, name string, text string"
    return pairs.mapInArrow(finder(Counter(r.name for r in held), single, case_sensitive), out).join(F.broadcast(codes), "name")


def coded(found: DataFrame) -> DataFrame:
    """A row for each code of a mention, with its ``code`` and ``ord``."""
    out = found.select("*", F.posexplode("codes").alias("nth", "each"))
    return out.withColumns({"ord": F.col("before") + F.col("nth") + 1, "code": F.col("each.code")}).drop("before", "new", "codes", "nth", "each")


def candidates(lines: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(doc_id, name, code)``: what a document mentions, each once, told from first mentions: nothing is dealt or kept to compare."""
    return coded(named(lines, gazetteer).where("new")).select("doc_id", "name", "code")


def mentions(lines: DataFrame, gazetteer: DataFrame, single: bool = False, case_sensitive: bool = False) -> DataFrame:
    """``(doc_id, ord, startline, startcol, endline, endcol, name, code, text)``.

    A name is a run of words of which each stands in some name; every contiguous part of the run that is itself a
    name is a mention, or only the longest (the first of equals) if ``single``. There is a row for each code. Columns
    count from 0, the end is exclusive; a mention on the second line alone is left to that line.
    """
    return coded(named(lines, gazetteer, single, case_sensitive)).select("doc_id", "ord", "startline", "startcol", "endline", "endcol", "name", "code", "text")


def met(lines: DataFrame, names: DataFrame, longest: int, single: bool, case_sensitive: bool) -> DataFrame:
    """Mentions of names of any number, by joins: a row for each name found, with its place (pos, n) in the paired line."""
    words = known_words(lines, names, longest, single, case_sensitive)
    line = ["doc_id", "block_id", "lineno"]
    w = Window.partitionBy(*line).orderBy("pos")
    it = F.struct("pos", "word", "piece", "stop")
    ahead = F.array(it, *[F.lead(it, k).over(w) for k in range(1, longest)]) if longest <= LEADS else F.collect_list(it).over(w.rowsBetween(0, longest - 1))
    words = words.withColumn("ahead", ahead)
    if single:
        words = words.withColumn("run", F.col("pos") - F.row_number().over(w))
    part = F.slice("ahead", F.lit(1), F.col("n"))
    found = words.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("ahead")))).where(F.expr("ahead[n - 1].pos = pos + n - 1")).select(
        *[c for c in words.columns if c not in ("ahead", "word", "piece", "stop")], "n", F.array_join(part["word"], " ").alias("name"),
        F.array_join(part["piece"], "").alias("pieces"), F.expr("ahead[n - 1].stop").alias("stop"))
    first = F.col("stop") <= F.col("seam")
    over = (F.col("start") < F.col("seam")) & ~first & F.col("both")
    if single:
        found = found.join(names, "name", "left_semi")
        best = Window.partitionBy(*line, "run").orderBy(F.desc("n"), "pos")
        found = found.withColumn("best", F.row_number().over(best)).where("best = 1")
    found = found.where(first | over).withColumn("over", over)
    # the text between start and stop, with what was cut off at the seam put back
    plain = F.expr("substring(pieces, start - `from` + 1, stop - start)")
    whole = F.concat(F.expr("substring(pieces, start - `from` + 1, seam - start)"), F.col("tail1"), F.col("lead2"), F.expr("substring(pieces, after - `from` + 1, stop - after)"))
    return found.select(
        "doc_id", F.col("lineno").alias("startline"), F.col("start").alias("startcol"), F.when(F.col("over"), F.col("lineno2")).otherwise(F.col("lineno")).alias("endline"),
        F.when(F.col("over"), F.col("stop") + F.col("shift")).otherwise(F.col("stop")).alias("endcol"), "name", "pos", "n", F.when(F.col("over"), whole).otherwise(plain).alias("text"))


def count_mentions(found: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(name, n)``: mentions of each name, a name's codes counted once."""
    codes = gazetteer.groupBy("name").agg(F.count_distinct("code").alias("codes"))
    return found.groupBy("name").agg(F.count("*").alias("rows")).join(codes, "name").select("name", F.floor(F.col("rows") / F.col("codes")).cast("long").alias("n"))
