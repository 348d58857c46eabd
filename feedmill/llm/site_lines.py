"""Lines that one source repeats in its documents, found and removed with bitmaps.

Lines are compared by their letters alone.  A first count, pre-aggregated, leaves the lines that can reach the threshold at all.
For each of these, the documents of each written variant are stored as bitmaps: one chunk for each 32,768 ids, holding
a bit for each document, compressed in its table.  The chunks of the variants are united, their exact cardinalities
added up and held against the thresholds; a line is deleted where the bitmap of its letters has the document's bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import written

# Named entities of letters that feeds use; all others stand for marks and are dropped.
LETTER_ENTITIES = {
    "agrave": "à", "aacute": "á", "acirc": "â", "atilde": "ã", "auml": "ä", "aring": "å", "aelig": "æ", "ccedil": "ç", "egrave": "è", "eacute": "é", "ecirc": "ê", "euml": "ë", "igrave": "ì", "iacute": "í", "icirc": "î", "iuml": "ï",
    "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocirc": "ô", "otilde": "õ", "ouml": "ö", "oslash": "ø", "ugrave": "ù", "uacute": "ú", "ucirc": "û", "uuml": "ü", "yacute": "ý", "yuml": "ÿ", "szlig": "ß", "oelig": "œ",
}


def _numbered(text: Column) -> Column:
    """Numeric character references resolved, those of no character by a blank."""

    def put(acc: Column, ref: Column) -> Column:
        is_hex = F.lower(F.substring(ref, 3, 1)) == "x"
        code = F.when(is_hex, F.conv(F.substring(ref, F.lit(4), F.length(ref) - 4), 16, 10)).otherwise(F.substring(ref, F.lit(3), F.length(ref) - 3)).cast("int")
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        letter = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(32)), 8, "0")), "UTF-32")
        return F.replace(acc, ref, letter)

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(0)))
    return F.aggregate(refs, text, put)


def _marks(text: Column) -> Column:
    """The text without tags, with entities resolved as far as letters need it."""
    plain = F.regexp_replace(text, r"<!--.*?(-->|$)|</?[A-Za-z][^<>]*(>|$)", " ")
    named = plain
    for name, letter in LETTER_ENTITIES.items():
        named = F.regexp_replace(named, f"(?i)&{name};", letter)
    named = F.when(plain.rlike("&[A-Za-z]"), named).otherwise(plain)
    named = F.when(plain.contains("&#"), _numbered(named)).otherwise(named)
    return F.regexp_replace(named, r"&#?\w+;", " ")


def letters_of(line: Column) -> Column:
    """The letters of a line's visible text in lower case, a space between words, and none else."""
    plain = F.when(line.rlike("[<&]"), _marks(line)).otherwise(line)
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{M}]+", " "))


def lines_of(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, line_no, letters, variant): each line with at least two words of letters, split at newlines, counted from 1."""
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.select("id", "source", (F.col("pos") + 1).alias("line_no"), letters_of(F.col("line")).alias("words"), F.xxhash64("line").alias("variant")).where(F.instr("words", " ") > 0)
    # two hashes: 128 bits stand for the letters
    joined = F.replace(F.col("words"), F.lit(" "), F.lit(""))
    return rows.select("id", "source", "line_no", F.xxhash64(joined).alias("k1"), F.xxhash64(F.lit(1), joined).alias("k2"), "variant")


def site_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Returns (lines, chunks): all lines, and the bitmap chunks (source, k1, k2, bucket, bitmap) of the repeated ones."""
    rows = written(lines_of(df, id_col, source_col, text_col), "lines")
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("size"))
    needed = F.greatest(F.lit(least), F.ceil(F.col("size") * F.lit(str(share)).cast("decimal(10,6)")))
    counts = rows.groupBy("source", "k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    hopeful = counts.join(sizes, counts.source.eqNullSafe(sizes.source)).where(F.col("n") >= needed).select(counts.source, "k1", "k2", needed.alias("needed"))
    hopeful = written(hopeful, "hopeful")
    match = lambda a, b: a.source.eqNullSafe(b.source) & (a.k1 == b.k1) & (a.k2 == b.k2)
    some = rows.join(hopeful, match(rows, hopeful), "left_semi")
    bitmaps = some.groupBy("source", "k1", "k2", "variant", F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bitmap"))
    united = written(bitmaps.groupBy("source", "k1", "k2", "bucket").agg(F.expr("bitmap_or_agg(bitmap)").alias("bitmap")), "bitmaps")
    held = united.groupBy("source", "k1", "k2").agg(F.sum(F.expr("bitmap_count(bitmap)")).alias("documents"))
    kept = held.join(hopeful, match(held, hopeful)).where(F.col("documents") >= F.col("needed")).select(held.source, held.k1, held.k2)
    return rows, united.hint("merge").join(kept, match(united, kept), "left_semi")


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5, share: float = 0.1) -> DataFrame:
    """(id, line_no) of each line that occurs in at least ``least`` rows and in at least ``share`` of the rows of its source.

    Rows of a null source form a source of their own.  Rows with null ids or texts have no lines but count as rows of their source.
    Rows with the same id count as one where lines are counted.  Other columns aren't read.
    """
    rows, chunks = site_lines(df, id_col, source_col, text_col, least, share)
    chunks = chunks.toDF("b_source", "b_k1", "b_k2", "bucket", "bitmap").hint("merge")  # grows with the ids: never broadcast
    hit = rows.withColumn("at", F.expr("bitmap_bit_position(id)")).join(
        chunks, rows.source.eqNullSafe(F.col("b_source")) & (F.col("k1") == F.col("b_k1")) & (F.col("k2") == F.col("b_k2")) & (F.expr("bitmap_bucket_number(id)") == F.col("bucket"))
    )
    has = "shiftright(cast(conv(hex(substring(bitmap, cast(at div 8 as int) + 1, 1)), 16, 10) as int), cast(at % 8 as int)) & 1 = 1"
    return hit.where(F.expr(has)).select("id", "line_no")


def cleaned(df: DataFrame, id_col: str, source_col: str, text_col: str, least: int = 5, share: float = 0.1) -> DataFrame:
    """(id, text): each row's text without the repeated lines of its source; null texts stay null, a text of such lines becomes ''.

    Rows with a null id keep their text.
    """
    drop = repeated_lines(df, id_col, source_col, text_col, least, share).groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("drop", (i + 1)), F.lit(False)))
    joined = rows.join(drop, rows.id.cast("bigint") == drop.id, "left").select(rows.id, F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
    return joined
