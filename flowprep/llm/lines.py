"""Line dedup in DataFrame operations alone.

Each line's key is hashed twice to 64 bits. The hashes are written once, so that the range partitioning samples them and
not the texts. Occurrences are range-partitioned by hash and by block of document ids, and sorted by document and position
behind that, so no task holds all occurrences of a common line and one pass over the sorted rows tells the first
occurrence in each document. Those are summed by hash (partial sums first). Occurrences of the keys that go are folded
into keep bitmaps of 64 lines a word. The bitmaps are compressed: words whose lines all stay are left out, and a document
that loses nothing has none. keep_bitmaps() returns them without any text; the other functions join them to the texts.

Cases: a null or empty text is one empty line; keys below the least length stay (so empty lines do); a line may repeat
within a document and counts once for it; rows that repeat a document id count as that one document, each gets its own
row; a null id counts as one document of its own, after all others; ids are whole numbers (or text of such: others are an
error); very long texts cost their lines only; an empty table gives no rows; other columns are ignored by dedup_lines() and
keep_bitmaps() and kept by drop_lines(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, quoted, text_of, tidy, written

# What is stripped from a line's ends, and what is lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of 2^12 consecutive ids share a block of a line's occurrences.
BLOCK_SHIFT = 12


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def bitmaps(base: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """(id, row, keep) of the documents of base (id, row, text) that lose lines."""
    lines = base.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashes = written(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "row", "pos"), "hashes")
    block = F.coalesce(F.shiftright("id", BLOCK_SHIFT), F.pmod("row", F.lit(1024)))  # rows without an id are dealt out by their texts
    ordered = hashes.withColumn("block", block).repartitionByRange("h1", "h2", "block")
    sweep = Window.partitionBy("h1", "h2", "block").orderBy("id", "pos", "row")
    own = F.struct("id")  # never null, whatever the id
    seen = written(ordered.withColumn("opens", ~F.lag(own).over(sweep).eqNullSafe(own)), "lines")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "pos")
    counts = seen.where("opens").groupBy("h1", "h2").agg((F.count("id") + F.max(F.col("id").isNull().cast("int"))).alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs)
    gone = seen.join(written(counts, "common"), ["h1", "h2"])  # a table on each side, so a common line's occurrences can be split
    if keep_first:
        gone = gone.where(~place.eqNullSafe(F.col("first")))
    words = gone.groupBy("id", "row", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("mask"))
    return words.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("keep"))


def based(df: DataFrame, text: Column, key: Column) -> DataFrame:
    """df and, for each row, what tells documents apart: id, and row, a hash of the text."""
    return df.withColumns({"id": key.cast("long"), "text": text_of(text)}).withColumn("row", F.xxhash64("text"))


def joined(base: DataFrame, masks: DataFrame) -> DataFrame:
    return base.join(masks.select(F.col("id").alias("i"), F.col("row").alias("r"), "keep"), F.col("id").eqNullSafe(F.col("i")) & (F.col("row") == F.col("r")), "left").withColumn("lines", F.split("text", "\n", -1))


def kept_lines() -> Column:
    """Of lines, those whose bit in keep is set; words that keep lacks are all set."""
    mask = lambda i: F.coalesce(F.try_element_at("keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    stays = F.filter("lines", lambda _, i: F.getbit(mask(i), F.pmod(i, F.lit(64))) == 1)
    return F.when(F.col("keep").isNull(), F.col("lines")).otherwise(stays)


@tidy
def keep_bitmaps(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """id, row (xxhash64 of the text), keep: of each document that loses lines, the words of 64 lines that lose any, with
    the bits of the lines that stay. Lines whose keys occur in min_docs documents or more go; with keep_first, all but the
    first occurrence does."""
    return bitmaps(based(df.select(quoted(id_col).alias("c0"), quoted(text_col).alias("c1")), F.col("c1"), F.col("c0")).select("id", "row", "text"), min_docs, min_chars, keep_first).withColumnRenamed("id", id_col)


@tidy
def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """id, n_lines, n_dropped, kept_sha256 and keep (the bitmap, null where nothing goes) of each row."""
    base = based(df.select(quoted(id_col).alias("c0"), quoted(text_col).alias("c1")), F.col("c1"), F.col("c0")).select("c0", "id", "row", "text")
    out = joined(base, bitmaps(base.drop("c0"), min_docs, min_chars, keep_first))
    out = out.select("c0", F.size("lines").cast("long").alias("n_lines"), kept_lines().alias("kept"), "keep")
    digest = F.sha2(F.encode(F.concat_ws("\n", "kept"), "UTF-8"), 256)
    return out.select(F.col("c0").alias(id_col), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), digest.alias("kept_sha256"), "keep")


@tidy
def drop_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """df with its texts cut to the lines that stay (null texts stay null where nothing goes)."""
    own, at = numbered(df), df.columns.index(text_col)
    base = based(own, F.col(f"c{at}"), F.col(f"c{df.columns.index(id_col)}"))
    out = joined(base, bitmaps(base.select("id", "row", "text"), min_docs, min_chars, keep_first))
    text = F.when(F.col("keep").isNull(), F.col(f"c{at}")).otherwise(F.concat_ws("\n", kept_lines()))
    return out.select(*[text if i == at else F.col(f"c{i}") for i in range(len(df.columns))]).toDF(*df.columns)


def op1_line_dedup(spark, sf_dir):
    """The documents without the lines that ten or more of them share."""
    from .common import table

    return dedup_lines(table(spark, sf_dir, "documents")).drop("keep")


SQL = """
WITH split AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
),
common AS (SELECT key FROM split WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM split s LEFT JOIN common c ON s.key = c.key
GROUP BY doc_id
"""
