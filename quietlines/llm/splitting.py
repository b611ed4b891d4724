"""Problem 2: items over a size limit, cut at natural boundaries with overlap.

Method: one regular expression with bounded quantifiers consumes the text. Its
alternatives are ordered by the strength of the boundary they end at (the rest of
the text, a blank line, a line end, a sentence end, a blank, any character), each
taking as much as fits; the last is the character fallback. The consumed stretches
are the cores of the pieces; each piece begins with the `overlap` characters of the
text before its core (the first with the first `overlap` characters of the text), so
neighbours share exactly those. All of it runs as SQL array functions inside the JVM,
linear in the text.

Sizes are code points. A core has at most `chunk - overlap` and, before the last, at
least half of that, so every piece fits and the pieces cover the whole text.

Defined results: null text or null or non-positive chunk size: null pieces. Text up
to the limit, the empty text included: one piece, the text itself. Overlap missing or
negative: none. An overlap of the chunk size or more leaves no room for anything new;
seven eighths of the chunk size are shared then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlines.plans.tables import salted_lookup

#: Pieces whose places are computed in one inner fold.
BLOCK = 256


def boundary_pattern(core: Column, least: Column) -> Column:
    """The pattern that consumes cores of `least` to `core` characters."""
    span = F.concat(F.lit("{"), least.cast("string"), F.lit(","), core.cast("string"), F.lit("}"))
    up_to = F.concat(F.lit("{1,"), core.cast("string"), F.lit("}"))
    exact = F.concat(F.lit("{"), core.cast("string"), F.lit("}"))
    return F.concat(
        F.lit("(?s)."), up_to, F.lit(r"\z|."),
        span, F.lit(r"(?<=\n[ \t]{0,8}\r?\n)|."),
        span, F.lit(r"(?<=\n)|."),
        span, F.lit(r"(?<=[.!?。！？;][\"')\]]?\s)|."),
        span, F.lit(r"(?<=[。！？]|\s)|."),
        exact,
    )


def split_pieces(text: Column, chunk: Column, overlap: Column) -> Column:
    """Column: array of struct<piece_no, start_pos, end_pos, piece> for a text column."""
    asked = F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0))
    lap = F.when(asked < chunk, asked).otherwise(chunk - F.greatest(F.floor(chunk / 8), F.lit(1))).cast("int")
    core = (chunk - lap).cast("int")
    least = F.greatest(F.floor(core / 2), F.lit(1)).cast("int")
    usable = text.isNotNull() & (chunk > 0)
    long = usable & (F.char_length(text) > chunk)
    cores = F.regexp_extract_all(F.substr(text, lap + 1), boundary_pattern(core, least), F.lit(0))
    parts = F.when(long, cores).when(usable, F.array(text))
    head = F.when(long, F.left(text, lap)).otherwise(F.lit(""))
    none = F.array().cast("array<struct<lap:string,end:int>>")
    start = F.struct(head.alias("tail"), F.char_length(head).alias("at"), F.array().cast("array<array<struct<lap:string,end:int>>>").alias("blocks"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.char_length(p)
        return F.struct(F.right(F.concat(a["tail"], p), lap).alias("tail"), end.alias("at"), F.concat(a["before"], F.array(F.struct(a["tail"].alias("lap"), end.alias("end")))).alias("before"))

    def block(a: Column, some: Column) -> Column:
        """A fold copies what it has gathered at every step, so it gathers blocks of steps."""
        inner = F.aggregate(some, F.struct(a["tail"].alias("tail"), a["at"].alias("at"), none.alias("before")), step)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["tail"].alias("tail"), r["at"].alias("at"), F.concat(a["blocks"], F.array(r["before"])).alias("blocks"))), F.lit(0))

    def placed(parts: Column) -> Column:
        """The pieces of one text; `parts` is bound here, so that the text is matched once."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)))
        before = F.aggregate(blocks, start, block, lambda a: F.flatten(a["blocks"]))
        return F.transform(F.arrays_zip(parts.alias("core"), before.alias("before")), piece)

    def piece(p: Column, i: Column) -> Column:
        first = p["before"]["end"] - F.char_length(p["core"]) - F.char_length(p["before"]["lap"])
        return F.struct(i.cast("int").alias("piece_no"), first.cast("bigint").alias("start_pos"), p["before"]["end"].cast("bigint").alias("end_pos"), F.concat(p["before"]["lap"], p["core"]).alias("piece"))

    return F.when(parts.isNotNull(), F.get(F.transform(F.array(parts), placed), F.lit(0)))


def with_limits(sessions: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """Add chunk_size and overlap_chars of the configuration of each row's file.

    A file scanned twice counts once, a configuration listed twice by its larger chunk
    size; rows without a known file drop out. The file
    table is reduced to one row per path first; a hot path is salted over tasks.
    """
    limits = configs.groupBy("config_id").agg(F.max(F.struct("chunk_size", "overlap_chars")).alias("c")).select("config_id", "c.*")
    per_file = files.where("relative_path IS NOT NULL AND config_id IS NOT NULL").groupBy("relative_path").agg(F.max("config_id").alias("config_id"))
    lookup = per_file.join(limits, "config_id").drop("config_id")
    return salted_lookup(sessions, lookup, "relative_path", "row_id")


def oversized(sessions: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """The rows that come out in more than one piece: `row_id`, the limits and `pieces`.

    Only rows over the smallest limit of all configurations can be cut, so that the
    join moves few texts; the smallest limit is one number of a fixed table.
    """
    floor = configs.agg(F.min("chunk_size")).first()[0]
    maybe = sessions.select("row_id", "relative_path", "content").where(F.char_length("content") > F.lit(floor if floor is not None else 0))
    limited = with_limits(maybe, files, configs)
    return limited.withColumn("pieces", split_pieces(F.col("content"), F.col("chunk_size"), F.col("overlap_chars"))).where(F.size("pieces") > 1).drop("content")


def pieces(sessions: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """One row per piece of every oversized row."""
    cut = oversized(sessions, files, configs).select("row_id", "chunk_size", F.explode("pieces").alias("p"))
    return cut.select("row_id", "chunk_size", "p.*")
