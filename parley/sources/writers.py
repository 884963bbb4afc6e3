"""Writers: subtitle and speaker files, per-speaker Markdown, review tables, statistics and score matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import scalars as s


def srt_text(lines: DataFrame, tagged: bool = False, key: str = "video_id") -> DataFrame:
    """(key, value): the subtitle file of each video, numbered from 1 in the order of time."""
    number = F.row_number().over(Window.partitionBy(key).orderBy("t0", "t1", "idx"))
    text = F.concat(F.lit("["), "spk", F.lit("] "), "text") if tagged else F.col("text")
    block = F.concat(number.cast("string"), F.lit("\n"), s.srt_time(F.col("t0")), F.lit(" --> "), s.srt_time(F.col("t1")), F.lit("\n"), text, F.lit("\n"))
    blocks = lines.select(key, number.alias("n"), block.alias("block"))
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("value"))


def rttm_text(segs: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, value): the speaker file of each video by start, lengths not under 0, in hundredths of a second."""
    row = F.format_string("SPEAKER %s 1 %07.3f %07.3f <NA> <NA> %s <NA> <NA>", F.col(key), F.col("t0") / 10, F.greatest(F.lit(0), F.col("t1") - F.col("t0")) / 10, F.col("spk"))
    rows = segs.select(key, "t0", "seg_ord", row.alias("row"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "seg_ord", "row"))), lambda x: x["row"]), "\n").alias("value"))


def speaker_markdown(lines: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, value): each video's lines under a heading for each speaker, speakers in order."""
    line = F.concat(F.lit("- "), s.minutes_seconds(F.col("t0") / 1000), F.lit(" "), "text")
    own = lines.groupBy(key, "spk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spk", "body"))), lambda x: F.concat(F.lit("## "), x["spk"], F.lit("\n"), x["body"])), "\n\n").alias("value"))


def write_texts(texts: DataFrame, path: str, key: str = "video_id") -> None:
    """One folder for each key; the file sink's commit makes it whole or absent."""
    texts.write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def write_review(lines: DataFrame, path: str) -> None:
    """Rows that want review, as CSV with a header."""
    lines.filter("review").write.mode("overwrite").csv(path, header=True)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def append_picks(picks: DataFrame, path: str) -> None:
    picks.write.mode("append").json(path)


def score_matrix_table(scores: DataFrame, people: list[str]) -> DataFrame:
    """Speakers by people; the people are given, so the pivot needs no pass of its own."""
    return scores.groupBy("video_id", "spk").pivot("person", people).agg(F.first("score"))


def matrix_markdown(scores: DataFrame, people: list[str]) -> DataFrame:
    """(video_id, value): the score matrix of each video as a Markdown table, speakers in order, scores to three places."""
    cell = lambda p: F.when(F.col(p).isNull(), F.lit("-")).otherwise(F.format_string("%.3f", F.col(p)))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "spk", *[cell(p) for p in people]), F.lit(" |"))
    head = "| speaker | " + " | ".join(people) + " |\n|" + "---|" * (len(people) + 1) + "\n"
    rows = score_matrix_table(scores, people).select("video_id", "spk", row.alias("row"))
    return rows.groupBy("video_id").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("spk", "row"))), lambda x: x["row"]), "\n")).alias("value"))


def _fs(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark, path: str) -> bool:
    """Whether a product and its sentinel are there: half-written ones have none."""
    return all(fs.exists(where) for where, fs in (_fs(spark, path), _fs(spark, path.rstrip("/") + ".done")))


def write_once(df: DataFrame, path: str, force: bool = False) -> str:
    """Write a product and then its sentinel; a complete one is left as it is unless ``force``. Says ``applied`` or ``reused``."""
    spark = df.sparkSession
    if not force and is_complete(spark, path):
        return "reused"
    mark, fs = _fs(spark, path.rstrip("/") + ".done")
    fs.delete(mark, True)
    df.write.mode("overwrite").parquet(path)
    fs.create(mark, True).close()
    return "applied"


#: Fields of a library entry in the order of the file.
LIBRARY_FIELDS = ("type", "engine", "voice", "ref_audio", "ref_text_file", "note")


def _quoted(text: Column) -> Column:
    """A double-quoted scalar: JSON's escapes are a part of YAML's."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def voices_yaml(speakers: DataFrame, settings: dict[str, str] | None = None, key: str = "decision") -> DataFrame:
    """(key, value): the voices file of each decision, always the same text for the same rows: settings, library and map, each in order.

    ``speakers``: (key, id, who, entry, skip and the library's fields); speakers that share an entry share its first one's fields.
    """
    q = lambda x: _quoted(F.lit(x))
    top = [F.concat(F.lit("  "), q(k), F.lit(": "), q(v)) for k, v in sorted((settings or {}).items())] or [F.lit("  {}")]
    head = F.concat_ws("\n", F.lit("global:"), *top, F.lit("library:"))
    fields = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"    {f}: "), _quoted(F.col(f)))) for f in LIBRARY_FIELDS]
    entry = F.concat_ws("\n", F.concat(F.lit("  "), _quoted(F.col("entry")), F.lit(":")), *fields)
    first = speakers.groupBy(key, "entry").agg(F.min_by(entry, "id").alias("text"))
    join = lambda rows, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, rows))), lambda x: x["text"]), "\n")
    library = first.groupBy(F.col(key).alias("_k")).agg(join("text", "entry").alias("library"))
    skip = F.when(F.col("skip"), F.lit(", skip: true")).otherwise(F.lit(""))
    line = F.concat(F.lit("      "), _quoted(F.col("id")), F.lit(": {voice: "), _quoted(F.col("entry")), F.lit(", who: "), _quoted(F.coalesce("who", F.lit(""))), skip, F.lit("}"))
    maps = speakers.select(key, "id", line.alias("text")).groupBy(key).agg(join("text", "id").alias("map"))
    body = F.concat_ws("\n", head, "library", F.lit("episode_maps:"), F.concat(F.lit("  - file: "), _quoted(F.col(key).cast("string"))), F.lit("    map:"), "map")
    return maps.join(library, F.col(key) == F.col("_k")).select(key, F.concat(body, F.lit("\n")).alias("value"))
