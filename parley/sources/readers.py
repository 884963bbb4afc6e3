"""Readers of subtitle, speaker and document files as DataFrames; times are whole milliseconds."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.intervals import merge_segments

_STAMP = r"(\d+):(\d+):(\d+)[,.](\d+)"
_TIMES = rf"{_STAMP}\s*-->\s*{_STAMP}"


def _file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(_file_stem(F.input_file_name()).alias("video_id"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n").alias("value"))


def _ms(text: Column, group: int) -> Column:
    """Milliseconds of a stamp; the fraction counts as thousandths whatever its number of digits."""
    part = lambda k: F.regexp_extract(text, _TIMES, group + k).cast("long")
    return ((part(0) * 60 + part(1)) * 60 + part(2)) * 1000 + part(3)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, idx, t0, t1, text) of subtitle files: blocks parted by blank lines, the first line with times wins, idx falls back to the block's place."""
    blocks = _whole(spark, path).select("video_id", F.posexplode(F.split(_strip(F.col("value")), r"\n\s*\n")).alias("pos", "block"))
    timed = blocks.filter(F.col("block").rlike(_TIMES))
    stamp = F.regexp_extract("block", _TIMES, 0)
    head = F.regexp_extract("block", rf"(?s)^(.*?){_TIMES}", 1)
    text = _strip(F.regexp_replace("block", rf"(?s)^.*?{_TIMES}[^\n]*\n?", ""))
    idx = F.coalesce(F.trim(F.regexp_replace(head, r"[^\d\n].*", "")).try_cast("int"), F.col("pos") + 1)
    return timed.select("video_id", idx.alias("idx"), _ms(stamp, 1).alias("t0"), _ms(stamp, 5).alias("t1"), text.alias("text"))


def read_rttm(spark: SparkSession, path: str, merged: bool = False) -> DataFrame:
    """(video_id, seg_ord, t0, t1, spk) of speaker files: SPEAKER rows of eight fields or more, start and length in hundredths of a second.

    With ``merged`` segments of one speaker that follow each other are fused, as every reader of a timeline wants them.
    """
    lines = _whole(spark, path).select("video_id", F.posexplode(F.split("value", "\n")).alias("seg_ord", "line"))
    p = F.split(F.trim("line"), r"\s+")
    rows = lines.withColumn("p", p).filter((F.size("p") >= 8) & (F.get("p", F.lit(0)) == "SPEAKER"))
    t0 = F.round(F.get("p", F.lit(3)).cast("double") * 10).cast("long")
    rows = rows.select("video_id", "seg_ord", t0.alias("t0"), (t0 + F.round(F.get("p", F.lit(4)).cast("double") * 10).cast("long")).alias("t1"), F.get("p", F.lit(7)).alias("spk"))
    return merge_segments(rows) if merged else rows


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a tagged subtitle file with their speaker."""
    return read_srt(spark, path).withColumn("spk", F.regexp_extract("text", r"^\[(SPK_\d+)\]", 1)).filter("spk <> ''").withColumn("text", F.regexp_replace("text", r"^\[SPK_\d+\]\s*", ""))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder, or anything that a pattern fits, is there; in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def read_documents(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON documents of a known schema; none if the file is missing. A corrupt one is an error if ``strict``, else a row of nulls."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST" if strict else "PERMISSIVE")


def read_catalogue(spark: SparkSession, path: str, schema: str = "bvid string, title string, length string, created long, is_charge boolean") -> DataFrame:
    """Items of a catalogue, a file that holds one JSON list; a missing or corrupt file, or one that holds something else, has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True).filter(F.col("value").rlike(r"(?s)^\s*\["))
    return whole.select(F.inline(F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, spk, vec) from rows (video_id, labels, vecs); rows whose numbers of labels and vectors differ are unavailable and give none."""
    df = spark.read.parquet(path).filter(F.size("labels") == F.size("vecs"))
    return df.select("video_id", F.inline(F.arrays_zip("labels", "vecs"))).withColumnsRenamed({"labels": "spk", "vecs": "vec"})


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of array files with their labels, file by file; the reason where there are none."""
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            why, labels, vecs = None, [], []
            try:
                if r["array"] is None or r["meta"] is None:
                    why = "no array" if r["array"] is None else "no labels"
                else:
                    labels, vecs = list((json.loads(r["meta"]) or {}).get("labels") or []), np.load(io.BytesIO(r["array"]), allow_pickle=False)
                    if vecs.ndim != 2 or len(vecs) != len(labels):
                        why = f"{len(vecs) if vecs.ndim else 0} vectors of {len(labels)} labels"
            except (ValueError, EOFError, AttributeError) as e:
                why = f"unreadable: {type(e).__name__}"
            if why:
                found.append((r["folder"], False, why, None, None, None))
            else:
                found += [(r["folder"], True, None, i, str(label), [float(x) for x in row]) for i, (label, row) in enumerate(zip(labels, vecs, strict=True))]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["folder", "available", "why", "place", "spk", "vec"])


def read_array_pairs(spark: SparkSession, folders: str, array: str = "spk_emb.npy", meta: str = "spk_emb.json") -> DataFrame:
    """(folder, available, why, place, spk, vec) from pairs of files, an array of vectors and a JSON document with their ``labels``, one pair in each of ``folders`` (a pattern).

    Row i of the array belongs to label i. A folder where one of the two is missing or unreadable, or where the numbers
    differ, is one row that is not available and says why. Files are read by the executors, a pair in one task.
    """
    read = lambda name, as_: spark.read.format("binaryFile").load(f"{folders}/{name}").select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.col("content").alias(as_))
    empty = lambda as_: spark.createDataFrame([], f"folder string, {as_} binary")
    a = read(array, "array") if exists(spark, f"{folders}/{array}") else empty("array")
    m = read(meta, "meta") if exists(spark, f"{folders}/{meta}") else empty("meta")
    pairs = a.join(m, "folder", "full")
    return pairs.mapInArrow(_decoded, "folder string, available boolean, why string, place int, spk string, vec array<double>")


def read_wav(spark: SparkSession, path: str, piece_s: int = 600) -> DataFrame:
    """(file, piece, rate, samples, problem) of recordings: 16-bit samples of one channel, in pieces of ``piece_s`` seconds.

    A recording of several channels gives their mean. What is no PCM recording of 16 bits is one row with the problem.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(x, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.string()), strict=True)], names=["file", "piece", "rate", "samples", "problem"])
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                try:
                    rate, channels, data = riff_samples(content.as_buffer())
                except ValueError as e:
                    yield row(file, 0, None, None, str(e))
                    continue
                width = piece_s * rate * channels
                for i, at in enumerate(range(0, max(len(data), 1), width)):
                    part = data[at : at + width]
                    part = part if channels == 1 else part[: len(part) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.int16)
                    yield row(file, i, rate, part, None)

    return files.mapInArrow(run, "file string, piece int, rate int, samples array<short>, problem string")


def riff_samples(content) -> tuple[int, int, np.ndarray]:
    """Rate, channels and samples of a RIFF file of 16-bit PCM, without a copy: chunks are walked, unknown ones skipped, a data chunk cut short is read as far as it goes."""
    view = memoryview(content)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("no RIFF file")
    at, kind = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data":
            if kind is None:
                raise ValueError("data before format")
            code, channels, rate, _, _, bits = kind
            if code not in (1, 0xFFFE) or bits != 16:
                raise ValueError(f"format {code} of {bits} bits")
            end = min(len(view), at + 8 + size)
            return rate, channels, np.frombuffer(view[at + 8 : at + 8 + (end - at - 8) // 2 * 2], "<i2")
        at += 8 + size + size % 2
    raise ValueError("no data")


def read_voice_config(spark: SparkSession, config: dict | str) -> DataFrame:
    """(file, spk, voice, who, skip) of a voice configuration, in its order; YAML text, or what has been parsed of it. It is configuration, not data."""
    if isinstance(config, str):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML text needs the yaml package; pass what it holds as a dict") from e
        config = yaml.safe_load(config) or {}
    rows = [(i, m.get("file"), spk, d.get("voice"), d.get("who"), bool(d.get("skip"))) for i, m in enumerate(config.get("episode_maps") or []) for spk, d in (m.get("map") or {}).items()]
    return spark.createDataFrame(rows, "ord int, file string, spk string, voice string, who string, skip boolean")
