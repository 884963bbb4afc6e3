"""The voice archive's upkeep: language of a speaker, samples archived after a review, fresh results, recomputed vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import scalars as s
from parley.operators.voice import fifo_cap
from parley.operators.closure import merge_closure

#: Entries that a person and language hold at most, and the least cosine of a vector with its recomputed self.
CAP, SAME = 10, 0.999


def with_language(speakers: DataFrame, people: DataFrame) -> DataFrame:
    """Speakers (person, lang, …) with the language they are archived under: their own, else their person's main one. Empty counts as none."""
    main = people.select(F.col("person").alias("_p"), "main_lang")
    return speakers.join(main, F.col("person") == F.col("_p"), "left").withColumn("archive_lang", F.coalesce(F.nullif("lang", F.lit("")), F.nullif("main_lang", F.lit("")))).drop("_p", "main_lang")


def entries(archive: DataFrame, person: str | None = None, lang: str | None = None) -> DataFrame:
    """Entries of a person, of a language, or of both; without either all of them."""
    out = archive if person is None else archive.filter(F.col("person") == person)
    return out if lang is None else out.filter(F.col("lang") == lang)


def valid_refs(archive: DataFrame, present: DataFrame) -> DataFrame:
    """Entries with ``valid``: an absolute path is if ``present`` (file) has it, a relative one always, an empty one never."""
    files = present.select(F.col("file").alias("_f")).distinct()
    met = archive.join(files, F.col("ref_path") == F.col("_f"), "left")
    empty = F.coalesce(F.col("ref_path"), F.lit("")) == ""
    return met.withColumn("valid", F.when(empty, False).when(F.col("ref_path").startswith("/"), F.col("_f").isNotNull()).otherwise(True)).drop("_f")


class _Person:
    """What the fold over a person's samples carries: the entries held, oldest first, as (language, unit vector or none), and samples archived that may come again."""

    def __init__(self, person: str):
        self.person, self.held, self.samples = person, [], set()

    def of(self, lang: str | None) -> list[tuple]:
        """Entries of a language; without a language all of the person's."""
        return self.held if lang is None else [x for x in self.held if x[0] == lang]

    def add(self, lang: str | None, unit: np.ndarray | None) -> None:
        self.held.append((lang, unit))
        mine = [i for i, x in enumerate(self.held) if x[0] == lang]
        if len(mine) > CAP:
            del self.held[mine[0]]


def _unit(vec: list[float] | None) -> np.ndarray | None:
    if not vec:
        return None
    out = np.array(vec, dtype=np.float64)
    length = np.linalg.norm(out)
    return out / length if length else out


def _mean_cosine(unit: np.ndarray | None, entries: list[tuple]) -> float:
    """Mean over the entries; products go over the shorter length."""
    if unit is None:
        return 0.0
    return float(np.mean([np.dot(unit[: len(v)], v[: len(unit)]) for _, v in entries]))


def _fold_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges samples in order, person by person: entries held come first. One person's entries are in memory, not its samples."""
    now = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or r["person"] != now.person:
                now = _Person(r["person"])
            unit = _unit(r["vec"])
            if not r["asked"]:
                now.add(r["lang"], unit)
                continue
            if r["again"] and r["sample"] in now.samples:
                out.append((r["key"], r["spk"], r["person"], r["lang"], "skipped", "archived before", None, None))
                continue
            known = [x for x in now.of(r["lang"]) if x[1] is not None]
            score = _mean_cosine(unit, known) if len(known) > 1 else None
            if score is not None and r["p5"] is not None and score < r["p5"]:
                out.append((r["key"], r["spk"], r["person"], r["lang"], "blocked", "unlike its person", score, None))
                continue
            now.add(r["lang"], unit)
            if r["again"]:
                now.samples.add(r["sample"])
            out.append((r["key"], r["spk"], r["person"], r["lang"], "archived", None, score, len(now.of(r["lang"]))))
        kinds = [batch.schema.field("key").type, pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32()]
        names = ["key", "spk", "person", "lang", "status", "why", "score", "total_after"]
        yield pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def archive_loop(speakers: DataFrame, people: DataFrame, archive: DataFrame, tiers: DataFrame, refs: DataFrame, key: str = "video_id") -> DataFrame:
    """What becomes of each reviewed speaker: archived, blocked or skipped, with the reason, and how many entries its group then has.

    ``speakers``: (key, spk, ord, merge_into, voice, host_person, person, lang, sample, vec). A merged speaker takes its final
    target's person and voice but keeps its own sample. Skipped are, in this order: no person or voice skip, a person that
    ``people`` (person, main_lang) does not hold, no sample, a sample that ``refs`` (person, audio) has or that was archived for the
    person before. The rest are taken in the order of ``ord``: a sample whose mean cosine with its group's entries is under the
    language's 5th percentile (``tiers``: lang, genuine_p5) is blocked, unless the group has fewer than two; others join the
    group at once, which keeps its latest ``CAP``. Without a language the group is all of the person's entries, and there is no
    percentile. The order matters within a person only: one person's samples pass through one task, row by row.
    """
    final = merge_closure(speakers.filter("merge_into IS NOT NULL AND merge_into <> spk").select(key, F.col("spk").alias("id"), F.col("merge_into").alias("target")), key)
    final = final.select(F.col(key).alias("_v"), F.col("id").alias("_i"), F.col("final").alias("target"))
    owner = speakers.select(F.col(key).alias("_o"), F.col("spk").alias("_s"), F.coalesce(F.nullif("host_person", F.lit("")), F.nullif("person", F.lit(""))).alias("owner"), F.col("voice").alias("owner_voice"))
    df = speakers.join(final, (F.col(key) == F.col("_v")) & (F.col("spk") == F.col("_i")), "left")
    df = df.join(owner, (F.col(key) == F.col("_o")) & (F.coalesce("target", "spk") == F.col("_s")), "left").select(key, "spk", "ord", "lang", "sample", "vec", F.col("owner").alias("person"), "owner_voice")
    known = people.select(F.col("person").alias("_k")).distinct()
    had = refs.select(F.col("person").alias("_r"), F.col("audio").alias("_a")).distinct()
    df = with_language(df, people).join(known, F.col("person") == F.col("_k"), "left").join(had, (F.col("person") == F.col("_r")) & (F.col("sample") == F.col("_a")), "left")
    why = F.when(F.col("person").isNull() | F.coalesce(F.col("owner_voice") == "skip", F.lit(False)), "no person").when(F.col("_k").isNull(), "unknown person").when(F.nullif("sample", F.lit("")).isNull(), "no sample").when(F.col("_a").isNotNull(), "archived before")
    df = df.withColumn("why", why)
    skipped = df.filter("why IS NOT NULL").select(F.col(key).alias("key"), "spk", "person", F.col("archive_lang").alias("lang"), F.lit("skipped").alias("status"), "why", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("total_after"))

    # of a sample that a person has once, nothing has to be remembered
    again = F.count(F.lit(1)).over(Window.partitionBy("person", "sample")) > 1
    gates = tiers.select(F.col("lang").alias("_t"), F.col("genuine_p5").alias("p5"))
    asked = df.filter("why IS NULL").withColumn("again", again).join(gates, F.col("archive_lang") == F.col("_t"), "left")
    asked = asked.select("person", F.lit(True).alias("asked"), F.col("ord").cast("long").alias("ord"), F.col(key).alias("key"), "spk", F.col("archive_lang").alias("lang"), "sample", "again", "p5", "vec")
    held = fifo_cap(archive, CAP).join(asked.select(F.col("person").alias("_p")).distinct(), F.col("person") == F.col("_p"), "left_semi").select("person", F.lit(False).alias("asked"), F.col("seq").cast("long").alias("ord"), "lang", "vec")
    rows = held.unionByName(asked, allowMissingColumns=True).select(*asked.columns)
    sorted_rows = rows.repartition("person").sortWithinPartitions("person", "asked", "ord", "key", "spk")
    judged = sorted_rows.mapInArrow(_fold_samples, f"key {dict(speakers.dtypes)[key]}, spk string, person string, lang string, status string, why string, score double, total_after int")
    return skipped.unionByName(judged).withColumnRenamed("key", key)


def archive_after(told: DataFrame, speakers: DataFrame, archive: DataFrame, key: str = "video_id") -> DataFrame:
    """The archive (seq, person, lang, vec, ref_path) with the samples that ``archive_loop`` archived, each group's latest ``CAP``.

    New entries follow all old ones, in the order of ``ord``. The thresholds after a review are ``calibrate`` of this.
    """
    last, least = archive.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0], speakers.agg(F.coalesce(F.min("ord"), F.lit(0))).first()[0]
    new = told.filter("status = 'archived'").select(F.col(key).alias("_v"), F.col("spk").alias("_s"), "person", "lang")
    mine = speakers.select(key, "spk", "ord", "sample", "vec").join(new, (F.col(key) == F.col("_v")) & (F.col("spk") == F.col("_s")))
    came = mine.select((F.col("ord") + (last + 1 - least)).alias("seq"), "person", "lang", "vec", F.col("sample").alias("ref_path"))
    return fifo_cap(archive.select("seq", "person", "lang", "vec", "ref_path").unionByName(came), CAP)


def archive_summary(told: DataFrame) -> DataFrame:
    """Of each person and language: how many samples were archived, and how many entries the group has after the last."""
    return told.filter("status = 'archived'").groupBy("person", "lang").agg(F.count(F.lit(1)).alias("archived"), F.max("total_after").alias("total"))


def freshness(results: DataFrame, speakers: DataFrame, archive_at: int | None, thresholds_at: int | None, key: str = "video_id") -> DataFrame:
    """Whether cached results (key, written_at, available, has_vectors, have) can be used again, and why not.

    Without vectors only a result that says it is unavailable stays true. With them it must be available, no older than the
    archive and the thresholds, and hold every speaker of ``speakers`` (key, spk). Videos without a result have none.
    """
    order = speakers.groupBy(F.col(key).alias("_k")).agg(F.collect_set("spk").alias("order"))
    df = order.join(results, F.col("_k") == F.col(key), "left")
    newest = max([x for x in (archive_at, thresholds_at) if x is not None], default=None)
    older = F.lit(False) if newest is None else F.col("written_at") < newest
    why = (
        F.when(F.col("written_at").isNull(), "no result")
        .when(~F.col("has_vectors"), F.when(F.col("available"), "no vectors"))
        .when(~F.col("available"), "vectors since")
        .when(older, "older than archive or thresholds")
        .when(F.size(F.array_except("order", F.coalesce("have", F.array().cast("array<string>")))) > 0, "other speakers")
    )
    return df.select(F.col("_k").alias(key), why.isNull().alias("fresh"), why.alias("why"))


def label_sets(left: DataFrame, right: DataFrame, key: str = "video_id", label: str = "spk") -> DataFrame:
    """Per key the labels of both sides, of the left alone, and of the right alone, each in order and joined by commas."""
    a = left.groupBy(key).agg(F.collect_set(label).alias("a"))
    b = right.groupBy(F.col(key).alias("_k")).agg(F.collect_set(label).alias("b"))
    none = F.array().cast("array<string>")
    both = a.join(b, F.col(key) == F.col("_k"), "full").select(F.coalesce(key, "_k").alias(key), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    text = lambda x: F.array_join(F.sort_array(x), ",")
    return both.select(key, text(F.array_union("a", "b")).alias("every"), text(F.array_except("a", "b")).alias("left_only"), text(F.array_except("b", "a")).alias("right_only"))


def sample_of(archive: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A fixed sample of entries that have a vector and a reference: the same for a seed, on any engine."""
    return archive.filter("size(vec) > 0 AND ref_path <> ''").orderBy(F.md5(F.concat(F.col("seq").cast("string"), F.lit(f":{seed}"))), "seq").limit(size)


def recompute_check(archive: DataFrame, extracted: DataFrame, size: int = 5, seed: int = 0) -> DataFrame:
    """Cosine of sampled entries with the vectors extracted anew from their references (ref_path, new_vec); ok from ``SAME`` on."""
    new = extracted.select(F.col("ref_path").alias("_r"), "new_vec")
    met = sample_of(archive, size, seed).join(new, F.col("ref_path") == F.col("_r"))
    return met.select("seq", "ref_path", "person", "lang", s.cosine(F.col("vec"), F.col("new_vec")).alias("cos")).withColumn("ok", F.col("cos") >= SAME)
