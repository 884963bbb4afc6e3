"""Workflow operators: catalogue ingest, decisions with merge chains, host checks, and the ledger's state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.carried import fold
from parley.operators.closure import merge_closure

#: (state, event) -> next state; "*" is the state that failed.
EDGES = {
    ("pending_download", "download_done"): "pending_analysis",
    ("pending_download", "fail"): "failed",
    ("pending_analysis", "analysis_done"): "pending_review",
    ("pending_analysis", "fail"): "failed",
    ("pending_review", "review_submit"): "reviewed",
    ("pending_review", "confirm_skip"): "excluded",
    ("pending_review", "rediarize"): "pending_review",
    ("reviewed", "preview_ready"): "preview",
    ("reviewed", "fail"): "failed",
    ("preview", "preview_pass"): "synthesizing",
    ("preview", "preview_reject"): "pending_review",
    ("synthesizing", "full_done"): "delivered",
    ("synthesizing", "fail"): "failed",
    ("failed", "retry"): "*",
}
START = "pending_download"


def next_state(state: Column, event: Column, verdict: Column, failed_from: Column) -> Column:
    """The state after an event; null if the edge does not exist or its verdict gate is shut."""
    target = F.lit(None).cast("string")
    for (a, e), b in EDGES.items():
        target = F.when((state == a) & (event == e), failed_from if b == "*" else F.lit(b)).otherwise(target)
    gate = ((event == "review_submit") & ~(verdict == "dub")) | ((event == "confirm_skip") & ~(verdict == "skip"))
    return F.when(~F.coalesce(gate, F.lit(False)), target)


#: What a verdict opens.
GATES = {"review_submit": "dub", "confirm_skip": "skip"}
_FIELDS = "state string, failed_from string, busy boolean, has_preview boolean, stale boolean, review string, applied long, rejected long"


class Record:
    """An item's record as its events change it: side effects are the busy flag, the stale preview, the review and where it failed."""

    def __init__(self):
        self.state, self.failed_from, self.busy, self.has_preview, self.stale, self.review, self.applied, self.rejected = START, None, False, False, False, None, 0, 0

    def take(self, event: str, verdict: str | None) -> bool:
        """Whether the event had an edge; else nothing but the count of rejections changes."""
        target = EDGES.get((self.state, event))
        target = self.failed_from if target == "*" else target
        if target is None or event in GATES and verdict is not None and verdict != GATES[event]:
            self.rejected += 1
            return False
        self.failed_from = self.state if event == "fail" else None
        self.state, self.busy = target, event in ("review_submit", "preview_pass", "rediarize")
        if event == "preview_ready":
            self.has_preview, self.stale = True, False
        elif event in ("preview_reject", "rediarize") and self.has_preview:
            self.stale = True
        if event in GATES:
            self.review = verdict
        elif event == "rediarize":
            self.review = None
        self.applied += 1
        return True

    def row(self) -> tuple:
        return self.state, self.failed_from, self.busy, self.has_preview, self.stale, self.review, self.applied, self.rejected


def _take(record: Record, x: dict) -> tuple:
    record.take(x["event"], x["verdict"])
    return ()


def replay(events: DataFrame) -> DataFrame:
    """Final record of each item from its events (bvid, part, ord, event, verdict) in order; events without an edge change nothing. A carried scan, which holds the record."""
    kinds = dict(events.dtypes)
    rows = events.select("bvid", "part", "ord", "event", "verdict")
    return fold(rows, ["bvid", "part"], ["ord", "event", "verdict"], f"bvid {kinds['bvid']}, part {kinds['part']}, {_FIELDS}", Record, _take, lambda r: [r.row()])


def insert_absent(batch: DataFrame, ledger: DataFrame, keys: tuple[str, ...] = ("bvid", "part"), order: str = "pos") -> DataFrame:
    """Rows of a batch whose key the ledger does not hold; of equal keys in the batch the first in ``order``."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
    return first.join(ledger.select(*keys), list(keys), "left_anti")


def host_attach(people: DataFrame, part: int) -> DataFrame:
    """Whether a person (name, refs) can be attached as host of a part: ok, and what is wrong with each reference if not."""
    ref = people.select("name", F.posexplode_outer("refs").alias("i", "r"))
    number = F.regexp_replace(F.lower(F.trim(F.col("r.part"))), "^p", "").try_cast("int")
    clone = F.coalesce(F.nullif(F.col("r.use"), F.lit("")), F.lit("clone")) != "voiceid"
    label = F.when(F.trim("r.audio") == "", F.concat(F.lit("refs["), F.col("i").cast("string"), F.lit("]"))).otherwise(F.col("r.audio"))
    problem = F.when(F.trim("r.audio") == "", F.concat(F.lit("no audio: "), label)).when(F.trim("r.transcript") == "", F.concat(F.lit("no transcript: "), label)).when((F.col("r.kind") == "episode") & (number == part), F.concat(F.lit("own part: "), label))
    marked = ref.select("name", F.coalesce(F.col("r").isNotNull() & clone, F.lit(False)).alias("counts"), problem.alias("problem"))
    agg = marked.groupBy("name").agg(F.bool_or(F.col("counts") & F.col("problem").isNull()).alias("ok"), F.sort_array(F.collect_set(F.when(F.col("counts"), F.col("problem")))).alias("found"), F.bool_or("counts").alias("any_clone"))
    return agg.select("name", "ok", F.when(F.col("ok"), F.array().cast("array<string>")).when(~F.col("any_clone"), F.array(F.lit("no clone reference"))).otherwise(F.col("found")).alias("problems"))


def decision_errors(speakers: DataFrame) -> DataFrame:
    """The first complaint about each decision (decision, pos, id, merge_into, voice, …), null if it holds: verdict, ids, merges, rings, voices."""
    ids = speakers.filter("trim(coalesce(id, '')) <> ''")
    twice = Window.partitionBy("decision", "id").orderBy("pos")
    known = ids.select(F.col("decision").alias("_d"), F.col("id").alias("_i")).distinct()
    df = speakers.withColumn("nth", F.row_number().over(twice))
    target = F.nullif(F.trim(F.coalesce("merge_into", F.lit(""))), F.lit(""))
    df = df.withColumn("target", target).join(known, (F.col("decision") == F.col("_d")) & (F.col("target") == F.col("_i")), "left")
    merges = ids.withColumn("target", target).filter("target IS NOT NULL AND target <> id").select("decision", "id", "target").distinct()
    rings = merge_closure(merges).filter("ring").groupBy(F.col("decision").alias("_r")).agg(F.min("id").alias("ring_id"))
    df = df.join(rings, F.col("decision") == F.col("_r"), "left")
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    said = F.when(F.col("verdict") != "dub", F.struct(F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit("verdict is not dub").alias("m")))
    said = said.when(empty("id"), F.struct(F.lit(1).alias("o"), F.col("pos").alias("p"), F.lit("missing id").alias("m")))
    said = said.when(F.col("nth") > 1, F.struct(F.lit(1).alias("o"), F.col("pos").alias("p"), F.concat(F.lit("repeated id "), "id").alias("m")))
    said = said.when(F.col("target").isNotNull() & F.col("_i").isNull(), F.struct(F.lit(2).alias("o"), F.col("pos").alias("p"), F.concat(F.lit("unknown merge target "), "target").alias("m")))
    said = said.when(F.col("target") == F.col("id"), F.struct(F.lit(2).alias("o"), F.col("pos").alias("p"), F.concat(F.lit("merged into itself "), "id").alias("m")))
    said = said.when(F.col("ring_id").isNotNull(), F.struct(F.lit(3).alias("o"), F.lit(0).alias("p"), F.concat(F.lit("merge ring at "), "ring_id").alias("m")))
    alone = F.col("target").isNull() & (F.trim(F.coalesce("voice", F.lit(""))) != "skip")
    voice = F.when(F.col("host"), F.when(empty("host_person"), F.lit("host without person"))).when(F.col("voice") == "clone", F.when(empty("clone_ref"), F.lit("clone without reference"))).when(F.col("voice") == "preset", F.when(empty("preset_voice"), F.lit("preset without voice"))).otherwise(F.lit("no valid voice"))
    said = said.when(alone & voice.isNotNull(), F.struct(F.lit(4).alias("o"), F.col("pos").alias("p"), F.concat(voice, F.lit(" "), "id").alias("m")))
    return df.withColumn("said", said).groupBy("decision").agg(F.min("said").alias("s")).select("decision", F.col("s.m").alias("error"))


def voices(speakers: DataFrame) -> DataFrame:
    """Voice of each speaker that is not merged away: skip before host before clone before preset."""
    alone = speakers.filter("trim(coalesce(merge_into, '')) = '' AND id <> ''")
    kind = F.when(F.col("voice") == "skip", "skip").when(F.col("host"), "host").when(F.col("voice") == "clone", "clone").otherwise("preset")
    df = alone.withColumn("kind", kind)
    return df.select("decision", "pos", "id", "kind", F.when(F.col("kind") == "skip", "skip").otherwise(F.lower("id")).alias("entry"), F.when(F.col("kind") == "host", F.col("host_person")).when(F.col("kind") == "clone", F.col("clone_ref")).when(F.col("kind") == "preset", F.col("preset_voice")).alias("source"))


def cascade_delete(people: DataFrame, archive: DataFrame, gone: DataFrame) -> DataFrame:
    """What goes with deleted references (person, ref_path): kind ref, vector, and file for those of voice identification only."""
    refs = people.select(F.col("name").alias("person"), F.inline("refs")).select("person", F.col("audio").alias("ref_path"), F.coalesce(F.nullif("use", F.lit("")), F.lit("clone")).alias("use"))
    hit = refs.join(gone, ["person", "ref_path"], "left_semi").filter("ref_path <> ''")
    vectors = archive.join(gone.select(F.col("ref_path")).distinct(), "ref_path", "left_semi")
    return (
        hit.select(F.lit("ref").alias("kind"), "person", "ref_path")
        .unionByName(hit.filter("use = 'voiceid'").select(F.lit("file").alias("kind"), "person", "ref_path"))
        .unionByName(vectors.select(F.lit("vector").alias("kind"), "person", "ref_path"))
    )
