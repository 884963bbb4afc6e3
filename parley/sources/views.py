"""Views of the driver tables in the shape of the dialogue data model, for Spark and as SQL common table expressions.

Times are whole milliseconds: thresholds scale with the unit, and sums stay exact in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Events of the workflow, in the order of their numbers in the view.
EVENTS = ("download_done", "analysis_done", "review_submit", "confirm_skip", "rediarize", "preview_ready", "preview_pass", "preview_reject", "full_done", "fail", "retry")
STATES = ("pending_download", "pending_analysis", "pending_review", "reviewed", "preview", "synthesizing", "delivered", "excluded", "failed")


_VOICE = "transform(embedding, (x, i) -> cast(x AS double) * {} + CASE WHEN i = label THEN cast(1 AS double) ELSE cast(0 AS double) END) AS vec"


class Views:
    """Lazy views over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def intervals(self) -> DataFrame:
        return self.table("events").selectExpr(
            "concat('V', cast(user_id AS string)) AS video_id",
            "event_id",
            "(unix_micros(cast(ts AS timestamp)) div 1000) % 240000 AS t0",
            "(unix_micros(cast(ts AS timestamp)) div 1000) % 240000 + greatest(500, least(cast(round(value * 100) AS bigint), 12000)) AS t1",
            "event_type",
            "value",
        )

    @property
    def segs(self) -> DataFrame:
        return self.intervals.filter("event_id % 2 = 1").selectExpr("video_id", "event_id AS seg_ord", "t0", "t1", "concat('SPK_0', cast((event_id div 2) % 3 AS string)) AS spk")

    @property
    def subs(self) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("video_id").orderBy("t0", "event_id"))
        return self.intervals.filter("event_id % 2 = 0").select("video_id", place.alias("idx"), "event_id", "t0", "t1", F.col("event_type").alias("text"), "value")

    @property
    def tagged(self) -> DataFrame:
        """Subtitle lines with a speaker's tag on two of three."""
        tag = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("[SPK_0"), (F.col("event_id") % 3).cast("string"), F.lit("] "))).otherwise(F.lit(""))
        return self.subs.withColumn("text", F.concat(tag, F.lit(" say  "), "text"))

    @property
    def archive(self) -> DataFrame:
        """Voices of people: their label's direction and some of the table's own. The first few are of a language of their own, too few to calibrate."""
        return self.table("embeddings").filter("vec_id % 5 <> 0").selectExpr(
            "vec_id AS seq",
            "concat('P', cast(label AS string)) AS person",
            "CASE WHEN vec_id < 5 THEN 'ko' ELSE element_at(array('zh', 'en', 'ja'), cast(vec_id % 3 AS int) + 1) END AS lang",
            _VOICE.format("CAST(0.4 AS DOUBLE)"),
            "concat('r', cast(vec_id AS string)) AS ref_path",
        )

    @property
    def speakers(self) -> DataFrame:
        """Speakers with a voice near their person's, but every third, which is near nobody's."""
        return self.table("embeddings").filter("vec_id % 5 = 0").selectExpr(
            "concat('V', cast(vec_id % 40 AS string)) AS video_id",
            "concat('SPK_', cast(vec_id AS string)) AS spk",
            "element_at(array('zh', 'en', 'ko', NULL), cast((vec_id div 5) % 4 AS int) + 1) AS lang",
            _VOICE.format("CAST(CASE WHEN vec_id % 3 = 0 THEN 9 ELSE 0.3 END AS DOUBLE)"),
            "concat('P', cast(label AS string)) AS truth",
        )

    @property
    def hits(self) -> DataFrame:
        lines = self.table("documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"), "n_chars")
        return lines.select("video_id", "pos", (F.col("pos").cast("long") * 500).alias("ts"), "text", ((F.col("n_chars") % 100) / 100.0).alias("conf"))

    @property
    def manifest(self) -> DataFrame:
        return self.subs.withColumn("wav_dur", F.expr("CASE WHEN event_id % 17 <> 0 THEN cast(round(value * 50) AS bigint) END"))

    @property
    def frames(self) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return self.table("events").select(F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("file"), (place - 1).alias("frame_no"), (F.least("value", F.lit(60.0)) - 70).alias("db"), (F.least(F.col("value") * 0.5, F.lit(50.0)) - 80).alias("db_h"))

    @property
    def ledger_events(self) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        name = F.element_at(F.array(*map(F.lit, EVENTS)), (F.col("event_id") % 11).cast("int") + 1)
        verdict = F.when(F.col("event_id") % 4 < 3, F.lit("dub")).otherwise(F.lit("skip"))
        return self.table("events").select(F.col("user_id").alias("bvid"), F.lit(1).alias("part"), place.alias("ord"), name.alias("event"), verdict.alias("verdict"))

    @property
    def ledger(self) -> DataFrame:
        part = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
        return self.table("orders").select(
            F.col("o_custkey").alias("bvid"), part.alias("part"), F.element_at(F.array(*map(F.lit, STATES)), (F.col("o_orderkey") % 9).cast("int") + 1).alias("status"), (F.col("o_orderkey") % 3 == 0).alias("busy"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("title"), "o_orderkey"
        )

    @property
    def catalog(self) -> DataFrame:
        length = F.expr("CASE WHEN p_size % 5 = 0 THEN 'n/a' WHEN p_size % 2 = 0 THEN format_string('%d:%02d', p_size, p_size % 60) ELSE format_string('%d:%02d:%02d', p_size % 3, p_size % 60, (p_size * 7) % 60) END")
        return self.table("part").select(F.col("p_partkey").alias("bvid"), F.col("p_name").alias("title"), length.alias("length"), (F.col("p_partkey") * 86400 + 1600000000).alias("created"), (F.col("p_partkey") % 5 == 0).alias("is_charge"))

    @property
    def refs(self) -> DataFrame:
        """People with their reference recordings, as an array of structs."""
        ref = F.struct(
            F.col("vec_id").alias("pos"),
            F.expr("CASE WHEN vec_id % 7 = 0 THEN '' ELSE concat('a', cast(vec_id AS string), '.wav') END").alias("audio"),
            F.expr("CASE WHEN vec_id % 3 = 0 THEN '' ELSE concat('t', cast(vec_id AS string), '.txt') END").alias("transcript"),
            F.expr("CASE WHEN vec_id % 4 = 0 THEN 'voiceid' WHEN vec_id % 4 = 1 THEN 'clone' WHEN vec_id % 4 = 2 THEN '' END").alias("use"),
            F.expr("CASE WHEN vec_id % 2 = 0 THEN 'episode' ELSE 'web' END").alias("kind"),
            F.expr("concat('P', cast(vec_id % 3 AS string))").alias("part"),
        )
        return self.table("embeddings").groupBy(F.expr("vec_id div 4").alias("n")).agg(F.sort_array(F.collect_list(ref)).alias("refs")).select(F.concat(F.lit("N"), F.col("n").cast("string")).alias("name"), "refs")

    @property
    def decisions(self) -> DataFrame:
        """Review decisions, one row for each speaker: id s0..s5 of a decision; merge targets may be missing or form a ring."""
        return self.table("customer").selectExpr(
            "c_custkey div 6 AS decision",
            "cast(c_custkey % 6 AS int) AS pos",
            "CASE WHEN c_custkey % 41 = 0 THEN '' WHEN c_custkey % 47 = 0 THEN 's0' ELSE concat('s', cast(c_custkey % 6 AS string)) END AS id",
            "CASE WHEN c_custkey % 13 = 0 THEN concat('s', cast(c_nationkey % 7 AS string)) END AS merge_into",
            "CASE WHEN c_nationkey % 5 = 0 THEN 'skip' WHEN c_nationkey % 5 < 3 THEN 'clone' WHEN c_nationkey % 5 = 3 THEN 'preset' ELSE CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'clone' END END AS voice",
            "c_custkey % 17 = 0 AS host",
            "CASE WHEN c_custkey % 34 = 0 THEN '' ELSE 'N1' END AS host_person",
            "CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'ref.wav' END AS clone_ref",
            "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'voice-a' END AS preset_voice",
            "CASE WHEN (c_custkey div 6) % 19 = 0 THEN 'skip' ELSE 'dub' END AS verdict",
        )

    @property
    def chains(self) -> DataFrame:
        """Merges of 50 ids to a decision: to the id before, but for every seventh decision some fields on, where rings form. Every ninth id is merged into nothing, but for some decisions."""
        return self.table("customer").selectExpr(
            "c_custkey div 50 AS decision",
            "c_custkey % 50 AS id",
            "CASE WHEN (c_custkey div 50) % 7 = 0 THEN (c_custkey % 50 * 3 + 1) % 50 WHEN (c_custkey div 50) % 5 = 0 THEN (c_custkey % 50 + 49) % 50 ELSE greatest(c_custkey % 50 - 1 - c_nationkey % 3, 0) END AS target",
        ).filter("(decision % 5 = 0 OR id % 9 <> 0) AND NOT (decision % 5 <> 0 AND decision % 7 <> 0 AND id = target)")


_SQL_VOICE = "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * {} + CASE WHEN i = label + 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS vec"
_VIEWS = {
    "v_iv": """SELECT concat('V', CAST(user_id AS VARCHAR)) AS video_id, event_id, (epoch_us(ts) // 1000) % 240000 AS t0,
        (epoch_us(ts) // 1000) % 240000 + greatest(500, least(CAST(round(value * 100) AS BIGINT), 12000)) AS t1, event_type, value FROM events""",
    "v_segs": "SELECT video_id, event_id AS seg_ord, t0, t1, concat('SPK_0', CAST((event_id // 2) % 3 AS VARCHAR)) AS spk FROM v_iv WHERE event_id % 2 = 1",
    "v_subs": "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t0, event_id) AS idx, event_id, t0, t1, event_type AS text, value FROM v_iv WHERE event_id % 2 = 0",
    "v_tagged": "SELECT * REPLACE (concat(CASE WHEN event_id % 3 > 0 THEN concat('[SPK_0', CAST(event_id % 3 AS VARCHAR), '] ') ELSE '' END, ' say  ', text) AS text) FROM v_subs",
    "v_archive": f"""SELECT vec_id AS seq, concat('P', CAST(label AS VARCHAR)) AS person, CASE WHEN vec_id < 5 THEN 'ko' ELSE ['zh', 'en', 'ja'][CAST(vec_id % 3 AS INT) + 1] END AS lang, {_SQL_VOICE.format("CAST(0.4 AS DOUBLE)")},
        concat('r', CAST(vec_id AS VARCHAR)) AS ref_path FROM embeddings WHERE vec_id % 5 <> 0""",
    "v_capped": "SELECT * FROM v_archive QUALIFY row_number() OVER (PARTITION BY person, lang ORDER BY seq DESC) <= 10",
    "v_speakers": f"""SELECT concat('V', CAST(vec_id % 40 AS VARCHAR)) AS video_id, concat('SPK_', CAST(vec_id AS VARCHAR)) AS spk, ['zh', 'en', 'ko', NULL][CAST(vec_id // 5 % 4 AS INT) + 1] AS lang,
        {_SQL_VOICE.format("CAST(CASE WHEN vec_id % 3 = 0 THEN 9 ELSE 0.3 END AS DOUBLE)")}, concat('P', CAST(label AS VARCHAR)) AS truth FROM embeddings WHERE vec_id % 5 = 0""",
    "v_hits": """SELECT doc_id AS video_id, pos - 1 AS pos, CAST((pos - 1) * 500 AS BIGINT) AS ts, lines[pos] AS text, (n_chars % 100) / 100.0 AS conf
        FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)""",
    "v_manifest": "SELECT *, CASE WHEN event_id % 17 <> 0 THEN CAST(round(value * 50) AS BIGINT) END AS wav_dur FROM v_subs",
    "v_frames": """SELECT concat('V', CAST(user_id AS VARCHAR)) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
        least(value, 60.0) - 70 AS db, least(value * 0.5, 50.0) - 80 AS db_h FROM events""",
    "v_ledger_events": f"""SELECT user_id AS bvid, 1 AS part, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, {list(EVENTS)}[CAST(event_id % 11 AS INT) + 1] AS event,
        CASE WHEN event_id % 4 < 3 THEN 'dub' ELSE 'skip' END AS verdict FROM events""",
    "v_ledger": f"""SELECT o_custkey AS bvid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS part, {list(STATES)}[CAST(o_orderkey % 9 AS INT) + 1] AS status,
        o_orderkey % 3 = 0 AS busy, concat('T', CAST(o_custkey AS VARCHAR)) AS title, o_orderkey FROM orders""",
    "v_catalog": """SELECT p_partkey AS bvid, p_name AS title, CASE WHEN p_size % 5 = 0 THEN 'n/a' WHEN p_size % 2 = 0 THEN printf('%d:%02d', p_size, p_size % 60)
        ELSE printf('%d:%02d:%02d', p_size % 3, p_size % 60, (p_size * 7) % 60) END AS length, p_partkey * 86400 + 1600000000 AS created, p_partkey % 5 = 0 AS is_charge FROM part""",
    "v_refs": """SELECT concat('N', CAST(vec_id // 4 AS VARCHAR)) AS name, vec_id AS pos, CASE WHEN vec_id % 7 = 0 THEN '' ELSE concat('a', CAST(vec_id AS VARCHAR), '.wav') END AS audio,
        CASE WHEN vec_id % 3 = 0 THEN '' ELSE concat('t', CAST(vec_id AS VARCHAR), '.txt') END AS transcript,
        CASE WHEN vec_id % 4 = 0 THEN 'voiceid' WHEN vec_id % 4 = 1 THEN 'clone' WHEN vec_id % 4 = 2 THEN '' END AS use,
        CASE WHEN vec_id % 2 = 0 THEN 'episode' ELSE 'web' END AS kind, concat('P', CAST(vec_id % 3 AS VARCHAR)) AS part FROM embeddings""",
    "v_chains": """SELECT * FROM (SELECT c_custkey // 50 AS decision, c_custkey % 50 AS id,
        CASE WHEN c_custkey // 50 % 7 = 0 THEN (c_custkey % 50 * 3 + 1) % 50 WHEN c_custkey // 50 % 5 = 0 THEN (c_custkey % 50 + 49) % 50 ELSE greatest(c_custkey % 50 - 1 - c_nationkey % 3, 0) END AS target FROM customer)
        WHERE (decision % 5 = 0 OR id % 9 <> 0) AND NOT (decision % 5 <> 0 AND decision % 7 <> 0 AND id = target)""",
    "v_decisions": """SELECT c_custkey // 6 AS decision, CAST(c_custkey % 6 AS INT) AS pos,
        CASE WHEN c_custkey % 41 = 0 THEN '' WHEN c_custkey % 47 = 0 THEN 's0' ELSE concat('s', CAST(c_custkey % 6 AS VARCHAR)) END AS id,
        CASE WHEN c_custkey % 13 = 0 THEN concat('s', CAST(c_nationkey % 7 AS VARCHAR)) END AS merge_into,
        CASE WHEN c_nationkey % 5 = 0 THEN 'skip' WHEN c_nationkey % 5 < 3 THEN 'clone' WHEN c_nationkey % 5 = 3 THEN 'preset' ELSE CASE WHEN c_custkey % 11 = 0 THEN 'other' ELSE 'clone' END END AS voice,
        c_custkey % 17 = 0 AS host, CASE WHEN c_custkey % 34 = 0 THEN '' ELSE 'N1' END AS host_person, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE 'ref.wav' END AS clone_ref,
        CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'voice-a' END AS preset_voice, CASE WHEN (c_custkey // 6) % 19 = 0 THEN 'skip' ELSE 'dub' END AS verdict FROM customer""",
}
_NEEDS = {"v_segs": ["v_iv"], "v_subs": ["v_iv"], "v_tagged": ["v_subs"], "v_manifest": ["v_subs"], "v_capped": ["v_archive"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` (further expressions, then the query) after the views it names."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    views = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in order)
    word = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    return word + views + (", " + body[5:] if body.startswith("WITH ") else " " + body)
