"""Column functions over times, labels, texts and vectors; all but ``similarity`` stay in generated JVM code."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StructType

_CJK = "[一-鿿]"


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share; 0 if they do not meet."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of whole milliseconds, negative ones as 0."""
    m = F.greatest(F.lit(0), ms).cast("long")
    part = lambda unit, wrap=None: F.floor(m / unit) if wrap is None else F.floor(m / unit) % wrap
    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000), part(60_000, 60), part(1000, 60), m % 1000)


def minutes_seconds(seconds: Column) -> Column:
    """MM:SS with minutes unbounded."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def parse_length(text: Column) -> Column:
    """Seconds of ``m:s`` or ``h:m:s``; null for any other shape."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda x: F.expr("NULL") if x is None else x.try_cast("int"))
    return F.when(F.size(parts) == 2, parts[0] * 60 + parts[1]).when(F.size(parts) == 3, F.get(parts, 0) * 3600 + F.get(parts, 1) * 60 + F.get(parts, 2))


def parse_length_any(text: Column) -> Column:
    """Seconds of fields in base 60, however many."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.try_cast("long"))


def norm_part(part: Column) -> Column:
    """Part number of ``1``, ``"1"`` or ``P1``; null if there is none."""
    return F.regexp_replace(F.lower(F.trim(part)), "^p", "").try_cast("int")


def norm_part_or_text(part: Column) -> Column:
    """The part's number as text, or what stands there trimmed, lower-cased and without its ``p`` if it is no number; null for none."""
    bare = F.regexp_replace(F.lower(F.trim(part)), "^p", "")
    return F.coalesce(bare.try_cast("int").cast("string"), F.nullif(bare, F.lit("")))


def epoch_date(seconds: Column) -> Column:
    """UTC date of an epoch."""
    return F.to_date(F.timestamp_seconds(seconds))


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"\s+", "")


def clean_badge(text: Column) -> Column:
    """Text without badge remnants: short ASCII runs at an edge beside CJK go; without CJK only a long ASCII token stays."""
    plain = F.when(text.rlike(r"^[0-9A-Za-z.%]{6,}$"), text).otherwise(F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, rf"^[0-9A-Za-z.]{{1,5}}(?={_CJK})", ""), rf"(?<={_CJK})[0-9A-Za-z.]{{1,5}}$", "")
    return F.when(text.rlike(_CJK), F.trim(bare)).otherwise(plain)


def speaker_tag(text: Column) -> Column:
    """Speaker of a leading ``[SPK_n]``; SPK_00 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^\[(SPK_\d+)\]", 1), F.lit("")), F.lit("SPK_00"))


def dub_text(text: Column) -> Column:
    """Text without its tag, white space squeezed to single spaces."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^\[SPK_\d+\]\s*", ""), r"\s+", " ")


def sanitize_title(title: Column) -> Column:
    """A file name of at most 60 characters."""
    return F.substring(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|\r\n\t]', "_")), 1, 60)


def speaker_label(label: Column) -> Column:
    return F.replace(label, F.lit("SPEAKER_"), F.lit("SPK_"))


#: Where an address of the page's own folders lies among the files.
FOLDERS = (("/audio/", "work/web/audio/"), ("/refs/", "refs/"), ("/work/", "work/"))


def file_of_url(url: Column) -> Column:
    """The relative file of an address: back slashes turned, the folders' prefixes mapped, others as they are; null for empty ones."""
    bare = F.nullif(F.trim(F.replace(url, F.lit("\\"), F.lit("/"))), F.lit(""))
    out = bare
    for prefix, folder in reversed(FOLDERS):
        out = F.when(bare.startswith(prefix), F.concat(F.lit(folder), F.substr(bare, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def url_of_file(path: Column, bases: tuple[tuple[str, str], ...], videos: tuple[str, ...] = (".mp4", ".mkv", ".flv", ".mov", ".webm")) -> Column:
    """The address of a file: the first base folder that holds it gives the prefix, a video elsewhere is media by its name; null otherwise."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    out = F.when(F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*videos), F.concat(F.lit("/media/"), name))
    for folder, prefix in reversed(bases):
        out = F.when(path.startswith(folder), F.concat(F.lit(prefix), F.substr(path, F.lit(len(folder) + 1)))).otherwise(out)
    return F.when(F.nullif(path, F.lit("")).isNotNull(), out)


def engine_of(kind: Column, engine: str) -> Column:
    """Engine of a speaker's voice: clones go to the cloning engine where it may be used, everything else to the preset one, or silence."""
    rest = F.lit("edge" if engine in ("edge", "auto") else "silence")
    return F.when((kind == "clone") & F.lit(engine in ("auto", "cosyvoice3")), F.lit("cosyvoice3")).otherwise(rest)


def total_duration(given: Column, probed: Column, recorded: Column, last_line: Column) -> Column:
    """Length of a part: what is given, else probed, else on record, else the last line's end; only positive numbers count, but of the last."""
    positive = lambda c: F.when(c > 0, c.cast("double"))
    return F.coalesce(positive(given), positive(probed), positive(recorded.try_cast("double")), last_line.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine: products over the shorter length, norms over the whole; 0 for a zero vector."""
    bottom = norm(a) * norm(b)
    return F.when(bottom == 0, F.lit(0.0)).otherwise(dot(a, b) / bottom)


def _sorted_fields(value: Column, kind) -> Column:
    if isinstance(kind, StructType):
        fields = [_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda _, x: _sorted_fields(x, kind.valueType)))))
    return value


def canonical_json(value: Column, kind) -> Column:
    """JSON text of a column of type ``kind`` with the keys of all structs and maps in order, however deep."""
    return F.to_json(_sorted_fields(value, kind), {"ignoreNullFields": "false"})


def content_hash(json: Column) -> Column:
    """12 hex digits of the SHA-256 of a canonical JSON text."""
    return F.substring(F.sha2(json, 256), 1, 12)


def norm_use(use: Column) -> Column:
    """Use of a recording: clone if null or empty; anything but clone and voiceid is an error."""
    found = F.coalesce(F.nullif(use, F.lit("")), F.lit("clone"))
    return F.when(found.isin("clone", "voiceid"), found).otherwise(F.raise_error(F.concat(F.lit("unknown use "), found)).cast("string"))


def score_bin(score: Column, width: float = 0.02) -> Column:
    """Lower edge of a score's bin, as a key of two decimals."""
    return F.format_string("%.2f", F.floor(score / width) * width)


def suggestion(verdict: Column) -> Column:
    return F.when(verdict.startswith("skip"), F.lit("skip")).otherwise(F.lit("dub"))


def shift_into(t: Column, window_start: Column) -> Column:
    return t - window_start


def sample_index(seconds: Column, rate: int) -> Column:
    """Sample of a time, ties to even."""
    return F.bround(seconds * rate).cast("long")


def title_contains(title: Column, query: str) -> Column:
    return F.contains(F.lower(title), F.lit(query.lower()))


@F.pandas_udf(DoubleType())
def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    found: dict[tuple[str, str], float] = {}
    for pair in zip(a, b, strict=True):
        if pair not in found:
            found[pair] = 0.0 if pair[0] is None else SequenceMatcher(None, *pair).ratio()
    return pd.Series([found[p] for p in zip(a, b, strict=True)])


def most_similar(x: Column, y: Column) -> Column:
    """A bound that the similarity of two texts never passes: letters that both have, each as often as the one that has fewer, twice, over all letters."""
    n, m = F.char_length(x), F.char_length(y)
    letters = F.array_distinct(F.split(x, ""))
    count = lambda text, c: F.char_length(text) - F.char_length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(letters, F.lit(0), lambda total, c: total + F.when(c == "", 0).otherwise(F.least(count(x, c), count(y, c))))
    return F.when(n + m == 0, F.lit(0.0)).otherwise(2.0 * shared / (n + m))


def _open_pair(x: Column, y: Column, threshold: float | None) -> Column:
    """Whether a pair of texts has to be matched: neither is empty, they differ, and the bounds by length and by letters let it reach the threshold."""
    differ = (x != "") & (y != "") & (x != y)
    if threshold is None:
        return differ
    n, m = F.char_length(x), F.char_length(y)
    # CASE tries the cheap bound first
    return F.when(~differ, F.lit(False)).when(2.0 * F.least(n, m) / (n + m) < threshold, F.lit(False)).otherwise(most_similar(x, y) >= threshold)


def similarity(a: Column, b: Column, threshold: float | None = None) -> Column:
    """Ratio of matched blocks, white space aside; empty: 0, equal: 1. With a ``threshold`` pairs that cannot reach it are 0 as well.

    Only pairs that are left are matched in Python: others reach it as nulls, and a batch matches equal pairs once.
    """
    x, y = squeeze(F.coalesce(a, F.lit(""))), squeeze(F.coalesce(b, F.lit("")))
    left = _open_pair(x, y, threshold)
    matched = _matched(F.when(left, x), F.when(left, y))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).when(left, matched).otherwise(F.lit(0.0))
