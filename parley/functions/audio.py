"""Levels of audio frames, the one place where a signal is transformed; numpy in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(samples: np.ndarray, rate: int, frame_ms: int = 100, low: int = 4000, high: int = 8000) -> tuple[np.ndarray, np.ndarray]:
    """Decibels of each whole frame of 16-bit samples, over the full band and between ``low`` and ``high`` hertz. A rest shorter than a frame is left out."""
    width = rate * frame_ms // 1000
    x = np.asarray(samples, np.float32)[: len(samples) // width * width].reshape(-1, width) / 32768
    decibels = lambda power, floor: 20 * np.log10(np.sqrt(power + floor) + 1e-12)
    spectrum = np.abs(np.fft.rfft(x * np.hanning(width), axis=1)) ** 2
    at = np.fft.rfftfreq(width, 1 / rate)
    return decibels((x**2).mean(axis=1), 1e-12), decibels(spectrum[:, (at >= low) & (at <= high)].mean(axis=1), 1e-18)


def frame_levels(files: DataFrame, frame_ms: int = 100, piece_s: int = 600) -> DataFrame:
    """(file, frame_no, db, db_h) of recordings (file, rate, samples) or of their pieces (piece, too); pieces but the last are ``piece_s`` seconds long.

    Frames of a piece are numbered on from those before it, so pieces must hold whole frames: ``read_wav``'s do. Rows without samples give none.
    """

    def run(frames):
        for df in frames:
            for file, rate, first, samples in zip(df["file"], df["rate"], df["first"], df["samples"], strict=True):
                db, db_h = levels(samples, int(rate), frame_ms)
                yield pd.DataFrame({"file": file, "frame_no": first + np.arange(len(db)), "db": db.astype(float), "db_h": db_h.astype(float)})

    frames = lambda seconds: F.floor(F.col("rate") * seconds / F.floor(F.col("rate") * frame_ms / 1000))
    first = (F.col("piece") * frames(piece_s)).cast("long") if "piece" in files.columns else F.lit(0).cast("long")
    return files.filter("samples IS NOT NULL").select("file", "rate", first.alias("first"), "samples").mapInPandas(run, "file string, frame_no long, db double, db_h double")
