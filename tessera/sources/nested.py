"""Declarative extraction from nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def path(document: str, where: str, kind: str, default=None) -> Column:
    """The value at a path, or the default where the path or the type is missing."""
    found = F.try_variant_get(F.col(document), f"$.{where}", kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def probability(document: str, classifier: str, label: str) -> Column:
    """A class's probability in a classifier's table."""
    return path(document, f"highlevel.{classifier}.all.{label}", "double")


def fields(df: DataFrame, document: str, specs: Sequence[tuple[str, str, str]], keep: Sequence[str]) -> DataFrame:
    """P20: one select of (name, path, type) specs with an availability flag."""
    return df.select(*keep, *(path(document, where, kind).alias(name) for name, where, kind in specs), F.col(document).isNotNull().alias("available"))


# The audio documents' fields (name without its prefix, path), text fields, and the classifiers.
LOW_LEVEL_PATHS: dict[str, str] = {
    "duration_seconds": "metadata.audio_properties.length", "sample_rate": "metadata.audio_properties.sample_rate", "bit_rate": "metadata.audio_properties.bit_rate",
    "channels": "metadata.audio_properties.channels", "codec": "metadata.audio_properties.codec", "average_loudness": "lowlevel.average_loudness",
    "dynamic_complexity": "lowlevel.dynamic_complexity", "loudness_ebu128_integrated": "lowlevel.loudness_ebu128.integrated", "loudness_ebu128_loudness_range": "lowlevel.loudness_ebu128.loudness_range",
    "spectral_centroid_mean": "lowlevel.spectral_centroid.mean", "spectral_centroid_stdev": "lowlevel.spectral_centroid.stdev", "spectral_entropy_mean": "lowlevel.spectral_entropy.mean",
    "spectral_flux_mean": "lowlevel.spectral_flux.mean", "spectral_rolloff_mean": "lowlevel.spectral_rolloff.mean", "zero_crossing_rate_mean": "lowlevel.zerocrossingrate.mean",
    "bpm": "rhythm.bpm", "bpm_histogram_first_peak_bpm": "rhythm.bpm_histogram_first_peak_bpm.mean", "beats_count": "rhythm.beats_count", "danceability": "rhythm.danceability", "onset_rate": "rhythm.onset_rate",
    "key_edma": "tonal.key_edma.key", "scale_edma": "tonal.key_edma.scale", "key_strength_edma": "tonal.key_edma.strength", "key_krumhansl": "tonal.key_krumhansl.key", "scale_krumhansl": "tonal.key_krumhansl.scale",
    "key_strength_krumhansl": "tonal.key_krumhansl.strength", "chords_key": "tonal.chords_key", "chords_scale": "tonal.chords_scale", "chords_changes_rate": "tonal.chords_changes_rate", "tuning_frequency": "tonal.tuning_frequency",
}
LOW_LEVEL_TEXTS = frozenset("codec key_edma scale_edma key_krumhansl scale_krumhansl chords_key chords_scale".split())
LABELS: dict[str, str] = {"highlevel_danceability": "danceability", "gender": "gender"} | {
    m: m for m in "mood_acoustic mood_aggressive mood_electronic mood_happy mood_party mood_relaxed mood_sad timbre tonal_atonal voice_instrumental genre_dortmund genre_electronic genre_rosamerica".split()
}
PROBABILITIES: dict[str, tuple[str, str]] = {"highlevel_danceable_probability": ("danceability", "danceable"), "voice_probability": ("voice_instrumental", "voice"), "instrumental_probability": ("voice_instrumental", "instrumental")} | {
    f"mood_{m}_probability": (f"mood_{m}", m) for m in "acoustic aggressive electronic happy party relaxed sad".split()
}
LOW_LEVEL = [(f"ab_{n}", w, "string" if n in LOW_LEVEL_TEXTS else "double") for n, w in LOW_LEVEL_PATHS.items()]


def high_level(df: DataFrame, document: str, keep: Sequence[str]) -> DataFrame:
    """Each classifier's winning label, and the probability of its named class."""
    labels = [path(document, f"highlevel.{c}.value", "string").alias(f"ab_{n}") for n, c in LABELS.items()]
    shares = [probability(document, c, label).alias(f"ab_{n}") for n, (c, label) in PROBABILITIES.items()]
    return df.select(*keep, *labels, *shares)
