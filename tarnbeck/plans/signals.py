"""Vectors, sound, and scorer columns.

The tables hold no sound, so embeddings stand in: a vector of 64 values is played as 64 samples, repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio, vectors as v
from ..operators import joins
from ..sources import frames
from .base import CONF, Registry, Tables, confidence

R = Registry()
PHRASE_VECTORS = "select label as phrase, arg_min(embedding, vec_id) as p from embeddings group by 1"
DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::double * {1}[i]::double))"


def _phrase_vectors(d: Tables) -> DataFrame:
    """One vector per label: a dictionary of as many rows as there are labels."""
    return d.embeddings.groupBy(F.col("label").alias("phrase")).agg(F.min_by("embedding", "vec_id").alias("p"))


def _beside(d: Tables) -> DataFrame:
    return joins.beside(d.embeddings, _phrase_vectors(d), 1000)


@R.add(f"select vec_id, phrase, round({DOT.format('embedding', 'p')} / sqrt({DOT.format('embedding', 'embedding')} * {DOT.format('p', 'p')}), 5) + 0.0::double as cosine from embeddings, ({PHRASE_VECTORS})")
def cosine_similarity(d: Tables) -> DataFrame:
    return _beside(d).select("vec_id", "phrase", (F.round(v.cosine(F.col("embedding"), F.col("p")), 5) + 0.0).alias("cosine"))


@R.add(f"""select vec_id, arg_max(phrase, s) as phrase, round(max(s), 5) as similarity, max(s) >= 0.65 as fires from (
  select vec_id, phrase, {DOT.format('embedding', 'p')} / sqrt({DOT.format('embedding', 'embedding')} * {DOT.format('p', 'p')}) as s from embeddings, ({PHRASE_VECTORS})) group by 1""")
def semantic_layer_best(d: Tables) -> DataFrame:
    s = _beside(d).withColumn("s", v.cosine(F.col("embedding"), F.col("p")))
    g = s.groupBy("vec_id").agg(F.max_by("phrase", F.struct("s", -F.col("phrase"))).alias("phrase"), F.max("s").alias("m"))
    return g.select("vec_id", "phrase", F.round("m", 5).alias("similarity"), (F.col("m") >= 0.65).alias("fires"))


@R.add(f"select vec_id, round(embedding[1]::double / sqrt({DOT.format('embedding', 'embedding')}), 6) + 0.0::double as first, round(embedding[64]::double / sqrt({DOT.format('embedding', 'embedding')}), 6) + 0.0::double as last from embeddings")
def l2_normalize(d: Tables) -> DataFrame:
    e = d.embeddings.select("vec_id", v.l2_normalize(F.col("embedding")).alias("u"))
    return e.select("vec_id", (F.round(F.col("u")[0], 6) + 0.0).alias("first"), (F.round(F.col("u")[63], 6) + 0.0).alias("last"))


@R.add(f"""select vec_id, arg_min(phrase, struct_pack(d := d, p := phrase)) as reference, round(min(d), 5) + 0.0::double as distance from (select vec_id, phrase, 1 - {DOT.format('embedding', 'p')} / sqrt({DOT.format('embedding', 'embedding')} * {DOT.format('p', 'p')}) as d
  from embeddings, ({PHRASE_VECTORS})) group by 1""")
def nearest_reference(d: Tables) -> DataFrame:
    s = _beside(d).withColumn("d", 1 - v.cosine(F.col("embedding"), F.col("p")))
    g = s.groupBy("vec_id").agg(F.min_by("phrase", F.struct("d", "phrase")).alias("reference"), F.min("d").alias("m"))
    return g.select("vec_id", "reference", (F.round("m", 5) + 0.0).alias("distance"))


@R.add("select vec_id, greatest(embedding[4], embedding[8], embedding[12], embedding[21])::double as p, greatest(embedding[4], embedding[8], embedding[12], embedding[21]) >= 0.1 as over from embeddings")
def class_subset_max(d: Tables) -> DataFrame:
    m = v.subset_max(F.col("embedding"), [3, 7, 11, 20])
    return d.embeddings.select("vec_id", m.cast("double").alias("p"), (m >= 0.1).alias("over"))


@R.add(f"select event_id, round(0.15::double * {CONF} + 0.8::double * ((event_id % 10) / 10.0::double) + 0.05::double * (1 - {CONF}), 9) as score from events")
def weighted_score(d: Tables) -> DataFrame:
    c = confidence()
    return d.events.select("event_id", F.round(0.15 * c + 0.8 * (F.col("event_id") % 10 / 10.0) + 0.05 * (1 - c), 9).alias("score"))


@R.add("select vec_id, round(1 / (1 + exp(embedding[2]::double - embedding[1]::double)), 9) as p from embeddings")
def softmax_binary(d: Tables) -> DataFrame:
    return d.embeddings.select("vec_id", F.round(v.softmax_binary(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")), 9).alias("p"))


#: Warping in DuckDB: cell after cell of the table of eight by eight frames, with the last nine cells at hand.
FRAMES = "list_transform(range(8), lambda f: list_transform({0}[8 * f + 1:8 * f + 8], lambda x: x::double))"
UNIT = "list_transform({0}, lambda f: list_transform(f, lambda x: x / greatest(sqrt(list_sum(list_transform(f, lambda y: y * y))), 1e-12)))"
WARPED = f"""with recursive v as (select vec_id, {UNIT.format(FRAMES.format('embedding'))} as u from embeddings), w as (select phrase, {UNIT.format(FRAMES.format('p'))} as q from ({PHRASE_VECTORS})),
c as (select vec_id, phrase, list_transform(range(64), lambda k: 1 - list_dot_product(u[k // 8 + 1], q[k % 8 + 1])) as cost from v, w),
t as (select vec_id, phrase, cost, 0 as k, list_concat(list_transform(range(8), lambda i: 'inf'::double), [cost[1]]) as last from c
  union all select vec_id, phrase, cost, k + 1, list_append(last[2:9], cost[k + 2] + least(last[2],
    case when (k + 1) % 8 > 0 then last[9] else 'inf'::double end, case when (k + 1) % 8 > 0 then last[1] else 'inf'::double end)) from t where k < 63),
d as (select vec_id, phrase, last[9] / 8 as distance from t where k = 63)"""


@R.add(WARPED + " select vec_id, phrase, round(distance, 6) + 0.0::double as distance from d")
def dtw_distance(d: Tables) -> DataFrame:
    """Each vector as eight frames of eight values, against each phrase's."""
    return _beside(d).select("vec_id", "phrase", (F.round(v.dtw_column(8)(F.col("embedding"), F.col("p")), 6) + 0.0).alias("distance"))


@R.add(WARPED + """ select vec_id, case when distance <= 0.18 then phrase end as phrase, round(distance, 6) + 0.0::double as distance from (
  select vec_id, min(distance) as distance, arg_min(phrase, struct_pack(d := distance, p := phrase)) as phrase from d group by 1)""")
def kws_spot(d: Tables) -> DataFrame:
    """The nearest phrase by warping distance, where it is near enough."""
    s = _beside(d).withColumn("distance", v.dtw_column(8)(F.col("embedding"), F.col("p")))
    g = s.groupBy("vec_id").agg(F.min_by("phrase", F.struct("distance", "phrase")).alias("phrase"), F.min("distance").alias("distance"))
    return g.select("vec_id", F.when(F.col("distance") <= 0.18, F.col("phrase")).alias("phrase"), (F.round("distance", 6) + 0.0).alias("distance"))


def _sound(d: Tables) -> DataFrame:
    """``vec_id, pcm``: each vector's values as samples, 50 times over (200 ms)."""

    @F.pandas_udf("binary")
    def play(e: pd.Series) -> pd.Series:
        return e.map(lambda x: audio.to_pcm(np.tile(np.asarray(x, np.float64) * 3, 50)))

    return d.embeddings.select("vec_id", "label", play("embedding").alias("pcm"))


#: The same in DuckDB: a list of samples, their level, and what sound becomes when it is written again.
SAMPLES = "list_transform(embedding, lambda e: trunc(greatest(-1.0::double, least(1.0::double, e::double * 3)) * 32767) / 32768.0::double)"
LEVEL = "sqrt(list_sum(list_transform({0}, lambda x: x * x)) / len({0}))"
WRITTEN = "list_transform({0}, lambda y: trunc(greatest(-1.0::double, least(1.0::double, y)) * 32767) / 32768.0::double)"


def _gained(db: float) -> str:
    return WRITTEN.format(f"list_transform({SAMPLES}, lambda z: z * {10 ** (db / 20)!r}::double)")


def _measured(name: str, measure: Column) -> Column:
    return F.round(measure, 6).alias(name)


def _rms(pcm: Column) -> Column:
    return audio.column(_rms_of, "double")(pcm)


def _rms_of(pcm: bytes) -> float:
    x = audio.to_float(pcm)
    return float(np.sqrt(np.mean(x**2))) if len(x) else 0.0


@R.add(f"select vec_id, cast(50 * len(embedding) as int) as n_samples, round({LEVEL.format(SAMPLES)}, 6) as rms from embeddings")
def pcm_to_float(d: Tables) -> DataFrame:
    return _sound(d).select("vec_id", (F.octet_length("pcm") / 2).cast("int").alias("n_samples"), _measured("rms", _rms(F.col("pcm"))))


@R.add(f"select vec_id, round(least(1.0, greatest(0.0, ({LEVEL.format(SAMPLES)} - {audio.QUIET_RMS!r}) / ({audio.LOUD_RMS!r} - {audio.QUIET_RMS!r}))), 6) as energy from embeddings")
def energy_score(d: Tables) -> DataFrame:
    return _sound(d).select("vec_id", _measured("energy", audio.column(audio.energy, "double")(F.col("pcm"))))


def _roughness(pcm: Column) -> Column:
    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        return audio.roughness_batch(p)

    return run(pcm)


@R.add()
def pitch_score(d: Tables) -> DataFrame:
    """How far the pitch of each sound lies above an ordinary voice's."""
    return _sound(d).select("vec_id", _measured("pitch", audio.column(audio.pitch_elevation, "double")(F.col("pcm"))))


@R.add()
def roughness_score(d: Tables) -> DataFrame:
    return _sound(d).select("vec_id", _measured("roughness", _roughness(F.col("pcm"))))


@R.add()
def audio_muffle(d: Tables) -> DataFrame:
    return _sound(d).select("vec_id", _measured("rms", _rms(audio.column(audio.muffle, "binary")(F.col("pcm")))), _measured("phone_rms", _rms(audio.column(audio.phone, "binary")(F.col("pcm")))))


@R.add()
def audio_add_noise(d: Tables) -> DataFrame:
    return _sound(d).select("vec_id", _measured("rms", _rms(audio.column(audio.add_noise, "binary", 10.0, "crowd")(F.col("pcm")))))


_BOTH = WRITTEN.format("list_transform(list_zip(s, o), lambda t: (t[1] + t[2]) * 0.5::double)")


@R.add(f"""with s as (select vec_id, label, {SAMPLES} as s from embeddings), f as (select label, arg_min(s, vec_id) as o from s group by 1)
select vec_id, round({LEVEL.format("m")}, 6) as rms from (select vec_id, {_BOTH} as m from s join f using (label))""")
def audio_overlap(d: Tables) -> DataFrame:
    first = _sound(d).groupBy("label").agg(F.min_by("pcm", "vec_id").alias("other"))
    return _sound(d).join(first, "label").select("vec_id", _measured("rms", _rms(audio.column(audio.overlap, "binary")(F.col("pcm"), F.col("other")))))


@R.add(f"select vec_id, round({LEVEL.format(_gained(-12.0))}, 6) as quiet, round({LEVEL.format(_gained(12.0))}, 6) as loud from embeddings")
def audio_gain_clip(d: Tables) -> DataFrame:
    return _sound(d).select("vec_id", _measured("quiet", _rms(audio.column(audio.gain, "binary", -12.0)(F.col("pcm")))), _measured("loud", _rms(audio.column(audio.gain, "binary", 12.0)(F.col("pcm")))))


@R.add()
def si_sdr(d: Tables) -> DataFrame:
    """Sound with noise against itself; both sides in one function, so noisy sounds are neither sent back nor held for a batch."""
    return _sound(d).select("vec_id", F.round(audio.column(_noisy_sdr, "double")(F.col("pcm")), 4).alias("db"))


def _noisy_sdr(pcm: bytes) -> float:
    return audio.si_sdr(audio.add_noise(pcm, 10.0, "traffic"), pcm)


@R.add()
def wav_decode_resample(d: Tables) -> DataFrame:
    """Sound as WAV files of 8 kHz, decoded and brought to 16 kHz."""
    wav = audio.column(audio.write_wav, "binary", 8000)(F.col("pcm"))
    pcm = audio.column(audio.read_wav, "binary")(wav)
    return _sound(d).select("vec_id", (F.octet_length(pcm) / 2).cast("int").alias("n_samples"), _measured("rms", _rms(pcm)))


@R.add("select event_id as seq, user_id as journey, value as client_ts, cast(length(event_type) as int) as n_bytes from events")
def frame_header_unpack(d: Tables) -> DataFrame:
    """Frames of number, time and body packed as they are sent, and taken apart again."""
    packed = d.events.select(F.col("user_id").alias("journey"), frames.pack(F.col("event_id"), F.col("value"), F.encode("event_type", "utf-8")).alias("frame"))
    return frames.unpack(packed, "frame").select("seq", "journey", "client_ts", F.octet_length("pcm").alias("n_bytes"))


@R.add("select label as phrase_id, cast(count(*) as int) as n_references, cast(count(*) * 8 as int) as n_frames from embeddings group by 1")
def reference_bank_load(d: Tables) -> DataFrame:
    """A bank of reference arrays stored under ``<phrase>__<number>``, loaded and counted by phrase."""
    return frames.bank_summary(d.embeddings, "label", "vec_id", "embedding", 8)


@R.add("select 'j' || j as journey_id, s as seq, round(1000.0::double * j + s * 0.5::double, 3) as client_ts, 320 as n_bytes from range(5) a(j), range(40) b(s)")
def frame_stream_source(d: Tables) -> DataFrame:
    """The frame source read as a batch: every frame of every journey of a fixed plan."""
    frames.register(d.spark)
    return d.spark.read.format("tarnbeck_frames").option("journeys", 5).option("frames", 40).load().select("journey_id", "seq", F.round("client_ts", 3).alias("client_ts"), F.octet_length("pcm").alias("n_bytes"))


@R.add()
def logreg_intent(d: Tables) -> DataFrame:
    """A logistic classifier over embeddings (label 0 against the rest), with its accuracy on the rest of the rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = d.embeddings.select("vec_id", array_to_vector("embedding").alias("features"), (F.col("label") == 0).cast("double").alias("label"))
    split = F.crc32(F.col("vec_id").cast("string")) % 4
    model = LogisticRegression(regParam=0.1, maxIter=20).fit(e.where(split != 2))
    p = model.transform(e).select("vec_id", vector_to_array("probability")[1].alias("p"), "label", (split == 2).alias("held_out"))
    return p.select("vec_id", "held_out", F.round("p", 4).alias("p"), ((F.col("p") >= 0.5).cast("double") == F.col("label")).alias("right"))
