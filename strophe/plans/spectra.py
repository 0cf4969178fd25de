"""Queries on waveforms: the embedding arrays as chunks of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import spectral as X
from strophe.operators import stats as S
from strophe.plans.registry import query, table

# Twenty songs; each vector is a chunk of 64 samples.
RATE, SIZE = 1000.0, 64
_WAVES = """w AS (SELECT vec_id % 20 AS song, (vec_id // 20) * 64 + k - 1 AS p, CAST(embedding[k] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)),
tot AS (SELECT song, count(*) AS n FROM w GROUP BY song)"""


def _waves(spark, sf):
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 20).alias("song"), F.floor(F.col("vec_id") / 20).alias("chunk"), F.col("embedding").alias("x")
    )


def _dft(frames: str, size: int) -> str:
    """Magnitudes of windowed frames f(song, frame_no, m, v) in plain SQL."""
    win = f"(0.5 - 0.5 * cos(2 * pi() * m / {size - 1}))"
    return f"""win AS (SELECT song, frame_no, m, v * {win} AS v FROM {frames}),
    sp AS (SELECT song, frame_no, b, sqrt(pow(sum(v * cos(2 * pi() * b * m / {size})), 2) + pow(sum(v * sin(2 * pi() * b * m / {size})), 2)) AS mag
      FROM win, range(0, {size // 2 + 1}) r(b) GROUP BY song, frame_no, b)"""


@query(
    "band_energy",
    f"""WITH {_WAVES}, fr AS (SELECT song, unnest(range(0, 1 + n // 24)) AS frame_no FROM tot),
    f AS (SELECT fr.song, frame_no, m, coalesce(x, 0.0) AS v FROM fr CROSS JOIN range(0, 32) r(m) LEFT JOIN w ON w.song = fr.song AND w.p = frame_no * 24 - 16 + m),
    {_dft("f", 32)}
    SELECT song, frame_no, round(sqrt(sum(mag * mag) / 8), 6) AS energy FROM sp WHERE b >= 3 AND b < 11 GROUP BY song, frame_no""",
)
def _(spark, sf):
    out = X.band_energy(_waves(spark, sf), ["song"], "chunk", "x", SIZE, RATE, 24, 100.0, 320.0, frame=32)
    return out.withColumn("energy", F.round("energy", 6))


_SPEC = f"""{_WAVES}, fr AS (SELECT song, unnest(range(0, (n - 128) // 40 + 1)) AS frame_no FROM tot WHERE n >= 128),
    f AS (SELECT fr.song, frame_no, m, x AS v FROM fr CROSS JOIN range(0, 128) r(m) JOIN w ON w.song = fr.song AND w.p = frame_no * 40 + m),
    {_dft("f", 128)}"""


def _spectrum(spark, sf):
    return X.spectrum(_waves(spark, sf), ["song"], "chunk", "x", SIZE, 128, 40, 64)


@query(
    "stft_db",
    f"""WITH {_SPEC} SELECT song, frame_no, CAST(b AS INTEGER) AS bin, round(b * 1000.0::DOUBLE / 128, 6) AS hz, round(20 * log10(mag + 0.0000001), 4) AS db FROM sp WHERE b * 1000.0 / 128 >= 50 AND b * 1000.0 / 128 <= 300""",
)
def _(spark, sf):
    out = X.stft_db(_spectrum(spark, sf), ["song"], RATE, 50.0, 300.0)
    return out.withColumn("hz", F.round("hz", 6)).withColumn("db", F.round("db", 4))


@query(
    "octave_fold",
    f"""WITH {_SPEC},
    bands(low, high) AS (VALUES (55.0::DOUBLE, 110.0::DOUBLE), (110.0, 220.0), (440.0, 480.0)),
    spot AS (SELECT low, k, (low + (high - low) * k / 28) / 7.8125::DOUBLE AS spot FROM bands, range(0, 29) r(k)),
    edge AS (SELECT low, k, i, least(i + 1, 64) AS j, least(1.0, greatest(0.0, spot - i)) AS up FROM (SELECT *, least(greatest(CAST(floor(spot + 1e-12) AS BIGINT), 0), 64) AS i FROM spot)),
    av AS (SELECT a.song, a.frame_no, low, k, a.mag * (1 - up) + z.mag * up AS v FROM edge JOIN sp a ON a.b = i JOIN sp z ON z.song = a.song AND z.frame_no = a.frame_no AND z.b = j),
    part AS (SELECT song, frame_no, k - 1 AS cell, greatest(0.0, v - lag(v) OVER (PARTITION BY song, frame_no, low ORDER BY k)) AS x, k FROM av
      UNION ALL SELECT song, frame_no, b - 28, mag, 1 FROM sp WHERE b BETWEEN 28 AND 55)
    SELECT song, frame_no, CAST(cell AS INTEGER) AS cell, round(sum(x), 6) AS level FROM part WHERE k > 0 GROUP BY song, frame_no, cell""",
)
def _(spark, sf):
    """All octaves of the spectra folded onto 220 to 440 Hz."""
    out = X.octave_fold(_spectrum(spark, sf), ["song"], RATE, 128, 55.0, 480.0)
    return out.withColumn("level", F.round("level", 6))


@query(
    "semitone_bins",
    """WITH m AS (SELECT vec_id, embedding, unnest(range(48, 73)) AS midi FROM embeddings),
    b AS (SELECT *, CAST(floor(440 * pow(2.0, (midi - 0.5 - 69) / 12.0) / 10.0) AS BIGINT) AS lo, CAST(ceil(440 * pow(2.0, (midi + 0.5 - 69) / 12.0) / 10.0) AS BIGINT) AS hi FROM m),
    e AS (SELECT vec_id, midi, coalesce(list_sum(list_transform(list_slice(embedding, lo + 1, hi), lambda x: abs(CAST(x AS DOUBLE)))), 0) AS e FROM b)
    SELECT vec_id, CAST(midi AS INTEGER) AS midi, round(e, 6) AS energy, round(20 * log10(e + 0.0000001), 4) AS db FROM e""",
)
def _(spark, sf):
    mags = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf, "embeddings").select("vec_id", mags.alias("mags"))
    out = X.semitone_bins(rows, ["vec_id"], "mags", 1280.0, 128, 48, 72)
    return out.withColumn("energy", F.round("energy", 6)).withColumn("db", F.round("db", 4))


@query(
    "chunk_series",
    """WITH s AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) + CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)) / 2) AS x FROM embeddings),
    c AS (SELECT vec_id, x, unnest(range(0, len(x), 15)) AS p FROM s)
    SELECT vec_id, p // 15 AS chunk_idx, CAST(least(15, len(x) - p) AS INTEGER) AS n, round(list_sum(list_slice(x, p + 1, p + 15)), 6) AS total FROM c WHERE least(15, len(x) - p) >= 8""",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", X.to_mono(F.col("embedding"), F.reverse("embedding")).alias("x")
    )
    out = X.chunk_series(rows, "x", 15, 8)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return out.select("vec_id", "chunk_idx", F.size("x").alias("n"), F.round(total, 6).alias("total"))


@query(
    "fit_frames",
    """WITH e AS (SELECT vec_id, embedding, unnest(range(0, vec_id % 20 + 1)) AS frame_no FROM embeddings)
    SELECT vec_id, frame_no, round(CASE WHEN frame_no < 13 THEN sqrt(list_sum(list_transform(list_slice(embedding, frame_no * 4 + 1, frame_no * 4 + 16), lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 16) ELSE 0 END, 6) AS rms FROM e""",
)
def _(spark, sf):
    base = table(spark, sf, "embeddings")
    levels = base.select("vec_id", F.posexplode(S.framed_rms(F.col("embedding"), 16, 4)).alias("k", "rms"))
    levels = levels.select("vec_id", F.col("k").cast("long").alias("frame_no"), "rms")
    songs = base.select("vec_id", (F.col("vec_id") % 20 + 1).alias("n"))
    return X.fit_frames(levels, songs, ["vec_id"], "n", "rms").withColumn("rms", F.round("rms", 6))
