"""UDF1 to UDF13: models enter as named functions over columns; none is part of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (input columns, return type). A model of that name must take and give these.
SIGNATURES = {
    "detect": (("image",), "array<struct<box: array<double>, score: double, label: int>>"),
    "segment": (("image", "box"), "binary"),
    "propagate": (("shot", "boxes"), "map<int, binary>"),
    "embed_image": (("image",), "array<float>"),
    "image_text_score": (("image", "text"), "double"),
    "embed_speaker": (("audio",), "array<float>"),
    "transcribe": (("audio",), "array<struct<start: double, end: double, text: string, speaker: string>>"),
    "translate": (("texts",), "array<string>"),
    "describe": (("frames", "prompt"), "string"),
    "summarise": (("text",), "string"),
    "sync": (("clip",), "array<double>"),
    "shots": (("video",), "array<struct<start: int, end: int>>"),
    "mel": (("audio",), "array<array<double>>"),
}
_models: dict[str, Callable[[], Callable]] = {}
_datasets: dict[str, Callable] = {}


def register(name: str, factory: Callable[[], Callable]) -> None:
    """factory() loads the model, once per Python worker, and returns a function from input series to a series."""
    if name not in SIGNATURES:
        raise KeyError(f"no model signature named {name}")
    _models[name] = factory


def model(name: str) -> Callable[..., Column]:
    """The registered model as a column function over Arrow batches."""
    factory, kind = _models[name], SIGNATURES[name][1]

    @F.pandas_udf(kind)
    def apply(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        run = factory()
        for batch in batches:
            yield run(*batch) if isinstance(batch, tuple) else run(batch)

    return apply


def per_movie(rows: DataFrame, name: str, output: str, movie: str = "movie") -> DataFrame:
    """UDF3: rows of a movie together, so that its weights load once; factory(movie) gives the model of that movie."""
    factory, inputs = _models[name], SIGNATURES[name][0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {output} {SIGNATURES[name][1]}"

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, run = None, None
        for batch in batches:
            for value, part in batch.groupby(movie, sort=False):
                if value != now:
                    now, run = value, factory(value)
                yield part.assign(**{output: run(*(part[c] for c in inputs))})

    return rows.repartition(movie).sortWithinPartitions(movie).mapInPandas(f, schema)


def whole_shot(shots: Column, n_frames: Column) -> Column:
    """UDF11: a video without a cut is one shot."""
    return F.when(F.size(shots) > 0, shots).otherwise(F.array(F.struct(F.lit(0).alias("start"), n_frames.cast("int").alias("end"))))


def register_dataset(name: str, loader: Callable) -> None:
    """UDF13."""
    _datasets[name] = loader


def dataset(name: str) -> Callable:
    if name not in _datasets:
        raise KeyError(f"no dataset named {name}; there are {sorted(_datasets)}")
    return _datasets[name]


def mel(audio, sample_rate: int = 16000, n_fft: int = 512, hop: int = 160, win: int = 320, bands: int = 80):  # noqa: ANN001, ANN201
    """UDF12: (frames, bands) log mel energies of a waveform, log(x + 1e-20); a numpy function to register as `mel`."""
    import numpy as np

    x = np.asarray(audio, dtype=float)
    if len(x) < win:
        return np.zeros((0, bands))
    at = np.arange(win)[None, :] + hop * np.arange(1 + (len(x) - win) // hop)[:, None]
    power = np.abs(np.fft.rfft(x[at] * np.hanning(win), n_fft)) ** 2
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(0), to_mel(sample_rate / 2), bands + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(n_fft, 1 / sample_rate)
    up = (freq[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freq[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.log(power @ np.maximum(0, np.minimum(up, down)).T + 1e-20)
