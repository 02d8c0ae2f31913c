"""Geometry of boxes [x0, y0, x1, y1] given as four columns or as an array, and of time and frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @staticmethod
    def from_array(a: Column) -> Box:
        return Box(a[0], a[1], a[2], a[3])

    def array(self) -> Column:
        return F.array(self.x0, self.y0, self.x1, self.y1)

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    def area(self) -> Column:
        """GEO3, sides clamped at 0."""
        return F.greatest(self.width, F.lit(0)) * F.greatest(self.height, F.lit(0))

    def raw_area(self) -> Column:
        """GEO3, as it is."""
        return self.width * self.height

    def intersection(self, other: Box) -> Column:
        w = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        h = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

    def iou(self, other: Box) -> Column:
        """GEO1: null where both are empty (D-11)."""
        inter = self.intersection(other)
        return F.try_divide(inter, self.raw_area() + other.raw_area() - inter)

    def iou_eps(self, other: Box) -> Column:
        """GEO2: a millionth in the denominator, so it is always defined."""
        inter = self.intersection(other)
        return inter / (self.raw_area() + other.raw_area() - inter + 1e-6)

    def containment(self, inner: Box) -> Column:
        """GEO4: the share of `inner` that lies in this box; 0 if it has no area."""
        return F.when(inner.raw_area() <= 0, F.lit(0.0)).otherwise(self.intersection(inner) / inner.raw_area())

    def slide_into(self, frame_width: Column, frame_height: Column) -> Box:
        """GEO6: shifted, size kept; larger than the frame is an error; the left edge is tested before the right."""
        w, h = self.width, self.height
        error = (w > frame_width) | (h > frame_height)

        def axis(a: Column, b: Column, size: Column, limit: Column) -> tuple[Column, Column]:
            low = F.when(error, F.raise_error(F.lit("box exceeds frame")).cast("double")).when(a < 0, F.lit(0)).when(b > limit, limit - size).otherwise(a)
            return low, F.when(a < 0, size).when(b > limit, limit).otherwise(b)

        x0, x1 = axis(self.x0, self.x1, w, frame_width)
        y0, y1 = axis(self.y0, self.y1, h, frame_height)
        return Box(x0, y0, x1, y1)

    def recentre(self, width: Column, height: Column) -> Box:
        """GEO7: same centre, given size."""
        cx, cy = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2
        return Box(cx - width / 2, cy - height / 2, cx + width / 2, cy + height / 2)

    def pad(self, width: Column, height: Column, share: float = 0.1) -> Box:
        """GEO8: a share of each side added on both ends, clipped to the canvas."""
        return Box(self.x0 - self.width * share, self.y0 - self.height * share, self.x1 + self.width * share, self.y1 + self.height * share).clip(width, height)

    def clip(self, width: Column, height: Column) -> Box:
        """GEO9: clipped to the image."""
        return Box(F.greatest(self.x0, F.lit(0)), F.greatest(self.y0, F.lit(0)), F.least(self.x1, width), F.least(self.y1, height))

    def clipped_array(self, width: Column, height: Column) -> Column:
        """GEO9: null where nothing is left."""
        c = self.clip(width, height)
        return F.when((c.x1 > c.x0) & (c.y1 > c.y0), c.array())


def time_to_frame(seconds: Column, fps: Column, n_frames: Column | None = None) -> Column:
    """PRJ2: truncated, and clamped to the last frame where the number of frames is given."""
    frame = (seconds * fps).cast("int")
    return frame if n_frames is None else F.least(frame, n_frames - 1)


def track_audio_window(first: Column, last: Column, fps: Column) -> tuple[Column, Column]:
    """TIM1: seconds of a track's first and last frame, relative to its shot."""
    return F.when(first == 0, F.lit(0.0)).otherwise((first + 1) / fps), (last + 1) / fps


def time_grid(start: Column, end: Column, step: float) -> Column:
    """TIM2: start, start + step, ...; like a half-open range that ends at end + step, it may pass end by one point."""
    last = F.ceil((end + step - start) / step) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: start + i * step)


def common_frames(audio: Column, video: Column, samples_per_frame: int) -> tuple[Column, Column]:
    """TIM3: both streams cut to the whole frames that they have in common."""
    n = F.least(F.floor(F.size(audio) / samples_per_frame), F.size(video)).cast("int")
    return F.slice(audio, F.lit(1), n * samples_per_frame), F.slice(video, F.lit(1), n)


def frame_samples(audio: Column, start: Column, n: int, sample_rate: int, fps: float) -> Column:
    """TIM4: the samples of n frames from a frame on."""
    per = round(sample_rate / fps)
    return F.slice(audio, start * per + 1, F.lit(n * per))


def waveform_slice(audio: Column, start: Column, end: Column, sample_rate: int = 16000) -> Column:
    """SRC17: samples from round(start * rate) to round(end * rate), half to even."""
    a, b = F.bround(start * sample_rate).cast("int"), F.bround(end * sample_rate).cast("int")
    return F.slice(audio, a + 1, F.greatest(b - a, F.lit(0)))


def mono(left: Column, right: Column) -> Column:
    """SRC17: mean of two channels."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def linspace_indices(n: Column, points: int = 16, to_last: bool = False) -> Column:
    """SMP4, ARR4: `points` indices evenly spaced over 0..n, end excluded, truncated; with to_last over 0..n - 1, end included."""
    span, steps = (n - 1, points - 1) if to_last else (n, points)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.floor(i * span / max(steps, 1)).cast("int"))


def every_second(values: Column) -> Column:
    """SMP5."""
    return F.filter(values, lambda v, i: i % 2 == 0)


def fps_grid(duration: Column, segment: Column) -> Column:
    """SMP6: the middle of each segment: segment // 2, then every segment, below duration."""
    first = F.floor(segment / 2)
    return F.when(first < duration, F.sequence(first, duration - 1, segment)).otherwise(F.array().cast("array<bigint>"))


def argsort_desc(scores: Column) -> Column:
    """ARR1: places of the values from the largest to the smallest, earlier places first on ties."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])
