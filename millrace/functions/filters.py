"""Filter descriptions for audio and video, as Column expressions: each option is a column, null where it isn't set."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _number(c: Column) -> Column:
    """A number as text: integers without a point, others with their shortest form."""
    return c.cast("string")


def _window(kind: str, start: Column, end: Column) -> Column:
    """kind=start=..:end=..; an infinite or null end is left out, and with neither there is no window."""
    infinite = lambda c: c.isNull() | (F.abs(c.cast("double")) == float("inf"))
    ends = F.concat_ws(
        ":",
        F.when(~infinite(start), F.concat(F.lit("start="), _number(start))),
        F.when(~infinite(end), F.concat(F.lit("end="), _number(end))),
    )
    return F.when(ends != "", F.concat(F.lit(f"{kind}="), ends))


def _joined(*parts: Column) -> Column:
    text = F.concat_ws(",", *parts)
    return F.when(text != "", text)


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), _number(c))  # null where c is


def audio_filter(
    *,
    sample_rate: Column | None = None,
    num_channels: Column | None = None,
    sample_fmt: Column | None = None,
    start: Column | None = None,
    end: Column | None = None,
    num_frames: Column | None = None,
    custom: Column | None = None,
) -> Column:
    """Layout, rate, window, fixed length, a filter of one's own, sample format, in this order; null if all are null."""
    none = F.lit(None).cast("string")
    c = lambda x: none if x is None else x
    frames = c(num_frames)
    return _joined(
        F.concat(F.lit("aformat=channel_layouts="), _number(c(num_channels)), F.lit("c")),
        _text("aresample=", c(sample_rate)),
        _window("atrim", c(start), c(end)),
        F.when(frames.isNotNull(), _text("apad,atrim=end_sample=", frames)),
        c(custom),
        _text("aformat=sample_fmts=", c(sample_fmt)),
    )


def video_filter(
    *,
    frame_rate: tuple[Column, Column] | None = None,
    start: Column | None = None,
    end: Column | None = None,
    scale_width: Column | None = None,
    scale_height: Column | None = None,
    scale_algo: str = "bicubic",
    scale_mode: str | None = "pad",
    crop_width: Column | None = None,
    crop_height: Column | None = None,
    pix_fmt: Column | None = None,
    num_frames: Column | None = None,
    pad_color: str | None = None,
    custom: Column | None = None,
) -> Column:
    """Rate, window, scaling (padded, cropped or plain), crop, fixed length, a filter of one's own, pixel format, in this
    order. A size of 0 keeps the original one; null if all are null."""
    if scale_mode not in ("pad", "crop", None):
        raise ValueError(f"scale_mode must be 'pad', 'crop' or None: {scale_mode!r}")
    none = F.lit(None).cast("string")
    c = lambda x: none if x is None else x
    size = lambda w, h: F.concat(F.lit("w="), F.coalesce(_number(c(w)), F.lit("0")), F.lit(":h="), F.coalesce(_number(c(h)), F.lit("0")))
    asked = lambda w, h: c(w).isNotNull() | c(h).isNotNull()
    box = size(scale_width, scale_height)
    fit = {"pad": ":force_original_aspect_ratio=decrease", "crop": ":force_original_aspect_ratio=increase", None: ""}[scale_mode]
    after = {"pad": F.concat(F.lit(",pad="), box, F.lit(f":x=-1:y=-1:color={pad_color or 'black'}")), "crop": F.concat(F.lit(",crop="), box), None: F.lit("")}[scale_mode]
    stop = "tpad=stop=-1:stop_mode=clone" if pad_color is None else f"tpad=stop=-1:stop_mode=add:color={pad_color}"
    return _joined(
        none if frame_rate is None else F.concat(F.lit("fps="), _number(frame_rate[0]), F.lit("/"), _number(frame_rate[1])),
        _window("trim", c(start), c(end)),
        F.when(asked(scale_width, scale_height), F.concat(F.lit("scale="), box, F.lit(f":flags={scale_algo}{fit}"), after)),
        F.when(asked(crop_width, crop_height), F.concat(F.lit("crop="), size(crop_width, crop_height))),
        F.when(c(num_frames).isNotNull(), _text(f"{stop},trim=end_frame=", c(num_frames))),
        c(custom),
        _text("format=pix_fmts=", c(pix_fmt)),
    )


def wnid(path: Column) -> Column:
    """The first class id (n and eight digits) in a path; a path without one fails the query."""
    found = F.regexp_extract(path, "n[0-9]{8}", 0)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no class id in "), path))).otherwise(found)


def audio_source(time_base: tuple[Column, Column], sample_rate: Column, sample_fmt: Column, layout: Column, label: str | None = None) -> Column:
    """The node that feeds audio into a filter graph; with a label, several can be told apart."""
    name = "abuffer" if label is None else f"abuffer@{label}"
    return F.concat(
        F.lit(f"{name}=time_base="), _number(time_base[0]), F.lit("/"), _number(time_base[1]), F.lit(":sample_rate="), _number(sample_rate),
        F.lit(":sample_fmt="), sample_fmt, F.lit(":channel_layout="), layout,
    )


def video_source(width: Column, height: Column, pix_fmt: Column, time_base: tuple[Column, Column], aspect: tuple[Column, Column], label: str | None = None) -> Column:
    """The node that feeds frames into a filter graph."""
    name = "buffer" if label is None else f"buffer@{label}"
    ratio = lambda r: F.concat(_number(r[0]), F.lit("/"), _number(r[1]))
    return F.concat(
        F.lit(f"{name}=video_size="), _number(width), F.lit("x"), _number(height), F.lit(":pix_fmt="), pix_fmt, F.lit(":time_base="), ratio(time_base),
        F.lit(":pixel_aspect="), ratio(aspect),
    )


def filter_for(media: Column, audio: Column, video: Column) -> Column:
    """The description by the kind of media; null for another kind."""
    return F.when(media == "audio", audio).when(media.isin("video", "image"), video)


def rational_window(start, end) -> tuple[tuple[int, int], tuple[int, int]]:
    """A window's ends (numbers, decimals, fractions or their texts) as exact (numerator, denominator) pairs."""
    from fractions import Fraction

    return tuple((f.numerator, f.denominator) for f in (Fraction(start), Fraction(end)))


def before(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Is the rational a below b? By cross-multiplication, exactly; denominators are positive."""
    wide = lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")
    return wide(a[0], b[1]) < wide(b[0], a[1])
