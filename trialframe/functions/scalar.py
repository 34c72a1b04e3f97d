"""Scalar expressions (X9-X24): device constants, coordinate conversion,
pass/fail flags, thresholds, bands, code vectors and one-hot lists. Every
function returns a Column of built-ins (no Python UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- X10/X11
# Fixed values that must equal the reference's screen geometry: points per
# inch, and per device family (screen width cm, x offset cm, y offset cm),
# checked in this order by substring; the fourth family is "iPhone N" for N
# in 12..16; anything else takes the last row.
PPI = 460
DEVICE_GEOMETRY = [
    ("Pro Max", 7.12, 2.9, 0.51),
    ("Pro", 6.5, 2.5, 0.47),
    ("Plus", 6.9, 2.6, 0.49),
    ("iPhone 12..16", 6.45, 2.35, 0.5),
    ("other", 6.5, 2.5, 0.5),
]


def device_geometry(device: str | Column) -> Column:
    """struct(screen_cm, x_off, y_off) by substring precedence."""
    d = _c(device)
    fams = DEVICE_GEOMETRY
    cond = [d.contains(fams[0][0]), d.contains(fams[1][0]), d.contains(fams[2][0]),
            F.lit(False)]
    for n in range(12, 17):
        cond[3] = cond[3] | d.contains(f"iPhone {n}")

    def pick(i):
        e = F.when(cond[0], F.lit(fams[0][i]))
        for k in (1, 2, 3):
            e = e.when(cond[k], F.lit(fams[k][i]))
        return e.otherwise(F.lit(fams[4][i]))

    return F.struct(pick(1).alias("screen_cm"), pick(2).alias("x_off"), pick(3).alias("y_off"))


def points_to_cm(pt: str | Column) -> Column:
    """X11: ((pt * 3) / ppi) * 2.54."""
    return ((_c(pt) * 3) / PPI) * 2.54


def true_position(x_pt, y_pt, geom: Column) -> tuple[Column, Column]:
    """X11: x = (screen - x_cm) - x_off ; y = y_cm - y_off (before mirroring)."""
    x = (geom["screen_cm"] - points_to_cm(x_pt)) - geom["x_off"]
    y = points_to_cm(y_pt) - geom["y_off"]
    return x, y


def pass_fail(err_x: Column | None, err_y: Column, thr: float) -> Column:
    """X12: 'fail' if either error >= thr, 'pass' if all < thr, else ''
    (undecidable, e.g. a missing error). ``err_x=None`` checks y only."""
    if err_x is None:
        return F.when(err_y >= thr, "fail").when(err_y < thr, "pass").otherwise("")
    return (F.when((err_x >= thr) | (err_y >= thr), "fail")
            .when((err_x < thr) & (err_y < thr), "pass").otherwise(""))


def to_class(score: str | Column, thr: float = 0.5, strict: bool = False) -> Column:
    """X13."""
    s = _c(score)
    return (s > thr if strict else s >= thr).cast("double")


def bbox(xs: str | Column, ys: str | Column, img_w: Column | float, img_h: Column | float) -> Column:
    """Width, height and area share of the box around a point list."""
    x, y = _c(xs), _c(ys)
    w = F.array_max(x) - F.array_min(x)
    h = F.array_max(y) - F.array_min(y)
    return F.struct(w.alias("bbox_width"), h.alias("bbox_height"),
                    (w * h / (F.lit(img_w) * F.lit(img_h)) * 100).alias("percentage"))


def renormalise_pair(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """When a+b > 1 divide both by a+b."""
    s = _c(a) + _c(b)
    return (F.when(s > 1, _c(a) / s).otherwise(_c(a)), F.when(s > 1, _c(b) / s).otherwise(_c(b)))


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """X19."""
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num/den, 0 when den is 0 (never raises under ANSI)."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(0.0))


def stars(p: str | Column) -> Column:
    """X22."""
    p = _c(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def score_band(s: str | Column) -> Column:
    """< .5 'poor', < .6 'fair', else 'good'."""
    s = _c(s)
    return F.when(s < 0.5, "poor").when(s < 0.6, "fair").otherwise("good")


def out_of_range_count(c: str | Column, lo: float, hi: float) -> Column:
    """Aggregate counting values outside [lo, hi] (0 = assertion holds)."""
    return F.count_if(~_c(c).between(lo, hi))


# ---------------------------------------------------------------- X16/X17
# Fixed values that must equal the reference's task encoders: task codes,
# and per task the ordered category lists of each field (code = position).
TASK_CODES = {"calibration": 0, "plr": 1, "mab": 2, "mckinnon": 3}
MAB_FIELDS = {
    "mab_engagement": ["disengagement", "engagement"],
    "mab_emotion": ["neutral", "happy", "sad", "angry"],
    "mab_emo_location": ["bottom", "top"],
    "mab_dot_location": ["bottom", "top"],
    "mab_cue_location": ["bottom", "top"],
}
MCK_FIELDS = {
    "mck_phase": ["fixation", "image", "blank"],
    "mck_emotion": ["positive", "negative", "neutral", "negative_arousal"],
}
TASK_FIELDS = {"calibration": {}, "plr": {}, "mab": MAB_FIELDS, "mckinnon": MCK_FIELDS}


def category_code(c: str | Column, cats: Sequence[str]) -> Column:
    """Position of the value in ``cats``; an unknown value raises (as the
    reference's dict lookup does), a null stays null."""
    v = _c(c)
    e = F.when(v.isNull(), F.lit(None).cast("int"))
    for i, k in enumerate(cats):
        e = e.when(v == F.lit(k), F.lit(i))
    return e.otherwise(F.raise_error(F.concat(F.lit("unknown category: "), v)).cast("int"))


def task_code_vector(task: str | Column, fields: dict[str, str | Column]) -> Column:
    """array<int> of length 6: [task code, f1..f5] (zeros for tasks
    without fields). ``fields`` maps field name -> column with its text."""
    t = _c(task)
    arrays = []
    for name, code in TASK_CODES.items():
        fs = TASK_FIELDS[name]
        vals = [F.lit(code)] + [category_code(fields[f], cats) for f, cats in fs.items()]
        vals += [F.lit(0)] * (6 - len(vals))
        arrays.append((name, F.array(*[v.cast("int") for v in vals])))
    e = F.when(t == F.lit(arrays[0][0]), arrays[0][1])
    for name, arr in arrays[1:]:
        e = e.when(t == F.lit(name), arr)
    return e.otherwise(F.raise_error(F.concat(F.lit("task not recognized: "), t)).cast("array<int>"))


def one_hot(c: str | Column, cats: Sequence[str]) -> Column:
    """array<double> one-hot over a fixed category list (all zeros for
    a value outside the list)."""
    v = _c(c)
    return F.array(*[(v == F.lit(k)).cast("double") for k in cats])


def task_one_hot(task: str | Column, fields: dict[str, str | Column]) -> dict[str, Column]:
    """``task_1hot`` plus one ``<field>_1hot`` per field of the row's
    task; fields of other tasks are null."""
    t = _c(task)
    out = {"task_1hot": one_hot(t, list(TASK_CODES))}
    for name, fs in TASK_FIELDS.items():
        for f, cats in fs.items():
            out[f"{f}_1hot"] = F.when(t == F.lit(name), one_hot(fields[f], cats))
    return out
