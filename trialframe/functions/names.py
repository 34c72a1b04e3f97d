"""Name and path expressions (X1-X8, X23, X3, Q5). All return Columns built
from built-in functions, so they run inside whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_token(c: str | Column, sep: str = "_") -> Column:
    """Text before the first ``sep`` (subject id from a session id)."""
    return F.split_part(_c(c), F.lit(sep), F.lit(1))


def base_name(c: str | Column) -> Column:
    """Last path segment."""
    return F.substring_index(_c(c), "/", -1)


def strip_ext(c: str | Column) -> Column:
    """File stem: drop the last ``.ext`` if the name has one."""
    return F.regexp_replace(_c(c), r"\.[^./]*$", "")


def drop_last_tokens(c: str | Column, n: int = 3, sep: str = "_", suffix: str = "",
                     strip: bool = True) -> Column:
    """Stem (extension stripped unless ``strip=False``) without its last
    ``n`` ``sep``-tokens, optional suffix added. ``n`` tokens or fewer -> ''."""
    parts = F.split(strip_ext(c) if strip else _c(c), F.lit(re.escape(sep)), -1)
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.lit(n), F.lit(0)))
    return F.concat(F.array_join(kept, sep), F.lit(suffix))


def insert_token(c: str | Column, token: str, from_end: int = 3, sep: str = "_", new_ext: str = "",
                 strip: bool = True) -> Column:
    """Insert ``token`` before the ``from_end``-th token from the end of
    the stem and swap the extension (``a_b_c_d.json`` -> ``a_T_b_c_d.csv``
    for from_end=3)."""
    parts = F.split(strip_ext(c) if strip else _c(c), F.lit(re.escape(sep)), -1)
    n = F.size(parts)
    cut = F.greatest(n - F.lit(from_end), F.lit(0))
    head = F.slice(parts, F.lit(1), cut)
    tail = F.slice(parts, cut + 1, F.greatest(n - cut, F.lit(1)))
    return F.concat(F.array_join(F.concat(head, F.array(F.lit(token)), tail), sep), F.lit(new_ext))


def epoch_from_name(c: str | Column) -> Column:
    """The first 13 digits in a row, else the first 10, else 0, as long (a
    longer run gives its first digits). ``regexp_extract`` gives '' on no
    match, hence the ``nullif``."""
    d13 = F.nullif(F.regexp_extract(_c(c), r"([0-9]{13})", 1), F.lit(""))
    d10 = F.nullif(F.regexp_extract(_c(c), r"([0-9]{10})", 1), F.lit(""))
    return F.coalesce(d13.cast("long"), d10.cast("long"), F.lit(0).cast("long"))


def fps_from_name(c: str | Column) -> Column:
    """``...30fps...`` -> 30, else null."""
    return F.nullif(F.regexp_extract(_c(c), r"(\d+)fps", 1), F.lit("")).cast("int")


def extension(c: str | Column) -> Column:
    """Lower-cased extension without the dot ('' if none)."""
    return F.lower(F.regexp_extract(base_name(c), r"\.([^.]+)$", 1))


def has_extension(c: str | Column, exts: Sequence[str]) -> Column:
    """Extension (lower-cased) in the set."""
    return extension(c).isin([e.lower().lstrip(".") for e in exts])


def fill_template(template: str, **cols: str | Column) -> Column:
    """``"{session_id}_{timestamp}.parquet"`` with each ``{name}``
    replaced by a column's text."""
    out = F.lit(template)
    for k, v in cols.items():
        out = F.replace(out, F.lit("{" + k + "}"), _c(v).cast("string"))
    return out


# ---------------------------------------------------------------- X3 / Q5
# Rules are applied in order; each later rule sees the earlier rule's output
# (first-match-wins would NOT be equivalent). Kinds: "regex" replaces every
# match of the pattern, "map" replaces exact whole values.
Rule = tuple  # ("regex", pattern, replacement, case_insensitive) | ("map", {old: new})

# Fixed values that must equal the reference's task-name normaliser, in its
# order: the 7 steps and the accepted task list after normalising.
TASK_RULES: list[Rule] = [
    ("regex", r".*plr.*", "plr", True),
    ("map", {"aiv": "affective_image_set", "ptsd_image_set": "affective_image_set"}),
    ("regex", r".*affective.*", "affective_image_set", False),
    ("regex", r".*face_pairs.*", "face_pairs", False),
    ("regex", r".*mckinnon.*", "mckinnon", False),
    ("regex", r".*list_learning.*", "list_learning", False),
    ("regex", r".*attention.*", "attention_bias", True),
]
TASK_WHITELIST = ["plr", "calibration_1", "calibration_2", "face_pairs", "mckinnon", "list_learning"]


def apply_rules(c: str | Column, rules: Sequence[Rule]) -> Column:
    """Ordered rule chain as nested built-in expressions."""
    out = _c(c)
    for r in rules:
        if r[0] == "regex":
            _, pat, rep, ci = r
            out = F.regexp_replace(out, F.lit(("(?i)" if ci else "") + pat), F.lit(rep))
        elif r[0] == "map":
            m = r[1]
            e = None
            for k, v in m.items():
                e = F.when(out == F.lit(k), F.lit(v)) if e is None else e.when(out == F.lit(k), F.lit(v))
            out = e.otherwise(out)
        else:
            raise ValueError(f"unknown rule kind {r[0]}")
    return out


def normalise_task(c: str | Column) -> Column:
    return apply_rules(c, TASK_RULES)
