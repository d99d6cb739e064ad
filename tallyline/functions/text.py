"""Text normalisers, validators, identities and bands, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.params import BANDS, COLOR_WORDS, LOCK_PLATE, NEUTRAL_COLORS, PLATE


def plate_text(x: Column) -> Column:
    """ASCII letters and digits only, then upper case; null is "". Filtering comes first: the upper case of some letters is ASCII."""
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))


def plate_text_upper_first(x: Column) -> Column:
    """Upper case first, then the filter, so that a sharp s becomes SS."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def registry_key(x: Column) -> Column:
    """White space (of all of Unicode), hyphens and dots go; upper case."""
    return F.upper(F.regexp_replace(x, r"(?U)[\s\-.]", ""))


def detected_key(x: Column) -> Column:
    """Only spaces, hyphens and dots go; upper case."""
    return F.upper(F.translate(x, " -.", ""))


def ocr_key(x: Column) -> Column:
    """Upper case first, then as registry_key."""
    return F.regexp_replace(F.upper(x), r"(?U)[\s\-.]", "")


def color_key(x: Column) -> Column:
    return F.upper(F.trim(x))


def is_plate(x: Column) -> Column:
    """Whether a text as it is, not normalised, has the plate format; false for null."""
    return F.coalesce(x.rlike(PLATE), F.lit(False))


def lock_plate(x: Column) -> Column:
    """The normalised text if it is a plate with five digits or more in its serial, else null."""
    norm = plate_text(x)
    return F.when(norm.rlike(LOCK_PLATE), norm)


def colors_equivalent(a: Column, b: Column, neutral: tuple[str, ...] = NEUTRAL_COLORS) -> Column:
    return (a == b) | (a.isin(*neutral) & b.isin(*neutral))


def short_hash(x: Column, n: int) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def identity_group(plate: Column, prefix: str = "vehicle:") -> Column:
    """The group of a plate's identity; null where the plate isn't valid."""
    norm = plate_text(plate)
    return F.when(norm.rlike(PLATE), F.concat(F.lit(prefix), short_hash(norm, 16)))


def source_group(stem: Column) -> Column:
    """The hash group of what stands before an augmentation suffix."""
    return F.concat(F.lit("source:"), short_hash(F.substring_index(stem, ".rf.", 1), 16))


def crop_name(prefix: str, source_sha: Column, rel_path: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%s_%02d.jpg", F.lit(prefix), F.substring(source_sha, 1, 16), short_hash(rel_path, 12), index)


def demo_session_id(video: Column, browser: Column) -> Column:
    return F.concat(F.lit("demo-"), short_hash(F.concat(browser, F.lit(":"), video), 32))


def demo_component_key(video: Column, activation: Column) -> Column:
    return F.concat(F.lit("demo-view-"), short_hash(video, 16), F.lit("-"), activation)


def confidence_band(conf: Column) -> Column:
    """Ten bands of a tenth, and one for 1 and above; null stays null. Doubles throughout, as decimals bin otherwise at the edges."""
    k = F.least(F.floor(conf.cast("double") * F.lit(10.0)), F.lit(9)).cast("int")
    return F.when(conf >= 1.0, BANDS[-1]).when(conf.isNotNull(), F.element_at(F.array(*[F.lit(b) for b in BANDS]), k + 1))


def verified(x: Column) -> Column:
    """true or 1, false or 0 (any case, trimmed), else null: a violation."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def color_of(text: Column) -> Column:
    """The first colour whose word stands in the text, in the order of COLOR_WORDS, else null."""
    low, out = F.lower(text), None
    for word, color in COLOR_WORDS:
        hit = low.contains(word)
        out = F.when(hit, color) if out is None else out.when(hit, color)
    return out


def brand_of(name: Column, brands: list[str]) -> Column:
    """The first of the brands, in order, that the name begins with, case aside."""
    out = None
    for b in brands:
        hit = F.lower(name).startswith(b.lower())
        out = F.when(hit, b) if out is None else out.when(hit, b)
    return out


def mapped(x: Column, names: dict[str, str], default: str | None = None) -> Column:
    """A class name by its lower-cased, trimmed key; the default (null: to be quarantined) otherwise."""
    pairs = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(x))), F.lit(default))


def glob_any(name: Column, patterns: list[str]) -> Column:
    """Whether the name matches any of the case-sensitive globs."""
    import fnmatch

    hit = F.lit(False)
    for p in patterns:
        hit = hit | name.rlike("^" + fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + r"\z")
    return hit


def percent(conf: Column) -> Column:
    return F.round(conf * 100, 2)
