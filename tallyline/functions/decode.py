"""Sequence decoding on arrays, with higher-order functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def argmax(scores: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def ctc_decode(logits: Column, alphabet: str = ALPHABET, blank: int | None = None) -> Column:
    """struct(text, conf) of an array of score rows: best symbol of each row, repeats joined, blanks dropped; conf is the mean probability of emitted rows (0 if none)."""
    blank = len(alphabet) if blank is None else blank
    best = F.transform(logits, lambda r: F.struct(argmax(r).alias("i"), F.array_max(softmax(r)).alias("p")))
    kept = F.filter(best, lambda b, k: (b["i"] != blank) & ((k == 0) | (b["i"] != F.get(best, k - 1)["i"])))
    text = F.array_join(F.transform(kept, lambda b: F.substr(F.lit(alphabet), b["i"] + 1, F.lit(1))), "")
    conf = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b["p"]) / F.size(kept)).otherwise(0.0)
    return F.struct(text.alias("text"), conf.alias("conf"))


def encode_labels(text: Column, alphabet: str = ALPHABET) -> Column:
    """Numbers of the characters; null where one isn't in the alphabet."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.when(~F.exists(codes, lambda c: c < 0), codes)


def ctc_timesteps(text: Column) -> Column:
    """Steps that a label needs: its length and one more for each pair of equal neighbours."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    same = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.size(chars) + F.aggregate(same, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def mean_of_two(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def once(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), with x worked out once for a row: a column that is named several times, or in a lambda, is worked out at each place and for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def reading_order(parts: Column) -> Column:
    """Text of array<struct(text, cx, cy)>: rows from the top (a third of the span of heights parts them, against a row's first part), each left to right."""
    plain = F.transform(parts, lambda p, i: F.struct(p["cy"].cast("double").alias("cy"), i.alias("i"), p["cx"].cast("double").alias("cx"), p["text"].alias("text")))
    return once(F.array_sort(plain), _in_rows)


def _in_rows(ordered: Column) -> Column:
    heights = F.transform(ordered, lambda p: p["cy"])
    limit = F.when(F.size(ordered) >= 2, (F.array_max(heights) - F.array_min(heights)) / 3).otherwise(float("inf"))
    none = F.array().cast("array<struct<row:int,cx:double,i:int,text:string>>")
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), limit.alias("limit"), none.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(p["cy"] - acc["anchor"]) > acc["limit"])
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        item = F.struct(row.alias("row"), p["cx"].alias("cx"), p["i"].alias("i"), p["text"].alias("text"))
        return F.struct(F.when(new, p["cy"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), acc["limit"].alias("limit"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(ordered, zero, step, lambda acc: F.array_join(F.transform(F.array_sort(acc["out"]), lambda x: x["text"]), ""))


def merged_observation(parts: Column, valid_plate: str) -> Column:
    """struct(text, conf) of array<struct(text, conf, y)>: parts from the greatest y, those of two or more letters and digits joined, least conf; if that is no plate, the most confident part that is one; else null."""
    clean = F.transform(parts, lambda p: F.struct((-p["y"]).alias("y"), F.upper(F.regexp_replace(p["text"], "[^A-Za-z0-9]", "")).alias("text"), p["conf"].alias("conf")))
    return once(clean, lambda c: _merged(c, valid_plate))


def _merged(clean: Column, valid_plate: str) -> Column:
    kept = F.array_sort(F.filter(clean, lambda p: F.length(p["text"]) >= 2))
    text = F.array_join(F.transform(kept, lambda p: p["text"]), "")
    joined = F.struct(text.alias("text"), F.array_min(F.transform(kept, lambda p: p["conf"])).alias("conf"))
    whole = once(joined, lambda w: F.when(w["text"].rlike(valid_plate), w))
    single = F.filter(clean, lambda p: p["text"].rlike(valid_plate))
    best = F.array_max(F.transform(single, lambda p: F.struct(p["conf"].alias("conf"), p["text"].alias("text"))))
    return F.coalesce(whole, once(best, lambda b: F.when(b.isNotNull(), F.struct(b["text"].alias("text"), b["conf"].alias("conf")))))


def lines_by_height(lines: Column, raw: bool = False) -> Column:
    """struct(text, conf) of array<struct(text, conf, y_min)>: lines from the top joined, letters and digits only, and the mean confidence of those with
    any, or with raw of those that aren't blank as read; 0 without a text."""
    clean = F.array_sort(F.transform(lines, lambda p, i: F.struct(p["y_min"].alias("y"), i.alias("i"), F.upper(F.regexp_replace(p["text"], "[^A-Za-z0-9]", "")).alias("text"), p["conf"].cast("double").alias("conf"), (F.trim(p["text"]) != "").alias("any"))))
    kept = F.filter(clean, lambda p: p["any"] if raw else p["text"] != "")
    text = F.array_join(F.transform(kept, lambda p: p["text"]), "")
    conf = F.when(text != "", F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["conf"]) / F.size(kept)).otherwise(0.0)
    return F.struct(text.alias("text"), conf.alias("conf"))


def merge_small_bands(counts: Column, least: int = 10) -> Column:
    """array<struct(band, n)> in order to array<struct(bands, n)>: neighbours joined until `least` rows; the last may have fewer."""
    kind = "array<struct<bands:array<string>,n:bigint>>"
    zero = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        more = last.isNotNull() & (last["n"] < least)
        grown = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.array_append(last["bands"], x["band"]).alias("bands"), (last["n"] + x["n"]).alias("n")))
        return F.when(more, grown.cast(kind)).otherwise(F.array_append(acc, F.struct(F.array(x["band"]).alias("bands"), x["n"].cast("bigint").alias("n"))).cast(kind))

    return F.aggregate(counts, zero, step)
