"""Scalar functions on text: mentions, paths, suggestions, fingerprints, truth values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Characters of a target or file name, for mentions of a whole token.
TOKEN = r"A-Za-z0-9_:.+-"


def mentions_token(text: Column, token: str) -> Column:
    """The token stands alone in the text, between characters that no name holds."""
    return text.rlike(f"(^|[^{TOKEN}]){re.escape(token)}($|[^{TOKEN}])")


def mentions_word(text: Column, word: str) -> Column:
    return text.rlike(f"(^|[^A-Za-z0-9_]){re.escape(word)}($|[^A-Za-z0-9_])")


def under(path: str, prefix: str) -> Column:
    """The path is the prefix or below it, by whole components."""
    return (F.col(path) == F.col(prefix)) | F.startswith(path, F.concat(prefix, F.lit("/")))


def full_commit(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]{40}$")


def is_true(value: Column) -> Column:
    """Truth of a value in build scripts: neither a false constant, nor empty, nor a not-found marker."""
    v = F.upper(F.trim(value))
    return ~(v.isin("", "0", "OFF", "NO", "FALSE", "N", "IGNORE", "NOTFOUND") | v.endswith("-NOTFOUND"))


def shorten(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def same_library(written: Column, target: Column, name: str) -> Column:
    """A link item names this library: by its target or its own text, or by its file's name without folder, -l, lib and extension, or by what follows the last :: in any case."""
    file = F.regexp_replace(F.regexp_extract(written, r"[^/\\\\]*$", 0), "^(?:-l)+", "")
    stem = F.regexp_replace(F.regexp_extract(file, r"^(.*)\.(?:a|so|dylib|lib|tbd)$", 1), r"\.so\..*$", "")
    spaced = F.lower(F.regexp_extract(written, "::([^:]*)$", 1))
    return F.coalesce(target == name, F.lit(False)) | (written == name) | (file == name) | (stem == name) | (stem == f"lib{name}") | (written.contains("::") & (spaced == name.lower()))


def human_time(micros: Column) -> Column:
    """Microseconds as `12 us`, `3.4 ms` or `5.67 s`."""
    return F.when(micros < 1000, F.concat(micros.cast("string"), F.lit(" us"))).when(micros < 1_000_000, F.concat(F.format_string("%.1f", micros / 1000), F.lit(" ms"))).otherwise(F.concat(F.format_string("%.2f", micros / 1_000_000), F.lit(" s")))


def line_and_column(text: Column, offset: Column) -> Column:
    """line and column, from 0, of a byte offset into the UTF-8 text; columns count UTF-16 units, as editors do. An offset inside a character means that character."""
    whole = F.encode(text, "UTF-8")
    # bytes that continue a character are passed over backwards, at most three of them
    at = F.least(F.greatest(offset, F.lit(0)), F.octet_length(whole))
    inside = lambda i: F.conv(F.hex(F.substring(whole, i + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)
    for _ in range(3):
        at = F.when(F.coalesce(inside(at), F.lit(False)), at - 1).otherwise(at)
    before = F.decode(F.substring(whole, F.lit(1), at), "UTF-8")
    last = F.substring_index(before, "\n", -1)
    return F.struct((F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))).alias("line"), (F.octet_length(F.encode(last, "UTF-16LE")) / 2).cast("int").alias("column"))


def word_at(line: Column, column: Column) -> Column:
    """The name that spans or touches a place of a line, counted in characters from 0; null where none does."""
    word = F.concat(F.regexp_extract(F.substring(line, F.lit(1), column), "[A-Za-z0-9_]*$", 0), F.regexp_extract(F.substring(line, column + 1, F.char_length(line)), "^[A-Za-z0-9_]*", 0))
    return F.when(word != "", word)


def suggestions(names: DataFrame, known: DataFrame) -> DataFrame:
    """Nearest other known name within two edits, by distance, then name. Pairs meet on length, so no cross join."""
    a = names.select("name", F.explode(F.sequence(F.char_length("name") - 2, F.char_length("name") + 2)).alias("n"))
    b = known.select(F.col("name").alias("suggestion"), F.char_length("name").alias("n"))
    near = a.join(b, "n").where("name <> suggestion").withColumn("distance", F.levenshtein("name", "suggestion", 2)).where("distance >= 0")
    best = W.partitionBy("name").orderBy("distance", "suggestion")
    return near.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("name", "suggestion", "distance")


@F.pandas_udf(T.StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return texts.map(one)


def fnv1a(text: Column) -> Column:
    """FNV-1a, 64 bits, in hex: Spark has no such function."""
    return _fnv(text)
