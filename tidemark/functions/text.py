"""Paths, modes and readable numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type bits of a mode and their names.
TYPES = {0o100000: "file", 0o040000: "dir", 0o120000: "symlink", 0o010000: "fifo", 0o140000: "socket", 0o020000: "char", 0o060000: "block"}


def file_type(mode: Column) -> Column:
    """Name of a mode's file type; null for unknown bits."""
    bits, out = mode.bitwiseAND(0o170000), F.lit(None).cast("string")
    for value, name in TYPES.items():
        out = F.when(bits == value, name).otherwise(out)
    return out


def loose_is_directory(mode: Column) -> Column:
    """The directory bit alone, which sockets and block devices also have."""
    return mode.bitwiseAND(0o040000) == 0o040000


def loose_is_file(mode: Column) -> Column:
    """The regular-file bit alone, which symlinks and sockets also have."""
    return mode.bitwiseAND(0o100000) == 0o100000


def is_special(mode: Column) -> Column:
    return file_type(mode).isin("fifo", "socket", "char", "block")


def chmod(mode: Column, new: Column) -> Column:
    return mode.bitwiseAND(0o170000).bitwiseOR(new.bitwiseAND(0o7777))


def without_set_ids(mode: Column) -> Column:
    """The mode after a write: set-user and set-group bits cleared."""
    return mode.bitwiseAND(0o177777 & ~0o6000)


def blocks_512(size: Column) -> Column:
    return F.call_function("div", size + 511, F.lit(512).cast("bigint"))


def valid_name(name: Column, most: int = 255, dots: bool = True) -> Column:
    """Whether a directory entry may have the name; ``.`` and ``..`` may, unless ``dots`` is false."""
    good = (F.octet_length(name).between(1, most)) & ~name.contains("/") & ~name.contains("\x00")
    return good if dots else good & ~name.isin(".", "..")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` folded; ``..`` at the root stays there."""
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(path_parts(path), F.array().cast("array<string>"), step), "/"))


def under(path: Column, prefix: Column) -> Column:
    """Whether a path is the prefix or below it, by components."""
    base = F.rtrim(prefix, F.lit("/"))
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def parent_and_name(path: Column) -> tuple[Column, Column]:
    cut = F.regexp_extract(path, "^(.*)/[^/]+/?$", 1)
    return F.when(cut == "", "/").otherwise(cut), F.regexp_extract(path, "([^/]+)/?$", 1)


def readable_bandwidth(bytes_per_s: Column) -> Column:
    mib = bytes_per_s / (1 << 20)
    return F.when(bytes_per_s == 0, "-").when(mib >= 1024, F.format_string("%.2f GiB/s", mib / 1024)).otherwise(F.format_string("%.1f MiB/s", mib))


def readable_latency(ns: Column) -> Column:
    ms = ns / 1_000_000
    return F.when(ns == 0, "-").when(ms < 0.1, F.format_string("%.1f µs", ns / 1000)).when(ms < 1000, F.format_string("%.2f ms", ms)).otherwise(F.format_string("%.2f s", ms / 1000))


def readable_rate(per_s: Column) -> Column:
    return F.when(per_s == 0, "-").when(per_s >= 1000, F.format_string("%.1fK", per_s / 1000)).otherwise(F.format_string("%.1f", per_s))


def delta_percent(base: Column, new: Column) -> Column:
    """Signed change in per cent with one decimal; empty for a zero base, unless both are zero."""
    delta = (new - base) / F.when(base != 0, base) * 100.0
    text = F.when(delta.isNotNull(), F.concat(F.when(delta >= 0, "+").otherwise(""), F.format_string("%.1f", delta)))
    return F.when((base == 0) & (new == 0), "+0.0").when(base == 0, "").otherwise(text)
