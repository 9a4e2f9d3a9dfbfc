"""Unit parsing. The parsers differ on purpose and stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_mem_mb(s: Column) -> Column:
    """A sampler's memory token in MB: binary for every unit form, bytes
    without one, 0 when it is no number."""
    pattern = r"^([0-9.]+)\s*([A-Za-z]*)"
    s = F.trim(s)
    v, u = F.regexp_extract(s, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(s, pattern, 2))
    return (F.when(v.isNull(), 0.0).when(F.startswith(u, F.lit("g")), v * 1024.0)
            .when(F.startswith(u, F.lit("m")), v).when(F.startswith(u, F.lit("k")), v / 1024.0)
            .when(u.isin("b", ""), v / 1048576.0).otherwise(v))


def host_mem_mib(s: Column) -> Column:
    """MiB of a figure like ``512.3MiB``; null when it is not one."""
    pattern = r"^\s*([\d.]+)\s*([KMGT]?)i?B"
    v, u = F.regexp_extract(s, pattern, 1).try_cast("double"), F.regexp_extract(s, pattern, 2)
    scale = (F.when(u == "", 2.0 ** -20).when(u == "K", 2.0 ** -10).when(u == "M", 1.0).when(u == "G", 2.0 ** 10).otherwise(2.0 ** 20))
    return F.round(v * scale, 1)


def size_bytes(s: Column) -> Column:
    """Bytes of ``59.8MB``: decimal and binary units differ, an unknown unit
    is 0, no number is null."""
    pattern = r"^([\d.]+)\s*([A-Za-z]+)"
    s = F.trim(s)
    v, u = F.regexp_extract(s, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(s, pattern, 2))
    # What a unit stands for.
    units = {"b": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12,
             "kib": 1024.0, "mib": 1024.0 ** 2, "gib": 1024.0 ** 3, "tib": 1024.0 ** 4}
    scale = F.lit(0.0)
    for name, value in units.items():
        scale = F.when(u == name, value).otherwise(scale)
    return v * scale


def cpu_pct(s: Column) -> Column:
    """``12.3%`` as it is, ``15m`` a tenth, a bare number, else 0."""
    s = F.trim(s)
    body = F.left(s, F.length(s) - 1)
    number = (F.when(F.endswith(s, F.lit("%")), body.try_cast("double"))
              .when(F.endswith(s, F.lit("m")), body.try_cast("double") / 10.0).otherwise(s.try_cast("double")))
    return F.coalesce(number, F.lit(0.0))


def cgroup_mem_mb(text: Column) -> Column:
    """Usage less the inactive file cache, in MB; null when unreadable."""
    t = F.split(F.trim(text), r"\s+")
    usage = t[0].try_cast("long")
    at = F.array_position(F.transform(t, lambda x: x.isin("inactive_file", "total_inactive_file")), F.lit(True)).cast("int")
    inactive = F.when(at > 0, F.coalesce(F.try_element_at(t, at + 1).try_cast("long"), F.lit(0))).otherwise(0)
    return F.greatest(usage - inactive, F.lit(0)) / F.lit(1048576.0) + usage * 0


def stats_rows(text: Column) -> Column:
    """Container rows of exactly three tab-separated fields whose CPU parses,
    as an array of (name, cpu_pct, mem_mb)."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda l: F.split(l, "\t")), lambda f: F.size(f) == 3)
    pct = lambda f: F.regexp_replace(F.trim(f[1]), "%+$", "").try_cast("double")
    kept = F.filter(rows, lambda f: pct(f).isNotNull())
    return F.transform(kept, lambda f: F.struct(F.trim(f[0]).alias("name"), pct(f).alias("cpu_pct"),
                                                host_mem_mib(F.split(f[2], "/")[0]).alias("mem_mb")))


def top_last(text: Column) -> Column:
    """The last CPU and load lines of a host report."""
    cpu = r"CPU usage: ([\d.]+)% user, ([\d.]+)% sys, ([\d.]+)% idle"
    last = lambda p, i: F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(i)), F.lit(-1)).try_cast("double")
    return F.struct(last(cpu, 1).alias("cpu_user"), last(cpu, 2).alias("cpu_sys"), last(cpu, 3).alias("cpu_idle"),
                    last(r"Load Avg: ([\d.]+)", 1).alias("load1"))


def sleep_gap(wall: Column, mono: Column) -> Column:
    """Seconds slept: wall less monotonic, 0 up to half a minute."""
    gap = wall - mono
    return F.when(gap > 30.0, gap).otherwise(F.lit(0.0))
