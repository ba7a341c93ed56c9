"""Header functions: layouts of read names, their fields, and the way back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(s: Column, most: int) -> Column:
    """An unsigned decimal up to `most`, else null."""
    value = F.when(s.rlike("^[+]?[0-9]{1,18}$"), s.try_cast("long"))
    return F.when(value <= most, value)


def parse(header: Column) -> Column:
    """struct<fmt, combo, read_num, lane, tile, x, y, umi, comment, prefix, suffix>; fmt is sra, casava or null.

    sra: `@PREFIX.NUMBER A:B:C:LANE:TILE:X:Y[/PAIR]`. casava: `@A:B:C:LANE:TILE:X:Y[:UMI] COMMENT`.
    """
    body = F.regexp_replace(header, "^@", "")
    spaced = F.contains(body, F.lit(" "))
    name = F.when(spaced, F.substring_index(body, " ", 1))
    comment = F.when(spaced, F.substr(body, F.length(name) + 2))
    base = F.substring_index(comment, "/", 1)
    read_num = number(F.substring_index(name, ".", -1), 2**32 - 1)
    a, b = F.split(base, ":", -1), F.split(name, ":", -1)
    part = lambda xs, i: F.get(xs, F.lit(i))
    fields = lambda xs: (number(part(xs, 3), 255), number(part(xs, 4), 65535), number(part(xs, 5), 65535), number(part(xs, 6), 65535))
    combo = lambda xs: F.array_join(F.slice(xs, 1, 3), ":")

    def full(xs: Column) -> Column:
        ok = F.size(xs) >= 7
        for x in fields(xs):
            ok = ok & x.isNotNull()
        return F.coalesce(ok, F.lit(False))

    sra = F.contains(name, F.lit(".")) & read_num.isNotNull() & full(a)
    casava = full(b)
    fmt = F.when(F.coalesce(sra, F.lit(False)), "sra").when(casava, "casava")
    pick = lambda i: F.when(fmt == "sra", fields(a)[i]).when(fmt == "casava", fields(b)[i])
    umi = F.when((fmt == "casava") & (F.size(b) >= 8), F.array_join(F.slice(b, 8, F.greatest(F.size(b) - 7, F.lit(1))), ":"))
    return F.struct(
        fmt.alias("fmt"),
        F.when(fmt == "sra", combo(a)).when(fmt == "casava", combo(b)).alias("combo"),
        F.when(fmt == "sra", read_num).alias("read_num"),
        pick(0).alias("lane"),
        pick(1).alias("tile"),
        pick(2).alias("x"),
        pick(3).alias("y"),
        umi.alias("umi"),
        F.when(fmt == "casava", comment).alias("comment"),
        F.when(fmt == "sra", F.substr(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1)).alias("prefix"),
        F.when(fmt == "sra", F.substr(comment, F.length(base) + 1)).alias("suffix"),
    )


def rebuild(p: Column) -> Column:
    """The header of a parsed struct; null where no layout was found."""
    place = lambda: F.concat_ws(":", p["combo"], p["lane"].cast("string"), p["tile"].cast("string"), p["x"].cast("string"), p["y"].cast("string"))
    sra = F.concat(F.lit("@"), p["prefix"], F.lit("."), p["read_num"].cast("string"), F.lit(" "), place(), p["suffix"])
    casava = F.concat(F.lit("@"), place(), F.when(p["umi"].isNotNull(), F.concat(F.lit(":"), p["umi"])).otherwise(F.lit("")), F.lit(" "), p["comment"])
    return F.when(p["fmt"] == "sra", sra).when(p["fmt"] == "casava", casava)
