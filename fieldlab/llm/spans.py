"""Places of all matches of a pattern, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (s, e, m) with code points [s, e) and the text of ``group``.

    Splitting at the pattern gives the gaps between the same matches, so places
    are running sums of gap and match lengths.
    """
    def placed(found):
        def walk(gaps):
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

            def step(acc, i):
                s = acc["at"] + F.length(F.get(gaps, i))
                e = s + F.length(F.get(found, i))
                m = F.regexp_extract(F.get(found, i), pattern, group) if group else F.get(found, i)
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(
                    F.struct(s.alias("s"), e.alias("e"), m.alias("m")))).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
        return let(F.split(text, pattern, -1), walk)
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def joined(spans: Column) -> Column:
    """kind:start:end, ordered by start, then kind as ranked; spans is an array of (s, rank, e, kind)."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(spans, lambda x: x["kind"] == kind)
