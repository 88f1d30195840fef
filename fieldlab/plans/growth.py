"""Weights to growth: dry weight, pre/post change, cleaning, area, assemblage mass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import water
from ..functions.columns import patch_value, percent_change, ratio
from ..operators.aggregates import combine_parts, mean_se, strict
from ..operators.joins import natural_join
from ..operators.verbs import keep_unless, stack
from ..session import small_side


def with_water_density(df: DataFrame, salinity: str, temperature: str, name: str = "sw_dens") -> DataFrame:
    """Seawater density in g per cubic centimetre."""
    return df.withColumn(name, water.density(salinity, temperature) * 0.001)


def dry_weights(df: DataFrame, organism: str, weight: str, salinity: str, temperature: str,
                body_density: Column, standards: Column) -> DataFrame:
    """Dry weight of each underwater weighing; standards and rows without density go."""
    kept = keep_unless(df, standards)
    kept = with_water_density(kept, salinity, temperature).filter(F.col("sw_dens").isNotNull())
    return kept.withColumn("skel_dens", body_density).withColumn(
        "dry_weight", water.dry_weight(weight, "sw_dens", "skel_dens"))


def standard_drift(df: DataFrame, phase: str, standard: str, weight: str) -> DataFrame:
    """Mean and SE of the weighed standards by phase."""
    return mean_se(df, [phase, standard], weight, ("mean_weight", "sd_weight", "se_weight")).drop("sd_weight")


def phase_change(df: DataFrame, ids: Sequence[str], phase: str, value: str, date: str | None = None,
                 pre="pre", post="post", average: bool = False) -> DataFrame:
    """Pre and post value of each organism in one aggregate.

    Replicates are averaged if asked, otherwise the largest of them counts,
    which is the value itself where each cell holds one. A NULL among averaged
    replicates makes the average NULL.
    """
    def at(level):
        mine = F.col(phase) == level
        v = F.when(mine, F.col(value))
        if not average:
            return F.max(v)
        return F.when(F.count(F.when(mine, 1)) == F.count(v), F.avg(v))

    aggs = [at(pre).alias("pre"), at(post).alias("post")]
    if date:
        aggs += [F.max(F.when(F.col(phase) == pre, F.col(date))).alias("pre_date"),
                 F.max(F.when(F.col(phase) == post, F.col(date))).alias("post_date")]
    return df.groupBy(*ids).agg(*aggs)


def growth(df: DataFrame, ids: Sequence[str], phase: str, weight: str, date: str,
           average: bool = False) -> DataFrame:
    """Change, change per starting mass, percent, and mg per g and day.

    Organisms without a post value (dead or lost) are dropped. Days are counted
    across the year end.
    """
    wide = phase_change(df, ids, phase, weight, date, average=average).filter(F.col("post").isNotNull())
    change = F.col("post") - F.col("pre")
    return wide.select(
        *ids, F.datediff("post_date", "pre_date").alias("days"), change.alias("change"),
        ratio(change, "pre").alias("change_per_mass"), percent_change("post", "pre").alias("change_pct"),
        (ratio(ratio(change, "pre"), F.datediff("post_date", "pre_date")) * 1000.0).alias("mg_g_day"))


def clean_growth(df: DataFrame, taxon: str, pct: str, rate: str, drop_taxa: Sequence[str],
                 min_pct: Mapping[str, float]) -> DataFrame:
    """Drop missing rates, whole taxa, and breakage below a taxon's bound."""
    bound = recode_bound(taxon, min_pct)
    kept = df.filter(F.col(rate).isNotNull()).filter(~F.col(taxon).isin(list(drop_taxa)))
    return keep_unless(kept, F.col(pct) < bound)


def recode_bound(taxon: str, min_pct: Mapping[str, float]) -> Column:
    pairs = [F.lit(x) for item in min_pct.items() for x in (item[0], float(item[1]))]
    return F.try_element_at(F.create_map(*pairs), F.col(taxon))


def complete_pairs(df: DataFrame, pair: Sequence[str], value: str | None = None,
                   only: Column | None = None) -> DataFrame:
    """Drop organisms whose pair has one member only.

    With ``value`` only members having it count; with ``only`` the test applies
    to those rows and the others stay.
    """
    counted = df if value is None else df.filter(F.col(value).isNotNull())
    if only is not None:
        counted = counted.filter(only)
    lone = counted.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return natural_join(df, small_side(lone, many=True), "left_anti", list(pair))


def length_change(df: DataFrame, ids: Sequence[str], phase: str, length: str) -> DataFrame:
    wide = phase_change(df, ids, phase, length).filter(F.col("post").isNotNull())
    return wide.select(*ids, (F.col("post") - F.col("pre")).alias("length_change"),
                       percent_change("post", "pre").alias("length_pct"))


def displacement(before: str, after: str) -> Column:
    """Displaced volume of a body put in a filled vessel."""
    return F.col(after) - F.col(before)


def volume_change(growth_volumes: DataFrame, chamber_volumes: DataFrame, ids: Sequence[str],
                  phase: str, volume: str) -> DataFrame:
    """Volume change, chamber measurements counting as the post value.

    Equal rows of both tables collapse before the two phases are compared.
    """
    both = stack(growth_volumes, chamber_volumes.withColumn(phase, F.lit("post"))
                 .select(*growth_volumes.columns)).filter(F.col(volume).isNotNull()).distinct()
    wide = phase_change(both, ids, phase, volume).filter(F.col("post").isNotNull())
    return wide.select(*ids, (F.col("post") - F.col("pre")).alias("volume_change"),
                       percent_change("post", "pre").alias("volume_pct"))


# Standard curves, area in square cm from grams of coating.
AREA_CURVES = {"wax": (38.6, 2.46), "foil": (241.0, -2.48)}


def surface_area(df: DataFrame, method: str, weight: str, curves: Mapping[str, tuple] = AREA_CURVES) -> DataFrame:
    """Area from the weight of a coating, by the curve of each method."""
    slope = recode_bound(method, {m: c[0] for m, c in curves.items()})
    offset = recode_bound(method, {m: c[1] for m, c in curves.items()})
    return df.withColumn("area_cm2", slope * F.col(weight) + offset)


def area_growth(df: DataFrame, taxon: str, taxa: Sequence[str], change: str, days: str, area: str) -> DataFrame:
    """mg per square cm and day for the taxa with a measured area."""
    return df.filter(F.col(taxon).isin(list(taxa))).withColumn(
        "mg_cm2_day", ratio(ratio(change, days), area) * 1000.0)


def ash_free_mass(tin: str, dry: str, ash: str) -> Column:
    """Dry mass minus ash mass, each weighed with its tin."""
    return (F.col(dry) - F.col(tin)) - (F.col(ash) - F.col(tin))


def assemblage_mass(volumes: DataFrame, masses: DataFrame, unit: Sequence[str], member: str,
                    volume: str, mass: str, aliases: Mapping[str, str] | None = None,
                    volume_patches: Mapping | None = None, mass_patches: Mapping | None = None) -> DataFrame:
    """Summed volume and ash-free mass per assemblage.

    ``volumes`` lists each member with its unit columns. ``aliases`` merges
    records of one member weighed in parts. One missing part makes a sum NULL.
    """
    v = volumes.withColumn(volume, patch_value(member, volume, volume_patches or {}))
    per_volume = v.groupBy(unit[0]).agg(strict(F.sum, volume).alias(volume))
    m = combine_parts(masses, [], member, aliases or {}, [mass])
    m = m.withColumn(mass, patch_value(member, mass, mass_patches or {}))
    used = natural_join(m, volumes.select(member, *unit).distinct(), "left", [member])
    per_mass = (used.filter(F.col(unit[0]).isNotNull()).groupBy(*unit)
                .agg(strict(F.sum, mass).alias(mass)))
    return natural_join(per_volume, per_mass, "full", [unit[0]]).select(*unit, volume, mass)
