"""Community cover: ranking of dominant taxa, traits, map points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recode, separate
from ..operators.aggregates import share_of_total
from ..operators.joins import natural_join
from ..operators.ordered import top_k
from ..operators.quantiles import exact_quantiles
from ..operators.verbs import keep_unless

# Trait codes and their full words.
SHAPES = {"Br": "Branching", "Mas": "Massive", "Enc": "Encrusting",
          "Cushion": "Cushion-like", "Poly": "Polypoid"}
CALCIFYING = {"Herm": "Heratypic", "NC": "Non-calcifying", "AC": "Articulated",
              "Non-AC": "Non-articulated"}
RESOURCES = {"Mix": "Mixotrophic", "Auto": "Autotrophic", "Het": "Heterotrophic"}


def decode_traits(df: DataFrame, entity: str) -> DataFrame:
    """Split a functional entity into its four traits and spell out the codes."""
    names = ["phylum", "morphology", "calcification", "resource"]
    return df.withColumns(separate(entity, ",", names)).withColumns({
        "morphology": recode("morphology", SHAPES),
        "calcification": recode("calcification", CALCIFYING),
        "resource": recode("resource", RESOURCES)})


def dominant_taxa(counts: DataFrame, group: str, taxon: str, amount: str, k: int = 8,
                  unused: DataFrame | None = None, skip: Column | None = None,
                  known: DataFrame | None = None, digits: int = 1) -> DataFrame:
    """Top taxa of each group by percent cover.

    The share is taken before unused taxa are removed; the ranking uses the
    unrounded share, the table shows the rounded one.
    """
    if known is not None:
        counts = natural_join(counts, known.select(taxon), "left_semi", [taxon])
    cover = share_of_total(counts, [group], taxon, amount)
    if unused is not None:
        cover = natural_join(cover, unused.select(taxon), "left_anti", [taxon])
    if skip is not None:
        cover = keep_unless(cover, skip)
    ranked = top_k(cover, [group], [F.desc("cover"), F.col(taxon)], k)
    return ranked.select(group, "rank", taxon, F.round("cover", digits).alias("cover"))


def with_traits(ranked: DataFrame, traits: DataFrame, taxon: str) -> DataFrame:
    return natural_join(ranked, traits, "left", [taxon])


def site_points(sites: DataFrame, site: str, keep: Sequence, nudge: Mapping, lat: str, lon: str,
                labels: Mapping[str, str] | None = None) -> DataFrame:
    """Chosen sites, some moved a little on the map and renamed."""
    key = F.col(site)
    shift_lat = F.coalesce(F.try_element_at(_pairs({k: v[0] for k, v in nudge.items()}), key), F.lit(0.0))
    shift_lon = F.coalesce(F.try_element_at(_pairs({k: v[1] for k, v in nudge.items()}), key), F.lit(0.0))
    out = sites.filter(key.isin(list(keep))).withColumns(
        {lat: F.col(lat) + shift_lat, lon: F.col(lon) + shift_lon})
    return out.withColumn(site, recode(site, labels or {})) if labels else out


def _pairs(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_centre(points: DataFrame, keys: Sequence[str], lat: str, lon: str) -> DataFrame:
    """Median position per location."""
    a = exact_quantiles(points, keys, lat, {"lat": 0.5}).drop("n")
    b = exact_quantiles(points, keys, lon, {"lon": 0.5}).drop("n")
    return natural_join(a, b, "full", list(keys))
