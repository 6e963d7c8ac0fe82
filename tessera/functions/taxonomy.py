"""Class taxonomy: names, coarse schemes, and remapping as joins with a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# No-data codes of masks.
NO_DATA = (0, 15, 127, -128, 255, 65535)

# The seven rolled-up classes.
ROLLED_UP = (2, 3, 4, 5, 6, 40, 301)

# Class id, short name (None where there is none), full name.
NAMES = (
    (0, "No class", "No class"),
    (1, "Non erosion", "Non erosion"),
    (2, "Ground", "Ground"),
    (3, "HumGras", "Hummock Grass"),
    (4, "Shrub", "Shrub"),
    (5, "Tree", "Tree"),
    (6, "Herb", "Herb"),
    (7, "Grass", "Grass"),
    (9, "Debris", "Generic Debris"),
    (40, "Sedge", "Sedge"),
    (70, "AnnHer", "Annual herbs and grasses"),
    (141, "Rills", "Rills"),
    (142, "Gullies", "Gullies"),
    (200, "Abiotic", "Abiotic"),
    (201, "Water", "Water"),
    (301, "TusGra", "Tussock Grass"),
    (302, "Herb2", "Herb 2"),
    (303, "CenSpp", "Cenchrus spp."),
    (401, "SkeShr", "Skeletal shrub"),
    (402, "AerJav", "Aerva javanica"),
    (450, "MacSpp", "Macrozamia spp."),
    (501, "CalPro", "Calotropis procera"),
    (601, "Melaleu", "Melaleuca spp."),
    (603, "EucSpp", "Eucalyptus spp."),
    (607, "BanSpp", "Banksia spp."),
    (1791, "PasFoe", "Passiflora foetida"),
    (4900, "XanPre", "Xanthorrhoea preissii"),
    (5007, "Mulga", "Mulga"),
    (5103, "NelPal", "Neltuma pallida"),
    (5114, "ParAcu", "Parkinsonia aculeata"),
    (5203, "VacFar", "Vachellia farnesiana"),
    (6008, "EucCam", "Eucalyptus camaldulensis"),
    (6012, "EucVic", "Eucalyptus victrix"),
    (6015, "MelArg", "Melaleuca argentea"),
    (6016, "PhoDac", "Phoenix dactylifera"),
    (9003, "DeadTr", "Dead Triodia"),
    (9004, "DeadSh", "Dead Shrub"),
    (10001, "SteveSpi", "Steve the spikey plant"),
    (10003, "BBT1", "BBT1"),
    (10004, "BBT2", "BBT2"),
    (10005, "BBT3", "BBT3"),
    (10006, "BBT4", "BBT4"),
    (10007, "NGLowPalm", "New Guinea low Palm"),
    (10008, "NGTallPalm", "New Guinea Tall Palm"),
    (10009, "NGGrass", "New Guinea Grass"),
    (10010, "NGBroad", "New Guinea Broadleaf"),
    (10011, "NGShrub", "New Guinea shrub"),
    (10012, "NGTree", "New Guinea Tree"),
    (10013, "NGWisTree", "New Guinea Wispy Tree"),
    (10014, None, "ALC Other Veg"),
    (10016, None, "Marrie"),
    (10050, "HerbRumVes", "Rumex Vesicarius"),
    (10092, "ShrubTecticorna", "Tecticorna spp"),
)

# Fine classes under each of the seven.
SEVEN = {
    2: (2, 9, 200, 201),
    3: (3, 9003),
    4: (4, 401, 402, 450, 501, 4900, 5007, 5203, 9004, 10001, 10007, 10011, 10092),
    5: (5, 601, 603, 607, 5103, 5114, 6008, 6012, 6015, 6016, 10003, 10004, 10005, 10006, 10008, 10010, 10012, 10013),
    6: (6, 70, 302, 1791, 10050),
    40: (40,),
    301: (7, 301, 303, 10009),
}

# The coarser schemes, as what they make of the seven.
COARSER = {
    "six": {2: 2, 3: 7, 4: 4, 5: 5, 6: 6, 40: 40, 301: 7},
    "three": {2: 2, 3: 3, 4: 4, 5: 4, 6: 3, 40: 3, 301: 3},
    "two": {2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 40: 3, 301: 3},
}

# The erosion scheme.
EROSION = {1: 1, 14: 14, 141: 14, 142: 14}


def mapping(scheme: str) -> dict[int, int]:
    """src -> dst of a scheme: seven, six, three, two, erosion or identity."""
    if scheme == "erosion":
        return dict(EROSION)
    if scheme == "identity":
        return {class_id: class_id for class_id, _, _ in NAMES}
    seven = {fine: coarse for coarse, fines in SEVEN.items() for fine in fines}
    return seven if scheme == "seven" else {fine: COARSER[scheme][coarse] for fine, coarse in seven.items()}


def scheme_table(spark: SparkSession, scheme: str) -> DataFrame:
    """(src, dst) rows of a scheme; at most a few dozen."""
    return spark.createDataFrame(sorted(mapping(scheme).items()), "src int, dst int")


def names_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAMES), "class_id int, short string, full string")


def remap(df: DataFrame, column: str, scheme: str, target: str | None = None) -> DataFrame:
    """All classes mapped at once; those that the scheme does not name pass through."""
    table = F.broadcast(scheme_table(df.sparkSession, scheme).select(F.col("src").alias("_src"), F.col("dst").alias("_dst")))
    return df.join(table, df[column] == F.col("_src"), "left").withColumn(target or column, F.coalesce("_dst", df[column])).drop("_src", "_dst")


def remap_strict(df: DataFrame, column: str, key: list[str], scheme: str = "seven", target: str = "mapped") -> DataFrame:
    """As ``remap``, but no-data becomes 0 and every group ``key`` that holds an unknown class is left out whole."""
    known = F.broadcast(scheme_table(df.sparkSession, scheme).select(F.col("src").alias("_src"), F.col("dst").alias("_dst")))
    out = df.join(known, df[column] == F.col("_src"), "left").withColumn(target, F.when(F.col(column).isin(*NO_DATA), 0).otherwise(F.col("_dst")))
    bad = out.where(F.col(target).isNull()).select(*key).distinct()
    return out.join(bad, key, "left_anti").drop("_src", "_dst")


def rejected(df: DataFrame, column: str, key: list[str], scheme: str = "seven") -> DataFrame:
    """The groups that ``remap_strict`` leaves out, with the classes that are unknown."""
    allowed = scheme_table(df.sparkSession, scheme).select(F.col("src").alias(column)).union(df.sparkSession.createDataFrame([(v,) for v in NO_DATA], f"{column} int")).distinct()
    return df.join(F.broadcast(allowed), column, "left_anti").groupBy(*key).agg(F.array_sort(F.collect_set(column)).alias("unknown"))


def with_class_name(df: DataFrame, column: str, full: bool = False, target: str = "class_name") -> DataFrame:
    """The class's name, or its number as text where it has none."""
    table = F.broadcast(names_table(df.sparkSession).select(F.col("class_id").alias("_id"), F.col("full" if full else "short").alias("_name")))
    return df.join(table, df[column] == F.col("_id"), "left").withColumn(target, F.coalesce("_name", df[column].cast("string"))).drop("_id", "_name")
