"""Declared types of the field-survey tables, as DDL (fixed column names of the exported CSV files).

Only the columns that the flows use are listed; files may hold others in any order.
"""

_CELLS = "PresMod{m}Corn{c} INT"
_UNIT = "location_name STRING, event_year INT, "

VEGETATION = (
    "EventYear INT, GRTSOrder INT, Park STRING, SubPark STRING, QAQCPlot BOOLEAN, PlantName STRING, "
    "ExoticPlant BOOLEAN, HighPriorityExotic BOOLEAN, CoverClass INT, "
    + ", ".join(_CELLS.format(m=m, c=c) for m in range(1, 5) for c in (1, 2))
    + ", BotanistName STRING, Latitude DOUBLE, Longitude DOUBLE"
)
COMMUNITY_GROUPS = ("event_name_date_calc STRING, lastCommGroup STRING")
HERBS = (
    _UNIT + "QAQC INT, Species_Original STRING, Cover_Class INT, " + ", ".join(f"Presence_Column_{i} INT" for i in range(1, 9))
)
_TREE = (
    "DBH DOUBLE, Tree_Status INT, Crown_Class INT, Vigor INT, Dieback INT, "
    + ", ".join(f"Condition_Damage_Code_{i} STRING" for i in range(1, 6))
    + ", "
    + ", ".join(f"Foliage_Condition_{i} STRING, Foliage_Percent_Class_{i} INT" for i in range(1, 6))
    + ", Snag_Height DOUBLE, Dead_Tree_Decay_Class INT, ArboristName STRING"
)
TREES_FIRST = ("Tree_ID STRING, qaqcPlotTree_ID STRING, " + _TREE)
TREES_AGAIN = ("Tree_ID STRING, normalPlotTree_ID STRING, " + _TREE)
ALL_TREES = (_UNIT + "qaqc INT, Module INT, Tree_Number INT")
_CLASSES = (
    "Seedling_Ht_5_15 INT, Seedling_Ht_15_30 INT, Seedling_Ht_30_50 INT, Seedling_Ht_50_137 INT, "
    "Sapling_DBH_0_1 INT, Sapling_DBH_1_2half INT, Sapling_DBH_2half_5 INT, Sapling_DBH_5_10 INT"
)
SEEDLINGS = (_UNIT + "QAQC INT, Module INT, Corner INT, " + _CLASSES)
DENSIOMETER = (
    _UNIT + "QAQC INT, Module INT, Direction STRING, Spherical_Densiometer_Tally INT"
)
DISTURBANCES = [
    "Disturbance_Open_Grown",
    "Disturbance_Homesite",
    "Disturbance_Fire_Recent",
    "Disturbance_Fire_Historic",
    "Disturbance_Deer_Browse",
    "Disturbance_Logging",
    "Disturbance_Plowing",
    "Disturbance_Pasture",
    "Disturbance_Erosion",
]
SITES = (_UNIT + "QAQC INT, Stand_Height DOUBLE, " + ", ".join(f"{d} BOOLEAN" for d in DISTURBANCES))
DEBRIS = (_UNIT + "QAQC INT, Transect STRING, Diameter DOUBLE, Decay_Class INT")
COMMUNITY = (_UNIT + "QAQC INT, Community_Code STRING, CommGroup STRING, Fit INT")
BINS = ("CEGL STRING, gp1 STRING")
REGEN_SEEDLINGS = (
    "event_name_date_calc STRING, Module INT, Corner INT, Plant_Name STRING, Seedling_Ht_5_50 INT, " + _CLASSES
)
REGEN_TREES = (
    "event_name_date_calc STRING, Tree_Number INT, Module INT, Plant_Name STRING, DBH DOUBLE, Tree_Status INT"
)
BURNS = ("Plot STRING, Date_Plot_Established STRING, Date_Plot_Revisited STRING, Fire_Start_Date STRING")
BOUNDARIES = ("long DOUBLE, lat DOUBLE, piece STRING, SubUnitLab STRING")


def threshold_extract(measure: str, with_community: bool) -> str:
    """Plot-event extract with one measure."""
    extra = "CEGL STRING, " if with_community else ""
    return (f"UnitCode STRING, SubunitCode STRING, panel_init_year INT, {extra}{measure} DOUBLE")
