"""Device hardware and manufacturer categories as ordered rules.

Rules are tried top to bottom and the first that holds decides, so their order is
part of the result: a short pattern such as ``pad`` or ``cat`` matches many names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import any_of, c, strip

# Lowest model number of each tier, highest tier first.
IPHONE_GENERATIONS = ((17, "iphone_16"), (15, "iphone_15"), (14, "iphone_14"), (13, "iphone_13"))
MEDIATEK_TIERS = (
    (6980, "mediatek_flagship"),
    (6850, "mediatek_upper_mid"),
    (6780, "mediatek_mid"),
)
KIRIN_TIERS = ((980, "kirin_flagship"),)

# Fixed values: (category, how to compare, patterns), in the order they are tried.
IPHONE_NAMES = (
    ("iphone_se", "contains", ("se",)),
    ("iphone_pro_max", "contains", ("pro max", "11 pro max")),
    ("iphone_pro", "contains", ("pro",)),
    ("iphone_x_series", "contains", ("xs max", "xr", "xs", "x")),
    ("iphone_11_12", "contains", ("11", "12")),
    ("iphone_legacy", "contains", ("6", "7", "8")),
)
EXYNOS_MODELS = (
    ("exynos_flagship", "contains", ("2100", "2200", "990", "9945", "9925", "9955")),
    ("exynos_upper_mid", "contains", ("980", "9825", "9820", "9810")),
    ("exynos_mid", "contains", ("9611", "9610", "850", "8895", "8835", "8825")),
)
PIXEL_CODENAMES = (
    "caiman", "komodo", "tokay", "comet",
    "shiba", "husky", "akita",
    "panther", "cheetah", "lynx",
    "oriole", "raven", "bluejay",
    "redfin", "bramble", "sunfish", "flame", "coral", "bonito", "sargo",
    "crosshatch", "blueline", "taimen", "walleye",
    "felix", "tegu",
)
OTHER_HARDWARE = (
    ("samsung_other", "contains", ("samsung",)),
    ("xiaomi", "contains", ("xiaomi",)),
    ("realme", "contains", ("rmx", "realme")),
    ("lg", "contains", ("lg", "lucye", "joan", "judyln", "elsa", "winglm")),
    ("itel_budget", "contains", ("itel",)),
    ("itel_budget", "starts", ("w6", "w5")),
    ("tcl", "contains", ("tcl",)),
    ("microsoft_surface", "contains", ("surface",)),
)
MANUFACTURERS = (
    ("apple", "equals", ("apple",)),
    ("samsung", "equals", ("samsung",)),
    ("google", "equals", ("google",)),
    ("xiaomi", "equals", ("xiaomi", "xiaomi communications co ltd", "xiaomi inc")),
    ("huawei_honor", "equals", ("huawei", "honor")),
    ("oppo", "equals", ("oppo",)),
    ("vivo", "equals", ("vivo",)),
    ("oneplus", "equals", ("oneplus",)),
    ("motorola", "equals", ("motorola", "motorola mobility llc")),
    ("realme", "equals", ("realme",)),
    ("nothing", "equals", ("nothing",)),
    ("sony", "equals", ("sony",)),
    ("transsion", "contains", ("tecno", "infinix", "itel")),
    (
        "budget_chinese",
        "contains",
        (
            "oscal", "cubot", "doogee", "oukitel", "blackview", "ulefone",
            "fossibot", "umidigi", "xgody", "gionee", "hxy", "villaon",
            "hena", "eacrugged", "agm", "firefly_mobile", "colors_mobile",
            "chinoe", "kxd", "gtel", "x-tigi", "qubo",
        ),
    ),
    ("tcl", "equals", ("tcl", "alcatel")),
    ("hmd_nokia", "equals", ("hmd global", "nokia")),
    ("lenovo", "equals", ("lenovo",)),
    ("zte_nubia", "equals", ("zte", "nubia")),
    ("asus", "equals", ("asus",)),
    ("lg", "equals", ("lge", "lg")),
    ("htc", "equals", ("htc",)),
    ("meizu", "equals", ("meizu",)),
    ("fairphone", "equals", ("fairphone",)),
    ("microsoft", "equals", ("microsoft",)),
    ("wiko", "equals", ("wiko",)),
    ("hisense", "equals", ("hisense",)),
    ("rugged_enterprise", "contains", ("crosscall", "bullitt", "kyocera", "cat")),
    ("japanese_other", "equals", ("fcnt", "sharp")),
    ("tablet_other", "contains", ("teclast", "pad", "tablet")),
    (
        "odm_reference",
        "equals",
        ("sprd", "wheatek", "alps", "incar", "stack", "revoview", "fih", "img"),
    ),
)

Rule = tuple[Column, Column]


def _any_contains(text: Column, *patterns: str) -> Column:
    # plain byte search; a regular expression would decode the text for every rule
    return any_of([text.contains(p) for p in patterns])


def _any_starts(text: Column, *patterns: str) -> Column:
    return any_of([text.startswith(p) for p in patterns])


def _holds(text: Column, how: str, patterns: Sequence[str]) -> Column:
    if how == "equals":
        return text.isin(*patterns)
    return _any_contains(text, *patterns) if how == "contains" else _any_starts(text, *patterns)


def _first_match(rules: Sequence[Rule], otherwise: Column) -> Column:
    result = otherwise
    for condition, category in reversed(rules):
        result = F.when(condition, category).otherwise(result)
    return result


def _named(text: Column, table) -> list[Rule]:
    return [(_holds(text, how, patterns), F.lit(name)) for name, how, patterns in table]


def _tiers(number: Column, table, lowest: str) -> Column:
    return _first_match([(number >= least, F.lit(name)) for least, name in table], F.lit(lowest))


def _number_after(text: Column, word_pattern: str) -> Column:
    """Digits following a word, as a double so that any length fits; else null."""
    return F.regexp_extract(text, word_pattern + r"(\d+)", 1).try_cast("double")


def cleaned(raw: Column) -> Column:
    return F.lower(strip(raw.cast("string")))


def hardware_category(hw: Column) -> Column:
    """Category of a cleaned hardware text."""
    generation = _number_after(hw, r"iphone\s*")
    mediatek = _number_after(hw, "mt")
    kirin = _number_after(hw, r"kirin\s*")
    iphone = F.when(
        generation.isNotNull(), _tiers(generation, IPHONE_GENERATIONS, "iphone_legacy")
    ).otherwise(_first_match(_named(hw, IPHONE_NAMES), F.lit("iphone_other")))
    rules: list[Rule] = [
        (hw.isNull(), F.lit("unknown")),
        (_any_contains(hw, "iphone"), iphone),
        (
            _any_starts(hw, "mt") | _any_contains(hw, "mediatek"),
            F.when(mediatek.isNotNull(), _tiers(mediatek, MEDIATEK_TIERS, "mediatek_budget"))
            .otherwise("mediatek_other"),
        ),
        (
            _any_contains(hw, "exynos") | _any_starts(hw, "s5e"),
            _first_match(_named(hw, EXYNOS_MODELS), F.lit("exynos_budget")),
        ),
        ((hw == "qcom") | _any_contains(hw, "qualcomm", "snapdragon"), F.lit("qualcomm")),
        (hw.isin(*PIXEL_CODENAMES), F.lit("google_pixel")),
        (_any_starts(hw, "ums", "sp") | _any_contains(hw, "s9863a"), F.lit("unisoc_budget")),
        (
            _any_contains(hw, "kirin", "hi62", "hi32", "hi36"),
            F.when(kirin.isNotNull(), _tiers(kirin, KIRIN_TIERS, "kirin_mid"))
            .otherwise("kirin_other"),
        ),
        *_named(hw, OTHER_HARDWARE),
    ]
    return _first_match(rules, F.lit("other"))


def manufacturer_category(name: Column) -> Column:
    """Category of a cleaned manufacturer text."""
    return _first_match(
        [(name.isNull(), F.lit("unknown")), *_named(name, MANUFACTURERS)], F.lit("other")
    )


def _with_categories(df: DataFrame, wanted) -> DataFrame:
    """Add (source, new column, rules) categories, cleaning each source once per row."""
    texts = {f"__text{i}": cleaned(c(source)) for i, (source, _, _) in enumerate(wanted)}
    made = {new: rules(F.col(f"__text{i}")) for i, (_, new, rules) in enumerate(wanted)}
    return df.withColumns(texts).withColumns(made).drop(*texts)


def add_hardware_category(
    df: DataFrame, hardware_col: str = "ditr_hardware", new_col: str = "hardware_category"
) -> DataFrame:
    return _with_categories(df, [(hardware_col, new_col, hardware_category)])


def add_manufacturer_category(
    df: DataFrame,
    manufacturer_col: str = "ditr_manufacturer",
    new_col: str = "manufacturer_category",
) -> DataFrame:
    return _with_categories(df, [(manufacturer_col, new_col, manufacturer_category)])


def add_device_categories(
    df: DataFrame,
    hardware_col: str = "ditr_hardware",
    manufacturer_col: str = "ditr_manufacturer",
) -> DataFrame:
    return _with_categories(
        df,
        [
            (hardware_col, "hardware_category", hardware_category),
            (manufacturer_col, "manufacturer_category", manufacturer_category),
        ],
    )


def get_device_mapping_summary(
    df: DataFrame,
    hardware_col: str = "ditr_hardware",
    manufacturer_col: str = "ditr_manufacturer",
) -> tuple[DataFrame, DataFrame]:
    """Raw value, category, count and share of the non-missing values, two tables.

    Values are counted first; the rules then run once per distinct value.
    """
    return (
        _mapping_summary(df, hardware_col, hardware_category),
        _mapping_summary(df, manufacturer_col, manufacturer_category),
    )


def _mapping_summary(df: DataFrame, column: str, categorise) -> DataFrame:
    counts = (
        df.where(c(column).isNotNull())
        .groupBy(c(column).alias("original_value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    total = counts.agg(F.sum("count")).scalar()
    made = _with_categories(counts, [("original_value", "category", categorise)])
    return made.select(
        "original_value",
        "category",
        "count",
        F.round(F.col("count") / total * 100, 2).alias("pct"),
    ).orderBy(F.col("count").desc(), "original_value")
