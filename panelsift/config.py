"""Settings as dataclasses, optionally read from YAML, and the code dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

# Study columns read, and the keys of the per-task study aggregate.
STUDY_COLUMNS = (
    "respondent_pk",
    "survey_pk",
    "platform_name",
    "hardware_version",
    "yob",
    "survey_locale",
    "request-remote-addr",
    "user-agent",
    "exposure_band",
)
STUDY_GROUP_KEYS = (
    *STUDY_COLUMNS,
    "task_pk",
    "task_origin_id",
    "task_length_of_task",
    "task_country",
    "task_targeting_type",
    "task_category",
    "task_points",
    "activation_date",
)
SUMMARY_CATEGORIES = (
    "platform_name",
    "hardware_version",
    "yob",
    "survey_locale",
    "exposure_band",
)

# Answer codes of the profile questions.
INCOME_LABELS = {
    "A": "Less than £15,000",
    "B": "£15,000 to £19,999",
    "C": "£20,000 to £24,999",
    "D": "£25,000 to £29,999",
    "E": "£30,000 to £34,999",
    "F": "£35,000 to £39,999",
    "G": "£40,000 to £44,999",
    "H": "£45,000 to £49,999",
    "I": "£50,000 to £59,999",
    "J": "£60,000 to £74,999",
    "K": "£75,000 to £84,999",
    "L": "£85,000 to £99,999",
    "M": "£100,000 to £124,999",
    "N": "£125,000 to £149,999",
    "O": "£150,000 to £174,999",
    "P": "£175,000 to £199,999",
    "Q": "£200,000 and above",
    "R": "Prefer not to answer",
}
REGION_LABELS = {
    "A": "East Midlands (England)",
    "B": "East Of England",
    "C": "London",
    "D": "North East (England)",
    "E": "North West (England)",
    "F": "Northern Ireland",
    "G": "Scotland",
    "H": "South East (England)",
    "I": "South West (England)",
    "J": "Wales",
    "K": "West Midlands (England)",
    "L": "Yorkshire And The Humber",
}
DEPARTMENT_LABELS = {
    "A": "Administration/General Staff",
    "B": "Customer Service/Client Service",
    "C": "Executive Leadership",
    "D": "Finance/Accounting",
    "E": "Human Resources",
    "F": "Legal/Law",
    "G": "Marketing",
    "H": "Operations",
    "I": "Procurement",
    "J": "Sales/Business Development",
    "K": "Technology Development Hardware (not only IT)",
    "L": "Technology Development Software (not only IT)",
    "M": "Technology Implementation",
    "N": "Other",
    "O": "I don't work",
}
INDUSTRY_LABELS = {
    "A": "Accounting",
    "B": "Advertising",
    "C": "Agriculture/Fishing",
    "D": "Architecture",
    "E": "Automotive",
    "F": "Aviation",
    "G": "Banking/Financial",
    "H": "Bio-Tech",
    "I": "Brokerage",
    "J": "Carpenting/Electrical installations/VVS",
    "K": "Chemicals/Plastics/Rubber",
    "L": "Communications/Information",
    "M": "Computer Hardware",
    "N": "Computer Reseller (software/hardware)",
    "O": "Computer Software",
    "P": "Construction",
    "Q": "Consulting",
    "R": "Consumer Electronics",
    "S": "Consumer Packaged Goods",
    "T": "Education",
    "U": "Energy/Utilities/Oil and Gas",
    "V": "Engineering",
    "W": "Environmental Services",
    "X": "Fashion/Apparel",
    "Y": "Food/Beverage",
    "Z": "Government/Public Sector",
    "AA": "Healthcare",
    "AB": "Hospitality/Tourism",
    "AC": "Human Resources",
    "AD": "Information Technology/IT",
    "AE": "Insurance",
    "AF": "Internet",
    "AG": "Legal/Law",
    "AH": "Manufacturing",
    "AI": "Market Research",
    "AJ": "Marketing/Sales",
    "AK": "Media/Entertainment",
    "AL": "Military",
    "AM": "Non Profit/Social services",
    "AN": "Personal Services",
    "AO": "Pharmaceuticals",
    "AP": "Printing Publishing",
    "AQ": "Public Relations",
    "AR": "Real Estate/Property",
    "AS": "Retail/Wholesale trade",
    "AT": "Security",
    "AU": "Shipping/Distribution",
    "AV": "Telecommunications",
    "AW": "Transportation",
    "AX": "Other",
    "AY": "I don't work",
}


@dataclass
class PathSettings:
    """Where tables live and which rows are pulled; nothing here has a hidden date."""

    silver_path: str
    project_repository_path: str
    country: str
    min_date: str
    task_origin: str
    fmt: str = "delta"
    output_files: dict[str, str] = field(default_factory=dict)


@dataclass
class StudySettings:
    study_labels: dict[str, bool]
    cols_to_include_subset: list[str] = field(default_factory=lambda: list(STUDY_COLUMNS))
    cols_to_group: list[str] = field(default_factory=lambda: list(STUDY_GROUP_KEYS))
    cols_to_exclude_respondent_info: list[str] = field(default_factory=list)
    cols_to_drop: list[str] = field(default_factory=list)


def read_yaml(path: str | Path) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def from_mapping(kind: type, values: dict[str, Any]):
    """Dataclass from a mapping; unknown keys are ignored."""
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in known})


def clean_feature_sets(
    raw: dict[str, list[str]], columns: list[str]
) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Feature sets limited to existing columns, and the unknown names per set.

    Stray commas at the end of a configured name are removed first.
    """
    have = set(columns)
    cleaned = {k: [n.strip().rstrip(",") for n in v] for k, v in raw.items()}
    known = {k: [n for n in v if n in have] for k, v in cleaned.items()}
    unknown = {k: [n for n in v if n not in have] for k, v in cleaned.items()}
    return known, {k: v for k, v in unknown.items() if v}
