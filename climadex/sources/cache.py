"""Monthly components kept as Parquet, one folder per component and period."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Country codes and names.
COUNTRIES = {
    "AUS": "Australia",
    "AUT": "Austria",
    "BEL": "Belgium",
    "CAN": "Canada",
    "CHE": "Switzerland",
    "CZE": "Czechia",
    "DEU": "Germany",
    "DNK": "Denmark",
    "ESP": "Spain",
    "FIN": "Finland",
    "FRA": "France",
    "GBR": "United Kingdom",
    "GRC": "Greece",
    "HUN": "Hungary",
    "IRL": "Ireland",
    "ITA": "Italy",
    "LUX": "Luxembourg",
    "NLD": "Netherlands",
    "NOR": "Norway",
    "NZL": "New Zealand",
    "POL": "Poland",
    "PRT": "Portugal",
    "ROU": "Romania",
    "SVK": "Slovakia",
    "SVN": "Slovenia",
    "SWE": "Sweden",
    "USA": "United States of America",
}


def country_name(code: str) -> str:
    code = code.strip().upper()
    if code not in COUNTRIES:
        raise ValueError(f"unknown country code: {code}")
    return COUNTRIES[code]


def cube_paths(country: str, years: tuple[int, int], base: str) -> dict[str, str]:
    """Where the cubes of a country are expected, by variable, and its mask."""
    span = f"{years[0]}_{years[1]}"
    return {v: f"{base}/{country}/{v}_{span}.nc" for v in ("t2m", "tp", "u10", "v10")} | {"mask": f"{base}/{country}/mask_{country}.nc"}


def component_path(folder: str, label: str, study: tuple[str, str]) -> str:
    return f"{folder.rstrip('/')}/{label}_{study[0][:4]}_{study[1][:4]}.parquet"


def save(df: DataFrame, folder: str, label: str, study: tuple[str, str]) -> DataFrame:
    path = component_path(folder, label, study)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, folder: str, label: str, study: tuple[str, str]) -> DataFrame:
    path = component_path(folder, label, study)
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} holds no component; compute it once with this folder") from e
