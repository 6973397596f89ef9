"""City settings, checked on the driver, and the adapter plug-in."""

from __future__ import annotations

import importlib.util
import inspect
import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an adapter must offer, and how many arguments each function takes.
REQUIRED = {"fetch_population_data": 1, "build_neighbourhood_layer": 3}
_ID, _YEAR, _DAY = re.compile(r"[a-z0-9_]+"), re.compile(r"(19|20)\d{2}"), re.compile(r"(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])")


@dataclass(frozen=True)
class City:
    city_id: str
    name: str
    bbox: tuple[float, float, float, float]
    season: tuple[str, str] = ("06-01", "08-31")
    most_cloud: float = 20.0
    buffer_m: float = 10.0

    @property
    def utm_zone(self) -> int:
        return int(((self.bbox[0] + self.bbox[2]) / 2 + 180) // 6) + 1


def faults(raw: Mapping[str, object]) -> list[str]:
    """What is wrong with a city's settings; empty if nothing is."""
    out = []
    if not _ID.fullmatch(str(raw.get("city_id", ""))):
        out.append("city_id: lower-case letters, digits and underscores")
    if not str(raw.get("name", "")).strip():
        out.append("name: missing")
    box = raw.get("bbox")
    if not (isinstance(box, (list, tuple)) and len(box) == 4 and all(isinstance(v, (int, float)) for v in box)):
        out.append("bbox: four numbers")
    elif not (-180 <= box[0] < box[2] <= 180 and -90 <= box[1] < box[3] <= 90):
        out.append("bbox: west < east and south < north")
    for day in raw.get("season", City.season):
        if not _DAY.fullmatch(str(day)):
            out.append(f"season: {day} is no MM-DD")
    if not 0 <= float(raw.get("most_cloud", City.most_cloud)) <= 100:
        out.append("most_cloud: 0 to 100")
    if float(raw.get("buffer_m", City.buffer_m)) <= 0:
        out.append("buffer_m: above 0")
    return out


def city(raw: Mapping[str, object]) -> City:
    """Settings as a City; ``ValueError`` lists every fault."""
    if found := faults(raw):
        raise ValueError("; ".join(found))
    return City(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in City.__dataclass_fields__})


def load_city(path: str) -> City:
    """A city's settings from a YAML (or JSON) file; ``ValueError`` lists every fault."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    if not isinstance(raw, Mapping):
        raise ValueError(f"{path}: no mapping")
    return city(raw)


def load_cities(folder: str) -> dict[str, City]:
    """Every city of a folder by its id; a file must be named after its city."""
    out = {}
    for name in sorted(os.listdir(folder)):
        stem, kind = os.path.splitext(name)
        if kind in (".yaml", ".yml", ".json"):
            one = load_city(os.path.join(folder, name))
            if one.city_id != stem or one.city_id in out:
                raise ValueError(f"{name}: holds city {one.city_id}")
            out[stem] = one
    return out


def in_season(day: Column, first: str, last: str) -> Column:
    """Whether a date's month and day lie between two ``MM-DD``, ends included; a season may reach over the new year."""
    at = F.date_format(day, "MM-dd")
    return at.between(first, last) if first <= last else (at >= first) | (at <= last)


def valid_year(year: object) -> bool:
    return bool(_YEAR.fullmatch(str(year)))


def adapter_faults(module: ModuleType | object) -> list[str]:
    """Functions that an adapter lacks or that take another number of arguments."""
    out = []
    for name, n in REQUIRED.items():
        f: Callable | None = getattr(module, name, None)
        if not callable(f):
            out.append(f"{name}: missing")
            continue
        p = inspect.signature(f).parameters.values()
        positional = [x for x in p if x.kind in (x.POSITIONAL_ONLY, x.POSITIONAL_OR_KEYWORD)]
        least = sum(x.default is x.empty for x in positional)
        if not (least <= n <= len(positional) or any(x.kind is x.VAR_POSITIONAL for x in p)):
            out.append(f"{name}: takes {least} to {len(positional)} arguments, {n} are given")
    return out


def load_adapter(path: str) -> ModuleType:
    """A city's adapter from its file; ``ValueError`` lists every function it lacks. Its functions return DataFrames."""
    spec = importlib.util.spec_from_file_location(f"adapter_{os.path.splitext(os.path.basename(path))[0]}", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"{path}: no module")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if found := adapter_faults(module):
        raise ValueError("; ".join(found))
    return module


def layer_of(adapter: ModuleType | object, city: City, districts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """The layer of neighbourhoods that a city's adapter makes; ``ValueError`` lists every function that the adapter lacks."""
    if found := adapter_faults(adapter):
        raise ValueError("; ".join(found))
    return adapter.build_neighbourhood_layer(adapter.fetch_population_data(city), districts, boundaries)


def csv_resource(package: Mapping[str, object]) -> str:
    """The address of the first CSV resource of an open-data package description; ``ValueError`` without one."""
    if not package.get("success"):
        raise ValueError("the package description is no success")
    for r in package["result"].get("resources", []):  # type: ignore[index, union-attr]
        if str(r.get("format", "")).strip().upper() == "CSV" and r.get("url"):
            return str(r["url"])
    raise ValueError("the package has no CSV resource")


def replaced_together(fetched: Mapping[str, DataFrame], valid: Callable[[str, DataFrame], str], put: Callable[[str, DataFrame], None]) -> None:
    """Put every fetched table in place only if each is valid (``valid`` names a fault, or nothing): all or none."""
    faults_ = [f"{n}: {why}" for n, df in fetched.items() if (why := valid(n, df))]
    if faults_:
        raise ValueError("; ".join(faults_))
    for n, df in fetched.items():
        put(n, df)


def registry(cities: Mapping[str, Mapping[str, object]], published: Mapping[str, object] = {}) -> dict[str, int]:
    """How many cities are known, valid, faulty and published."""
    bad = sum(bool(faults(c)) for c in cities.values())
    return {"cities": len(cities), "valid": len(cities) - bad, "faulty": bad, "published": sum(c in published for c in cities)}


# ---- tables of settings and descriptions ----


def settings_faults(settings: DataFrame) -> DataFrame:
    """``settings`` with ``faults``, an array of what is wrong with each row; empty if nothing is.

    Columns ``city_id, name, west, south, east, north, season_first, season_last, most_cloud, buffer_m``; a missing season, cloud or
    buffer has its default. Unlike ``faults`` it sees all rows, so an id that several rows have is a fault of each.
    """
    c = F.col
    box = [c(k) for k in ("west", "south", "east", "north")]
    known = box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
    right = (box[0] >= -180) & (box[0] < box[2]) & (box[2] <= 180) & (box[1] >= -90) & (box[1] < box[3]) & (box[3] <= 90)
    whole = lambda v, pattern: F.coalesce(v.rlike(rf"\A(?:{pattern.pattern})\z"), F.lit(False))
    tests = [
        (whole(c("city_id"), _ID), F.lit("city_id: lower-case letters, digits and underscores")),
        (F.coalesce(c("n_same"), F.lit(1)) == 1, F.lit("city_id: repeated")),
        (F.coalesce(c("name").rlike(r"\S"), F.lit(False)), F.lit("name: missing")),
        (known, F.lit("bbox: four numbers")),
        (~known | right, F.lit("bbox: west < east and south < north")),
    ]
    for name, default in zip(("season_first", "season_last"), City.season, strict=True):
        day = F.coalesce(c(name), F.lit(default))
        tests.append((whole(day, _DAY), F.format_string("season: %s is no MM-DD", day)))
    tests.append((F.coalesce(c("most_cloud"), F.lit(City.most_cloud)).between(0, 100), F.lit("most_cloud: 0 to 100")))
    tests.append((F.coalesce(c("buffer_m"), F.lit(City.buffer_m)) > 0, F.lit("buffer_m: above 0")))
    same = settings.groupBy("city_id").agg(F.count("*").alias("n_same")).filter("n_same > 1 and city_id is not null")
    found = F.array_compact(F.array(*[F.when(~ok, text) for ok, text in tests]))
    return settings.join(same, "city_id", "left").withColumn("faults", found).drop("n_same")


def registry_table(settings: DataFrame, published: DataFrame) -> DataFrame:
    """One row ``cities, valid, faulty, published``; ``published`` has the ids of cities whose results are out."""
    out = published.select("city_id").distinct().withColumn("is_out", F.lit(True))
    bad = F.size("faults") > 0
    one = lambda test: F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("long")), F.lit(0).cast("long"))
    return settings_faults(settings).join(out, "city_id", "left").agg(
        F.count("*").alias("cities"), one(~bad).alias("valid"), one(bad).alias("faulty"), one(F.col("is_out")).alias("published")
    )


def csv_resources(packages: DataFrame, package: str) -> DataFrame:
    """``packages`` with ``url``, the first CSV resource of each open-data package description (JSON text), and ``fault`` where there is none."""
    read = F.from_json(package, "success boolean, result struct<resources: array<struct<format: string, url: string>>>")
    fits = lambda r: (F.upper(F.trim(r["format"])) == "CSV") & (F.length(r["url"]) > 0)
    success = F.coalesce(F.col("_p.success"), F.lit(False))
    url = F.when(success, F.get(F.filter(F.col("_p.result.resources"), fits), F.lit(0))["url"])
    fault = F.when(~success, "the package description is no success").when(F.col("url").isNull(), "the package has no CSV resource")
    return packages.withColumn("_p", read).withColumn("url", url).withColumn("fault", fault).drop("_p")
