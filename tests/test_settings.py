"""Tables of settings against the checks of one city, and package descriptions."""

import json

from kerbside import config


def test_settings_agree_with_those_of_one_city(spark):
    base = {"city_id": "a", "name": "A", "bbox": [26.0, 38.0, 27.0, 39.0]}
    changes = [
        {}, {"city_id": "A b"}, {"city_id": "b\n"}, {"name": " \t"}, {"bbox": [27.0, 38.0, 26.0, 39.0]}, {"bbox": [26.0, None, 27.0, 39.0]},
        {"season": ("02-30", "1-1")}, {"season": ("00-10", "08-31")}, {"most_cloud": -1.0}, {"most_cloud": 100.0}, {"buffer_m": 0.0}, {"bbox": [-181.0, 38.0, 27.0, 91.0], "buffer_m": -2.0},
    ]
    raw = [base | {"city_id": f"c{i}"} | c for i, c in enumerate(changes)]
    rows = [(r["city_id"], r["name"], *r["bbox"], *r.get("season", (None, None)), r.get("most_cloud"), r.get("buffer_m")) for r in raw]
    schema = "city_id string, name string, west double, south double, east double, north double, season_first string, season_last string, most_cloud double, buffer_m double"
    df = spark.createDataFrame(rows, schema)
    got = {r["city_id"]: r["faults"] for r in config.settings_faults(df).collect()}
    assert got == {r["city_id"]: config.faults(r) for r in raw}
    twice = df.unionByName(df.filter("city_id = 'c0'")).unionByName(spark.createDataFrame([(None,) * 10] * 2, schema))
    found = config.settings_faults(twice).collect()
    assert len(found) == 15 and [r["faults"] for r in found if r["city_id"] == "c0"] == [["city_id: repeated"]] * 2
    assert all(r["faults"] == ["city_id: lower-case letters, digits and underscores", "name: missing", "bbox: four numbers"] for r in found if r["city_id"] is None)
    out = spark.createDataFrame([("c0",), ("c0",), ("none",)], "city_id string")
    bad = sum(bool(config.faults(r)) for r in raw)
    assert config.registry_table(df, out).first().asDict() == {"cities": 12, "valid": 12 - bad, "faulty": bad, "published": 1}
    assert config.registry_table(df.limit(0), out).first().asDict() == {"cities": 0, "valid": 0, "faulty": 0, "published": 0}


def test_csv_resources_agree_with_those_of_one_package(spark):
    packages = [
        {"success": True, "result": {"resources": [{"format": "PDF", "url": "x"}, {"format": " csv", "url": "y"}, {"format": "CSV", "url": "z"}]}},
        {"success": True, "result": {"resources": [{"format": "CSV", "url": ""}, {"format": None, "url": "y"}]}}, {"success": True, "result": {}}, {"success": False}, {},
    ]

    def one(p):
        try:
            return config.csv_resource(p), None
        except ValueError as e:
            return None, str(e)

    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(packages)] + [(8, "{"), (9, None)], "i int, p string")
    got = {r["i"]: (r["url"], r["fault"]) for r in config.csv_resources(df, "p").collect()}
    none = (None, "the package description is no success")
    assert got == {i: one(p) for i, p in enumerate(packages)} | {8: none, 9: none}
