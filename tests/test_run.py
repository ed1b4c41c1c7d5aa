"""The run entry, acquisition lists and stored products."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import ml
from rasterlake.run import Products, Settings, run
from rasterlake.sources import acquire, files


def write_inputs(spark, folder, height=24, width=30):
    rng = np.random.default_rng(1)
    cells = [(r, c) for r in range(height) for c in range(width)]
    z = {(r, c): 1000 + 3 * r + 20 * np.sin(c / 4) + rng.uniform(0, 5) for r, c in cells}
    spark.createDataFrame([(r, c, float(z[r, c])) for r, c in cells], "row int, col int, elev double").write.parquet(f"{folder}/dem")
    dates = ["2023-01-10", "2023-02-10", "2023-07-10", "2023-08-10"]
    s1 = [(r, c, d, float(-10 - k - 2 * np.cos(r / 5) + rng.normal()), float(-17 + rng.normal())) for k, d in enumerate(dates) for r, c in cells]
    spark.createDataFrame(s1, "row int, col int, acq_date string, vv double, vh double").withColumn("acq_date", F.to_date("acq_date")).write.parquet(f"{folder}/s1")
    spark.createDataFrame([(r, c, float(z[r, c] * 0.1)) for r, c in cells if (r + c) % 2], "row int, col int, clay double").write.parquet(f"{folder}/labels")


def test_stages_make_skip_and_wait(spark, tmp_path):
    folder = f"{tmp_path}/p"
    write_inputs(spark, folder)
    config = tmp_path / "run.json"
    config.write_text(json.dumps({"folder": folder, "trees": 5, "folds": 2, "block": 8, "sensor": "s1"}))
    settings = Settings.load(str(config))
    assert settings.options == {"sensor": "s1"} and settings.trees == 5
    assert run(spark, settings, ["hydrology"]) == {"hydrology": "missing terrain"}
    done = run(spark, settings)
    assert done["flood"] == "missing chips" and {v for k, v in done.items() if k != "flood"} == {"made"}
    p = Products(spark, folder)
    assert p.read("prediction").count() > 300 and p.read("risk").where("risk < 0 OR risk > 1.1").count() == 0
    assert p.read("metrics").first()["r2_mean"] is not None and p.read("importances").count() == 3
    assert {r["name"] for r in p.read("classes").select("name").distinct().collect()} == set(files.CLASS_NAMES)
    names = {r["name"] for r in p.read("catalog").collect()}
    assert {"terrain", "wetness", "classes", "prediction"} <= names and "flood_metrics" not in names
    again = run(spark, settings, ["terrain", "train", "catalog"])
    assert again == {"terrain": "exists", "train": "exists", "catalog": "made"}
    with pytest.raises(ValueError):
        run(spark, settings, ["nothing"])


def test_flood_stage(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = []
    for chip in range(10):
        for i in range(60):
            wet = rng.random() < 0.4
            rows.append((f"c{chip}", i // 8, i % 8, float(-20 + rng.normal() if wet else -9 + rng.normal()), float(-25 if wet else -15), None if i % 11 == 0 else int(wet)))
    spark.createDataFrame(rows, "chip string, row int, col int, vv double, vh double, target int").write.parquet(f"{tmp_path}/chips")
    assert run(spark, Settings(str(tmp_path), rounds=3), ["flood"]) == {"flood": "made"}
    p = Products(spark, str(tmp_path))
    assert p.read("flood_metrics").first()["miou"] > 0.8
    assert p.read("flood_examples").select("chip").distinct().count() == 2  # a tenth of ten chips and what is left: two in the test part


def test_acquisition(spark, tmp_path, monkeypatch):
    rain = acquire.monthly_rain(spark, 2000, 2001, str(tmp_path)).collect()
    assert len(rain) == 24 and rain[0]["name"] == "chirps-v2.0.2000.01.tif.gz"
    (tmp_path / "chirps-v2.0.2000.03.tif.gz").write_bytes(b"x")
    left = acquire.pending(spark, acquire.monthly_rain(spark, 2000, 2001, str(tmp_path)), str(tmp_path))
    assert left.count() == 23 and left.where("name like '%2000.03%'").count() == 0
    box = {"west": 32.0, "south": 37.0, "east": 32.5, "north": 37.5}
    soil = acquire.soil_layers(spark, box, "out")
    assert [r["name"] for r in soil.collect()] == ["sg_clay_0_5cm_mean.tif", "sg_sand_0_5cm_mean.tif", "sg_soc_0_5cm_mean.tif"]

    def fetch(url):
        if "sand" in url:
            raise OSError("no route")
        return b"<xml/>" if "soc" in url else b"II*\0rest"

    got = {r["name"].split("_")[1]: (r["content"], r["error"]) for r in acquire.fetched(soil, fetch).collect()}
    assert bytes(got["clay"][0]) == b"II*\0rest" and got["sand"][1].startswith("OSError") and "no TIFF" in got["soc"][1]
    assert acquire.monthly_climate_request(box, ["t2m"], 2000, 2002)["area"] == [37.5, 32.0, 37.0, 32.5]
    for name in ("SH_CLIENT_ID", "SH_CLIENT_SECRET"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(ValueError):
        acquire.ImageService.from_env("https://a", "https://b")
    monkeypatch.setenv("SH_CLIENT_ID", "i")
    monkeypatch.setenv("SH_CLIENT_SECRET", "s")
    options = acquire.ImageService.from_env("https://a", "https://b").options("s1", box, "2023-01-01", "2023-02-01", 10)
    assert options["bbox"] == "32.0,37.0,32.5,37.5" and "s" not in options.values()


def test_cubes_scalers_and_models(spark, tmp_path):
    df = spark.createDataFrame([(r, c, float(r), float(c)) for r in range(20) for c in range(20)], "row int, col int, b double, a double")
    files.write_cube(df, ["b", "a"], f"{tmp_path}/cube", block=8)
    cube, names = files.read_cube(spark, f"{tmp_path}/cube")
    assert names == ["b", "a"] and cube.columns == ["row", "col", "b", "a"] and cube.count() == 400
    scaler = spark.createDataFrame([(0, 1.5, 2.0), (1, 0.25, 0.5)], "c int, mean double, std double")
    files.save_json(scaler, f"{tmp_path}/scaler")
    assert sorted(map(tuple, files.load_json(spark, f"{tmp_path}/scaler", "c int, mean double, std double").collect())) == [(0, 1.5, 2.0), (1, 0.25, 0.5)]
    model = ml.forest(3, 3).fit(ml.assemble(df.withColumn("label", F.col("a") * 2), ["b", "a"]))
    ml.save_model(model, f"{tmp_path}/model", ["b", "a"], spark)
    loaded, features = ml.load_model(f"{tmp_path}/model", spark)
    x = ml.assemble(df, features)
    assert features == ["b", "a"] and loaded.transform(x).select("prediction").collect() == model.transform(x).select("prediction").collect()
    with pytest.raises(KeyError):
        files.checked_schema(df, ["a", "gone"])
    assert files.checked_schema(df, ["a", "b"]).columns == ["a", "b"]
