"""Runs named stages over a folder of products: python -m rasterlake.run CONFIG [--stages a,b].

A product is a Parquet table of the folder. A stage whose products are all there is skipped, one that lacks an input says
so and is skipped, too; so a run that was cut off is taken up again where it stopped.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import hydrology, ml, resample, stats, stencil, temporal, tiles
from .plans.tables import checkpointed
from .sources.acquire import exists
from .sources.files import catalog, load_config

log = logging.getLogger("rasterlake")


@dataclass
class Settings:
    """A run's configuration: where products are, cell size, and the parameters of its stages."""

    folder: str
    cell: float = 30.0
    wet: list[int] = field(default_factory=lambda: [1, 2, 3])
    dry: list[int] = field(default_factory=lambda: [7, 8, 9])
    classes: int = 5
    risk_weights: list[float] = field(default_factory=lambda: [0.5, 0.3, 0.2])
    target: str = "clay"
    features: list[str] = field(default_factory=lambda: ["nddi", "slope", "twi"])
    block: int = 50
    folds: int = 5
    trees: int = 200
    rounds: int = 200
    options: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> "Settings":
        """Of a YAML or JSON file; names that no stage knows are options."""
        given = load_config(path)
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "options"}
        return cls(**known, options={k: v for k, v in given.items() if k not in known})


class Products:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(name))


@dataclass(frozen=True)
class Stage:
    """make gives a table for each name in `makes` from those in `needs`."""

    name: str
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    make: Callable[[Products, Settings], dict[str, DataFrame]]


def _terrain(p: Products, s: Settings) -> dict[str, DataFrame]:
    dem = p.read("dem")
    return {"terrain": stencil.terrain(dem, s.cell), "curvature": stencil.curvature(dem, cell=s.cell)}


def _hydrology(p: Products, s: Settings) -> dict[str, DataFrame]:
    area = checkpointed(hydrology.accumulate_filled(p.read("dem"), checkpoint=checkpointed))
    return {"flow": area, "wetness": hydrology.wetness(area, p.read("terrain"), s.cell)}


def _indices(p: Products, s: Settings) -> dict[str, DataFrame]:
    s1 = p.read("s1")
    season = S.season("acq_date", s.wet, s.dry)
    power = s1.withColumns({"vv": S.db_to_linear("vv"), "vh": S.db_to_linear("vh")}).withColumn("season", season)
    wet, dry = (temporal.median_composite(power.where(F.col("season") == x), ["vv", "vh"]) for x in ("wet", "dry"))
    both = wet.select("row", "col", F.col("vv").alias("wet"), F.col("vh").alias("wet_vh")).join(dry.select("row", "col", F.col("vv").alias("dry"), F.col("vh").alias("dry_vh")), ["row", "col"])
    return {"seasons": both.withColumns({"nddi": S.nddi("wet", "dry"), "ratio_wet": S.ratio_db("wet", "wet_vh"), "ratio_dry": S.ratio_db("dry", "dry_vh")})}


def _stack(p: Products) -> DataFrame:
    """All pixel features on the terrain's grid."""
    x = p.read("terrain").select("row", "col", "slope").join(p.read("wetness"), ["row", "col"], "left")
    return x.join(p.read("seasons"), ["row", "col"], "left")


def _classify(p: Products, s: Settings) -> dict[str, DataFrame]:
    x = _stack(p).select("row", "col", F.col("nddi").alias("moisture"), "twi", "slope")
    score = F.col("moisture") + F.col("twi") * 0.05 - F.col("slope") * 0.01
    return {"classes": ml.surface_classes(x, score, ["moisture", "twi", "slope"], s.classes)}


def _stats(p: Products, s: Settings) -> dict[str, DataFrame]:
    x = _stack(p).na.drop("any", subset=["wet", "dry", "nddi", "twi", "slope"])
    return {"stats": stats.report(checkpointed(x.select("wet", "dry", "nddi", "twi", "slope")), "wet", "dry", "nddi", "twi", "slope", checkpointed)}


def _risk(p: Products, s: Settings) -> dict[str, DataFrame]:
    x = _stack(p).join(p.read("flow"), ["row", "col"], "left")
    return {"risk": hydrology.construction_risk(x.withColumn("cells", F.col("cells").cast("double")), "nddi", "cells", "slope", tuple(s.risk_weights))}


def _matrix(p: Products, s: Settings) -> dict[str, DataFrame]:
    width = p.read("dem").agg(F.max("col") + 1).first()[0]
    labels = p.read("labels").select("row", "col", F.col(s.target).cast("double").alias(s.target))
    return {"matrix": resample.training_matrix(_stack(p).select("row", "col", *s.features), labels, s.block, width)}


def _train(p: Products, s: Settings) -> dict[str, DataFrame]:
    x = p.read("matrix")
    folds = ml.cross_validate(tiles.group_kfold(x, "block_id", s.folds), s.features, s.target, ml.forest(s.trees))
    model = ml.forest(s.trees).fit(ml.assemble(x, s.features).withColumnRenamed(s.target, "label"))
    ml.save_model(model, p.path("model"), s.features, p.spark)
    return {"metrics": ml.summary(folds), "importances": ml.importances(model, s.features, p.spark)}


def _predict(p: Products, s: Settings) -> dict[str, DataFrame]:
    model, names = ml.load_model(p.path("model"), p.spark)
    return {"prediction": model.transform(ml.assemble(_stack(p), names)).select("row", "col", F.col("prediction").alias(s.target))}


def _flood(p: Products, s: Settings) -> dict[str, DataFrame]:
    chips = tiles.assign_split(p.read("chips").withColumn("ratio", S.ratio_db("vv", "vh")), "chip", rounded=False)
    out = ml.pixel_classifier(chips.where("split = 'train'"), chips.where("split = 'test'"), ["vv", "vh", "ratio"], "target", s.rounds)
    out = checkpointed(out.select("chip", "row", "col", "target", "pred"))
    scores = stats.per_class_scores(out, 2)
    some = tiles.first_k(out.select("chip").distinct(), "chip", 4)  # chips to look at
    return {"flood_metrics": scores.agg(F.avg("iou").alias("miou"), F.max(F.when(F.col("class") == 1, F.col("f1"))).alias("f1_water")), "flood_examples": out.join(F.broadcast(some), "chip")}


def _catalog(p: Products, s: Settings) -> dict[str, DataFrame]:
    made = [(m, stage.name) for stage in STAGES for m in stage.makes if stage.name != "catalog" and p.has(m)]
    return {"catalog": catalog(p.spark, [{"name": n, "path": p.path(n), "type": kind} for n, kind in made])}


STAGES = (
    Stage("terrain", ("dem",), ("terrain", "curvature"), _terrain),
    Stage("hydrology", ("dem", "terrain"), ("flow", "wetness"), _hydrology),
    Stage("indices", ("s1",), ("seasons",), _indices),
    Stage("classify", ("terrain", "wetness", "seasons"), ("classes",), _classify),
    Stage("stats", ("terrain", "wetness", "seasons"), ("stats",), _stats),
    Stage("risk", ("terrain", "wetness", "seasons", "flow"), ("risk",), _risk),
    Stage("matrix", ("dem", "terrain", "wetness", "seasons", "labels"), ("matrix",), _matrix),
    Stage("train", ("matrix",), ("metrics", "importances"), _train),
    Stage("predict", ("terrain", "wetness", "seasons", "metrics"), ("prediction",), _predict),
    Stage("flood", ("chips",), ("flood_metrics", "flood_examples"), _flood),
    Stage("catalog", (), ("catalog",), _catalog),
)


def run(spark: SparkSession, settings: Settings, stages: list[str] | None = None) -> dict[str, str]:
    """What became of each stage: made, exists, or missing and the inputs that are. Unknown stages are a ValueError. The
    catalog is made anew by each run."""
    known = [s.name for s in STAGES]
    unknown = set(stages or ()) - set(known)
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}; there are {known}")
    products, done = Products(spark, settings.folder), {}
    for stage in STAGES:
        if stages and stage.name not in stages:
            continue
        missing = [n for n in stage.needs if not products.has(n)]
        if stage.name != "catalog" and all(products.has(m) for m in stage.makes):
            done[stage.name] = "exists"
        elif missing:
            done[stage.name] = "missing " + ", ".join(missing)
        else:
            for name, df in stage.make(products, settings).items():
                products.write(df, name)
            done[stage.name] = "made"
        log.log(logging.WARNING if missing else logging.INFO, "%s: %s", stage.name, done[stage.name])
    return done


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="rasterlake.run", description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--stages", default="all", help="names with commas between them, or all")
    parser.add_argument("--log", help="a file that gets the log, too")
    args = parser.parse_args(argv)
    handlers = [logging.StreamHandler(), *([logging.FileHandler(args.log)] if args.log else [])]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers)
    run(SparkSession.builder.appName("rasterlake").getOrCreate(), Settings.load(args.config), None if args.stages == "all" else args.stages.split(","))


if __name__ == "__main__":
    main()
