"""Registries as tables: models with refusals, an example library, datasets and their manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.operators.matching import overlaps
from evidentia.operators.records import newest

CARD = "name string, version int, kind string, profile string, classes array<string>, sha256 string, metrics map<string,double>, retired boolean"


def refusal(profile: str, kind: str, sha256: Column) -> Column:
    """Why a model may not be used for a profile and kind with weights of this hash; null if it may."""
    return F.when(F.col("retired"), "retired").when(
        F.col("profile") != profile, F.concat(F.lit("made for "), "profile")
    ).when(F.col("kind") != kind, F.concat(F.lit("is a "), "kind")).when(F.col("sha256") != sha256, "weights differ from the card")


def usable(cards: DataFrame, profile: str, kind: str) -> DataFrame:
    """The newest version of each model that may be used."""
    return newest(cards, ["name"], ["version"]).filter((F.col("profile") == profile) & (F.col("kind") == kind) & ~F.col("retired"))


def verdict(kind: str) -> Column:
    """A plain sentence from a card's metrics, as ``metrics`` has them."""
    m = lambda k: F.col("metrics")[k]
    if kind == "finder":
        return F.when(m("recall").isNull(), "not tested").when(
            m("false_rate") > 0.01, "too many false alarms"
        ).when(m("recall") < 0.8, "misses too much").otherwise("good")
    return F.when(
        m("real_accuracy").isNull(), "tested on made-up signals only"
    ).when(m("real_accuracy") >= 0.9, "good").when(m("real_accuracy") >= 0.7, "usable").otherwise("not usable")


def overlapping_examples(examples: DataFrame, width: int) -> DataFrame:
    """Pairs of live originals of one recording whose spans overlap: the library refuses them. examples: id, recording, start, stop, kind, removed."""
    own = examples.filter("kind = 'original' AND NOT removed").select(
        "id", "recording", F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop")
    )
    return overlaps(own, own, "start", "stop", float(width), ["recording"]).filter("id < id_b").select("recording", "id", "id_b")


def set_role(examples: DataFrame, recording: str, role: str) -> DataFrame:
    """Roles belong to recordings, so all its examples change."""
    return examples.withColumn("role", F.when(F.col("recording") == recording, role).otherwise(F.col("role")))


def remove(examples: DataFrame, ids: DataFrame, back: bool = False) -> DataFrame:
    """Mark examples as removed, or take them back; nothing is deleted."""
    marked = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return examples.join(marked, "id", "left").withColumn("removed", F.when(F.col("_hit"), F.lit(not back)).otherwise(F.col("removed"))).drop("_hit")


def share_of(column: str, seed: int) -> Column:
    """A number in [0, 1) from the hash of a seed and a value; the same on any machine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def example_sets(examples: DataFrame, cap: int, test: float = 0.2, seed: int = 0) -> DataFrame:
    """examples (id, cls, recording, original) of a training set, with ``split``: train or test.

    A recording is on one side only, by its hash. In training, originals of a class stay, all of them, and its copies fill it up to
    ``cap``, those of the least hashes; copies are no tests. The rank stops at ``cap``, so a task hands on that many
    rows of a class at most and a class with a third of all rows is no burden. Removed examples must be left out before.
    """
    side = F.when(share_of("recording", seed) < test, "test").otherwise("train")
    rows = examples.withColumn("split", side)
    tests, originals = rows.filter("split = 'test' AND original"), rows.filter("split = 'train' AND original")
    ranked = Window.partitionBy("cls").orderBy("_share", "id")
    copies = rows.filter("split = 'train' AND NOT original").withColumn("_share", share_of("id", seed)).withColumn("_r", F.row_number().over(ranked))
    copies = copies.filter(F.col("_r") <= cap)
    held = originals.groupBy("cls").agg(F.count(F.lit(1)).alias("_n"))
    held = F.broadcast(held)  # one row a class
    fill = copies.join(held, "cls", "left").filter(F.col("_r") <= F.greatest(cap - F.coalesce("_n", F.lit(0)), F.lit(0)))
    return tests.unionByName(originals).unionByName(fill.select(*rows.columns))


def spread_windows(cuts: DataFrame, samples: str, length: int, most: int) -> DataFrame:
    """cuts with ``start`` of each of their windows and whether it is ``padded``: spread from end to end, ``most`` at most, half to even.

    A cut of less than a window has one, padded; one without samples has none.
    """
    n = F.col(samples)
    count = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n / length)))
    steps = F.sequence(F.lit(0), (count - 1).cast("int"))
    start = F.transform(steps, lambda i: F.when(count == 1, F.lit(0)).otherwise(F.bround((n - length) * i / (count - 1), 0)).cast("long"))
    return cuts.filter(n > 0).withColumn("start", F.explode(start)).withColumn("padded", n < length)


def build(spark: SparkSession, kernel, n: int, path: str, schema: str, seed: int = 0) -> None:
    """A dataset of n made rows: ``kernel(seed, id)`` makes one, splits follow the id's hash, files are partitioned by split."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [kernel(seed, int(i)) for i in b["id"]]
            yield pd.DataFrame(rows).assign(id=b["id"].to_numpy())

    made = spark.range(n).mapInPandas(run, f"{schema}, id long")
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10))
    made.withColumn("split", F.when(part == 0, "test").when(part == 1, "val").otherwise("train")).write.partitionBy("split").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file under a folder; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def recipe(steps: list[dict]) -> tuple[str, str]:
    """A recipe of augmentations as canonical JSON, and its hash."""
    import hashlib

    text = json.dumps(steps, sort_keys=True, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest()


def shards(files: DataFrame) -> DataFrame:
    """file, array, shape, of NumPy archives read as ``binaryFile``; only headers are parsed."""
    import io
    import zipfile

    import numpy as np
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            version = np.lib.format.read_magic(f)
                            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                            out.append((path, name.removesuffix(".npy"), list(shape), str(kind)))
            yield pd.DataFrame(out, columns=["path", "name", "shape", "kind"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, shape array<long>, kind string")


def report(facts: Column) -> Column:
    """Facts (a map) as markdown lines, in order of their names."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(facts)),
            lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), F.coalesce(e["value"].cast("string"), F.lit("not known")))
        ),
        "\n"
    )
