"""Views of cluster objects: which claims and pods use the filesystem's driver, and how they are.

Objects are rows ``kind`` (class, volume, claim, pod) and ``body`` (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(path: str, body: str = "body") -> Column:
    return F.get_json_object(body, path)


def _marked(marker: str) -> Column:
    app = _at("$.metadata.labels['app.kubernetes.io/name']") == marker
    named = _at(f"$.metadata.labels['{marker}.io/filesystem']").isNotNull() | _at(f"$.metadata.annotations['{marker}.io/filesystem']").isNotNull()
    return F.coalesce(app, F.lit(False)) | named


def classes(objects: DataFrame, driver: str, marker: str) -> DataFrame:
    return objects.where((F.col("kind") == "class") & (F.coalesce(_at("$.provisioner") == driver, F.lit(False)) | _marked(marker))).select(_at("$.metadata.name").alias("name"))


def volumes(objects: DataFrame, driver: str, marker: str) -> DataFrame:
    """Volumes of the driver, by its name or annotation, a matching class, or a marker."""
    rows = objects.where("kind = 'volume'").select(
        _at("$.metadata.name").alias("name"), _at("$.spec.storageClassName").alias("class"),
        (F.coalesce(_at("$.spec.csi.driver") == driver, F.lit(False)) | F.coalesce(_at(f"$.metadata.annotations['csi.{marker}.io/driver']") == driver, F.lit(False)) | _marked(marker)).alias("own"),
    )
    known = classes(objects, driver, marker).distinct()
    by_class = rows.where("not own").join(known.select(F.col("name").alias("class")), "class", "left_semi")
    return rows.where("own").select("name").unionByName(by_class.select("name"))


def claims(objects: DataFrame, driver: str, marker: str, namespace: str | None = None) -> DataFrame:
    """``namespace`` and ``name`` of claims with a matching class, a matching volume or a marker."""
    rows = objects.where("kind = 'claim'").select(
        _at("$.metadata.namespace").alias("namespace"), _at("$.metadata.name").alias("name"), _at("$.spec.storageClassName").alias("class"), _at("$.spec.volumeName").alias("volume"), _marked(marker).alias("own")
    )
    rows = rows if namespace is None else rows.where(F.col("namespace") == namespace)
    c = classes(objects, driver, marker).distinct().select(F.col("name").alias("class"), F.lit(True).alias("by_class"))
    v = volumes(objects, driver, marker).distinct().select(F.col("name").alias("volume"), F.lit(True).alias("by_volume"))
    return rows.join(c, "class", "left").join(v, "volume", "left").where("own or by_class or by_volume").select("namespace", "name")


def ready(phase: Column, condition: Column) -> Column:
    """Running, and either without a Ready condition or with it true."""
    return F.coalesce((phase == "Running") & (condition.isNull() | (condition == "True")), F.lit(False))


_POD = "struct<metadata:struct<namespace:string,name:string>,spec:struct<volumes:array<struct<name:string,csi:struct<driver:string>,persistentVolumeClaim:struct<claimName:string>>>>,status:struct<phase:string,conditions:array<struct<type:string,status:string>>>>"


def pods(objects: DataFrame, driver: str, marker: str) -> DataFrame:
    """``namespace``, ``name`` and ``ready`` of pods with an inline volume of the driver or a matching claim in their namespace."""
    parsed = objects.where("kind = 'pod'").select(F.from_json("body", _POD).alias("p"), F.monotonically_increasing_id().alias("row"))
    named = F.get(F.transform(F.filter("p.status.conditions", lambda c: c["type"] == "Ready"), lambda c: c["status"]), F.lit(0))
    rows = parsed.select("row", F.col("p.metadata.namespace").alias("namespace"), F.col("p.metadata.name").alias("name"), ready(F.col("p.status.phase"), named).alias("ready"), F.explode("p.spec.volumes").alias("v"))
    known = claims(objects, driver, marker).distinct().select(F.col("namespace").alias("ns"), F.col("name").alias("claim"), F.lit(True).alias("claimed"))
    used = rows.join(known, F.col("namespace").eqNullSafe(F.col("ns")) & (F.col("v.persistentVolumeClaim.claimName") == F.col("claim")), "left")
    return used.where((F.coalesce(F.col("v.csi.driver"), F.lit("")) == driver) | F.col("claimed")).groupBy("row", "namespace", "name", "ready").count().select("namespace", "name", "ready")


def summary(objects: DataFrame, driver: str, marker: str) -> DataFrame:
    """One row of five counts."""
    c, v, m, p = classes(objects, driver, marker), volumes(objects, driver, marker), claims(objects, driver, marker), pods(objects, driver, marker)
    rows = c.select(F.lit("class").alias("k")).unionAll(v.select(F.lit("volume"))).unionAll(m.select(F.lit("claim"))).unionAll(p.select(F.when(F.col("ready"), "pod").otherwise("bad")))
    n = lambda *k: F.count_if(F.col("k").isin(*k))
    return rows.agg(n("class").alias("classes"), n("volume").alias("volumes"), n("claim").alias("claims"), n("pod", "bad").alias("pods"), n("bad").alias("unhealthy"))
