"""Stored models: PMML by id, one small file each, on any file system that Spark reads."""

from __future__ import annotations

import base64
import json
import re
import uuid

from pyspark.sql import SparkSession

from textlab.plans.pmml import Pmml, parse, write


class ModelStore:
    """Models below a folder (local, HDFS or an object store)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._jvm = jvm
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, id_: str):  # noqa: ANN202
        if not re.fullmatch(r"[\w.=-]+", id_) or id_.startswith("."):
            raise ValueError(f"not a valid model id [{id_}]")
        return self._new(f"{self.path}/{id_}.pmml")

    def put(self, model: str | Pmml, id_: str | None = None) -> dict:
        """Store a model (PMML, JSON ``{"model": PMML}`` or a parsed one); replaces one of the same id."""
        if isinstance(model, str) and model.lstrip().startswith("{"):
            body = json.loads(model)
            if "model" not in body:
                raise ValueError("the model is missing")
            model = body["model"]
        xml = write(model) if isinstance(model, Pmml) else model
        parse(xml)
        id_ = id_ or base64.urlsafe_b64encode(uuid.uuid4().bytes).decode().rstrip("=").replace("-", "_")
        out = self._fs.create(self._file(id_), True)
        try:
            out.write(bytearray(xml.encode()))
        finally:
            out.close()
        return {"acknowledged": True, "id": id_}

    def get(self, id_: str) -> Pmml:
        return parse(self.xml(id_))

    def xml(self, id_: str) -> str:
        file = self._file(id_)
        if not self._fs.exists(file):
            raise KeyError(f"no model [{id_}]")
        stream = self._fs.open(file)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def ids(self) -> list[str]:
        root = self._new(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(s.getPath().getName().removesuffix(".pmml") for s in self._fs.listStatus(root) if s.getPath().getName().endswith(".pmml"))
