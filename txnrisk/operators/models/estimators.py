"""The detectors as ``pyspark.ml`` estimators and models, so that ``Pipeline``
and ``CrossValidator`` take them and their own writers save them."""

from __future__ import annotations

import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasSeed
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession

from txnrisk.operators.models import persist
from txnrisk.operators.models.iforest import IsolationForest
from txnrisk.operators.models.recon import ReconstructionDetector


class _Detector(HasInputCols, HasLabelCol, HasSeed):
    """``inputCols``: features; outputs are ``<prefix>_score`` or ``_error``, ``_pred`` and ``_proba``."""
    idCol = Param(Params._dummy(), "idCol", "row id that sampling hashes", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "prefix of the output columns", TypeConverters.toString)

    def getIdCol(self) -> str:
        return self.getOrDefault(self.idCol)

    def getPrefix(self) -> str:
        return self.getOrDefault(self.prefix)


class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        self.instance._save(spark, self.instance.fitted, os.path.join(path, "fitted"))


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(self.cls._load(spark, os.path.join(path, "fitted")))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _DetectorModel(Model, _Detector, MLWritable, MLReadable):
    """``fitted``: the plain fitted object that scores."""

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getPrefix())

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class IsolationForestModelStage(_DetectorModel):
    _save, _load = staticmethod(persist.save_iforest), staticmethod(persist.load_iforest)


class ReconstructionModelStage(_DetectorModel):
    _save, _load = staticmethod(persist.save_recon), staticmethod(persist.load_recon)


class IsolationForestEstimator(Estimator, _Detector, DefaultParamsReadable, DefaultParamsWritable):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows of a tree", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of training rows taken as anomalies", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, idCol="transaction_id", prefix="if", numTrees=200, maxSamples=256, contamination=0.03, seed=42):
        super().__init__()
        self._setDefault(idCol="transaction_id", prefix="if", numTrees=200, maxSamples=256, contamination=0.03, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> IsolationForestModelStage:
        plain = IsolationForest(self.getOrDefault(self.numTrees), self.getOrDefault(self.maxSamples), self.getOrDefault(self.contamination),
                                self.getSeed())
        return self._copyValues(IsolationForestModelStage(plain.fit(dataset, self.getInputCols(), self.getIdCol())))


class ReconstructionEstimator(Estimator, _Detector, DefaultParamsReadable, DefaultParamsWritable):
    """PCA reconstruction; rows whose ``labelCol`` is 0 are learned from, where there are any."""
    k = Param(Params._dummy(), "k", "dimensions kept", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol="label", prefix="ae", k=16):
        super().__init__()
        self._setDefault(idCol="transaction_id", labelCol="label", prefix="ae", k=16, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ReconstructionModelStage:
        plain = ReconstructionDetector(self.getOrDefault(self.k))
        return self._copyValues(ReconstructionModelStage(plain.fit(dataset, self.getInputCols(), self.getLabelCol())))
