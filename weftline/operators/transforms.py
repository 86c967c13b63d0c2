"""Fitted transforms of sparse matrices (row_id, col_id, value) and of categories.

Each is a Spark ML estimator whose model keeps what it has learned as a table of one row a column or category. Models are saved
with that table, loaded on another day, and applied to any matrix of the same columns: a corpus, a batch or one row. They can
be stages of a ``Pipeline``. What each does with columns that it has not seen is in its docstring. An empty training table
gives a model that has seen no column.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from weftline.operators import coo, dictionary
from weftline.sources.scratch import saved


class _Writer(MLWriter):
    def __init__(self, model: Fitted):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.state.write.parquet(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, kind: type[Fitted]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Fitted:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.sparkSession.read.parquet(f"{path}/state"))
        model._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(model, known)
        return model


class Fitted(Model, MLReadable, MLWritable):
    """A model whose ``state`` is a table."""

    def __init__(self, state: DataFrame | None = None):
        super().__init__()
        self.state = state

    def copy(self, extra: dict | None = None) -> Fitted:
        that = super().copy(extra)
        that.state = self.state
        return that

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Fitting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fitting writes the state once, so that every use of the model reads it and none computes it again."""

    model: type[Fitted]

    def learned(self, m: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, m: DataFrame) -> Fitted:
        return self._copyValues(self.model(saved(self.learned(m), "state")))


class _Norm(Params):
    p = Param(Params._dummy(), "p", "which norm", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "smaller norms do not divide", TypeConverters.toFloat)


class ColumnNormModel(Fitted, _Norm):
    """Entries divided by the norm of their column in training; columns without one stay as they are."""

    def _transform(self, m: DataFrame) -> DataFrame:
        return coo.divided(m, self.state, "col_id", self.getOrDefault("least"), how="left")


class ColumnNorm(_Fitting, _Norm):
    model = ColumnNormModel

    @keyword_only
    def __init__(self, *, p: float = 2.0, least: float = 1e-10):
        super().__init__()
        self._setDefault(p=2.0, least=1e-10)
        self._set(**self._input_kwargs)

    def learned(self, m: DataFrame) -> DataFrame:
        return coo.norms(m, "col_id", self.getOrDefault("p"))


class RowNorm(Transformer, _Norm, DefaultParamsReadable, DefaultParamsWritable):
    """Entries divided by the norm of their own row: nothing to learn, so that training and inference are one."""

    @keyword_only
    def __init__(self, *, p: float = 2.0, least: float = 1e-5):
        super().__init__()
        self._setDefault(p=2.0, least=1e-5)
        self._set(**self._input_kwargs)

    def _transform(self, m: DataFrame) -> DataFrame:
        return coo.normalize(m, "row_id", self.getOrDefault("p"), self.getOrDefault("least"))


class _Cutoff(Params):
    cutoff = Param(Params._dummy(), "cutoff", "entries a column must exceed, or the largest z-score", TypeConverters.toFloat)


class ColumnSelectorModel(Fitted, _Cutoff):
    """The columns with more than cutoff entries in training under their new numbers; all others, seen or not, go."""

    def _transform(self, m: DataFrame) -> DataFrame:
        return coo.renumbered(m, self.state)

    def names(self, columns: DataFrame) -> DataFrame:
        """(col_id, name) of the new columns from those of the old ones."""
        return columns.join(self.state, "col_id").select(self.state["idx"].alias("col_id"), "name")


class ColumnSelector(_Fitting, _Cutoff):
    model = ColumnSelectorModel

    @keyword_only
    def __init__(self, *, cutoff: float = 0.0):
        super().__init__()
        self._setDefault(cutoff=0.0)
        self._set(**self._input_kwargs)

    def learned(self, m: DataFrame) -> DataFrame:
        return coo.frequent_columns(m, self.getOrDefault("cutoff"))


class StandardizerModel(Fitted, _Cutoff):
    """z-scores by the means and deviations of training, clipped at cutoff; entries within 1e-5 of the mean, and of columns without one, go."""

    def _transform(self, m: DataFrame) -> DataFrame:
        return coo.standardized(m, self.state, self.getOrDefault("cutoff"))


class Standardizer(_Fitting, _Cutoff):
    model = StandardizerModel

    @keyword_only
    def __init__(self, *, cutoff: float = 5.0):
        super().__init__()
        self._setDefault(cutoff=5.0)
        self._set(**self._input_kwargs)

    def learned(self, m: DataFrame) -> DataFrame:
        return coo.column_stats(m)


class _Named(Params):
    row = Param(Params._dummy(), "row", "column of row ids", TypeConverters.toString)
    category = Param(Params._dummy(), "category", "column of categories", TypeConverters.toString)
    order = Param(Params._dummy(), "order", "columns that order first appearances; none: by the category", TypeConverters.toListString)


class CategoriesModel(Fitted, _Named):
    """How often each row has each category of the frozen dictionary; null and unknown categories go."""

    def _transform(self, df: DataFrame) -> DataFrame:
        row, category = self.getOrDefault("row"), self.getOrDefault("category")
        return dictionary.bag_feature(df.select(row, category), row, category, self.state.withColumnRenamed("category", category))


class Categories(_Fitting, _Named):
    """A dictionary by first appearance."""

    model = CategoriesModel

    @keyword_only
    def __init__(self, *, row: str = "row_id", category: str = "category", order: list[str] | None = None):
        super().__init__()
        self._setDefault(row="row_id", category="category", order=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def learned(self, df: DataFrame) -> DataFrame:
        category = self.getOrDefault("category")
        return dictionary.first_seen(df.drop("idx"), category, *(self.getOrDefault("order") or [category])).withColumnRenamed(category, "category")
