"""A feature table with its views: all phonemes and features, a subset of them, and the subset's phonemes with all features."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonora.functions import text
from phonora.operators import inventory, nearest, vocabulary


@dataclass
class Indexer:
    """``table`` has one row or more per phoneme (column ``phoneme``), features from ``features`` on; the first row counts."""

    table: DataFrame
    features: Sequence[str]
    attributes: Sequence[str] | None = None
    phonemes: Sequence[str] | None = None
    allophones: dict = field(default_factory=dict)

    def _first(self) -> DataFrame:
        return inventory.first_rows(inventory.with_row_id(self.table), "phoneme")

    def _phones(self, features: Sequence[str], phonemes: Sequence[str] | None) -> DataFrame:
        rows = self._first()
        vector = F.array(*[text.first_of_contour(F.col(f)) for f in features])
        if phonemes is None:
            ids = vocabulary.dense_ids(rows, "phoneme").withColumnRenamed("phoneme", "_p")
            rows = rows.join(nearest.small(ids), F.col("phoneme") == F.col("_p"))
            return rows.select(F.col("id").alias("pos"), F.col("id").alias("idx"), "phoneme", vector.alias("features"))
        wanted = self.table.sparkSession.createDataFrame(list(enumerate(phonemes)), "pos int, phoneme string")
        return nearest.subset(rows.select("phoneme", vector.alias("features")), wanted).select("pos", F.col("idx").cast("int").alias("idx"), "phoneme", "features")

    def full(self) -> DataFrame:
        """All phonemes with all features."""
        return self._phones(self.features, None)

    def subset(self) -> DataFrame:
        """The chosen phonemes with the chosen attributes."""
        return self._phones(self.attributes or self.features, self.phonemes)

    def full_of_subset(self) -> DataFrame:
        """The chosen phonemes with all features."""
        return self._phones(self.features, self.phonemes)

    def long(self) -> DataFrame:
        return vocabulary.unpivoted(self._first(), ["phoneme"], self.attributes or self.features)

    def categories(self) -> DataFrame:
        """Vocabularies of the attributes, over all phonemes."""
        return vocabulary.categories(self.long())

    def category_ids(self) -> DataFrame:
        """(phoneme, feature, cats) of the attributes."""
        return vocabulary.binarised(self.long(), ["phoneme"], self.categories())

    def composition(self, phonemes: Sequence[str], segments: list[str] | None = None) -> DataFrame:
        """Feature vectors of any inventory, in its order; unknown phones may take their first segment's."""
        wanted = self.table.sparkSession.createDataFrame(list(enumerate(phonemes)), "pos int, phoneme string")
        return nearest.subset(self.full(), wanted, segments)

    def map_to_subset(self, phones: DataFrame) -> DataFrame:
        """Each of (phoneme, features) to itself or the nearest phone of the subset."""
        return nearest.nearest_or_same(phones, self.full_of_subset())

    def state(self) -> str:
        """Everything needed to make the indexer again; an inventory is small, so its table goes along as CSV."""
        rows = self._first().drop("row_id").toPandas()
        return json.dumps({"phoneme_inventory": self.phonemes, "attributes": self.attributes, "features": list(self.features), "language_allophones": self.allophones, "table_file": rows.to_csv(index=False)}, ensure_ascii=False)

    @classmethod
    def from_state(cls, spark: SparkSession, state: str) -> Indexer:
        from phonora import sources

        s = json.loads(state)
        return cls(sources.feature_table_from_text(spark, s["table_file"]), s["features"], s["attributes"], s["phoneme_inventory"], s["language_allophones"])
