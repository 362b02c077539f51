"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Cases: rows are judged one by one, by their texts: rows without a doc_id, rows that share one and rows
with other columns than usual are rows like all others. Null and empty texts pass or fail the classifiers
by the score of an empty text, are linked with nothing and hold no benchmark passage. Of a group of near
duplicates one row stays, the first by doc_id (null last) and, among rows of one id, by a hash of the whole row;
of rows equal in all columns one stays. Without labels the classifiers keep or drop all rows alike (see
their modules); an empty benchmark drops none; an empty table gives an empty result.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from tidemark.llm import decontaminate, near, packing, quality, toxicity
from tidemark.llm.common import fold, forget, saved, shared_dir, table


def quality_stage(spark, docs, sf_dir):
    """Drop what the quality classifier rejects. It learns from the labelled rows among its input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda c: fold(c, 5) != 0)
    return quality.kept_rows(docs, model)


def toxicity_stage(spark, docs, sf_dir):
    """Drop what the toxicity classifier rejects."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda c: fold(c, 4) != 2)
    return toxicity.kept_rows(docs, model)


def unhashable(kind) -> bool:
    """Whether a column of this type has to be hashed as JSON."""
    if isinstance(kind, ArrayType):
        return unhashable(kind.elementType)
    if isinstance(kind, StructType):
        return any(unhashable(f.dataType) for f in kind.fields)
    return isinstance(kind, (MapType, VariantType))


def row_key(docs, id_col="doc_id"):
    """A struct that orders rows by id, nulls last, and tells rows apart that differ in any column: a hash of
    128 bits, which marks nulls, as hashing passes over them."""
    values = [x for f in docs.schema.fields for c in [F.col(f"`{f.name}`")] for x in (c.isNull(), F.to_json(F.struct(c)) if unhashable(f.dataType) else c)]
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def near_duplicate_stage(spark, docs, sf_dir):
    """Of each group of linked documents keep one row, the first by ``row_key``.

    The keys that go grow with the input: they are a table, and a sort-merge join, the same at every size,
    takes them out, which shuffles each text once. Rows equal in all columns have one key; of these, one is
    kept by an aggregation over such rows alone.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, row_key(docs))
    found = saved(near.near_duplicates(keyed, id_col=key), "components")
    gone = saved(found.filter("doc_id <> component_id").select("doc_id.a", "doc_id.b").distinct(), "gone-rows", few=True)
    again = found.filter("doc_id = component_id").filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id.a", "doc_id.b")
    again = saved(again, "equal-rows", few=True)
    forget(found)
    by = lambda t: [F.col(key)["a"] == t["a"], F.col(key)["b"] == t["b"]]
    out = keyed.join(gone.hint("merge"), by(gone), "left_anti")
    if again.limit(1).count():
        copies = out.join(again, by(again), "left_semi").groupBy(F.col(key)["a"], F.col(key)["b"]).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
        return out.join(again, by(again), "left_anti").select(docs.columns).unionByName(copies)
    return out.select(docs.columns)


def decontamination_stage(spark, docs, sf_dir):
    """Drop documents that hold benchmark passages beyond the contract's share."""
    return decontaminate.kept_rows(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Trained models and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``. What a stage returns is a table in the shared folder, which goes when
    the next stage's is written; the last one's input stays, as its result is read later."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
